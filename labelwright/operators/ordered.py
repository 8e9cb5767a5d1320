"""Running totals over an ordered key without a single-partition window.

Rows are first reduced to distinct keys, so a key held by a third of all rows is one row
like any other. Small results then take one window per group. Larger ones are range
partitioned into value ranges of bounded size and written down with the number of their
range; each range is summed on its own and receives the totals of the ranges before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_groups
from ..session import pin

#: Up to this many distinct (group, key) rows one window per group is used.
SMALL_CELLS = 200_000
#: Target number of distinct keys per value range.
RANGE_CELLS = 100_000


@dataclass(frozen=True)
class RangedCells:
    """Distinct (by, key) rows with a ``_range`` column that ascends in (by, key)."""

    table: DataFrame
    by: tuple[str, ...]
    key: str
    single: bool


def reduce_cells(df: DataFrame, by: Sequence[str], key: str, sums: dict[str, Column]) -> DataFrame:
    """Distinct (by, key) rows with summed measures, computed once and written down.

    Null keys have no place in the order and are left out.
    """
    kept = df.filter(F.col(key).isNotNull())
    return pin(kept.groupBy(*by, key).agg(*[F.sum(v).alias(n) for n, v in sums.items()]))


def cut_ranges(cells: DataFrame, by: Sequence[str], key: str, *, small: int | None = None,
               range_cells: int | None = None) -> RangedCells:
    """Assign every cell a value range of bounded size.

    The ranges of Spark's range partitioning depend on a sample, so the table is written down
    together with them: every later step, and every retried task, sees the same ranges.
    """
    small, range_cells = small or SMALL_CELLS, range_cells or RANGE_CELLS
    total = cells.count()
    if total <= small:
        return RangedCells(cells.withColumn("_range", F.lit(0)), tuple(by), key, True)
    n_ranges = math.ceil(total / range_cells)
    spread = cells.repartitionByRange(n_ranges, *by, key).withColumn("_range", F.spark_partition_id())
    return RangedCells(pin(spread), tuple(by), key, False)


def range_offsets(ranged: RangedCells, measures: Sequence[str], *, descending: bool = False) -> DataFrame:
    """Per (by, range): ``_before_<measure>``, the totals of all ranges before it, and
    ``_all_<measure>``, the total of the group."""
    by = ranged.by
    totals = ranged.table.groupBy(*by, "_range").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    order = F.col("_range").desc() if descending else F.col("_range").asc()
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_range", *[
        F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_before_{m}") for m in measures
    ], *[F.sum(f"_{m}").over(Window.partitionBy(*by)).alias(f"_all_{m}") for m in measures])


def running_totals(cells: DataFrame, by: Sequence[str], key: str, measures: Sequence[str], *,
                   descending: bool = False, small: int | None = None, range_cells: int | None = None) -> DataFrame:
    """``cells`` plus, per group, ``cum_<measure>`` (totals up to and including each key)
    and ``all_<measure>`` (the group's total)."""
    ranged = cut_ranges(cells, by, key, small=small, range_cells=range_cells)
    direction = F.col(key).desc() if descending else F.col(key).asc()
    group = Window.partitionBy(*by, "_range")
    inside = group.orderBy(direction).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.table.withColumns({f"cum_{m}": F.sum(m).over(inside) for m in measures})
    if ranged.single:
        return local.withColumns({f"all_{m}": F.sum(m).over(group) for m in measures}).drop("_range")
    joined = join_groups(local, range_offsets(ranged, measures, descending=descending), [*by, "_range"])
    return joined.select(
        *cells.columns,
        *[(F.col(f"cum_{m}") + F.col(f"_before_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.col(f"_all_{m}").alias(f"all_{m}") for m in measures])


def grouped_median(df: DataFrame, by: Sequence[str], values: Sequence[str], *, weight: str | None = None, **limits: int) -> DataFrame:
    """Exact median of several columns per group (mean of the two middle values when even); a row counts ``weight`` times.

    Nulls and NaN are left out. Unlike the built-in, no group's values are ever held together: the columns are unpivoted,
    reduced to distinct values, and the middle positions are read off running counts.
    """
    kept = [*by, *([weight] if weight else [])]
    long = df.select(*kept, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        kept, list(values), "_column", "_value").filter(~F.isnan("_value"))
    cells = reduce_cells(long, [*by, "_column"], "_value", {"_n": F.col(weight) if weight else F.lit(1).cast("bigint")})
    placed = running_totals(cells, [*by, "_column"], "_value", ["_n"], **limits)
    lower, upper = F.expr("(all__n + 1) div 2"), F.expr("all__n div 2 + 1")
    last, before = F.col("cum__n"), F.col("cum__n") - F.col("_n")
    middle = placed.filter(((before < lower) & (last >= lower)) | ((before < upper) & (last >= upper)))
    found = middle.groupBy(*by, "_column").agg(((F.min("_value") + F.max("_value")) / 2).alias("_median"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_column") == v, F.col("_median"))).alias(v) for v in values])
