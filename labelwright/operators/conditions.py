"""Single conditions that separate a label, and the greedy OR-rule built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.intervals import ratio
from ..session import pin
from .ordered import running_totals

MIN_SUPPORT = 20
#: Numeric columns with at most this many distinct values are read as categories.
MAX_NUMERIC_CATEGORIES = 12
#: Rounds of the greedy search after which what is left is written down, to keep plans short.
ROUNDS_PER_PIN = 16


def column_roles(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """(text-like, numeric) input columns."""
    names = [c for c in (columns or df.columns) if c != target]
    numeric = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    return [c for c in names if c not in numeric], numeric


def _is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def number_text(number: Column, whole: bool) -> Column:
    """The one spelling of a number as a value: also for decimals and floats that of its double."""
    return (number.cast("bigint") if whole else number).cast("string")


def value_text(df: DataFrame, column: str, missing: str) -> Column:
    """The text by which a column's value is counted and compared; null and NaN are ``missing``."""
    if not isinstance(df.schema[column].dataType, T.NumericType):
        return F.coalesce(F.col(column).cast("string"), F.lit(missing))
    number = F.col(column).cast("double")
    return F.coalesce(F.when(~F.isnan(number), number_text(number, _is_whole(df, column))), F.lit(missing))


def text_cells(df: DataFrame, target: str, columns: Sequence[str], missing: str) -> DataFrame:
    """Rows and positives of every (column, value), all columns in one pass."""
    wide = df.select(F.col(target).cast("bigint").alias("_y"), *[
        F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns])
    return wide.unpivot(["_y"], list(columns), "column", "value").groupBy("column", "value").agg(
        F.count("*").alias("n_rows"), F.sum("_y").alias("positives"))


def number_cells(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """The same for numeric columns, keyed by the number (null for null and NaN)."""

    def number(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(~F.isnan(value), value).alias(c)

    wide = df.select(F.col(target).cast("bigint").alias("_y"), *[number(c) for c in columns])
    return pin(wide.unpivot(["_y"], list(columns), "column", "number").groupBy("column", "number").agg(
        F.count("*").alias("n_rows"), F.sum("_y").alias("positives")))


def _with_purity(conditions: DataFrame) -> DataFrame:
    n, p = F.col("n_rows"), F.col("positives")
    return conditions.withColumns({
        "purity": ratio(F.greatest(p, n - p), n),
        "pure_label": F.when(p == n, 1).when(p == 0, 0),
    })


def categorical_conditions(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                           min_support: int = MIN_SUPPORT, missing: str = "nan",
                           cells: DataFrame | None = None) -> DataFrame:
    """``column == value`` conditions with enough support.

    Text columns always, numeric ones when they have few distinct values; a missing value is
    a value of its own. ``cells`` reuses an existing :func:`number_cells` table.
    """
    texts, numbers = column_roles(df, target, columns)
    parts = []
    if texts:
        parts.append(text_cells(df, target, texts, missing))
    if numbers:
        cells = cells if cells is not None else number_cells(df, target, numbers)
        few = _few_valued(cells, numbers)
        whole = [c for c in numbers if _is_whole(df, c)]
        text = F.when(F.col("column").isin(*whole), number_text(F.col("number"), True)).otherwise(
            number_text(F.col("number"), False)) if whole else number_text(F.col("number"), False)
        if few:
            parts.append(cells.filter(F.col("column").isin(*few)).select(
                "column", F.coalesce(text, F.lit(missing)).alias("value"), "n_rows", "positives"))
    if not parts:
        return _with_purity(_no_conditions(df))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _with_purity(found.filter(F.col("n_rows") >= min_support).select(
        "column", F.lit("==").alias("op"), "value", F.lit(None).cast("double").alias("threshold"),
        "n_rows", "positives"))


def _no_conditions(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "column string, op string, value string, threshold double, n_rows bigint, positives bigint")


def _few_valued(cells: DataFrame, columns: Sequence[str]) -> list[str]:
    distinct = {r["column"]: r["d"] for r in cells.groupBy("column").agg(F.count("number").alias("d")).collect()}
    return [c for c in columns if distinct.get(c, 0) <= MAX_NUMERIC_CATEGORIES]


def stump_conditions(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                     min_support: int = MIN_SUPPORT, cells: DataFrame | None = None, **limits: int) -> DataFrame:
    """The best single Gini split of each many-valued numeric column, as ``<=`` and ``>``.

    The threshold lies midway between neighbouring values; of equally good splits the
    smallest wins. Columns that are constant, or whose rows are all one class, give nothing.
    """
    _, numbers = column_roles(df, target, columns)
    if not numbers:
        return _with_purity(_no_conditions(df))
    cells = cells if cells is not None else number_cells(df, target, numbers)
    many = [c for c in numbers if c not in _few_valued(cells, numbers)]
    if not many:
        return _with_purity(_no_conditions(df))
    known = cells.filter(F.col("column").isin(*many) & F.col("number").isNotNull())
    placed = running_totals(known, ["column"], "number", ["n_rows", "positives"], **limits)
    n, p = F.col("cum_n_rows").cast("double"), F.col("cum_positives").cast("double")
    rest_n, rest_p = F.col("all_n_rows") - n, F.col("all_positives") - p
    impurity = 2 * p * (n - p) / n + 2 * rest_p * (rest_n - rest_p) / rest_n
    mixed = (F.col("all_positives") > 0) & (F.col("all_positives") < F.col("all_n_rows"))
    splits = placed.filter(mixed & (F.col("cum_n_rows") < F.col("all_n_rows")) & (F.col("all_n_rows") >= min_support))
    best = splits.groupBy("column").agg(F.min(F.struct(
        impurity.alias("impurity"), F.col("number").alias("at"), "cum_n_rows", "cum_positives", "all_n_rows",
        "all_positives")).alias("b")).select("column", "b.*")
    # one row per column: its size is the number of columns
    after = known.join(F.broadcast(best), "column").filter(F.col("number") > F.col("at"))
    cut = after.groupBy("column", "at", "cum_n_rows", "cum_positives", "all_n_rows", "all_positives").agg(
        F.min("number").alias("next"))
    sides = cut.select("column", ((F.col("at") + F.col("next")) / 2).alias("threshold"), F.explode(F.array(
        F.struct(F.lit("<=").alias("op"), F.col("cum_n_rows").alias("n_rows"), F.col("cum_positives").alias("positives")),
        F.struct(F.lit(">").alias("op"), (F.col("all_n_rows") - F.col("cum_n_rows")).alias("n_rows"),
                 (F.col("all_positives") - F.col("cum_positives")).alias("positives")))).alias("s"))
    return _with_purity(sides.select("column", "s.op", F.lit(None).cast("string").alias("value"), "threshold",
                                     "s.n_rows", "s.positives").filter(F.col("n_rows") >= min_support))


def single_conditions(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                      min_support: int = MIN_SUPPORT, missing: str = "nan", **limits: int) -> DataFrame:
    """All single conditions of a table, ranked: ``rank`` 1 is the purest, largest one.

    Ties fall to the earlier column, then to operator, value and threshold.
    """
    names = [c for c in (columns or df.columns) if c != target]
    _, numbers = column_roles(df, target, names)
    cells = number_cells(df, target, numbers) if numbers else None
    found = categorical_conditions(df, target, names, min_support, missing, cells).unionByName(
        stump_conditions(df, target, names, min_support, cells, **limits))
    return rank_conditions(found, names)


def condition_order(columns: Sequence[str]) -> list[Column]:
    ordinal = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    return [F.col("purity").desc(), F.col("n_rows").desc(), ordinal.asc(), F.col("op").asc(),
            F.col("value").asc_nulls_first(), F.col("threshold").asc_nulls_first()]


def rank_conditions(conditions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Conditions in ranked order (a distributed sort; no rank numbers are needed)."""
    return conditions.orderBy(*condition_order(columns))


def describe(column: str = "column") -> Column:
    """Readable text of a typed condition."""
    number = F.format_string("%s %s %s", F.col(column), F.col("op"), F.col("threshold").cast("string"))
    return F.when(F.col("op") == "==", F.format_string('%s == "%s"', F.col(column), F.col("value"))).otherwise(number)


# ------------------------------------------------------------------------ greedy rule
def _satisfied(positives: DataFrame, pure: DataFrame, missing: str) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """Positives per set of satisfied conditions, and (column, op) by slot.

    A slot is a column of the result: one per input column with equalities, holding the value if it is
    pure and null otherwise, and one per one-sided split. Values of a column exclude each other, so a
    set is one value per slot. Pure values are joined, however many there are.
    """
    kinds = pure.select("column", "op").distinct().orderBy("column", "op").collect()  # at most three per column
    slots = {f"s{i}": (r["column"], r["op"]) for i, r in enumerate(kinds)}
    out = positives
    for slot, (column, op) in slots.items():
        own = pure.filter((F.col("column") == column) & (F.col("op") == op))
        if op == "==":
            known = own.select(F.col("value").alias(f"_{slot}"), F.col("value").alias(slot))
            out = out.withColumn(f"_{slot}", value_text(positives, column, missing)).join(known, f"_{slot}", "left")
        else:
            cut = own.first()["threshold"]
            number = F.col(column).cast("double")
            hit = number <= cut if op == "<=" else (number > cut) & ~F.isnan(number)
            out = out.withColumn(slot, F.when(hit, F.lit(op)))
    return pin(out.groupBy(*slots).agg(F.count("*").alias("n"))), slots


def greedy_or_rule(df: DataFrame, target: str, conditions: DataFrame, columns: Sequence[str] | None = None,
                   missing: str = "nan") -> DataFrame:
    """OR together pure-positive conditions, always the one covering most uncovered rows.

    Ties fall to the condition that ranks first. ``conditions`` were found on ``df``, so those that are pure cover no negative
    row. One pass turns the positives into counts per set of satisfied conditions; each round reads those
    counts only. One output row: rule, size, accuracy, mismatches, coverage.
    """
    names = [c for c in (columns or df.columns) if c != target]
    pure = pin(conditions.filter(F.col("pure_label") == 1).withColumn("label", describe()))
    y = F.col(target).cast("int")
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(y == 1, 1)), F.lit(0)).alias("p")).first()
    chosen, covered = [], 0
    if not pure.isEmpty():
        left, slots = _satisfied(df.filter(y == 1), pure, missing)
        pairs = F.create_map(*[F.lit(x) for s, (c, op) in slots.items() for x in (f"{c} {op}", s)])
        ranked = pure.withColumns({"slot": pairs[F.concat_ws(" ", "column", "op")],
                                   "held": F.when(F.col("op") == "==", F.col("value")).otherwise(F.col("op"))})
        while True:
            gains = left.unpivot(["n"], list(slots), "slot", "held").filter("held IS NOT NULL").groupBy("slot", "held").agg(
                F.sum("n").alias("gain"))
            top = ranked.join(gains, ["slot", "held"]).orderBy(F.desc("gain"), *condition_order(names)).limit(1).collect()
            if not top:
                break
            best = top[0]
            chosen.append(best["label"])
            covered += best["gain"]
            left = left.filter(~F.col(best["slot"]).eqNullSafe(F.lit(best["held"])))
            if len(chosen) % ROUNDS_PER_PIN == 0:
                left = pin(left)
    wrong = total["p"] - covered
    row = (" OR ".join(chosen) if chosen else None, len(chosen), (total["n"] - wrong) / total["n"] if total["n"] else 0.0, wrong, covered, total["p"])
    return df.sparkSession.createDataFrame([row], "rule string, n_conditions int, accuracy double, mismatches bigint, "
                                                  "positives_covered bigint, positives_total bigint")
