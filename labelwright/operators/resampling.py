"""Bootstrap intervals from sufficient statistics.

Rows are never resampled. A replicate gives every *cell* (distinct outcome, with its row
count m) a Poisson(m) weight - the sum of m Poisson(1) row weights - so the work follows
the number of distinct cells, and what is shuffled afterwards is one short row per
(value range, replicate).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform, row_hash
from ..functions.intervals import ratio
from ..functions.joins import join_groups
from ..session import pin
from .classification import confusion
from .ordered import cut_ranges, reduce_cells, running_totals
from .ranking import score_cells

#: Metric registry over confusion counts (extend with any Column of tn, fp, fn, tp).
COUNT_METRICS: dict[str, Callable[[], Column]] = {
    "acc": lambda: ratio(F.col("tp") + F.col("tn"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")),
    "precision": lambda: ratio(F.col("tp"), F.col("tp") + F.col("fp")),
    "recall": lambda: ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    "f1": lambda: ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
}
#: Smaller value ranges than elsewhere: each cell is weighed once per replicate.
BOOT_LIMITS = {"small": 5_000, "range_cells": 5_000}


def poisson_weight(u: Column, mean: Column) -> Column:
    """The Poisson(mean) quantile of u in (0, 1)."""

    @F.pandas_udf("bigint")
    def quantile(us: pd.Series, means: pd.Series) -> pd.Series:
        import math

        import numpy as np

        uu, mm = us.to_numpy(dtype=float), means.to_numpy(dtype=float)
        out = np.zeros(len(uu), dtype="int64")
        for m in np.unique(mm[mm > 0]):
            spread = 10 * math.sqrt(m) + 20
            k = np.arange(max(0, math.floor(m - spread)), math.ceil(m + spread) + 1)
            start = -m + k[0] * math.log(m) - math.lgamma(k[0] + 1)
            log_pmf = start + np.concatenate(([0.0], np.cumsum(math.log(m) - np.log(k[1:]))))
            rows = mm == m
            out[rows] = k[0] + np.searchsorted(np.cumsum(np.exp(log_pmf)), uu[rows], side="left")
        return pd.Series(out)

    return quantile(u, mean)


def _percentile_bounds(replicates: DataFrame, by: Sequence[str], metrics: Sequence[str], alpha: float) -> DataFrame:
    aggs = [F.count("*").alias("replicates")]
    for m in metrics:
        aggs += [F.percentile(m, alpha / 2).alias(f"{m}_lo"), F.percentile(m, 1 - alpha / 2).alias(f"{m}_hi")]
    return replicates.groupBy(*by).agg(*aggs)


def _replicates(n_boot: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n_boot - 1))


def count_replicates(counts: DataFrame, by: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Resampled ``tn, fp, fn, tp`` per (group, replicate); one-class replicates are skipped."""
    cells = counts.select(*by, F.explode(F.create_map(*[
        x for c in ("tn", "fp", "fn", "tp") for x in (F.lit(c), F.col(c))])).alias("cell", "m"))
    drawn = cells.select(*by, "cell", "m", F.explode(_replicates(n_boot)).alias("replicate"))
    u = hash_uniform(row_hash(seed, [*by, "replicate", "cell"]))
    weighed = drawn.select(*by, "replicate", "cell", poisson_weight(u, F.col("m")).alias("w"))
    wide = weighed.groupBy(*by, "replicate").agg(*[
        F.sum(F.when(F.col("cell") == c, F.col("w")).otherwise(0)).alias(c) for c in ("tn", "fp", "fn", "tp")])
    return wide.filter((F.col("tn") + F.col("fp") > 0) & (F.col("fn") + F.col("tp") > 0))


def bootstrap_counts(df: DataFrame, y: str, pred: str, by: Sequence[str] = (), metrics: Sequence[str] = ("acc", "f1"),
                     n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Percentile intervals of count metrics; ``degenerate`` marks groups without errors."""
    counts = pin(confusion(df, y, pred, by))
    reps = count_replicates(counts, by, n_boot, seed).select(
        *by, "replicate", *[COUNT_METRICS[m]().alias(m) for m in metrics])
    bounds = _percentile_bounds(reps, by, metrics, alpha)
    flags = counts.select(*by, (F.col("fp") + F.col("fn") == 0).alias("degenerate"))
    if by:
        return join_groups(flags, bounds, by, "left")
    return bounds.withColumn("degenerate", flags.scalar())


# ------------------------------------------------------------------ ranking metrics
_PART = "replicate int, p double, n double, pairs double"


def _weigher(n_boot: int, seed: int):
    """A function that yields (replicate slice, positive weights, negative weights) of score cells.

    A weight depends on the seed, the group, the score, the class and the replicate alone: not on the
    range a cell lies in, its neighbours or the layout of the input. The function is nested, so
    that it travels to the workers by value.
    """
    def weights(pdf: pd.DataFrame, group: str):
        import hashlib
        import math

        import numpy as np

        def mix(x):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        def quantiles(u, means):
            """The Poisson quantiles of a (replicates, cells) array of numbers in (0, 1)."""
            out = np.zeros(u.shape, dtype="int64")
            for m in np.unique(means[means > 0]):
                spread = 10 * math.sqrt(m) + 20
                k = np.arange(max(0, math.floor(m - spread)), math.ceil(m + spread) + 1)
                start = -m + k[0] * math.log(m) - math.lgamma(k[0] + 1)
                log_pmf = start + np.concatenate(([0.0], np.cumsum(math.log(m) - np.log(k[1:]))))
                same = means == m
                out[:, same] = k[0] + np.searchsorted(np.cumsum(np.exp(log_pmf)), u[:, same])
            return out

        odd = np.uint64(0x9E3779B97F4A7C15)
        by_class = [np.uint64(c * int(odd) % 2**64) for c in (1, 2)]
        own = np.uint64(int(hashlib.md5(f"{seed}|{group}".encode()).hexdigest()[:16], 16))
        scores = (pdf["score"].to_numpy(dtype=float) + 0.0).view(np.uint64)
        means = [pdf[c].to_numpy(dtype=float) for c in ("pos", "neg")]
        bases = [mix(mix(scores ^ own) + c) for c in by_class]
        chunk = max(1, 1_000_000 // max(1, len(pdf)))
        for start in range(0, n_boot, chunk):
            rows = slice(start, min(n_boot, start + chunk))
            step = np.arange(rows.start + 1, rows.stop + 1, dtype=np.uint64)[:, None] * odd
            drawn = [((mix(base[None, :] + step) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53 for base in bases]
            yield rows, quantiles(drawn[0], means[0]), quantiles(drawn[1], means[1])

    return weights


def bootstrap_ranking(df: DataFrame, y: str, score: str, by: Sequence[str] = (), n_boot: int = 1000, seed: int = 0,
                      alpha: float = 0.05, **limits: int) -> DataFrame:
    """Row-bootstrap intervals of AUROC and average precision per group.

    Two passes over ranges of distinct scores: the first gives each (range, replicate) its
    weight totals, from which every range learns what lies above it; the second adds up the
    metric inside each range. No row is ever multiplied in a shuffle.
    """
    ranged = cut_ranges(score_cells(df, y, score, by), by, "score", **{**BOOT_LIMITS, **limits})
    keys = [*by, "_range"]
    types = {f.name: f.dataType.simpleString() for f in ranged.table.schema}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    n_by, weights = len(keys), _weigher(n_boot, seed)

    def totals(key, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ordered = pdf.sort_values("score", ascending=False)
        p, n = np.empty(n_boot), np.empty(n_boot)
        for rows, wp, wn in weights(ordered, "|".join(map(str, key[:-1]))):
            p[rows], n[rows] = wp.sum(axis=1), wn.sum(axis=1)
        out = pd.DataFrame({"p": [p.tolist()], "n": [n.tolist()]})
        for i, k in enumerate(keys):
            out.insert(i, k, [key[i]])
        return out

    sums = ranged.table.groupBy(*keys).applyInPandas(totals, f"{head}, p array<double>, n array<double>")
    above = Window.partitionBy(*by, "_r").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    flat = sums.select(*keys, F.posexplode(F.arrays_zip("p", "n")).alias("_r", "_w"))
    offsets = flat.select(*keys, "_r", F.coalesce(F.sum("_w.p").over(above), F.lit(0.0)).alias("p"),
                          F.coalesce(F.sum("_w.n").over(above), F.lit(0.0)).alias("n"))
    lists = offsets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "p", "n"))).alias("_above"))
    lists = lists.select(*keys, F.col("_above.p").alias("_p"), F.col("_above.n").alias("_n"))

    def parts(key, cells: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ordered = cells.sort_values("score", ascending=False)
        p0, n0 = np.asarray(before["_p"].iloc[0]), np.asarray(before["_n"].iloc[0])
        pieces = []
        for rows, wp, wn in weights(ordered, "|".join(map(str, key[:-1]))):
            cp = p0[rows, None] + np.cumsum(wp, axis=1)
            cn = n0[rows, None] + np.cumsum(wn, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                steps = np.where(wp > 0, wp * cp / (cp + cn), 0.0)
            pieces.append(pd.DataFrame({
                "replicate": np.arange(rows.start, rows.stop, dtype="int32"),
                "p": wp.sum(axis=1).astype(float), "n": wn.sum(axis=1).astype(float),
                "pairs": (wn * (cp - wp / 2)).sum(axis=1), "steps": steps.sum(axis=1)}))
        out = pd.concat(pieces)
        for i in range(n_by - 1):
            out.insert(i, keys[i], key[i])
        return out

    by_head = "".join(f"`{k}` {types[k]}, " for k in by)
    measured = ranged.table.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(
        parts, f"{by_head}{_PART}, steps double")
    reps = measured.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in ("p", "n", "pairs", "steps")])
    reps = reps.filter((F.col("p") > 0) & (F.col("n") > 0)).select(
        *by, "replicate", (F.col("pairs") / (F.col("p") * F.col("n"))).alias("auroc"),
        (F.col("steps") / F.col("p")).alias("auprc"))
    return _percentile_bounds(reps, by, ["auroc", "auprc"], alpha)


def bootstrap_blocks(df: DataFrame, y: str, score: str, block: str, n_boot: int = 300, seed: int = 0,
                     alpha: float = 0.05, by: Sequence[str] = (), **limits: int) -> DataFrame:
    """AUROC intervals when whole blocks (say, months) are resampled, per group.

    Each replicate draws as many blocks as the group has, with replacement. A draw is a hash of seed, replicate and
    number, so groups with the same blocks draw the same ones. How often each replicate has a block is worked out once, in a table of
    (blocks, block) rows, whatever the number of cells; each range of scores meets the rows of its own blocks only. Rows without label or
    block do not count; a replicate of one class gives no value.
    """
    yy = F.col(y).cast("int")
    slim = df.select(*by, F.col(score).cast("double").alias("score"), F.col(block).alias("block"), yy.alias("_y"))
    cells = reduce_cells(slim.filter(F.col("_y").isNotNull() & F.col("block").isNotNull()), [*by, "block"], "score", {
        "pos": (F.col("_y") == 1).cast("bigint"), "neg": (F.col("_y") == 0).cast("bigint")})
    numbered = pin(_number_blocks(cells.select(*by, "block").distinct(), by))
    placed = join_groups(cells, numbered, [*by, "block"]).select(*by, "score", "block_no", "blocks", "pos", "neg")
    reps = _block_replicates(placed, by, block_draws(numbered.select("blocks").distinct(), n_boot, seed), n_boot, **limits)
    bounds = _percentile_bounds(reps, by, ["auroc"], alpha)
    sizes = numbered.select(*by, F.col("blocks").cast("bigint").alias("blocks")).distinct()
    if by:
        return join_groups(bounds, sizes, by)
    return bounds.withColumn("blocks", sizes.scalar())


def block_draws(sizes: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(blocks, block_no, times): how often each block is drawn in each of ``n_boot`` replicates, for every number of ``blocks`` given.

    ``times`` holds a 16-bit number per replicate. The draws are made by Spark, a row per replicate and draw, and summed up per block.
    """
    drawn = sizes.select("blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("d")).repartition("d").select(
        "blocks", "d", F.explode(_replicates(n_boot)).alias("replicate"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("d").cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("blocks")
    counts = drawn.groupBy("blocks", number.alias("block_no"), "replicate").agg(F.count("*").cast("int").alias("w"))
    return pin(counts.groupBy("blocks", "block_no").agg(F.collect_list(F.struct("replicate", "w")).alias("times")))  # n_boot at most


def _block_replicates(placed: DataFrame, by: Sequence[str], draws: DataFrame, n_boot: int, **limits: int) -> DataFrame:
    ranged = cut_ranges(placed, by, "score", **{**BOOT_LIMITS, **limits})
    keys = [*by, "_range"]
    types = {f.name: f.dataType.simpleString() for f in ranged.table.schema}
    n_by = len(by)
    own = ranged.table.select(*keys, "blocks", "block_no").distinct().join(draws, ["blocks", "block_no"])
    own = own.select(*[F.col(k).alias(k) for k in keys], F.col("block_no").alias("block_no"), "times")  # columns of their own, for the cogroup

    def inside(key, cells: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ordered = cells.sort_values("score", ascending=False)
        score = ordered["score"].to_numpy()
        tie_starts = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
        pos, neg = ordered["pos"].to_numpy(dtype=float)[:, None], ordered["neg"].to_numpy(dtype=float)[:, None]
        # a block that is never drawn has no row
        known = {b: i + 1 for i, b in enumerate(mine["block_no"])}
        row = np.array([known.get(b, 0) for b in ordered["block_no"]])
        times = np.zeros((len(mine) + 1, n_boot), dtype="int32")
        for i, found in enumerate(mine["times"]):
            for t in found:
                times[i + 1, t["replicate"]] = t["w"]
        parts, chunk = [], max(1, 4_000_000 // max(1, len(ordered)))
        for start in range(0, n_boot, chunk):
            w = times[:, start:start + chunk][row]
            wp, wn = np.add.reduceat(w * pos, tie_starts), np.add.reduceat(w * neg, tie_starts)
            parts.append(pd.DataFrame({"_range": int(key[-1]), "replicate": np.arange(start, start + w.shape[1], dtype="int32"), "p": wp.sum(0), "n": wn.sum(0),
                                       "pairs": (wn * (np.cumsum(wp, 0) - wp / 2)).sum(0)}))
        out = pd.concat(parts)
        for i in range(n_by):
            out.insert(i, keys[i], key[i])
        return out

    head = "".join(f"`{k}` {types[k]}, " for k in by)
    parts = ranged.table.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(inside, f"{head}_range int, " + _PART)
    above = Window.partitionBy(*by, "replicate").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_above", F.coalesce(F.sum("p").over(above), F.lit(0.0)))
    sums = carried.groupBy(*by, "replicate").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("pairs") + F.col("n") * F.col("_above")).alias("u"))
    return sums.filter((F.col("p") > 0) & (F.col("n") > 0)).select(
        *by, "replicate", (F.col("u") / (F.col("p") * F.col("n"))).alias("auroc"))


def _number_blocks(names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each group's blocks numbered from 0 in ascending order, and their number (via running counts, not one big window)."""
    cells = reduce_cells(names, by, "block", {"_one": F.lit(1).cast("bigint")})
    return running_totals(cells, by, "block", ["_one"]).select(
        *by, "block", (F.col("cum__one") - 1).alias("block_no"), F.col("all__one").alias("blocks"))
