"""Ranking and calibration metrics from one table of distinct scores per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import ratio
from ..functions.joins import join_groups
from .ordered import reduce_cells, running_totals

# --- Fixed values: threshold lists and bin edges (exact doubles) --------------------------
SWEEP_THRESHOLDS = (0.05, 0.1, 0.2, 0.3, 0.5)
BIN_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)
# --- end of fixed values ------------------------------------------------------------------


def curve_thresholds(lo: float = 0.02, hi: float = 0.6, points: int = 30) -> tuple[float, ...]:
    """Evenly spaced thresholds, both ends included."""
    import numpy as np

    return tuple(float(v) for v in np.linspace(lo, hi, points))


def score_cells(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores per group with their negative and positive rows (``neg``, ``pos``)."""
    yy = F.col(y).cast("int")
    slim = df.select(*by, F.col(score).cast("double").alias("score"), yy.alias("_y")).filter(F.col("_y").isNotNull())
    return reduce_cells(slim, by, "score", {
        "pos": (F.col("_y") == 1).cast("bigint"), "neg": (F.col("_y") == 0).cast("bigint")})


def roc_points(cells: DataFrame, by: Sequence[str] = (), **limits: int) -> DataFrame:
    """Per distinct score, from the highest down: cumulative positives and negatives."""
    return running_totals(cells, by, "score", ["pos", "neg"], descending=True, **limits)


def ranking_from_cells(cells: DataFrame, by: Sequence[str] = (), **limits: int) -> DataFrame:
    """AUROC (ties count one half), average precision (step sum) and score cardinality.

    Both are null for a group with only one class. ``hard_scores`` marks groups with at
    most two distinct scores, whose AUROC only restates accuracy.
    """
    pos, neg, cp, cn = (F.col(c).cast("double") for c in ("pos", "neg", "cum_pos", "cum_neg"))
    sums = roc_points(cells, by, **limits).groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(neg * (cp - pos / 2)).alias("_pairs"), F.sum(pos * cp / (cp + cn)).alias("_steps"),
        F.count("*").alias("distinct_scores"))
    p, n = F.col("positives"), F.col("negatives")
    both = (p > 0) & (n > 0)
    return sums.select(
        *by, (p + n).alias("n"), p.alias("positives"),
        F.when(both, F.col("_pairs") / (p.cast("double") * n)).alias("auroc"),
        F.when(both, F.col("_steps") / p).alias("auprc"),
        "distinct_scores", (F.col("distinct_scores") <= 2).alias("hard_scores"))


def auroc(df: DataFrame, y: str, score: str, by: Sequence[str] = (), **limits: int) -> DataFrame:
    return ranking_from_cells(score_cells(df, y, score, by), by, **limits).drop("auprc")


def average_precision(df: DataFrame, y: str, score: str, by: Sequence[str] = (), **limits: int) -> DataFrame:
    return ranking_from_cells(score_cells(df, y, score, by), by, **limits).select(*by, "n", "positives", "auprc")


def brier(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col(score) - F.col(y)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(gap * gap).alias("brier"))


def metric_bundle(df: DataFrame, y: str, score: str, by: Sequence[str] = (), **limits: int) -> DataFrame:
    """n, positives, prevalence, mean prediction, AUROC, AUPRC and Brier score per group.

    The rows are read once: everything follows from the distinct-score table.
    """
    cells = score_cells(df, y, score, by)
    pos, neg, s = F.col("pos"), F.col("neg"), F.col("score")
    calibration = cells.groupBy(*by).agg(
        F.sum(pos + neg).alias("_n"), F.sum(pos).alias("_p"), F.sum(s * (pos + neg)).alias("_score"),
        F.sum(pos * (s - 1) * (s - 1) + neg * s * s).alias("_gap")
    ).select(*by, ratio(F.col("_p"), F.col("_n")).alias("prevalence"),
             ratio(F.col("_score"), F.col("_n")).alias("mean_predicted"),
             ratio(F.col("_gap"), F.col("_n")).alias("brier"))
    ranking = ranking_from_cells(cells, by, **limits)
    if by:
        return join_groups(ranking, calibration, by)
    # both sides are single rows
    one = calibration.select(F.struct("prevalence", "mean_predicted", "brier").alias("c")).scalar()
    return ranking.withColumn("_c", one).select("*", "_c.*").drop("_c")


def _passed(score: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds a score reaches."""
    level = F.lit(0)
    for i, t in enumerate(thresholds, 1):
        level = F.when(score >= t, F.lit(i)).otherwise(level)
    return level


def threshold_table(df: DataFrame, y: str, score: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Flagged share, recall and precision at each threshold (``score >= threshold``).

    Rows are counted once by the highest threshold they reach; the thresholds are then
    accumulated over that handful of counts.
    """
    steps = sorted(thresholds)
    levels = df.groupBy(*by, _passed(F.col(score), steps).alias("_level")).agg(
        F.count("*").alias("_n"), F.count_if(F.col(y) == 1).alias("_p"))
    reached = levels.select(*by, "_level", "_n", "_p", F.explode(F.sequence(F.lit(0), F.col("_level"))).alias("_t"))
    sums = reached.groupBy(*by, "_t").agg(F.sum("_n").alias("flagged"), F.sum("_p").alias("tp"))
    totals = levels.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_p").alias("positives"))
    # every threshold is listed for every group, also where no row reaches it
    grid = totals.select(*by, "n", "positives", F.explode(F.array(*[
        F.struct(F.lit(i).alias("_t"), F.lit(t).alias("threshold")) for i, t in enumerate(steps, 1)])).alias("_s"))
    grid = grid.select(*by, "n", "positives", "_s._t", "_s.threshold")
    table = join_groups(grid, sums, [*by, "_t"], "left").na.fill(0, ["flagged", "tp"])
    flagged, tp = F.col("flagged"), F.col("tp")
    return table.select(
        *by, "threshold", "flagged", "tp", ratio(flagged, F.col("n")).alias("flagged_share"),
        (tp / F.greatest(F.lit(1), F.col("positives"))).alias("recall"),
        ratio(tp, flagged, None).alias("precision"))


def threshold_sweep(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return threshold_table(df, y, score, SWEEP_THRESHOLDS, by)


def pr_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = (), points: int = 30) -> DataFrame:
    return threshold_table(df, y, score, curve_thresholds(points=points), by)


def reliability(df: DataFrame, y: str, score: str, by: Sequence[str] = (),
                edges: Sequence[float] = BIN_EDGES) -> DataFrame:
    """Per score bin (right-open, the last closed; empty ones absent): n, mean score, observed rate.

    Scores outside the edges belong to no bin.
    """
    s = F.col(score)
    last = len(edges) - 2
    which = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        upper = s <= edges[i + 1] if i == last else s < edges[i + 1]
        which = F.when((s >= edges[i]) & upper, F.lit(i)).otherwise(which)
    binned = df.select(*by, which.alias("bin"), s.alias("_s"), F.col(y).cast("double").alias("_y"))
    names = F.array(*[F.lit(round(e, 2)) for e in edges])
    return binned.filter(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.avg("_s").alias("mean_pred"), F.avg("_y").alias("observed_rate")
    ).select(*by, names[F.col("bin")].alias("bin_lo"), names[F.col("bin") + 1].alias("bin_hi"),
             "n", "mean_pred", "observed_rate")


def single_feature_rank(df: DataFrame, y: str, feature: str, by: Sequence[str] = (), **limits: int) -> DataFrame:
    """Ranking quality of one feature, smaller values first."""
    return ranking_from_cells(
        score_cells(df.withColumn("_score", -F.col(feature).cast("double")), y, "_score", by), by, **limits
    ).select(*by, "n", "positives", "auroc", "auprc")


def prevalence_baseline(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """The constant predictor: the training rate on every test row."""
    rate = train.agg(F.avg(F.col(y).cast("double"))).scalar()
    gap = F.col("_p") - F.col("_y")
    return test.select(F.col(y).cast("double").alias("_y"), rate.alias("_p")).agg(
        F.count("*").alias("n"), F.avg("_p").alias("mean_predicted"), F.lit(0.5).alias("auroc"),
        F.avg("_y").alias("auprc"), F.avg(gap * gap).alias("brier"))
