"""Hard-label metrics. Every job measures all ``by`` groups in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_groups
from ..functions.intervals import exact_bounds, ratio, wilson_bounds
from .ordered import grouped_median


def confusion(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``tn, fp, fn, tp`` per group; rows without a prediction are not counted."""
    yy, pp = F.col(y).cast("int"), F.col(pred).cast("int")
    cell = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return df.groupBy(*by).agg(*[F.count_if((yy == a) & (pp == b)).alias(n) for n, (a, b) in cell.items()])


def metrics_from_confusion(counts: DataFrame) -> DataFrame:
    """n, positive rate, accuracy, precision, recall, F1, errors; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return counts.withColumns({
        "n": n,
        "pos_rate": ratio(tp + fn, n),
        "acc": ratio(tp + tn, n),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "errors": fp + fn,
    })


def classification_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return metrics_from_confusion(confusion(df, y, pred, by))


def with_wilson(counts: DataFrame, k: str, n: str, prefix: str) -> DataFrame:
    lo, hi = wilson_bounds(F.col(k), F.col(n))
    return counts.withColumns({f"{prefix}_lo": lo, f"{prefix}_hi": hi})


def with_exact(counts: DataFrame, k: str, n: str, prefix: str, alpha: float = 0.05) -> DataFrame:
    both = counts.withColumn("_ci", exact_bounds(F.col(k), F.col(n), alpha))
    return both.withColumns({f"{prefix}_lo": F.col("_ci.lo"), f"{prefix}_hi": F.col("_ci.hi")}).drop("_ci")


def with_accuracy_intervals(metrics: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Both accuracy intervals of a metrics table."""
    counted = metrics.withColumn("_right", F.col("tn") + F.col("tp"))
    return with_exact(with_wilson(counted, "_right", "n", "acc_wilson"), "_right", "n", "acc_exact", alpha).drop("_right")


def scored_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics on parsed rows, plus how many could not be parsed and accuracy counting those as wrong."""
    yy, pp = F.col(y).cast("int"), F.col(pred).cast("int")
    cell = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    counts = df.groupBy(*by).agg(
        *[F.count_if((yy == a) & (pp == b)).alias(n) for n, (a, b) in cell.items()],
        F.count("*").alias("_all"), F.count(pp).alias("n_scored"))
    return metrics_from_confusion(counts).withColumns({
        "unparsable": F.col("_all") - F.col("n_scored"),
        "acc_unparsable_wrong": ratio(F.col("tn") + F.col("tp"), F.col("_all")),
    }).drop("_all")


def with_agreement(df: DataFrame, pred: str, rule: str, out: str = "agrees_with_rule") -> DataFrame:
    """Row column: prediction equals the rule; null when the answer is unparsable."""
    return df.withColumn(out, F.when(F.col(pred).isNotNull(), F.col(pred) == F.col(rule)))


def rule_agreement(df: DataFrame, pred: str, rule: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of all rows (unparsable included) whose prediction equals the rule."""
    same = F.count_if(F.col(pred) == F.col(rule))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), same.alias("agreeing"), ratio(same, F.count("*")).alias("agreement"),
        ratio(F.count_if(F.col(pred) == 1), F.count("*")).alias("positive_rate"))


def error_rows(df: DataFrame, y: str, pred: str, context: Sequence[str]) -> DataFrame:
    """Rows whose prediction differs from the label or could not be parsed."""
    return df.filter(~F.col(pred).eqNullSafe(F.col(y))).select(*context, y, pred)


def repeat_stability(df: DataFrame, row_id: str, run: str, y: str, pred: str) -> DataFrame:
    """Per run: accuracy, unparsable rows, and rows whose label differs from the run before.

    The first run has no run before it and counts 0 changes.
    """
    w = Window.partitionBy(row_id).orderBy(run)
    parsed = F.coalesce(F.col(pred), F.lit(-1))
    staged = df.select(run, y, pred, F.lag(parsed).over(w).alias("_prev"), parsed.alias("_now"))
    return staged.groupBy(run).agg(
        F.count("*").alias("n"),
        ratio(F.count_if(F.col(pred) == F.col(y)), F.count("*")).alias("acc_unparsable_wrong"),
        F.count_if(F.col(pred).isNull()).alias("unparsable"),
        F.count_if(F.col("_prev") != F.col("_now")).alias("changed_rows"))


def margin_summary(df: DataFrame, margin: str, by: Sequence[str] = (), flag: str | None = None) -> DataFrame:
    """Smallest, largest and median-absolute margin per group, optional share of a 0/1 flag."""
    m = F.col(margin)
    aggs = [F.count(m).alias("n"), F.min(m).alias("margin_min"), F.max(m).alias("margin_max"),
            F.min(F.abs(m)).alias("margin_abs_min")]
    if flag:
        aggs.append(F.avg(F.col(flag).cast("double")).alias("flag_share"))
    plain = df.groupBy(*by).agg(*aggs)
    medians = grouped_median(df.select(*by, F.abs(m).alias("margin_abs_median")), by, ["margin_abs_median"])
    if by:
        return join_groups(plain, medians, by, "left")
    return plain.withColumn("margin_abs_median", medians.scalar())
