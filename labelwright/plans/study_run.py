"""The prospective study from order tables to its report, in one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as md
from ..operators import ranking
from ..operators.resampling import bootstrap_blocks, bootstrap_ranking
from ..session import pin
from . import order_study as st
from .label_audit import audit

#: Boosting rounds and step of the study; categories below so many training rows share a slot.
ROUNDS, STEP, RARE = 200, 0.05, 20
IN_FLIGHT_MODEL = "logistic_regression_in_flight_counted_late"


def study_specs(rounds: int = ROUNDS) -> list[md.ModelSpec]:
    """Logistic regression and boosting on all features, and logistic regression without the month."""
    no_month = tuple(c for c in st.CATEGORICAL if c != "purchase_month")
    return [md.ModelSpec("logistic_regression", "logistic", st.NUMERIC, st.CATEGORICAL),
            md.ModelSpec("gradient_boosting", "boosting", st.NUMERIC, st.CATEGORICAL, {"maxIter": rounds, "stepSize": STEP}),
            md.ModelSpec("logistic_regression_without_purchase_month", "logistic", st.NUMERIC, no_month)]


def scored_cohorts(table: DataFrame, specs: Sequence[md.ModelSpec], seed: int = 0) -> DataFrame:
    """(model, order_id, month, late, p1) of the test rows; the first model also scores them together with the orders still
    in flight, counted late, under a name of its own. ``table`` has a ``cohort``: train, test, flight (others are left out).
    """
    keep = ["order_id", "month", "late", "cohort"]
    rows = table.withColumn("month", F.date_format("purchased", "yyyy-MM"))
    scored = pin(md.fit_and_score(rows.filter("cohort = 'train'"), rows.filter("cohort IN ('test', 'flight')"), specs, "late", keep,
                                  min_count=RARE, missing="unknown", seed=seed))
    both = scored.filter(F.col("model") == specs[0].name).withColumn("model", F.lit(IN_FLIGHT_MODEL))
    return scored.filter("cohort = 'test'").unionByName(both).select("model", "order_id", "month", "late", "p1")


def measured(scored: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """One row per model: the metric bundle with row-bootstrap and month-bootstrap intervals."""
    rows = bootstrap_ranking(scored, "late", "p1", ["model"], n_boot, seed).drop("replicates")
    months = bootstrap_blocks(scored, "late", "p1", "month", n_boot, seed, by=["model"]).select(
        "model", F.col("auroc_lo").alias("auroc_month_lo"), F.col("auroc_hi").alias("auroc_month_hi"), F.col("blocks").alias("months"))
    return ranking.metric_bundle(scored, "late", "p1", ["model"]).join(rows, "model", "left").join(months, "model", "left")


def run(t: st.StudyTables, *, train_end: str = st.TRAIN_END, delivered: str = st.DELIVERED, in_flight: Sequence[str] = st.IN_FLIGHT,
        not_delivery: Sequence[str] = st.NOT_A_DELIVERY, item_order: Sequence[str] = ("item_no",), pay_order: Sequence[str] = ("pay_no",),
        specs: Sequence[md.ModelSpec] | None = None, n_boot: int = 300, seed: int = 0, wanted: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Sections of the study (those ``wanted``, or all), each a DataFrame:

    ``cutoff``, ``notes`` (undelivered orders by status), ``splits``, ``by_month`` (train and test), ``models`` (metrics with row and
    month intervals, sensitivity model included), ``sweep``, ``reliability``, ``pr_curve``, ``by_month_test`` (per model),
    ``constant`` and ``lead_days_only`` (the two reference points), ``audit_summary``, ``audit_rule``, ``audit_pure`` and ``audit_tree`` (the label audit of the test rows).

    The feature table of labelled and in-flight orders and the predictions are written down once; every section starts from these, and one that is not wanted costs nothing.
    """
    pre = st.before_cutoff(t.orders)
    known = st.with_split(st.labelled(pre, delivered), train_end).withColumnRenamed("split", "cohort")
    flight = st.in_flight_cohort(pre, delivered, in_flight).withColumn("cohort", F.when(
        F.col("purchased") >= F.lit(train_end).cast("timestamp_ntz"), "flight").otherwise("early_flight"))
    table = pin(st.attach_features(known.unionByName(flight), t, item_order, pay_order))
    labelled = table.filter("cohort NOT IN ('flight', 'early_flight')")
    train, test = table.filter("cohort = 'train'"), table.filter("cohort = 'test'")
    specs = specs or study_specs()
    scored = pin(scored_cohorts(table, specs, seed))
    months = scored.groupBy("model", "month").agg(F.count("*").alias("n"), F.avg(F.col("late").cast("double")).alias("late_rate"),
                                                  F.avg("p1").alias("mean_predicted")).orderBy("model", "month")

    def audited() -> dict[str, DataFrame]:
        found = audit(test, "late", [*st.NUMERIC, *st.CATEGORICAL], tree=True, keys=["order_id"])
        return {f"audit_{name}": found[part] for name, part in (("summary", "summary"), ("rule", "rule"), ("pure", "pure_conditions"), ("tree", "tree"))}

    sections = {
        "cutoff": lambda: st.censor_cutoff(t.orders),
        "notes": lambda: st.cohort_notes(pre, st.last_purchase(t.orders), delivered, in_flight, not_delivery),
        "splits": lambda: st.split_rates(labelled.withColumnRenamed("cohort", "split")),
        "by_month": lambda: st.by_month(labelled.filter("cohort <> 'straddling'"), by=["cohort"]),
        "models": lambda: measured(scored, n_boot, seed),
        "sweep": lambda: ranking.threshold_sweep(scored, "late", "p1", ["model"]),
        "reliability": lambda: ranking.reliability(scored, "late", "p1", ["model"]),
        "pr_curve": lambda: ranking.pr_curve(scored, "late", "p1", ["model"]),
        "by_month_test": lambda: months,
        "constant": lambda: ranking.prevalence_baseline(train, test, "late"),
        "lead_days_only": lambda: ranking.single_feature_rank(test, "late", "promised_lead_days"),
    }
    names = [*sections, "audit_summary", "audit_rule", "audit_pure", "audit_tree"] if wanted is None else list(wanted)
    # the audit searches as it is asked for, in many jobs: only where a section needs it
    found = audited() if any(n.startswith("audit_") for n in names) else {}
    return {n: found[n] if n in found else sections[n]() for n in names}
