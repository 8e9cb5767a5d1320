"""The whole label audit of one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.conditions import MIN_SUPPORT, describe, greedy_or_rule, rank_conditions, single_conditions
from ..operators.rule_tables import label_summary
from ..session import pin


def audit(df: DataFrame, target: str, columns: Sequence[str] | None = None, min_support: int = MIN_SUPPORT,
          missing: str = "nan", tree: bool = False, keys: Sequence[str] = (), materialize: bool = False,
          **limits: int) -> dict[str, DataFrame]:
    """Sections: ``summary``, ``conditions``, ``pure_conditions``, ``rule`` and, on request, ``tree``.

    The condition table is written down once; the rule search starts from it. The audit reads
    its input a handful of times: ``materialize`` writes the audited columns down first, which
    pays when the input is a join or another costly query rather than a table.
    """
    names = [c for c in (columns or df.columns) if c != target]
    if materialize:
        df = pin(df.select(*names, target, *[k for k in keys if k not in names]))
    found = pin(single_conditions(df, target, names, min_support, missing, **limits))
    ranked = rank_conditions(found, names).withColumn("condition", describe())
    sections = {
        "summary": label_summary(df, target).withColumn("target", F.lit(target)),
        "conditions": ranked,
        "pure_conditions": ranked.filter(F.col("pure_label").isNotNull()),
        "rule": greedy_or_rule(df, target, found, names, missing),
    }
    if tree:
        from ..operators.trees import tree_cv

        sections["tree"] = tree_cv(df.select(*names, target, *[k for k in keys if k not in names]), target, keys)
    return sections


def audit_report(df: DataFrame, target: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """The audit as one row: size, label rate, pure conditions counted, and the rule."""
    parts = audit(df, target, columns, **options)
    pure = parts["pure_conditions"].agg(F.struct(
        F.count("*").alias("pure_conditions"),
        F.count_if(F.col("pure_label") == 1).alias("pure_positive_conditions")).alias("p")).scalar()
    size = parts["summary"].select(F.struct("n", "positives", "rate").alias("s")).scalar()
    return parts["rule"].select(
        F.lit(target).alias("target"), size.alias("_s"), pure.alias("_p"), "*").select(
        "target", "_s.*", "_p.*", "rule", "n_conditions", "accuracy", "mismatches", "positives_covered",
        "positives_total")
