"""Sinks: row-level predictions and report sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prediction_table(scored: DataFrame, inputs: Sequence[str], *, gold: str = "gold", rule: str = "rule",
                     raw: str = "raw", label: str = "label", scores: Sequence[str] = ()) -> DataFrame:
    """The audit layout: inputs, gold, rule, raw output, label (blank when unparsable), scores."""
    return scored.select(
        *inputs, F.col(gold).alias("gold"), F.col(rule).alias("rule"), F.col(raw).alias("model_raw"),
        F.coalesce(F.col(label).cast("string"), F.lit("")).alias("model_label"), *scores)


def write_predictions(table: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = table.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("emptyValue", "")
    writer.format(fmt).save(path)


def write_report(sections: dict[str, DataFrame], folder: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Every section is a table of its own below ``folder``."""
    for name, section in sections.items():
        writer = section.write.mode(mode)
        if fmt == "json":
            writer = writer.option("ignoreNullFields", False)
        writer.format(fmt).save(f"{folder.rstrip('/')}/{name}")
