"""Summaries of run logs (``run, step, metric, value``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarize_runs(df: DataFrame, run: str = "run", step: str = "step", value: str = "value",
                   reached: Column | None = None) -> DataFrame:
    """Per run: first, smallest and last value with their steps, points, first step ``reached``.

    The smallest value is reported at its earliest step. ``reached`` defaults to ``value = 0``.
    """
    s, v = F.col(step), F.col(value)
    reached = reached if reached is not None else v == 0
    logged = df.filter(v.isNotNull())
    return logged.groupBy(run).agg(
        F.count("*").alias("points"), F.min(s).alias("first_step"), F.min_by(v, s).alias("first_value"),
        F.min(v).alias("min_value"), F.min(F.struct(v.alias("v"), s.alias("s")))["s"].alias("min_step"),
        F.max(s).alias("last_step"), F.max_by(v, s).alias("last_value"),
        F.min(F.when(reached, s)).alias("first_reached_step"))
