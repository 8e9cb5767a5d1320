"""Joins on group columns in which a null group is a group like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join; the columns of ``left`` first, each ``by`` column once."""
    renamed = right.withColumnsRenamed({b: f"_right_{b}" for b in by})
    match = F.lit(True)
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_right_{b}"))
    return left.join(renamed, match, how).drop(*[f"_right_{b}" for b in by])


def never_null(column: str) -> Column:
    """A text key that is distinct for every value and for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))
