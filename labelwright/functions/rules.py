"""Column expressions for OR-rules of equality clauses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import Clause
from . import text as tx


def clause_hit(clause: Clause, *, trim: bool = True) -> Column:
    """True where the clause holds; a null is never a hit."""
    value = F.col(clause.column).cast("string")
    return F.coalesce((tx.strip(value) if trim else value) == clause.value, F.lit(False))


def any_clause(clauses: Sequence[Clause], *, trim: bool = True) -> Column:
    hit = F.lit(False)
    for clause in clauses:
        hit = hit | clause_hit(clause, trim=trim)
    return hit.cast("int")


def rule_on_values(values: Sequence[Column], clauses: Sequence[Clause]) -> Column:
    """The rule on field values read from a text; null when any field is absent (null)."""
    hit, present = F.lit(False), F.lit(True)
    for value, clause in zip(values, clauses, strict=True):
        hit, present = hit | (value == clause.value), present & value.isNotNull()
    return F.when(present, hit.cast("int"))


def remaining_on_values(values: Sequence[Column], clauses: Sequence[Clause], n_fields: Column, full_count: int) -> Column:
    """Value of the one clause left after a deletion.

    Null when nothing was deleted (as many fields as a full record: a rename is not a
    deletion) and when both or neither of the rule fields are present.
    """
    (a, b), (first, second) = values, clauses
    left = F.when(b.isNull(), (a == first.value).cast("int")).otherwise((b == second.value).cast("int"))
    # fields are counted only where exactly one rule field is left
    return F.when((a.isNotNull() != b.isNotNull()) & (n_fields < full_count), left)
