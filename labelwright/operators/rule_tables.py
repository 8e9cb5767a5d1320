"""Rule predictions and the counts behind a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..functions.intervals import ratio
from ..vocab import Clause, Vocabulary


def apply_rule(df: DataFrame, clauses: Sequence[Clause], out: str = "rule") -> DataFrame:
    return df.withColumn(out, rules.any_clause(clauses))


def read_rule(df: DataFrame, vocab: Vocabulary, text: str = "text", rule: str | None = "rule_on_text",
              remaining: str | None = "remaining") -> DataFrame:
    """What the rule says about each text, and what its one remaining clause says.

    The rule fields are read once, as staged columns, and serve both answers.
    """
    after = {f"_after{i}": tx.after_line(F.col(text), c.column) for i, c in enumerate(vocab.clauses)}
    raw = {f"_tail{i}": tx.last_line_tail(F.col(text), c.column, F.col(f"_after{i}")) for i, c in enumerate(vocab.clauses)}
    staged = df.withColumns(after).withColumns(raw)
    staged = staged.withColumns({f"_value{i}": tx.tail_value(F.col(f"_tail{i}")) for i in range(len(raw))})
    values = [F.col(f"_value{i}") for i in range(len(raw))]
    answers = {}
    if rule:
        answers[rule] = rules.rule_on_values(values, vocab.clauses)
    if remaining:
        answers[remaining] = rules.remaining_on_values(
            values, vocab.clauses, tx.field_count(F.col(text)), len(vocab.fields))
    return staged.withColumns(answers).drop(*after, *raw, *[f"_value{i}" for i in range(len(raw))])


def rule_on_text(df: DataFrame, vocab: Vocabulary, text: str = "text", out: str = "rule_on_text") -> DataFrame:
    """The rule read off each text; null when any rule field is absent."""
    return read_rule(df, vocab, text, out, None)


def remaining_clause(df: DataFrame, vocab: Vocabulary, text: str = "text", out: str = "remaining") -> DataFrame:
    return read_rule(df, vocab, text, None, out)


def flip_by_rule(df: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """The nearest counterfactual of each row, and which fields were changed.

    A row the rule fires on has every firing clause cleared; any other row gets the first
    clause's trigger value.
    """
    hits = [F.coalesce(F.col(c.column) == c.value, F.lit(False)) for c in clauses]
    fired = F.lit(False)
    for hit in hits:
        fired = fired | hit
    notes = F.concat_ws(" and ", *[
        F.when(hit, F.lit(f"{c.column} -> {c.clear}")) for hit, c in zip(hits, clauses, strict=True)
    ])
    first = clauses[0]
    note = F.when(fired, notes).otherwise(f"{first.column} -> {first.value}")
    changed = {}
    for hit, clause in zip(hits, clauses, strict=True):
        value = F.when(hit, F.lit(clause.clear))
        if clause is first:
            value = value.when(~fired, F.lit(clause.value))
        changed[clause.column] = value.otherwise(F.col(clause.column))
    return df.select("*", note.alias("flip_note"), F.when(fired, 0).otherwise(1).alias("flipped_rule"),
                     *[v.alias(f"flipped_{k}") for k, v in changed.items()])


def _counts(cond: Column, y: Column, name: str) -> list[Column]:
    return [F.count_if(cond).alias(f"{name}_rows"),
            F.coalesce(F.sum(F.when(cond, y)), F.lit(0)).cast("bigint").alias(f"{name}_positives")]


def rule_clauses(df: DataFrame, clauses: Sequence[Clause], target: str, named: dict[str, dict[str, str]] | None = None,
                 missing: str = "nan") -> DataFrame:
    """One row: rows and positives of each clause, both, neither and any named cells.

    These counts compare untrimmed text; ``mismatches`` uses the trimmed rule.
    """
    y = F.col(target).cast("int")
    a, b = (F.coalesce(F.col(c.column).cast("string"), F.lit(missing)) == c.value for c in clauses)
    aggs = [*_counts(a, y, "first"), *_counts(b, y, "second"), *_counts(a & b, y, "both"),
            *_counts(~(a | b), y, "neither")]
    for name, cell in (named or {}).items():
        cond = F.lit(True)
        for column, value in cell.items():
            cond = cond & (F.coalesce(F.col(column).cast("string"), F.lit(missing)) == value)
        aggs += _counts(cond, y, name)
    aggs += [F.count_if(rules.any_clause(clauses) != y).alias("mismatches"), F.count("*").alias("n")]
    return df.agg(*aggs)


def rule_crosstab(df: DataFrame, rows: str, cols: str, target: str, missing: str = "nan") -> DataFrame:
    """Rows and positives of every ``rows`` x ``cols`` value cell, empty cells included.

    One aggregation over the data; the grid is then filled from the distinct values of the
    (already aggregated) cells, so its size is that of the output.
    """
    r = F.coalesce(F.col(rows).cast("string"), F.lit(missing)).alias(rows)
    c = F.coalesce(F.col(cols).cast("string"), F.lit(missing)).alias(cols)
    cells = df.groupBy(r, c).agg(
        F.count("*").alias("n_rows"), F.sum(F.col(target).cast("int")).cast("bigint").alias("positives"))
    col_values = cells.agg(F.array_sort(F.collect_set(cols)).alias("v")).scalar()
    by_row = cells.groupBy(rows).agg(
        F.map_from_entries(F.collect_list(F.struct(cols, F.struct("n_rows", "positives")))).alias("_cells"))
    grid = by_row.select(rows, "_cells", F.explode(col_values).alias(cols))
    cell = F.try_element_at(F.col("_cells"), F.col(cols))
    return grid.select(rows, cols, F.coalesce(cell["n_rows"], F.lit(0)).alias("n_rows"),
                       F.coalesce(cell["positives"], F.lit(0)).alias("positives"))


def rate_matrix(df: DataFrame, rows: str, cols: str, target: str, col_values: Sequence[str]) -> DataFrame:
    """Pivot: count and mean label per cell for the given column values; empty cells null."""
    return df.groupBy(rows).pivot(cols, list(col_values)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("rate"))


def category_counts(df: DataFrame, columns: Sequence[str], missing: str = "None") -> DataFrame:
    """``column, value, n`` for many columns in one pass; nulls are counted under ``missing``."""
    wide = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def label_summary(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(target).cast("int")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"),
        ratio(F.count_if(y == 1), F.count("*"), None).alias("rate"))


def present_by_label(df: DataFrame, column: str, target: str, missing: str = "None") -> DataFrame:
    """Per label: rows whose field holds something other than the missing token."""
    present = F.coalesce(F.col(column).cast("string"), F.lit(missing)) != missing
    return df.groupBy(F.col(target).alias("label")).agg(F.count("*").alias("n"), F.count_if(present).alias("present"))
