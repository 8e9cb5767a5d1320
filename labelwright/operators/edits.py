"""Edit plans: rewrite cohorts of records in controlled ways, all in one pass.

A plan is a short, fixed list of :class:`Edit` entries (configuration, not data). Each
record is paired with the entries of the cohorts it belongs to by exploding a literal, so
the job needs no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

ORDER_SEPARATOR = "\n"


@dataclass(frozen=True)
class Step:
    """One text edit: ``set``/``rename``/``drop``/``append``/``reorder``."""

    op: str
    name: str = ""
    value: str = ""


@dataclass(frozen=True)
class Edit:
    """One plan entry: which cohort is rewritten, how, and what is expected afterwards."""

    key: str
    group: str
    cohort: str
    steps: tuple[Step, ...]
    expected: int | None = None
    expected_kind: str = "none"
    meta: dict[str, str] = field(default_factory=dict)


def set_to(name: str, value: str) -> Step:
    return Step("set", name, value)


def drop(*names: str) -> tuple[Step, ...]:
    return tuple(Step("drop", n) for n in names)


def _clean(value: str) -> str:
    """A plan's value as it is written into a record (the plan is cleaned once, not per row)."""
    return value.strip() or "None"


def _apply_step(df: DataFrame, entry: Column, i: int, on_error: str) -> DataFrame:
    """Columns ``_text`` -> ``_text`` by step ``i`` of the row's plan entry.

    Line positions are staged as columns of their own, so each is computed once per row.
    """
    op, name, value = (entry[f"{part}{i}"] for part in ("op", "name", "value"))
    text, lines, at = F.col("_text"), F.col("_lines"), F.col("_at")
    lined = F.when(op.isin("set", "rename"), tx.framed(text))
    staged = df.withColumn("_lines", lined).withColumn("_at", tx.line_start(lines, name)).withColumn(
        "_keyed", F.when(op == "reorder", tx.keyed_lines(text)))
    done = (
        F.when(op.isNull(), text)
        .when(op == "set", tx.set_at(text, lines, at, name, value))
        .when(op == "rename", tx.rename_at(text, at, name, value))
        .when(op == "drop", tx.drop_lines(text, name))
        .when(op == "append", tx.append_line(text, value))
        .when(op == "reorder", tx.reorder_lines(F.col("_keyed"), F.split(value, ORDER_SEPARATOR, -1)))
    )
    done = _checked(done, F.concat(F.lit("plan entry "), entry["key"]), on_error)
    return staged.withColumn("_text", done).drop("_lines", "_at", "_keyed")


def _checked(result: Column, what: Column, on_error: str) -> Column:
    """Fail the job on a step that did not fit, or leave null (``on_error='null'``)."""
    if on_error == "null":
        return result
    return F.coalesce(result, F.raise_error(F.concat(F.lit("edit does not fit the record: "), what)))


def edit_column(df: DataFrame, text: str, steps: Iterable[Step], out: str = "text", on_error: str = "raise") -> DataFrame:
    """Apply the same steps, left to right, to every record of a table."""
    work = df.withColumn("_text", F.col(text))
    for step in steps:
        t, name, value = F.col("_text"), F.lit(step.name), F.lit(step.value)
        if step.op in ("set", "rename"):
            work = work.withColumn("_lines", tx.framed(t)).withColumn("_at", tx.line_start(F.col("_lines"), name))
            done = (tx.set_at(t, F.col("_lines"), F.col("_at"), name, F.lit(_clean(step.value))) if step.op == "set"
                    else tx.rename_at(t, F.col("_at"), name, value))
        elif step.op == "reorder":
            work = work.withColumn("_keyed", tx.keyed_lines(t))
            done = tx.reorder_lines(F.col("_keyed"), F.split(value, ORDER_SEPARATOR, -1))
        else:
            done = tx.drop_lines(t, [step.name]) if step.op == "drop" else tx.append_line(t, value)
        work = work.withColumn("_text", _checked(done, F.lit(f"{step.op} {step.name}"), on_error))
    return work.withColumn(out, F.col("_text")).drop("_text", "_lines", "_at", "_keyed")


def seeded_order(seed: int, fields: Sequence[str]) -> list[str]:
    """A fixed permutation of the field names per seed (names only, so driver-sized)."""
    import hashlib

    return sorted(fields, key=lambda f: hashlib.md5(f"{seed}|{f}".encode()).hexdigest())


def reorder(order: Sequence[str]) -> Step:
    return Step("reorder", "", ORDER_SEPARATOR.join(order))


def _prepared(plan: Sequence[Edit]) -> tuple[list[str], list[tuple[str, ...]]]:
    """The lines that first steps set, and the sets of names that they reorder: what is looked up once per record."""
    first = [e.steps[0] for e in plan if e.steps]
    orders = [tuple(sorted(set(s.value.split(ORDER_SEPARATOR)))) for s in first if s.op == "reorder"]
    return list(dict.fromkeys(s.name for s in first if s.op == "set")), list(dict.fromkeys(orders))


def _first_step(df: DataFrame, entry: Column, on_error: str) -> DataFrame:
    """Like :func:`_apply_step` for the first step, with what :func:`apply_plan` looked up in the record."""
    op, name, value = (entry[f"{part}0"] for part in ("op", "name", "value"))
    text, cut, lines = F.col("_text"), F.get("_cuts", entry["cut"]), F.get("_picked", entry["picked"])
    at = F.when(op == "rename", tx.line_start(tx.framed(text), name))
    staged = df.withColumn("_at", at).withColumn("_cut", cut)
    done = (
        F.when(op == "set", F.concat(F.col("_cut.head"), value, F.col("_cut.tail")))
        .when(op.isNull(), text)
        .when(op == "rename", tx.rename_at(text, F.col("_at"), name, value))
        .when(op == "drop", tx.drop_lines(text, name))
        .when(op == "append", tx.append_line(text, value))
        .when((op == "reorder") & lines.isNotNull(), F.array_join(F.transform(entry["order"], lambda i: F.get(lines, i)), "\n"))
    )
    done = _checked(done, F.concat(F.lit("plan entry "), entry["key"]), on_error)
    return staged.withColumn("_text", done).drop("_at", "_cut", "_cuts", "_picked")


def _plan_literal(plan: Sequence[Edit]) -> tuple[Column, Column, int]:
    """The plan as constants: ``array<struct<key, cut, picked, order, op0, name0, value0, ...>>``, the positions
    of each cohort's entries as ``map<cohort, array<int>>``, and the most steps of an entry.

    ``cut`` and ``picked`` say which of the :func:`_prepared` lookups the first step needs, ``order`` the places of its lines there."""
    depth = max((len(e.steps) for e in plan), default=0)
    names, sets = _prepared(plan)

    def entry(e: Edit) -> Column:
        first = e.steps[0] if e.steps else None
        order = first.value.split(ORDER_SEPARATOR) if first and first.op == "reorder" else None
        known = tuple(sorted(set(order))) if order else None
        cells = [F.lit(e.key).alias("key"), F.lit(names.index(first.name) if first and first.op == "set" else None).cast("int").alias("cut"),
                 F.lit(sets.index(known) if known else None).cast("int").alias("picked"),
                 (F.array(*[F.lit(known.index(n)) for n in order]) if order else F.lit(None)).cast("array<int>").alias("order")]
        for i in range(depth):
            step = e.steps[i] if i < len(e.steps) else None
            for part in ("op", "name", "value"):
                cell = getattr(step, part) if step else None
                if part == "value" and step and step.op == "set":
                    cell = _clean(cell)
                cells.append(F.lit(cell).cast("string").alias(f"{part}{i}"))
        return F.struct(*cells)

    positions: list[Column] = []
    for cohort in dict.fromkeys(e.cohort for e in plan):
        positions += [F.lit(cohort), F.array(*[F.lit(i) for i, e in enumerate(plan) if e.cohort == cohort])]
    return F.array(*[entry(e) for e in plan]), F.create_map(*positions), depth


def apply_plan(records: DataFrame, plan: Sequence[Edit], cohorts: dict[str, Column], *, text: str = "text",
               row_id: str = "row_id", keep: Sequence[str] = (), on_error: str = "raise") -> DataFrame:
    """One row per (plan entry, record of its cohort): ``probe_key, row_id, keep..., text``.

    ``cohorts`` maps cohort names to boolean columns of ``records``.
    """
    if len({e.key for e in plan}) != len(plan):
        raise ValueError("plan keys must be unique")
    unknown = {e.cohort for e in plan} - set(cohorts)
    if unknown:
        raise ValueError(f"plan uses undefined cohorts: {sorted(unknown)}")
    used = [c for c in cohorts if any(e.cohort == c for e in plan)]
    entries, positions, depth = _plan_literal(plan)
    member = F.array_compact(F.array(*[F.when(cohorts[c], F.lit(c)) for c in used]))
    fitting = F.flatten(F.transform(member, lambda c: F.try_element_at(positions, c)))
    # what first steps look up in a text is looked up once per record, not once per entry
    names, sets = _prepared(plan)
    base = records.select("*", tx.framed(F.col(text)).alias("_lines")).select(
        "*", *[tx.line_start(F.col("_lines"), F.lit(n)).alias(f"_at{i}") for i, n in enumerate(names)],
        *([tx.keyed_lines(F.col(text)).alias("_keyed")] if sets else []))
    cuts = F.array(*[tx.cut_at(F.col(text), F.col("_lines"), F.col(f"_at{i}"), n) for i, n in enumerate(names)])
    picked = F.array(*[tx.picked_lines(F.col("_keyed"), F.array(*map(F.lit, s))) for s in sets])
    no_cuts, no_lines = F.lit(None).cast("array<struct<head:string,tail:string>>"), F.lit(None).cast("array<array<string>>")
    # only positions are exploded; the entry itself is looked up in the constant
    paired = base.select(row_id, *keep, F.col(text).alias("_text"), (cuts if names else no_cuts).alias("_cuts"),
                         (picked if sets else no_lines).alias("_picked"), fitting.alias("_fitting")).select(
        row_id, *keep, "_text", "_cuts", "_picked", F.explode("_fitting").alias("_i"))
    for i in range(depth):
        entry = entries[F.col("_i")]
        paired = _apply_step(paired, entry, i, on_error) if i else _first_step(paired, entry, on_error)
    if not depth:
        paired = paired.drop("_cuts", "_picked")
    return paired.select(entries[F.col("_i")]["key"].alias("probe_key"), row_id, *keep, F.col("_text").alias("text"))


def plan_table(spark: SparkSession, plan: Sequence[Edit]) -> DataFrame:
    """The plan as a small table: one row per entry."""
    rows = [(e.key, e.group, e.cohort, e.expected, e.expected_kind, dict(e.meta)) for e in plan]
    return spark.createDataFrame(
        rows, "probe_key string, probe_group string, cohort string, expected int, expected_kind string, "
              "meta map<string,string>")


__all__ = [
    "Edit", "Step", "apply_plan", "drop", "edit_column", "plan_table", "reorder",
    "seeded_order", "set_to",
]
