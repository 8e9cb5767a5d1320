"""Jobs between tables, record texts and chat records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

_FLOATS = (T.DoubleType, T.FloatType)


def missing_columns(df: DataFrame, fields: Sequence[str]) -> list[str]:
    """Wanted fields the table does not have, in the wanted order."""
    return [f for f in fields if f not in df.columns]


def conform(df: DataFrame, fields: Sequence[str], numeric: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``fields`` in order (plus ``keep``): absent ones null, numerics coerced."""
    absent = set(missing_columns(df, fields))

    def pick(name: str) -> Column:
        source = F.lit(None).cast("string") if name in absent else F.col(name)
        if name in numeric:
            source = source.cast("string").try_cast("double")
        return source.alias(name)

    return df.select(*keep, *[pick(f) for f in fields])


def _is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _FLOATS)


def render(df: DataFrame, fields: Sequence[str], out: str = "text", missing: str = "None") -> DataFrame:
    """Add the record text: one ``Field: value`` line per field, in argument order.

    A field the table lacks is rendered as ``missing``, as a null would be.
    """
    absent = set(missing_columns(df, fields))
    parts = [
        F.concat(
            F.lit(f"{f}: "),
            F.lit(missing) if f in absent else tx.clean_value(F.col(f), missing, floating=_is_float(df, f)),
        )
        for f in fields
    ]
    return df.withColumn(out, F.concat_ws("\n", *parts))


def render_sparse(df: DataFrame, fields: Sequence[str], out: str = "text") -> DataFrame:
    """Like :func:`render`, but null and blank fields are left out; values stay untrimmed."""
    parts = [F.when(tx.blank_to_null(F.col(f).cast("string")).isNotNull(),
                    F.concat(F.lit(f"{f}: "), F.col(f).cast("string"))) for f in fields]
    return df.withColumn(out, F.concat_ws("\n", *parts))  # concat_ws skips nulls


def to_chat(df: DataFrame, target: str, system: str, out: str = "conversations", keep: Sequence[str] = ()) -> DataFrame:
    """Three-turn chat records; ``target`` must be the table's last column.

    Here a missing value becomes an empty text, not a token.
    """
    if not df.columns or df.columns[-1] != target:
        last = df.columns[-1] if df.columns else None
        raise ValueError(f"last column is {last!r}, expected {target!r}")
    fields = [c for c in df.columns[:-1] if c not in keep]
    user = F.concat_ws("\n", *[
        F.concat(F.lit(f"{c}: "), F.coalesce(tx.strip(F.col(c).cast("string")), F.lit(""))) for c in fields
    ])
    label = tx.strip(F.col(target).cast("string")).cast("int")
    answer = F.concat(F.lit(f"{target}: "), F.coalesce(
        label.cast("string"), F.raise_error(F.lit(f"null or malformed value in target column {target}"))))
    turns = F.array(
        F.struct(F.lit("system").alias("from"), F.lit(system).alias("value")),
        F.struct(F.lit("user").alias("from"), user.alias("value")),
        F.struct(F.lit("assistant").alias("from"), answer.alias("value")),
    )
    return df.select(*keep, turns.alias(out))


def to_messages(df: DataFrame, text: str, system: str, out: str = "messages") -> DataFrame:
    """Two-message prompt (system, user) for a chat scorer."""
    return df.withColumn(out, F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(text).alias("content")),
    ))


def decode(df: DataFrame, text: str, fields: Sequence[str] | None = None, numeric: Sequence[str] = (),
           out: str = "fields", keep: Sequence[str] = ()) -> DataFrame:
    """Parse record texts: a map column, or one column per wanted field."""
    if fields is None:
        staged = df.withColumn("_pairs", tx.entries(F.col(text))).withColumn("_keys", tx.keys_from_end(F.col("_pairs")))
        return staged.withColumn(out, tx.last_wins_map(F.col("_pairs"), F.col("_keys"))).drop("_pairs", "_keys")
    tails = df.select(*keep, *[tx.last_line_tail(F.col(text), f).alias(f) for f in fields])
    wide = tails.select(*keep, *[tx.tail_value(F.col(f)).alias(f) for f in fields])
    return conform(wide, fields, numeric, keep)


def parse_answers(df: DataFrame, raw: str, target: str, out: str = "label") -> DataFrame:
    return df.withColumn(out, tx.answer_label(F.col(raw), target))


def clean_outputs(df: DataFrame, raw: str, out: str = "cleaned") -> DataFrame:
    """Trim the lines of raw model outputs, drop blank ones and a leading speaker line."""
    staged = df.withColumn("_lines", tx.output_lines(F.col(raw)))
    return staged.withColumn(out, tx.without_speaker(F.col("_lines"))).drop("_lines")


def turn_value(conversations: str, position: int) -> Column:
    """Text of the turn at ``position`` (0-based); null when the record is shorter."""
    return F.try_element_at(F.col(conversations), F.lit(position + 1))["value"]


def gold_from_chat(df: DataFrame, target: str, conversations: str = "conversations", *,
                   on_error: str = "raise") -> DataFrame:
    """Add ``user_text`` and ``gold`` from the second and third turn.

    ``on_error='raise'`` fails the job on an unparsable answer, ``'null'`` leaves gold null.
    """
    answer = turn_value(conversations, 2)
    gold = tx.answer_label(answer, target)
    if on_error == "raise":
        gold = F.coalesce(gold, F.raise_error(
            F.concat(F.lit("unparsable gold answer: "), F.coalesce(answer, F.lit("<missing turn>")))).cast("int"))
    return df.withColumn("user_text", turn_value(conversations, 1)).withColumn("gold", gold)


def chat_rejects(df: DataFrame, target: str, conversations: str = "conversations") -> DataFrame:
    """Chat records whose answer turn is missing or unparsable."""
    return df.filter(tx.answer_label(turn_value(conversations, 2), target).isNull())
