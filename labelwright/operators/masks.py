"""Token-level jobs over chat data: response masks and length profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def response_labels(tokens: Column, prefix: Sequence[int], suffix: Sequence[int]) -> Column:
    """Training labels: the token inside a response, -100 elsewhere.

    A response runs from the token after a full ``prefix`` through the first token of the
    next ``suffix`` (to the end when no suffix token follows). A prefix whose next suffix
    start is not a full suffix opens no response. The last token is always kept, unless the
    sequence ends right after a prefix.

    Built-in functions only. The starts of prefixes, and the places of suffix tokens with what stands there, are two short
    arrays; one fold over the prefixes carries where the next one may start and gives the kept ranges, which the last step reads beside the tokens.
    """
    head, tail = list(prefix), list(suffix)
    size = F.size(tokens)
    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))

    def stands(pattern: list[int], at: Column) -> Column:
        """The whole pattern stands at a place (from 1)."""
        hit = at + (len(pattern) - 1) <= size
        for i, token in enumerate(pattern):
            hit = hit & (F.get(tokens, at - 1 + i) == token)
        return F.coalesce(hit, F.lit(False))

    opens = F.filter(places, lambda at: stands(head, at))
    ends = F.filter(places, lambda at: F.coalesce(F.get(tokens, at - 1) == tail[0], F.lit(False)))
    none = F.array().cast("array<struct<a:int,b:int>>")
    zero = F.struct(F.lit(1).alias("free"), none.alias("kept"), F.lit(False).alias("bare"), ends.alias("ends"))

    def step(state: Column, at: Column) -> Column:
        body = at + len(head)
        # places of suffix tokens ascend, and prefixes do too: what lies before this body is not needed any more
        left = F.filter(state["ends"], lambda e: e >= body)
        end = F.get(left, 0)
        open_ = F.struct(F.lit(2**31 - 1).alias("free"), F.concat(state["kept"], F.array(F.struct(body.alias("a"), size.alias("b")))).alias("kept"),
                         (body > size).alias("bare"), left.alias("ends"))
        closed = F.struct((end + len(tail)).alias("free"), F.concat(state["kept"], F.array(F.struct(body.alias("a"), end.alias("b")))).alias("kept"),
                          state["bare"].alias("bare"), left.alias("ends"))
        broken = F.struct((end + 1).alias("free"), state["kept"].alias("kept"), state["bare"].alias("bare"), left.alias("ends"))
        return F.when(at < state["free"], state).otherwise(F.when(end.isNull(), open_).otherwise(F.when(stands(tail, end), closed).otherwise(broken)))

    found = F.aggregate(opens, zero, step, lambda s: F.struct(s["kept"].alias("kept"), s["bare"].alias("bare")))

    def labelled(state: Column) -> Column:
        # ranges ascend and do not meet, so the last one that begins before a token decides
        return F.transform(tokens, lambda t, i: F.when(
            F.exists(state["kept"], lambda r: (r["a"] <= i + 1) & (i + 1 <= r["b"])) | ((i + 1 == size) & ~state["bare"]), t).otherwise(IGNORED).cast("int"))

    return F.when(tokens.isNotNull(), F.get(F.transform(F.array(found), labelled), 0))


def mask_profile(df: DataFrame, tokens: str, prefix: Sequence[int], suffix: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Tokens, kept tokens, their share, and records without any response, per group."""
    labelled = df.select(*by, F.size(tokens).alias("_n"), response_labels(F.col(tokens), prefix, suffix).alias("_l"))
    kept = F.size(F.filter(F.col("_l"), lambda t: t != IGNORED))
    counted = labelled.select(*by, "_n", kept.alias("_k"))
    return counted.groupBy(*by).agg(
        F.count("*").alias("records"), F.sum("_n").cast("bigint").alias("tokens"),
        F.sum("_k").cast("bigint").alias("kept_tokens"), (F.sum("_k") / F.sum("_n")).alias("kept_share"))


def length_profile(df: DataFrame, text: Column, limit: int, by: Sequence[str] = (), record: Sequence[str] = ()) -> DataFrame:
    """White-space tokens per record: total, longest, and total after cutting at ``limit``.

    When a record is spread over several rows (say, the turns of a conversation), ``record``
    names its key: the rows are counted apart and summed, and a record belongs to the largest
    ``by`` values among its rows.
    """
    n = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    counted = df.select(*record, *by, n.cast("bigint").alias("_n"))
    if record:
        counted = counted.groupBy(*record).agg(F.sum("_n").alias("_n"), *[F.max(b).alias(b) for b in by])
    return counted.groupBy(*by).agg(
        F.count("*").alias("records"), F.sum("_n").alias("tokens"), F.max("_n").alias("longest"),
        F.sum(F.least(F.col("_n"), F.lit(limit))).alias("tokens_after_cut"),
        F.count_if(F.col("_n") > limit).alias("cut_records"))
