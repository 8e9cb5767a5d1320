"""Frequencies of pre-tokens over a whole corpus, and the bounded table of the commonest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import size_of

#: Bytes of counts that a task holds before it hands them on, and characters of text between two looks at them.
HELD, LOOK = 48_000_000, 2_000_000
#: Characters of the longest pre-token that may enter the broadcast table of the commonest.
HEAD_CHARS = 64


def pretoken_counts(rows: DataFrame, text_col: str, split: Callable[[], tuple[Callable, Callable | None]], *, whole_batches: bool = False) -> DataFrame:
    """(token, freq) over all rows. ``split()`` is called once per task and gives (cut, expand).

    ``cut`` takes a text into parts, which are counted; with ``whole_batches`` it takes a column of texts into (distinct parts,
    times of each) of blocks of them. ``expand`` takes a distinct part into its tokens, or is
    None where parts are tokens. Each task counts locally, so a token in every text is one short row per task.
    """
    limit, look = HELD, LOOK

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        (cut, expand), counts, seen = split(), Counter(), 0

        def out():
            found = counts
            if expand:
                found = Counter()
                while counts:  # one table grows as the other shrinks
                    part, n = counts.popitem()
                    for token in expand(part):
                        found[token] += n
            keys, times = [], []
            while found:
                key, n = found.popitem()
                keys.append(key)
                times.append(n)
                if len(keys) == 50_000 or not found:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int64())], names=["token", "freq"])
                    keys, times = [], []

        for batch in batches:
            if whole_batches:
                for parts, times in cut(batch.column(0)):
                    for part, n in zip(parts, times, strict=True):
                        if n:
                            old = counts.get(part)
                            if old is None:
                                seen += size_of(part)
                                counts[part] = n
                            else:
                                counts[part] = old + n
                    if seen > limit:
                        seen = 0
                        yield from out()
                continue
            for text in batch.column(0):
                if text := text.as_py():
                    counts.update(cut(text))
                    seen += len(text)
                    if seen > look:
                        seen = 0
                        if sum(map(size_of, counts)) > limit:
                            yield from out()
        yield from out()

    return rows.select(text_col).mapInArrow(count, "token string, freq bigint").groupBy("token").agg(F.sum("freq").alias("freq"))


def commonest(counts: DataFrame, n: int) -> DataFrame:
    """At most ``n`` of the commonest pre-tokens of at most ``HEAD_CHARS`` characters: bounded, so they may be broadcast.

    Frequencies are counted in steps of a twelfth of a power of two, and the steps that fit into ``n`` from the
    top are taken whole: no sort, and nothing but these counts and the rows asked for reaches the driver.
    ``counts`` is read twice and should be written down.
    """
    short = counts.filter(F.char_length("token") <= HEAD_CHARS).withColumn("_step", F.floor(12 * F.log2("freq")))
    steps = sorted(((r["_step"], r["count"]) for r in short.groupBy("_step").count().collect()), reverse=True)  # below 800
    total, least = 0, None
    for step, size in steps:
        total += size
        if total > n:
            break
        least = step
    return short.filter(F.lit(False) if least is None else F.col("_step") >= least).drop("_step")
