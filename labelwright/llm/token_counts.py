"""Token counts of documents without their token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin, take, text_of
from .frequencies import commonest, pretoken_counts

#: Pre-tokens whose counts every task holds; the others are joined. It changes the cost, never the result.
HEAD = 200_000


def _splitter():
    """Pre-tokens of a sentence-piece text: pieces never reach over them.

    A space is written as the mark U+2581, also in front of the text. No piece holds a mark
    behind another character, and none holds a line feed: so a text falls into marks with what
    follows them, and line feeds.
    """
    import re

    mark = "▁"
    find = re.compile(f"\n|{mark}*[^{mark}\n]+|{mark}+").findall
    return lambda text: find(mark + text.replace(" ", mark))


def _counter(model_path: str):
    """Pieces of each pre-token, from the library, in lists."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    mark = "▁"

    def counts(tokens: list[str]) -> list[int]:
        # the library puts a mark in front itself; behind a line feed a pre-token may have none
        asked = [t[1:].replace(mark, " ") if t[0] == mark else "\n" + t for t in tokens]
        for i, t in enumerate(tokens):
            if t == mark:
                asked[i] = "\n "
        found = model.encode(asked, num_threads=1)
        return [len(ids) - (0 if t[0] == mark and t != mark else 2) for t, ids in zip(tokens, found, strict=True)]

    return counts


def _count_pieces(counts: DataFrame, model_path: str) -> DataFrame:
    def count(batches):
        import pyarrow as pa

        pieces = _counter(model_path)
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces(tokens) if tokens else [], pa.int64())],
                                             names=["token", "freq", "pieces"])

    return counts.select("token", "freq").mapInArrow(count, "token string, freq bigint, pieces bigint")


def token_counts(docs: DataFrame, model_path: str, *, limit: int = 4096, head: int = HEAD, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row of ``docs``.

    Every distinct pre-token of the corpus is counted once by the sentence-piece model. Each
    document's pre-token frequencies are joined with those counts and summed. The commonest
    ``head`` pre-tokens, a table of bounded size, meet the frequencies in the task that reads
    the document, which also takes the hot keys out of the join; all others are joined on the
    pre-token.

    Null text is empty: 0 bytes, 0 tokens. Rows that repeat id and text give equal rows; ids may be
    null or repeat. Texts are taken whole. An empty table gives an empty result; other columns are ignored.
    """
    rows = take(docs, id_col, text_col).toDF("doc_id", "text")
    pieces = pin(_count_pieces(pretoken_counts(rows, "text", lambda: (_splitter(), None)), model_path), "snappy")
    common = rows.sparkSession.sparkContext.broadcast(
        {r["token"]: r["pieces"] for r in commonest(pieces, head).select("token", "pieces").collect()})

    def frequencies(batches):
        from collections import Counter

        import pyarrow as pa

        cut, known = _splitter(), common.value.get
        names = ["doc_id", "mark", "rows", "bytes", "known", "token", "freq"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, ones, size, sums, rare, times = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    total, own = 0, []
                    for token, n in Counter(cut(text) if text else ()).items():
                        count = known(token)
                        if count is None:
                            own.append((token, n))
                        else:
                            total += count * n
                    own = own or [(None, 0)]
                    row += [i] * len(own)
                    ones += [1] + [0] * (len(own) - 1)
                    size += [len(text.encode()) if text else 0] + [0] * (len(own) - 1)
                    sums += [total] + [0] * (len(own) - 1)
                    rare += [t for t, _ in own]
                    times += [n for _, n in own]
                index = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(index), part.column(2).take(index), pa.array(ones, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(sums, pa.int64()), pa.array(rare, pa.string()), pa.array(times, pa.int64())], names=names)

    # a row is known by its id and a hash of its text, the same whenever a lost task runs again
    marked = rows.select("doc_id", "text", F.xxhash64(text_of("text")).alias("mark"))
    kind = docs.schema[docs.columns.index(id_col)].dataType.simpleString()
    found = marked.mapInArrow(frequencies, f"doc_id {kind}, mark bigint, rows bigint, bytes bigint, known bigint, token string, freq bigint")
    # rows without rare pre-tokens match nothing; a key of their own keeps them from meeting in one task
    found = found.withColumn("token", F.coalesce("token", F.concat(F.lit("\n\n"), F.col("mark").cast("string"))))
    joined = found.join(pieces.select("token", "pieces"), "token", "left")
    sums = joined.groupBy("doc_id", "mark").agg(
        F.sum("rows").alias("_rows"), F.sum("bytes").alias("_bytes"),
        F.sum(F.col("known") + F.coalesce(F.col("freq") * F.col("pieces"), F.lit(0))).alias("_sum"))
    # rows that repeat id and text were added up: share the sums out again
    each = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))))
    n_tokens = F.expr("_sum div _rows")
    return each.select("doc_id", F.expr("_bytes div _rows").alias("n_bytes"), n_tokens.alias("n_tokens"),
                       (n_tokens > limit).alias("over_limit"))
