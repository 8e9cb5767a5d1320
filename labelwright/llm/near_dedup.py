"""Near duplicates among whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin, take, text_of, unpack_row, with_row
from .linking import SHINGLE, THRESHOLD, crowded, linked_classes, verify_texts, words

#: Bands and registers per band: a pair of similarity 0.8 meets with probability 0.9998, one of 0.5 with 0.17.
BANDS, ROWS = 48, 8
#: Bits of the parity sketch of a shingle set. Two sets differ in at least as many shingles as their sketches in bits, so a
#: pair that is told apart by them is never similar; the more bits, the longer the texts that can be told apart.
PARITIES = 1024


def prob_minhash(hashes, weights, docs, n_docs: int, registers: int):
    """ProbMinHash signatures of many weighted sets at once: an array (n_docs, registers) of element hashes.

    Every element sends arrivals to random registers; the gaps between arrivals are exponential
    with the element's weight as rate. A register keeps the element of its earliest arrival, so two
    sets agree in a register with the probability that is their probability Jaccard. An element stops when its next
    arrival comes after the latest register of its set. Gaps and registers depend on element
    and arrival number alone. Registers of an empty set are 0.
    """
    import numpy as np

    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    first = np.full(n_docs * registers, np.inf)
    kept = np.zeros(n_docs * registers, np.uint64)
    open_, at, drawn, block = np.arange(len(hashes)), np.zeros(len(hashes)), 0, 1
    latest = np.full(n_docs, np.inf)
    while len(open_):
        steps = np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = mix(hashes[open_][:, None] + steps[None, :])
        gaps = -np.log((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights[open_][:, None]
        times = at[open_][:, None] + np.cumsum(gaps, axis=1)
        slot = docs[open_][:, None] * registers + (mix(bits) % np.uint64(registers)).astype(np.int64)
        live = times < latest[docs[open_]][:, None]
        flat, when, who = slot[live], times[live], np.broadcast_to(hashes[open_][:, None], slot.shape)[live]
        np.minimum.at(first, flat, when)
        won = when == first[flat]
        kept[flat[won]] = who[won]
        touched = np.unique(docs[open_])
        latest[touched] = first.reshape(n_docs, registers)[touched].max(axis=1)
        at[open_] = times[:, -1]
        open_ = open_[times[:, -1] < latest[docs[open_]]]
        drawn += block
        block = min(2 * block, 64)
    return kept.reshape(n_docs, registers)


def signatures(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, key, bands, n, sketch) from (doc_id, text): ``key`` is a 128-bit hash of the words, ``bands`` one
    number per band, ``n`` the number of distinct shingles, ``sketch`` whether the shingles that fall to each of ``PARITIES``
    slots are odd in number, in 64-bit numbers.

    Elements are the shingles of ``size`` words; each weighs 1 however often it occurs, as in the
    verdict. Texts of fewer words are one
    shingle; texts without words have no bands.
    """
    staged = docs.select("doc_id", words(text_of("text")).alias("_w"))
    staged = staged.select("doc_id", F.unhex(F.md5(F.array_join("_w", " ").cast("binary"))).alias("key"),
                           F.transform("_w", lambda w: F.xxhash64(w)).alias("_w"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        odd = np.uint64(0x9E3779B97F4A7C15)

        def shingle_hashes(flat, ends):
            """(hash, document) of every shingle in the words of many documents."""
            lengths = np.diff(ends)
            count = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
            doc = np.repeat(np.arange(len(lengths)), count)
            start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends[:-1], count)
            value = np.zeros(len(doc), np.uint64)
            for k in range(size):
                there = start + k < ends[1:][doc]
                word = np.where(there, flat[np.minimum(start + k, max(len(flat) - 1, 0))], np.uint64(0))
                value = (value ^ (value >> np.uint64(29))) * odd + word + np.uint64(1)
            return value, doc

        def banded(part):
            column = part.column(2)
            ends = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].view(np.uint64)
            value, doc = shingle_hashes(flat, ends - ends[0])
            order = np.lexsort((value, doc))
            value, doc = value[order], doc[order]
            new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
            value, doc = value[new], doc[new]
            kept = prob_minhash(value, np.ones(len(value)), doc, part.num_rows, bands * rows).reshape(part.num_rows, bands, rows)
            number = np.arange(bands, dtype=np.uint64)[None, :] * odd + np.uint64(1)
            for k in range(rows):
                number = (number ^ (number >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + kept[:, :, k]
            filled = np.diff(ends) > 0
            sizes = np.r_[0, np.cumsum(np.where(filled, bands, 0))]
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(number[filled].reshape(-1).view(np.int64)))
            slot = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)
            fell = np.bincount(doc * PARITIES + (slot % np.uint64(PARITIES)).astype(np.int64), minlength=part.num_rows * PARITIES)
            bits = np.packbits((fell & 1).astype(np.uint8)).view(np.int64)
            sketch = pa.FixedSizeListArray.from_arrays(pa.array(bits), PARITIES // 64).cast(pa.list_(pa.int64()))
            n = pa.array(np.bincount(doc, minlength=part.num_rows).astype(np.int64))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, n, sketch], names=["doc_id", "key", "bands", "n", "sketch"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield banded(batch.slice(at, 256))

    return staged.mapInArrow(sign, f"doc_id {kind}, key binary, bands array<bigint>, n bigint, sketch array<bigint>")


def near_classes(docs: DataFrame, *, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links) of (doc_id, text) rows.

    ``members``: doc_id, key, times (rows with this id and key) and class, a key. Rows of equal words are one key,
    whose copies are never compared. ``links``: the verified pairs (a, b, similarity) of different keys.
    """
    signed = pin(signatures(docs))
    distinct = pin(signed.groupBy("key").agg(F.first("bands").alias("bands"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    rows = crowded(distinct.select(F.explode("bands").alias("bucket"), "key"))
    texts = docs.select(words(text_of("text")).alias("_w")).select(F.array_join("_w", " ").alias("text"))
    texts = texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    # copies are dropped before they are sent; only texts that meet another are kept
    texts = pin(texts.groupBy("key").agg(F.first("text").alias("text")).join(rows.select("key").distinct(), "key", "left_semi"), "lz4")
    part = PARITIES // 64
    sketches = distinct.select("key", "bands", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(part)])

    def alike(x: str, y: str) -> Column:
        differ = F.abs(F.col(f"{x}.n") - F.col(f"{y}.n"))
        parity = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(part)])
        # of two sets with n shingles together and similarity t, n * (1 - t) / (1 + t) stand in one only
        most = (F.col(f"{x}.n") + F.col(f"{y}.n")) * ((1 - threshold) / (1 + threshold)) + 1e-6
        # a pair that meets in several buckets counts in the first of them
        shared = F.filter(F.zip_with(f"{x}.bands", f"{y}.bands", lambda a, b: F.when(a == b, a)), lambda a: a.isNotNull())
        return (differ <= most) & (parity <= most) & (F.get(shared, 0) == F.col(f"{x}.bucket"))

    classes, links = linked_classes(rows, lambda pairs: verify_texts(pairs, texts, SHINGLE), threshold, sketches=sketches, alike=alike)
    members = pin(signed.groupBy("doc_id", "key").agg(F.count("*").alias("times")))
    members = members.join(classes, "key", "left").select("doc_id", "key", "times", F.coalesce("comp", "key").alias("class"))
    return pin(members), links


def _kept(members: DataFrame) -> DataFrame:
    """``members`` plus class_id, class_size, and ``first``: the row's id and key are those of the row that stays.

    Of a class the row with the smallest id stays (null last), then with the smallest key.
    """
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key")))
    summary = pin(members.groupBy("class").agg(best.alias("_best"), F.sum("times").alias("class_size")))
    joined = members.join(summary, "class")
    first = F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (F.col("key") == F.col("_best.key"))
    return joined.select("doc_id", "key", "times", F.col("_best.doc_id").alias("class_id"), "class_size", first.alias("first"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of its class), class_size, kept.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at
    least ``threshold``; classes are the components. Words are runs without ``[\\x20\\x09-\\x0D]``; texts of
    equal words are linked, also those without any (null counts as empty). Exactly one row of a
    class is kept, that of the smallest id (null last). Candidates come from ProbMinHash bands, the
    verdict from the texts themselves. An empty table gives an empty result; other columns are ignored.
    """
    rows = take(docs, id_col, text_col).toDF("doc_id", "text")
    kept = _kept(near_classes(rows, threshold=threshold)[0])
    copies = kept.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return copies.select("doc_id", "class_id", "class_size", (F.col("first") & (F.col("_copy") == 1)).alias("kept"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    Texts without words, null ones too, are equal to each other; a null id gives way to any other. Of rows that repeat id and words one
    stays, whichever it is where other columns differ. An empty table stays empty; columns that differ in case only come back as they were.
    """
    rows = take(docs, id_col, text_col).toDF("doc_id", "text")
    stay = _kept(near_classes(rows, threshold=threshold)[0]).filter("first").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    whole = with_row(docs, id_col, text_col).toDF("_doc", "_text", "_row")
    whole = whole.select("_doc", "_row", F.array_join(words(text_of("_text")), " ").alias("_t"))
    whole = whole.select("_doc", "_row", F.unhex(F.md5(F.col("_t").cast("binary"))).alias("key"))
    once = whole.groupBy("key", "_doc").agg(F.first("_row").alias("_row"))  # rows that repeat id and words: any one
    joined = once.join(stay, (F.col("key") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")
    return unpack_row(joined.select("_row"), docs.columns)
