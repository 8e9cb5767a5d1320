"""Packing of token sequences into windows of near-equal length."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, pin, take, worker_state

#: Longest piece that is balanced; longer rests of documents are cut into equal parts.
GRAIN = 512
#: Pieces balanced together.
BLOCK = 2_048
#: Bytes of chunks, and of words, that a worker remembers with their ids.
REMEMBERED = 160_000_000


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp differencing: the indices of ``sizes`` in ``ways`` parts of near-equal sums.

    A partial partition is its parts' loads in ascending order, less the smallest. The two of the
    largest imbalance are merged, the fullest parts of one with the emptiest of the other, until
    one is left. Ties are merged in the order in which they came up.
    """
    import heapq

    import numpy as np

    joined = np.arange(len(sizes))  # every piece points to a piece of its part
    heap = [(-s, i, None, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    if ways == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(ways - 1)]

    def loads_of(item):
        if item[2] is not None:
            return item[2], item[3]
        loads, heads = np.zeros(ways, np.int64), np.full(ways, -1)
        loads[-1], heads[-1] = -item[0], item[1]
        return loads, heads

    while len(heap) > 1:
        first, second = heapq.heappop(heap), heapq.heappop(heap)
        (a, a_heads) = loads_of(first)
        if second[2] is None:  # a piece alone joins the emptiest part, which then moves up to its place
            size, piece = -second[0], second[1]
            if a_heads[0] >= 0:
                joined[piece] = a_heads[0]
                piece = a_heads[0]
            place = int(a.searchsorted(size, "right"))
            loads, heads = a.copy(), a_heads.copy()
            loads[:place - 1], loads[place - 1] = a[1:place], size
            heads[:place - 1], heads[place - 1] = a_heads[1:place], piece
            if loads[0]:
                loads -= loads[0]
            heapq.heappush(heap, (-int(loads[-1]), made, loads, heads))
            made += 1
            continue
        b, b_heads = loads_of(second)
        loads, b_heads = a + b[::-1], b_heads[::-1]
        both = (a_heads >= 0) & (b_heads >= 0)
        joined[b_heads[both]] = a_heads[both]
        heads = np.where(a_heads >= 0, a_heads, b_heads)
        order = np.argsort(loads, kind="stable")
        loads, heads = loads[order], heads[order]
        loads -= loads[0]
        heapq.heappush(heap, (-int(loads[-1]), made, loads, heads))
        made += 1
    while not np.array_equal(joined, joined[joined]):
        joined = joined[joined]
    parts: dict[int, list[int]] = {}
    for i, head in enumerate(joined.tolist()):
        parts.setdefault(head, []).append(i)
    return list(parts.values()) + [[] for _ in range(ways - len(parts))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """``sizes`` in as few balanced windows as differencing finds; one more whenever one overflows."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, ways)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        ways += 1


def _encoder(tokenizer_json: str, end_id: int):
    """A function from a text to its ids as little-endian unsigned 32-bit integers, ``end_id`` last.

    The tokenizer drops white space and never joins what it parts, so the ids of a text are those
    of its chunks between blanks and line feeds, and those of a chunk are those of the words that the
    tokenizer's own first steps make of it. Each worker remembers recent chunks and words.
    """
    import json
    import re
    from array import array
    from hashlib import md5

    from tokenizers import Tokenizer

    own = md5(tokenizer_json.encode()).hexdigest()
    model = worker_state(f"word_bpe_{own}", lambda: Tokenizer.from_str(tokenizer_json))
    marks = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
    merge, normal, parted = model.model.tokenize, model.normalizer.normalize_str, model.pre_tokenizer.pre_tokenize_str
    # visible Latin, where normal form and lower case are Python's; then the tokenizer's pattern for it
    latin = re.compile("[\x21-\x7e\xa1-ɏ]*").fullmatch
    pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                        "|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ0-9\xb2\xb3\xb9\xbc-\xbe]+").findall
    # the letters that stand for bytes: visible ones for themselves, the others from U+0100 on
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    letters = {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}

    def of_chunk(chunk: str) -> bytes:
        if not latin(chunk):
            return b"".join([words[w] for w, _ in parted(normal(chunk))])
        if chunk.isascii():
            return b"".join(map(words.__getitem__, pieces(chunk.lower())))
        return b"".join([words["".join(map(letters.__getitem__, w.encode()))] for w in pieces(chunk.lower())])

    words = worker_state(f"word_bpe_words_{own}", lambda: Memory(lambda word: array("I", [t.id for t in merge(word)]).tobytes(), REMEMBERED))
    known = worker_state(f"word_bpe_chunks_{own}", lambda: Memory(None, REMEMBERED))
    known.make = of_chunk
    end = end_id.to_bytes(4, "little")

    def ids(text: str) -> bytes:
        if any(mark in text for mark in marks):
            return array("I", model.encode(text, add_special_tokens=False).ids).tobytes() + end
        return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" "))) + end

    return ids


def cut_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 1, grain: int = GRAIN,
               with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (little-endian 32-bit) of each piece.

    A document is the ids of its text and ``end_id``; null is an empty text, so each row has at
    least one piece. Whole windows are cut off first; a rest above ``grain`` is cut into equal parts.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    kind = docs.schema[docs.columns.index(id_col)].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if with_ids else "")

    def cut(batches: Iterator) -> Iterator:
        from zlib import crc32

        import pyarrow as pa

        encode = _encoder(tokenizer_json, end_id)
        for batch in batches:
            row, starts, sizes, sums, totals, pieces = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "")
                total = len(ids) // 4
                whole = total // capacity
                rest = total - whole * capacity
                parts = -(-rest // grain)
                edges = [k * capacity for k in range(whole + 1)] + [whole * capacity + rest * k // parts for k in range(1, parts + 1)]
                for a, b in zip(edges, edges[1:], strict=False):
                    row.append(i)
                    starts.append(a)
                    sizes.append(b - a)
                    sums.append(crc32(ids[4 * a:4 * b]))
                    totals.append(total)
                    if with_ids:
                        pieces.append(ids[4 * a:4 * b])
            index = pa.array(row, pa.int64())
            columns = [batch.column(0).take(index), *[pa.array(v, pa.int64()) for v in (starts, sizes, sums, totals)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(pieces, pa.binary())] if with_ids else []),
                                             names=names + (["ids"] if with_ids else []))

    return take(docs, id_col, text_col).toDF("doc_id", "text").mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, block: int = BLOCK) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``: every piece in one window of at most ``capacity``.

    The written pieces are dealt evenly to tasks, whatever document or source they are of. A task
    balances ``block`` pieces at a time by differencing, so its memory is bounded; a piece as
    long as a window is a sequence alone. Zero-length pieces do not occur.
    """
    pieces = pin(pieces, "lz4" if "ids" in pieces.columns else "none")
    tasks = max(1, round(pieces.count() / (4 * block)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32

        def placed(rows):
            nonlocal sequence
            size = rows.column("length").to_pylist()
            rest = [i for i, n in enumerate(size) if n < capacity]
            parts = [[i] for i, n in enumerate(size) if n >= capacity]
            parts += [[rest[j] for j in p] for p in windows([size[i] for i in rest], capacity)] if rest else []
            order, ids, offsets = [], [], []
            for part in parts:
                at = 0
                for i in part:
                    order.append(i)
                    ids.append(sequence)
                    offsets.append(at)
                    at += size[i]
                sequence += 1
            return pa.RecordBatch.from_arrays([*rows.take(pa.array(order, pa.int64())).columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())],
                                              names=[*rows.schema.names, "sequence_id", "offset"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                n += held[-1].num_rows
                if n >= block:
                    yield placed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, n = [], 0
        if n:
            yield placed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return pieces.repartition(tasks).mapInArrow(place, schema + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 1, with_ids: bool = False,
                   **columns: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Null and empty texts are one token long (``end_id``). Rows that repeat, or share or lack an id, are packed each.
    An empty table gives an empty result; other columns are ignored.
    """
    return pack_pieces(cut_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, with_ids=with_ids, **columns), capacity=capacity)


def sequences(packed: DataFrame, *, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids (little-endian 32-bit) of each window, from pieces with ids.

    Windows are padded to ``capacity`` with ``pad_id``, unless their length is a power of two.
    A window holds at most ``capacity`` tokens, so its group is bounded.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda p: p["ids"])
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_join(parts, "").alias("_hex"))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    padding = F.when(power, F.lit("")).otherwise(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(capacity) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.unhex(F.concat("_hex", padding)).alias("ids"))
