"""Byte-level BPE: encoding and decoding of whole texts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memory, pin, take, worker_state
from .frequencies import commonest, pretoken_counts

#: Buckets of the literal rank map: a lookup scans about three entries.
BUCKETS = 16_384
#: Commonest words, which the fold encodes once for the whole corpus. Changes the cost only.
HEAD = 100_000
#: Bytes of chunks, and of rarer words, that a worker remembers with their ids.
REMEMBERED = 32_000_000
#: Bytes from which on a word takes the linked-list merge, whose cost does not grow with the square.
LONG = 64
#: Bytes of texts that are encoded at a time; no text is cut.
BLOCK = 1_500_000
#: Rows of an Arrow batch at most: a batch stands in the JVM and in the worker, on its way to the encoder and to the decoder.
ROWS = 2_000
#: Fixed value: the pattern in which an ASCII chunk of letters, and a mark behind them, need no search.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = frozenset(".,;:!?")
#: Fixed value: white space of the pattern's engine.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    from base64 import b64decode

    with open(path, "rb") as file:
        return {b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def fold_merges(ranks: dict[bytes, int]):
    """A function from a binary column of words to their ids, in built-in higher-order functions.

    Bytes stand as characters U+0000 to U+00FF. The rank map is one literal: an array of small maps, found by
    CRC-32. A word that is a piece is its rank. Else a fold over its bytes carries the
    pieces, the rank of each neighbouring pair and the least of these ranks; a step merges the first pair of least
    rank and looks up the two pairs that this makes.
    """
    from zlib import crc32

    none = 2**31 - 1
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        letters = piece.decode("latin-1")
        maps[crc32(letters.encode()) % BUCKETS][letters] = rank
    literal = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
    empty = F.array().cast("array<int>")

    def fold(table: Column, letters: Column) -> Column:
        def rank(piece: Column) -> Column:
            return F.element_at(F.element_at(table, (F.crc32(piece.cast("binary")) % BUCKETS + 1).cast("int")), piece)

        def pair_rank(pair: Column) -> Column:
            return F.coalesce(rank(pair), F.lit(none))

        def state(pieces: Column, pairs: Column) -> Column:
            return _let(pairs, lambda p: F.struct(pieces.alias("p"), p.alias("r"), F.coalesce(F.array_min(p), F.lit(none)).alias("m")))

        def merge(s: Column, k: Column) -> Column:
            pieces, pairs = s["p"], s["r"]

            def put(joined: Column) -> Column:
                left = F.when(k > 1, F.array(pair_rank(F.concat(F.get(pieces, k - 2), joined)))).otherwise(empty)
                right = F.when(k + 1 < F.size(pieces), F.array(pair_rank(F.concat(joined, F.get(pieces, k + 1))))).otherwise(empty)
                return state(F.concat(F.slice(pieces, F.lit(1), k - 1), F.array(joined), F.slice(pieces, k + 2, F.size(pieces))),
                             F.concat(F.slice(pairs, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right, F.slice(pairs, k + 2, F.size(pieces))))

            return _let(F.concat(F.get(pieces, k - 1), F.get(pieces, k)), put)

        def step(s: Column, _: Column) -> Column:
            return F.when(s["m"] == none, s).otherwise(_let(F.array_position(s["r"], s["m"]).cast("int"), lambda k: merge(s, k)))

        def merged() -> Column:
            start = state(F.split(letters, ""), F.transform(
                F.sequence(F.lit(1), F.length(letters) - 1), lambda i: pair_rank(F.substring(letters, i, F.lit(2)))))
            pieces = F.aggregate(F.sequence(F.lit(2), F.length(letters)), start, step, lambda s: s["p"])
            return F.transform(pieces, rank)

        return _let(rank(letters), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(merged()))

    # the literal is bound once, so that it stands once in the plan
    return lambda word: _let(literal, lambda table: _let(F.decode(word, "ISO-8859-1"), lambda letters: fold(table, letters)))


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one short word: the first pair of least rank, until no pair has one."""
    if word in ranks:
        return [ranks[word]]
    none = 2**31 - 1
    pieces = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b, none) for a, b in zip(pieces, pieces[1:], strict=False)]
    while pairs and (least := min(pairs)) < none:
        k = pairs.index(least)
        pieces[k:k + 2] = [joined := pieces[k] + pieces[k + 1]]
        del pairs[k]
        if k:
            pairs[k - 1] = ranks.get(pieces[k - 1] + joined, none)
        if k < len(pairs):
            pairs[k] = ranks.get(joined + pieces[k + 1], none)
    return [ranks[p] for p in pieces]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, by a heap over a linked list: O(n log n)."""
    import heapq

    if word in ranks:
        return [ranks[word]]
    end = len(word)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    stop = list(range(1, end + 1))  # where the piece that starts here stops; 0 once it was merged away
    heap = []

    def offer(at: int) -> None:
        following = after[at]
        if following < end and (rank := ranks.get(word[at:stop[following]])) is not None:
            heapq.heappush(heap, (rank, at, stop[following]))

    for at in range(end - 1):
        offer(at)
    while heap:
        _, at, until = heapq.heappop(heap)
        if not stop[at] or after[at] >= end or stop[after[at]] != until:
            continue
        gone = after[at]
        stop[at], stop[gone], after[at] = until, 0, after[gone]
        if after[at] < end:
            before[after[at]] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return [ranks[word[at:stop[at]]] for at in range(end) if stop[at]]


def pair_table(ranks: dict[bytes, int]):
    """(keys, ranks, bytes, two): every two pieces that make a piece, as first rank << 32 | second rank, in order, and what they make;
    the rank of every byte, and of every two bytes (2^31 - 1: none)."""
    import numpy as np

    pairs = sorted((first << 32 | second, rank) for piece, rank in ranks.items() for k in range(1, len(piece))
                   if (first := ranks.get(piece[:k])) is not None and (second := ranks.get(piece[k:])) is not None)
    two = np.full(1 << 16, 2**31 - 1, np.int64)
    for piece, rank in ranks.items():
        if len(piece) == 2:
            two[piece[0] << 8 | piece[1]] = rank
    return np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64), np.array([ranks[bytes([b])] for b in range(256)], np.int64), two


def merge_many(words: list[bytes], table) -> list[bytes]:
    """The same merges for many words that are no pieces, none empty, all together: ids of each, little-endian 32-bit.

    A row of arrays is a word, a step merges the first pair of least rank of every word that has one. ``table`` is
    ``pair_table``. Words of like length go together, since a row is as wide as the longest.
    """
    import numpy as np

    if not words:
        return []
    keys, made, single, two = table
    none, nothing = 2**31 - 1, np.int64(2**31 - 2)

    def pair_rank(first, second):
        key = first << 32 | second
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, made[at], none) if len(keys) else np.full(len(key), none)

    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    out: list = [b""] * len(words)
    for start in range(0, len(order), 4096):
        group = order[start:start + 4096]
        length, wide = size[group], int(size[group[-1]])
        inside = np.arange(wide) < length[:, None]
        # the column behind the last is what a first piece has before it, and a last one behind it: it makes no pair
        raw = np.zeros((len(group), wide), np.int64)
        raw[inside] = np.frombuffer(b"".join([words[k] for k in group.tolist()]), np.uint8)
        piece = np.full((len(group), wide + 1), nothing)
        piece[:, :wide][inside] = single[raw[inside]]
        place = np.arange(wide)
        after = np.where(place + 1 < length[:, None], place + 1, wide)
        before = np.broadcast_to(np.where(place > 0, place - 1, wide), after.shape).copy()
        after, before = (np.pad(x, ((0, 0), (0, 1)), constant_values=wide) for x in (after, before))
        alive = inside.copy()
        rank = np.full((len(group), wide + 1), none)
        rank[:, :wide - 1][inside[:, 1:]] = two[raw[:, :-1] << 8 | raw[:, 1:]][inside[:, 1:]]
        row = np.arange(len(group))
        while len(row):
            least = rank[row, :wide]
            at = least.argmin(1)
            least = least[np.arange(len(row)), at]
            more = least < none
            row, at, least = row[more], at[more], least[more]
            gone = after[row, at]
            behind, ahead = after[row, gone], before[row, at]
            piece[row, at] = least
            alive[row, gone] = False
            after[row, at], before[row, behind] = behind, at
            rank[row, gone] = none
            rank[row, at] = pair_rank(least, piece[row, behind])
            rank[row, ahead] = pair_rank(piece[row, ahead], least)
        ids = piece[:, :wide][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        for k, a, z in zip(group.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[k] = ids[a:z]
    return out


def _chunker(pattern: str):
    """(chunks, words): chunks of a text that the pattern never crosses, and the pattern's matches in a chunk.

    A chunk is white space and what follows up to the next white space. The pattern looks at most one
    blank back from a word, so its matches in a chunk are those in the text.
    """
    import re

    import regex

    chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
    search = regex.compile(pattern).findall

    def inside(chunk: str) -> list[str]:
        if chunk.isascii():
            body = chunk[1:] if chunk[:1] == " " else chunk
            if body.isalpha():
                return [chunk]
            if body[-1:] in MARKS and body[:-1].isalpha():
                return [chunk[:-1], body[-1]]
        return search(chunk)

    return chunks, inside if pattern == PLAIN else search


def _blocks(texts):
    """Slices of a column of texts (null: empty), about ``BLOCK`` bytes each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
    at, held = 0, 0
    for k, end in enumerate(ends):
        if end - held >= BLOCK or k == len(ends) - 1:
            yield texts.slice(at, k + 1 - at).cast(pa.large_string())
            at, held = k + 1, end


def cut_block(texts, chunks):
    """(distinct chunks, place among them of each chunk of the texts in a row, first chunk of each text and the end), each chunk
    one that the pattern never crosses.

    Texts are cut before every blank (U+0020). Where white space stands before a blank, matches may begin there: such texts are
    cut by ``chunks``.
    """
    import re

    import numpy as np
    import pyarrow.compute as pc

    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    known, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
    edges = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    head, tail = edges[:-1], edges[1:] - 1
    white = re.compile(f"[{WHITE}]").match
    white = {c: white(c) is not None for c in {p[-1:] for p in known} if c} | {"": True}
    blank = np.array([white[p[-1:]] for p in known], bool)[index]
    # an empty part at the start or the end is no white space before a blank
    blank[head] &= np.array([bool(p) for p in known], bool)[index[head]]
    blank[tail] = False
    starts, place = np.unique(index[head], return_inverse=True)
    index[head] = len(known) + place
    found = [" " + p for p in known] + [known[k] for k in starts.tolist()]
    odd = np.flatnonzero(np.logical_or.reduceat(blank, head))
    if len(odd):
        cut = [chunks(texts[k].as_py()) for k in odd.tolist()]
        where: dict = {}
        own = [np.array([where.setdefault(c, len(found) + len(where)) for c in one], np.int64) for one in cut]
        found += where
        pieces, last = [], 0
        sizes = np.diff(edges)
        for k, one in zip(odd.tolist(), own, strict=True):
            pieces += [index[last:edges[k]], one]
            last, sizes[k] = edges[k + 1], len(one)
        index = np.concatenate([*pieces, index[last:]])
        edges = np.concatenate(([0], np.cumsum(sizes)))
    return found, index, edges


def joined(values, index, edges) -> list[bytes]:
    """The bytes of ``values`` (an Arrow array) at ``index``, joined from one of ``edges`` to the next."""
    import numpy as np
    import pyarrow as pa

    taken = values.take(pa.array(index))
    _, offsets, data = taken.buffers()
    stops = np.frombuffer(offsets, np.int64)[taken.offset + np.asarray(edges)].tolist()
    data = memoryview(data) if data is not None else memoryview(b"")
    return [data[a:z].tobytes() for a, z in zip(stops, stops[1:], strict=False)]


def common_words(docs: DataFrame, encode, pattern: str, head: int) -> dict[str, bytes]:
    """Ids (little-endian 32-bit) of the ``head`` commonest words of the corpus, each encoded once by the fold."""
    if not head:
        return {}

    def split():
        import numpy as np

        chunks, inside = _chunker(pattern)

        def cut(texts):
            for block in _blocks(texts):
                found, index, _ = cut_block(block, chunks)
                yield found, np.bincount(index, minlength=len(found)).tolist()

        return cut, inside

    counts = pin(pretoken_counts(docs, "text", split, whole_batches=True), "snappy")
    found = commonest(counts, head).select("token")
    # spread the words, so that the fold runs in all tasks
    encoded = found.repartition(docs.sparkSession.sparkContext.defaultParallelism).select("token", encode(F.encode("token", "UTF-8")).alias("ids"))

    def packed(batches: Iterator) -> Iterator:
        from array import array

        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([array("I", i).tobytes() for i in batch.column(1).to_pylist()], pa.binary())], names=["token", "ids"])

    return {r["token"]: bytes(r["ids"]) for r in encoded.mapInArrow(packed, "token string, ids binary").collect()}


def _small_batches(spark) -> None:
    """Let Arrow batches of the session have ``ROWS`` rows at most; Spark reads this when a query runs, so it stays set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row of ``docs``.

    Each match of ``pattern`` is encoded by itself, without special tokens. The commonest words are encoded
    once for all documents by the fold over ranked merges, a table of bounded size that every task holds. Rarer words
    take the same merges in the task that meets them, which remembers a bounded number of them; from ``LONG`` bytes on by a
    linked list, shorter ones many at a time. So no text is sent anywhere. Null text is empty: no ids. Repeated rows and ids are rows like
    others; an empty table gives an empty result; other columns are ignored. The session's Arrow batches are made
    smaller (``ROWS``), which changes the memory only.
    """
    _small_batches(docs.sparkSession)
    rows = take(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    ranks = read_ranks(ranks_path)
    own = md5(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((common_words(rows, fold_merges(ranks), pattern, head), ranks, pair_table(ranks)))

    def encode(batches: Iterator) -> Iterator:
        from array import array

        import pyarrow as pa

        (common, ranked, table), (chunks, inside) = shared.value, _chunker(pattern)
        rare = worker_state(f"byte_bpe_words_{own}", lambda: Memory(None, REMEMBERED))
        known = worker_state(f"byte_bpe_chunks_{own}", lambda: Memory(None, REMEMBERED))

        def ids_of(found: list[str]) -> list[bytes]:
            """Ids of each chunk; rarer words that none remembers are merged together."""
            new = {c: inside(c) for c in found if c not in known}
            words = {w: rare.get(w) for ws in new.values() for w in ws if w not in common}
            merge = {w: w.encode() for w, ids in words.items() if ids is None}
            short = [w for w, raw in merge.items() if len(raw) < LONG and raw not in ranked]
            words |= zip(short, merge_many([merge[w] for w in short], table), strict=True)
            words |= {w: array("I", merge_long(merge[w], ranked)).tobytes() for w in merge if words[w] is None}
            made = {c: b"".join([common[w] if w in common else words[w] for w in ws]) for c, ws in new.items()}
            out = [made[c] if c in made else known[c] for c in found]
            for memory, fresh in ((rare, {w: words[w] for w in merge}), (known, made)):
                for key, ids in fresh.items():
                    memory.keep(key, ids)
            return out

        for batch in batches:
            at = 0
            for texts in _blocks(batch.column(1)):
                found, index, edges = cut_block(texts, chunks)
                out = joined(pa.array(ids_of(found), pa.large_binary()), index, edges)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(out)), pa.array(out, pa.binary())], names=["doc_id", "ids"])
                at += len(out)

    return rows.mapInArrow(encode, f"doc_id {kind}, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) plus ``decoded``, the concatenated pieces of the ids."""
    _small_batches(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    ranks = read_ranks(ranks_path)
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def decode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        values = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                ids = part.column(1).to_pylist()
                edges = np.cumsum([0, *[len(i) // 4 for i in ids]])
                out = joined(values, np.frombuffer(b"".join(ids), "<u4"), edges)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids binary, decoded binary")


def encoding_digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the rows of ``decode_documents``."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
