"""Phrases whose words stand together more often than their parts would, per language."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bits import bit_filter, opened
from .common import numbered, pin, take, text_of

#: Characters that end a piece; blanks between words are space and tab.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Words of the longest phrase, least occurrences of a candidate, phrases returned per language.
LONGEST, LEAST, TOP = 4, 30, 2_000
#: Ids a side of a tile spans: the counters of a dense tile are an array of SIDE x SIDE numbers (2 MB).
SIDE = 512
#: Commonest words or phrases whose ids every task holds; rarer ones are joined. It changes the cost, never the result.
HEAD = 300_000
#: Bytes of the longest word that the tasks hold.
HEAD_BYTES = 128
#: Bits of the filter that keeps pairs without an id from being asked for: a false hit costs a row.
FILTER_BITS = 1 << 26
#: Bytes of text between two looks at the size of a task's counter, bytes it may hold, pairs a task counts at a time.
LOOK, HELD, BLOCK = 2_000_000, 32_000_000, 1_000_000
#: Counted pairs that a task holds before it hands them on, and least number of parts they are dealt out to.
TOGETHER, PARTS = 2_000_000, 64


def _lower_pieces():
    """A function from a text to its bytes with A-Z lower-cased and every end of a piece a line feed."""
    table = bytes(10 if c in ENDS else c for c in range(256))
    return lambda text: text.encode("utf-8", "surrogatepass").lower().translate(table)  # bytes.lower() knows A-Z only


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of ``rows`` (lang, text). Tasks count locally and hand on their counts whenever they hold too many bytes."""
    look, held = LOOK, HELD

    def count(batches: Iterator) -> Iterator:
        from collections import Counter, defaultdict

        import pyarrow as pa

        plain, counts, seen = _lower_pieces(), defaultdict(Counter), 0

        def out():
            for lang, found in counts.items():
                words = list(found)
                for at in range(0, len(words), 50_000):
                    part = words[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                                                      pa.array([found[w] for w in part], pa.int64())], names=["lang", "word", "f"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text := text.as_py():
                    counts[lang].update(plain(text).split())
                    seen += len(text)
                    if seen > look:
                        seen = 0
                        if sum(100 + len(w) for found in counts.values() for w in found) > held:
                            yield from out()
        yield from out()

    return rows.select("lang", "text").mapInArrow(count, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _ranked(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``id``, their 0-based rank by falling ``f``, written down; and their number."""
    placed, n = numbered(rows.withColumn("_less", -F.col("f")), "_less", *order)
    return pin(placed.withColumnRenamed("_at", "id").drop("_less"), "lz4"), n


def _sequences(rows: DataFrame, words: DataFrame, n_words: int, head: int) -> DataFrame:
    """(mark, ids): each text as the ids of its words, 64 bits each; -1 for a word that is too rare and between pieces.

    The ``head`` commonest words are a bounded table that every task holds. Other words with an id are joined: each text asks
    for its own distinct ones, and gets back those that have one.
    """
    spark = rows.sparkSession
    marked = rows.select("lang", "text", F.xxhash64("lang", "text").alias("mark"))  # equal marks may share a word list: it is true for all
    short = F.octet_length("word") <= HEAD_BYTES
    near = {}
    for r in words.filter((F.col("id") < head) & short).select("lang", "word", "id").toLocalIterator():
        near.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
    shared = spark.sparkContext.broadcast(near)
    rest = words.filter((F.col("id") >= head) | ~short)
    asked = None
    if n_words > head or not rest.isEmpty():
        def ask(batches: Iterator) -> Iterator:
            import pyarrow as pa

            plain, known = _lower_pieces(), shared.value
            for batch in batches:
                for lang, text, mark in zip(*(batch.column(k) for k in range(3)), strict=True):
                    lang, own = lang.as_py(), known.get(lang.as_py(), {})
                    new = [w for w in set(plain(text.as_py()).split()) if w not in own]
                    if new:
                        yield pa.RecordBatch.from_arrays([pa.array([mark.as_py()] * len(new), pa.int64()), pa.array([lang] * len(new)),
                                                          pa.array(new, pa.binary()).cast(pa.string())], names=["mark", "lang", "word"])

        wanted = marked.mapInArrow(ask, "mark bigint, lang string, word string").distinct()
        asked = wanted.join(rest.select("lang", "word", "id"), ["lang", "word"]).groupBy("mark").agg(
            F.collect_list(F.struct("word", "id")).alias("own"))  # at most the words of a text
        marked = marked.join(asked, "mark", "left")
    else:
        marked = marked.withColumn("own", F.lit(None).cast("array<struct<word:string,id:bigint>>"))

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        plain, known = _lower_pieces(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for lang, text, own in zip(*(part.column(k) for k in (0, 1, 3)), strict=True):
                    get = known.get(lang.as_py(), {}).get
                    if own.is_valid:
                        extra = {r["word"].encode(): r["id"] for r in own.as_py()}
                        first, second = get, extra.get
                        get = lambda w, _, first=first, second=second: first(w, second(w, -1))
                    ids = []
                    for piece in plain(text.as_py()).split(b"\n"):
                        ids += [get(w, -1) for w in piece.split()]
                        ids.append(-1)
                    out.append(np.array(ids, np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(out, pa.binary())], names=["mark", "ids"])

    return pin(marked.select("lang", "text", "mark", "own").mapInArrow(encode, "mark bigint, ids binary"), "zstd")


def tile_counts(a, b, side: int = SIDE):
    """(a, b, n) of the distinct pairs of two equally long arrays of ranks, by tiles of ``side`` x ``side`` cells.

    A tile with more pairs than a fourth of its cells is counted by direct address, in a dense array; the pairs
    of all other tiles are sorted coordinates, whose runs are counted.
    """
    import numpy as np

    if not len(a):
        return a, b, np.zeros(0, np.int64)
    tile_a, tile_b = a // side, b // side
    width = int(tile_b.max()) + 1
    tile = tile_a * width + tile_b  # ids are below 2^31 times the side, so this fits
    # ranks are by frequency, so the dense tiles lie in the corner of small tile numbers
    corner = min(width, int(tile_a.max()) + 1, 64)
    near = (tile_a < corner) & (tile_b < corner)
    sizes = np.bincount((tile_a * corner + tile_b)[near], minlength=corner * corner)
    dense = np.flatnonzero(sizes * 4 >= side * side)
    found, rest = [], np.ones(len(a), bool)
    for k in dense.tolist():
        here = near & (tile_a == k // corner) & (tile_b == k % corner)
        cells = np.bincount((a[here] % side) * side + b[here] % side, minlength=side * side)
        at = np.flatnonzero(cells)
        found.append((at // side + k // corner * side, at % side + k % corner * side, cells[at]))
        rest &= ~here
    a, b, tile = a[rest], b[rest], tile[rest]
    if len(a):
        found.append(summed_pairs(a, b, np.ones(len(a), np.int64)))
    return tuple(np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))


def pack_pairs(a, b, n) -> bytes:
    """Sorted coordinates with counts, packed: small steps of ``a`` and the byte planes of all three, compressed."""
    import numpy as np
    import pyarrow as pa

    numbers = np.concatenate((np.diff(a, prepend=0), b, n)).astype("<i8")
    planes = numbers.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_pairs(packed: bytes):
    import numpy as np
    import pyarrow as pa

    size = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=24 * size, codec="zstd", asbytes=True), np.uint8)
    a, b, n = planes.reshape(8, -1).T.copy().view("<i8").reshape(3, -1)
    return np.cumsum(a), b, n


def summed_pairs(a, b, n):
    """Distinct (a, b) in order, with the sums of n."""
    import numpy as np

    order = np.lexsort((b, a)) if len(a) and max(int(a.max()), int(b.max())) >= 1 << 31 else np.argsort(a << 32 | b)
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(n, first) if len(a) else n


def _pair_counts(sequences: DataFrame, least: int) -> DataFrame:
    """(a, b, f) of the neighbouring ids that occur ``least`` times or more.

    Tasks count a block of pairs at a time, tile by tile, add blocks up while they are few, and send the sorted coordinates in
    packed parts, dealt out by a hash of the pair: a pair that stands everywhere is one entry per task. The number of parts follows the
    number of input partitions, so that what a task adds up keeps its size as the input grows; only frequent pairs become rows.
    """
    block, together = BLOCK, TOGETHER
    parts = max(PARTS, 2 * sequences.rdd.getNumPartitions())

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        left, right, held, counted = [], [], 0, []

        def add():
            counted.append(tile_counts(np.concatenate(left), np.concatenate(right)))
            left.clear()
            right.clear()

        def out():
            a, b, n = (np.concatenate([c[k] for c in counted]) for k in range(3))
            counted.clear()
            a, b, n = summed_pairs(a, b, n)
            part = ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            edges = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
            a, b, n = a[order], b[order], n[order]
            full = [k for k in range(parts) if edges[k] < edges[k + 1]]
            for at in range(0, len(full), 1_000):
                some = full[at:at + 1_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(
                    [pack_pairs(*(x[edges[k]:edges[k + 1]] for x in (a, b, n))) for k in some], pa.binary())], names=["part", "packed"])

        for batch in batches:
            for ids in batch.column(0):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                for at in range(0, len(ids) - 1, block):  # a very long text in several steps
                    some = ids[at:at + block + 1]
                    good = (some[:-1] >= 0) & (some[1:] >= 0)
                    left.append(some[:-1][good])
                    right.append(some[1:][good])
                    held += len(left[-1])
                    if held >= block:
                        add()
                        held = 0
                        if sum(len(c[0]) for c in counted) > together:
                            yield from out()
        if held:
            add()
        if counted:
            yield from out()

    def total(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, now = [], None

        def out():
            a, b, n = summed_pairs(*(np.concatenate([h[k] for h in held]) for k in range(3)))
            good = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (a, b, n)], names=["a", "b", "f"])

        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now is not None and part != now:
                    yield from out()
                    held = []
                now = part
                held.append(unpack_pairs(packed.as_py()))
        if held:
            yield from out()

    packed = sequences.select("ids").mapInArrow(count, "part int, packed binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(total, "a bigint, b bigint, f bigint")


def _next_sequences(sequences: DataFrame, pairs: DataFrame, n_pairs: int, head: int, bits: int) -> DataFrame:
    """The sequences of the next level: each place has the id of the pair that begins there, or -1.

    The ``head`` commonest pairs are sorted arrays that every task holds. Of other pairs, those that pass a filter of
    bounded size are asked for, text by text, in a join.
    """
    import numpy as np

    spark = sequences.sparkSession
    near = pairs.filter(F.col("id") < head).select("a", "b", "id").toPandas()
    order = np.lexsort((near["b"], near["a"]))
    shared = spark.sparkContext.broadcast(tuple(near[c].to_numpy(np.int64)[order] for c in ("a", "b", "id")))

    def lookup(table, a, b):
        """Ids of pairs in a table sorted by (a, b); -1 where there is none."""
        import numpy as np

        ta, tb, ids = table
        out = np.full(len(a), -1, np.int64)
        if len(ta):
            starts = np.flatnonzero(np.concatenate(([True], ta[1:] != ta[:-1])))
            keys = ta[starts]
            k = np.minimum(np.searchsorted(keys, a), len(keys) - 1)
            there = np.flatnonzero(keys[k] == a)
            # dense numbers of the first id keep the pair in 64 bits
            span = int(max(tb.max(), b.max() if len(b) else 0)) + 1
            own = np.repeat(np.arange(len(keys)), np.diff(np.append(starts, len(ta)))) * span + tb
            asked = k[there] * span + b[there]
            at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
            good = own[at] == asked
            out[there[good]] = ids[at[good]]
        return out

    def mixed(a, b):
        import numpy as np

        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def joined(batches: Iterator, emit) -> Iterator:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                ids = np.concatenate([np.append(x, -1) for x in texts])  # texts end in -1, so no pair reaches over two
                row = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in texts])
                a, b = ids, np.append(ids[1:], -1)
                good = np.flatnonzero((a >= 0) & (b >= 0))
                out = np.full(len(ids), -1, np.int64)
                out[good] = lookup(shared.value, a[good], b[good])
                yield from emit(part, texts, row, a, b, good, out)

    rest, tail = pairs.filter(F.col("id") >= head), None
    if n_pairs > head:
        def hashes(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(mixed(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.int64))], names=["h"])

        kept = spark.sparkContext.broadcast(bit_filter(rest.select("a", "b").mapInArrow(hashes, "h bigint"), bits))

        def ask(batches: Iterator) -> Iterator:
            import pyarrow as pa

            within = opened(kept.value, bits)

            def emit(part, texts, row, a, b, good, out):
                at = good[within(mixed(a[good], b[good])) & (out[good] < 0)]
                mark = part.column(0).to_numpy()[row[at]]
                yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(a[at]), pa.array(b[at])], names=["mark", "a", "b"])

            yield from joined(batches, emit)

        wanted = sequences.mapInArrow(ask, "mark bigint, a bigint, b bigint").distinct()
        tail = wanted.join(rest.select("a", "b", "id"), ["a", "b"]).groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("a", "b", "id"))).alias("own"))

    def relabel(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def emit(part, texts, row, a, b, good, out):
            if part.num_columns > 2 and part.column(2).null_count < part.num_rows:
                for k, own in enumerate(part.column(2)):
                    if own.is_valid:
                        cells = own.values
                        table = [cells.field(c).to_numpy().astype(np.int64) for c in range(3)]
                        at = good[(row[good] == k) & (out[good] < 0)]
                        out[at] = lookup(table, a[at], b[at])
            ends = np.cumsum([len(x) + 1 for x in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in np.split(out, ends[:-1])], pa.binary())], names=["mark", "ids"])

        yield from joined(batches, emit)

    source = sequences if tail is None else sequences.join(tail, "mark", "left")
    return pin(source.mapInArrow(relabel, "mark bigint, ids binary"), "zstd")


def _scored(phrases: DataFrame, size: int) -> DataFrame:
    """The least score of the cuts of each phrase, with the ``l`` and ``r`` of that cut; ties to the first cut.

    ``before`` and ``behind`` are the frequencies of the first 1, 2, ... and of the last 1, 2, ... words.
    """
    cuts = [F.struct(F.expr(f"CAST(2000000 AS DECIMAL(20,0)) * f DIV (CAST({left} AS DECIMAL(20,0)) + {right})").alias("score"), F.lit(k).alias("k"),
                     F.expr(left).alias("l"), F.expr(right).alias("r"))
            for k in range(1, size) for left, right in [(f"before[{k - 1}]", f"behind[{size - k - 1}]")]]
    return phrases.withColumn("_cut", F.array_min(F.array(*cuts))).select("id", "lang", "phrase", F.col("f").alias("a"), "_cut.l", "_cut.r", "_cut.score")


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, head: int = HEAD, filter_bits: int = FILTER_BITS,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased, texts split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks into words. A candidate occurs
    ``least`` times or more (a); cut in two, its parts occur l and r times, and floor(2000000 a / (l + r)) is least for the cut that counts, ties to
    the first cut. A candidate that stands inside a longer one with 100 f(longer) >= 80 a is dropped. n counts the words of the language.

    Level by level: words get ids by falling frequency, texts become sequences of ids, neighbouring ids are counted in tiles
    (see ``tile_counts``), the frequent pairs get ids by falling frequency in turn, and the sequences are written anew with these: two
    neighbouring ids of a level overlap in all but one word each. A phrase can only be frequent if both are, so
    nothing is lost.

    Null texts have no words, a null language is ``und``. Repeated rows count each time; ids are not read. An empty table gives an
    empty result; other columns are ignored. Products are decimals, so nothing overflows.
    """
    rows = take(docs, lang_col, text_col).toDF("lang", "text").select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of("text").alias("text"))
    rows = rows.filter(F.octet_length("text") > 0)
    counts = pin(word_counts(rows), "lz4")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words, n = _ranked(counts.filter(F.col("f") >= least), "lang", "word")
    sequences = _sequences(rows, words, n, head)
    phrases = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
                           F.array("f").alias("before"), F.array("f").alias("behind"))
    found, longer = [], []
    for size in range(2, longest + 1):
        pairs, n = _ranked(_pair_counts(sequences, least), "a", "b")
        left = phrases.select(F.col("id").alias("a"), "lang", "phrase", "before")
        right = phrases.select(F.col("id").alias("b"), "last", "behind")
        named = pairs.join(left, "a").join(right, "b").select(
            "id", "a", "b", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
            F.concat("before", F.array("f")).alias("before"), F.concat("behind", F.array("f")).alias("behind"))
        phrases = pin(named, "lz4")
        found.append(_scored(phrases, size))
        inside = pairs.select(F.col("a").alias("id"), "f").union(pairs.select(F.col("b").alias("id"), "f"))
        longer.append(inside.groupBy("id").agg(F.max("f").alias("_more")))
        if size < longest:
            sequences = _next_sequences(sequences, pairs, n, head, filter_bits)
    # one word more is enough: a phrase inside a much longer one stands inside all those between, which occur as often at least
    kept = found[-1]
    for mine, above in zip(found[:-1], longer[1:], strict=True):
        joined = mine.join(above, "id", "left")
        alone = joined.filter("_more IS NULL OR CAST(100 AS DECIMAL(20,0)) * _more < CAST(80 AS DECIMAL(20,0)) * a").drop("_more")
        kept = kept.union(alone)
    return _first(pin(kept.drop("id"), "lz4"), top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank: first in each of 64 parts of it, then among those."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    some = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_k", F.row_number().over(part)).filter(F.col("_k") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(
        F.col("rank") <= top).drop("_part", "_k")


def collocations_sql(table: str, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same in SQL, with every phrase of a piece as a row."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM {table}),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, range(1, {longest + 1}) AS s(m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= {least}),
k AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y FROM c, range(1, {longest}) AS s(k) WHERE k < m),
s AS (SELECT k.lang, k.m, k.phrase, a, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS more FROM c, range(1, {longest}) AS s(i), range(2, {longest + 1}) AS e(j)
  WHERE j > i AND j <= m AND j - i + 1 < m GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM s LEFT JOIN i USING (lang, phrase) JOIN n USING (lang) WHERE more IS NULL OR 100 * more < 80 * a QUALIFY rank <= {top}
"""
