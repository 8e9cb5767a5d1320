"""Passages that several documents share, found by their paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import CHECK, bit_filter, opened, repeated_filter
from .common import forget, pin, release, take, text_of
from .linking import SHINGLE, THRESHOLD, components, crowded, jaccard, linked_classes

#: An anchor is the least place of a window of REACH + 1 places. Of 51 equal words (50 places) the first anchor is then at
#: place REACH or before, the last at 49 - REACH or later, and paragraphs reach to SHORTEST - 1 words before that or
#: further: 20 words at least, which is LEAST_WORDS.
REACH = 12
#: MinHash values (least hashes of shingles) of a band.
ROWS = 4
#: Signatures that a set of shingles may have; paragraphs that can have more are linked bucket by bucket.
MANY = 1_000
#: Words of a run of shared paragraphs from which on it is a shared passage.
LEAST_WORDS = 20
#: Words between two runs shared with the same document that are bridged: an altered word spoils the paragraphs that hold it.
GAP = 24
#: Fixed value: the shortest paragraph compared, one more than a shingle.
SHORTEST = SHINGLE + 1
#: Bits of the filters of buckets, and of keys, that are met twice; code points that are cut at a time.
FILTER_BITS, BLOCK = 1 << 28, 1 << 19
#: What stands behind the last shingle of a set.
FILL = 2**64 - 1
#: The factors of the hashes.
ODD, FACTORS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x):
    """A hash of 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(FACTORS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(FACTORS[1])
    return x ^ (x >> np.uint64(31))


def _missing(size, threshold: float):
    """Shingles that a set of ``size`` may have besides those of a similar set."""
    import numpy as np

    return np.floor(size * (1 - threshold) + 1e-9).astype(np.int64)


def bands_of(minima, threshold: float = THRESHOLD):
    """(row, number) of the bands of each row of sorted shingle hashes (``FILL`` behind the last).

    A band is ``ROWS`` MinHash values. Two similar sets may lack x shingles of each other's, so the ``ROWS`` least they have
    in common stand among the x + ``ROWS`` least of both: every choice of so many of these is a band, and similar sets always
    meet in one. A set of fewer shingles, which may lack none, is one band.
    """
    from itertools import combinations

    import numpy as np

    rows = ROWS if threshold >= 1 - 1 / (ROWS + 1) else 1  # a set that may lack a shingle has more in common than a band
    odd = np.uint64(ODD)
    size = (minima != np.uint64(FILL)).sum(1)
    spare = np.minimum(_missing(size, threshold), np.maximum(size - rows, 0))
    taken = np.minimum(size, rows)
    found = []
    for x, n in sorted({*zip(spare.tolist(), taken.tolist(), strict=True)}):
        at = np.flatnonzero((spare == x) & (taken == n))
        part = minima[at, :x + n].T.copy()
        for chosen in combinations(range(x + n), n):
            number = np.full(len(at), n, np.uint64)
            for k in chosen:
                number = mix(number * odd + part[k])
            found.append((at, number))
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(f) for f in zip(*(found or [none]), strict=True))


def signatures(minima, threshold: float = THRESHOLD):
    """(row, number, left out, kept) of every set that a similar one can have in common with each row of sorted shingle hashes."""
    from itertools import combinations

    import numpy as np

    odd = np.uint64(ODD)
    size = (minima != np.uint64(FILL)).sum(1)
    values = mix(minima ^ odd)
    found = []
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        part = values[at, :n]
        whole = part.sum(1, dtype=np.uint64)
        for x in range(int(_missing(n, threshold)) + 1):
            out = np.array([*combinations(range(n), x)], np.int64)  # one empty row at x = 0
            number = mix(whole[:, None] - part[:, out].sum(2, dtype=np.uint64) + np.uint64((n - x) * ODD % 2**64))
            found.append((np.repeat(at, len(out)), number.reshape(-1), np.full(number.size, x), np.full(number.size, n - x)))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(f) for f in zip(*(found or [(none, none.astype(np.uint64), none, none)]), strict=True))


def paragraph_cutter(reach: int, minhashes: int | None = None):
    """A function from a list of texts to their paragraphs: (text, keys, minima, words, characters), arrays with one row each.

    A passage may stand inside a line, so lines do not show where it begins. Paragraphs are therefore cut at
    anchors that depend on the words around them alone: a place whose hash of two words is the least of some
    ``reach`` + 1 places in a row (winnowing), so no such window is without one. A paragraph begins at every anchor and
    ends at the first one ``SHORTEST`` words or more behind it, so paragraphs overlap, none is too short, and where one
    ends does not depend on where others begin. Two documents that share a passage have the same paragraphs from the first
    to the last anchor of the windows that lie inside it.
    ``text`` is the place of the text in the list, ``keys`` are two 64-bit hashes of the words, ``minima`` the ``minhashes`` (None: all) least distinct
    hashes of shingles in order (``FILL`` behind the last), ``words`` and ``characters`` the first and one past the last of each paragraph in its text.
    """
    import numpy as np

    odd = np.uint64(ODD)
    powers = {"n": 0, "up": None, "down": None}
    inverse = np.uint64(pow(ODD, -1, 2**64))

    def table(n: int):
        if powers["n"] < n:
            size = max(n, 1 << 14)
            with np.errstate(over="ignore"):
                powers["up"] = np.cumprod(np.full(size, odd), dtype=np.uint64)
                powers["down"] = np.cumprod(np.full(size, inverse), dtype=np.uint64)
            powers["n"] = size
        return powers["up"], powers["down"]

    def sums(values, starts, ends):
        """Hash of each stretch of values: a polynomial, shifted to the start of the stretch."""
        up, down = table(len(values) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:len(values)], dtype=np.uint64)))
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    none = np.zeros(0, np.int64)
    nothing = none, (none.astype(np.uint64),) * 2, [none.astype(np.uint64)] * (minhashes or 0), (none, none), (none, none)

    def cut(texts: list[str]):
        code = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum([len(t) + 1 for t in texts])  # one past the blank behind each text
        gap = np.concatenate(([True], (code == 32) | ((code >= 9) & (code <= 13))))
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        n = len(starts)
        if n < SHORTEST:
            return nothing
        owner = np.searchsorted(stops, starts, side="right")  # text of each word
        head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))  # first word of each text that has one
        tail = np.append(head[1:], n)
        word = sums(code.astype(np.uint64) + np.uint64(1), starts, ends)
        pair = mix(word[:-1] * odd + word[1:])
        width = reach + 1
        anchor = np.zeros(len(pair), bool)
        if len(pair) >= width:
            least = pair  # of each window
            for k in range(1, width):
                least = np.minimum(least[:-1], pair[k:])
            least = np.where(owner[:len(least)] == owner[width:width + len(least)], least, np.uint64(0))  # windows inside one text
            most = np.zeros(len(pair), np.uint64)  # the largest of the windows' least values around each place
            for k in range(width):
                np.maximum(most[k:k + len(least)], least, out=most[k:k + len(least)])
            anchor = (pair == most) & (most > 0)
        few = (tail - head <= width) & (tail - head >= SHORTEST)  # too short for a window: all its places are one
        if few.any():
            a, z = head[few], tail[few] - 1
            low = np.minimum.reduceat(np.append(pair, np.uint64(0)), np.stack((a, z), 1).reshape(-1))[::2]
            size = z - a
            at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            anchor[at[pair[at] == np.repeat(low, size)]] = True
        place = np.flatnonzero(anchor) + 1  # of equal words every place is an anchor
        first, last = np.sort(np.concatenate((head, place))), np.sort(np.concatenate((place, tail)))
        end_of = tail[np.searchsorted(head, first, side="right") - 1]
        at = np.searchsorted(last, first + SHORTEST)
        last = np.append(last, n + 1)[at]
        enough = last <= end_of
        first, last = first[enough], last[enough]
        if not len(first):
            return nothing
        minima = []
        if minhashes != 0:
            shingle = word[:n - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                shingle = mix(shingle * odd + word[k:n - SHINGLE + 1 + k])
            size = last - first - SHINGLE + 1
            place = np.arange(max(int(size.max()), minhashes or 0))
            sets = np.where(place < size[:, None], shingle[np.minimum(first[:, None] + place, len(shingle) - 1)], np.uint64(FILL))
            sets.sort(axis=1)
            again = sets[:, 1:] == sets[:, :-1]
            if (again & (sets[:, 1:] != np.uint64(FILL))).any():
                sets[:, 1:][again] = np.uint64(FILL)
                sets.sort(axis=1)
            minima = list(sets.T[:minhashes])
        keys = sums(word, first, last), sums(mix(word), first, last)
        text = owner[first]
        begin = np.concatenate(([0], stops))[text]
        base = head[np.searchsorted(head, first, side="right") - 1]
        return text, keys, minima, (first - base, last - base), (starts[first] - begin, ends[last - 1] - begin)

    return cut


def cutter(reach: int, minhashes: int | None = None):
    """``paragraph_cutter`` for one text: (keys, minima, words, characters), or None where it has no paragraph."""
    many = paragraph_cutter(reach, minhashes)

    def cut(text: str):
        found = many([text])
        return found[1:] if len(found[0]) else None

    return cut


def _blocks(batch):
    """(first row, texts) of consecutive rows of a batch, about ``BLOCK`` code points at a time; no text is cut."""
    at, held, size, block = 0, [], 0, BLOCK
    for k, text in enumerate(batch.column("text")):
        text = text.as_py() or ""
        if held and size + len(text) > block:
            yield at, held
            at, held, size = k, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield at, held


def _met(rows: DataFrame, reach: int, threshold: float, bits: int) -> list:
    """A filter of the keys that two rows or more have, and of the bands that different keys have."""
    def numbers(batch):
        import numpy as np

        cut, low = paragraph_cutter(reach), np.uint64(CHECK)
        for _, texts in _blocks(batch):
            text, (key, _), minima, _, _ = cut(texts)
            if not len(text):
                continue
            order = np.lexsort((text, key))
            new = np.ones(len(key), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])  # once a row
            yield _key_number(key[order][new]) & ~low
            first = order[np.concatenate(([True], key[order][1:] != key[order][:-1]))]  # once a block
            row, number = bands_of(np.stack(minima, 1)[first], threshold)
            yield (number & ~low) | (key[first][row] % low + np.uint64(1))

    return repeated_filter(rows.select("text"), numbers, bits, checked=True)


def _key_number(key):
    """The number by which a key stands in the filter of ``_met``; not that of a band."""
    import numpy as np

    return mix(key ^ np.uint64(ODD))


def _packed_keys(keys, good):
    """An Arrow array of the 16 bytes of each key at ``good``."""
    import numpy as np
    import pyarrow as pa

    raw = np.stack([k[good] for k in keys], 1).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(raw) // 16, [None, pa.py_buffer(raw)]).cast(pa.binary())


def _sets(rows: DataFrame, met: list, reach: int, threshold: float, bits: int) -> DataFrame:
    """(key, tokens): once each, the paragraphs that have a band in common with a different one, and their distinct shingles in order."""
    kept = rows.sparkSession.sparkContext.broadcast(met)

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cut, within, low = paragraph_cutter(reach), opened(kept.value, bits, twofold=True), np.uint64(CHECK.bit_length())
        for batch in batches:
            for _, texts in _blocks(batch):
                text, keys, minima, _, _ = cut(texts)
                if not len(text):
                    continue
                _, first = np.unique(np.stack(keys, 1).view("V16").reshape(-1), return_index=True)
                sets = np.stack(minima, 1)[first]
                row, number = bands_of(sets, threshold)
                good = np.unique(row[within(number >> low)])
                sets, first = sets[good], first[good]
                there = sets != np.uint64(FILL)
                edges = np.concatenate(([0], np.cumsum(there.sum(1)))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(edges), pa.array(sets[there].view(np.int64)))
                yield pa.RecordBatch.from_arrays([_packed_keys(keys, first), tokens], names=["key", "tokens"])

    return rows.select("text").mapInArrow(find, "key binary, tokens array<bigint>").dropDuplicates(["key"])


def _matrix(tokens):
    """The sorted sets of an Arrow column of token lists, as rows."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    inside = np.arange(int(size.max(initial=0))) < size[:, None]
    sets = np.full(inside.shape, np.uint64(FILL))
    sets[inside] = tokens.flatten().to_numpy().view(np.uint64)
    return sets


def similar_sets(sets: DataFrame, threshold: float, bits: int) -> DataFrame:
    """(a, b): pairs of ``sets`` (key, tokens; distinct keys, sorted tokens, written down) of a Jaccard similarity of ``threshold`` or
    more that connect all sets which any such pairs connect.

    Of sets with h shingles in common that lack x and y of each other's, x + y is at most h * (1 - threshold) / threshold. So a set
    goes to a cell for each set it can have in common with a similar one (``signatures``), and in each cell to the one that leaves out least
    there, if that is near enough: if it is not, no set of the cell is. A cell costs one row a set, and no pairs.
    """
    spark = sets.sparkSession

    def numbers(batch):
        for at in range(0, batch.num_rows, 1_000):
            yield signatures(_matrix(batch.column(0).slice(at, 1_000)), threshold)[1]

    kept = spark.sparkContext.broadcast(repeated_filter(sets.select("tokens"), numbers, bits))
    release(spark)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        within = opened(kept.value, bits, twofold=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                row, number, x, h = signatures(_matrix(part.column(1)), threshold)
                good = within(number)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[good])), pa.array(number[good].view("int64")),
                                                  pa.array(x[good], pa.int32()), pa.array(h[good], pa.int32())], names=["key", "cell", "x", "h"])

    cells = pin(sets.select("key", "tokens").mapInArrow(find, "key binary, cell bigint, x int, h int"), "zstd")
    hubs = cells.groupBy("cell").agg(F.min(F.struct("x", "key")).alias("hub"))
    near = (F.col("key") != F.col("hub.key")) & (F.col("x") + F.col("hub.x") <= F.col("h") * ((1 - threshold) / threshold) + 1e-9)
    found = pin(cells.join(hubs, "cell").filter(near).select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct())
    forget(cells)
    release(spark)
    return found


def _classes(sets: DataFrame, reach: int, threshold: float, bits: int) -> DataFrame:
    """(key, comp) of the keys of ``sets`` that are similar to another."""
    from math import comb

    most = SHORTEST + reach - SHINGLE + 1  # shingles of the longest paragraph
    if sum(comb(most, x) for x in range(int(_missing(most, threshold)) + 1)) <= MANY:
        return components(similar_sets(sets, threshold, bits))

    def buckets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            row, number = bands_of(_matrix(batch.column(1)), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(number.view("int64")), batch.column(0).take(pa.array(row))], names=["bucket", "key"])

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("key").alias(k), F.col("tokens").alias(f"_{k}")) for k in "ab")
        return pin(pairs.join(a, "a").join(b, "b").select("a", "b", jaccard(F.col("_a"), F.col("_b")).alias("similarity")))

    return linked_classes(crowded(pin(sets.select("key", "tokens").mapInArrow(buckets, "bucket bigint, key binary").distinct())), verify, threshold)[0]


def _places(rows: DataFrame, met: list, classes: DataFrame, reach: int, bits: int) -> DataFrame:
    """(key, doc_id, mark, w, c): the paragraphs that another row has too, or that are in one of ``classes``.

    ``w`` and ``c`` are first and one past the last word and code point, 32 bits each.
    """
    def halves(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            pair = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[::2])], names=["h"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    context = rows.sparkSession.sparkContext
    kept = context.broadcast((met, bit_filter(classes.select("key").mapInArrow(halves, "h bigint"), bits)))

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cut, low, high = paragraph_cutter(reach, 0), np.uint64(CHECK.bit_length()), np.uint64(32)
        repeated, similar = opened(kept.value[0], bits, twofold=True), opened(kept.value[1], bits)

        def packed(pair, good):
            return pa.array((pair[0][good].astype(np.uint64) << high | pair[1][good].astype(np.uint64)).view(np.int64))

        for batch in batches:
            for at, texts in _blocks(batch):
                text, keys, _, words, chars = cut(texts)
                good = repeated(_key_number(keys[0]) >> low) | similar(keys[0])
                if not good.any():
                    continue
                index = pa.array(at + text[good])
                yield pa.RecordBatch.from_arrays([_packed_keys(keys, good), batch.column(0).take(index), batch.column(2).take(index), packed(words, good), packed(chars, good)],
                                                 names=["key", "doc_id", "mark", "w", "c"])

    return rows.select("doc_id", "text", "mark").mapInArrow(find, f"key binary, doc_id {kind}, mark bigint, w bigint, c bigint")


def shared_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH,
                    least_words: int = LEAST_WORDS, threshold: float = THRESHOLD,
                    gap: int = GAP, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shared, n_removed, shared, removed, first_ids.

    Paragraphs (see ``cutter``) that are equal, or whose five-word shingles have a Jaccard similarity
    of at least ``threshold``, are of one class; classes are components of verified pairs. A paragraph is
    shared if its class stands in two documents or more, and counts if the run of neighbouring shared
    paragraphs has ``least_words`` words or more; up to ``gap`` words between two runs first seen in the same document are bridged,
    since an altered word spoils all paragraphs that hold it. All but the first place of a class (smallest id, null last; then place) are to
    be removed; paragraphs overlap, and those over the first place stay with it. ``shared`` and ``removed`` are lists of start:end in code points, joined by commas; ``n_`` count
    paragraphs; ``first_ids`` are the documents that keep what is removed here.

    Null and short texts have no paragraphs. Rows that repeat id and text are one document, and get
    equal rows; repetitions inside one document are left alone. An empty table gives an empty result; other columns are ignored.
    """
    rows = take(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.select("doc_id", text_of("text").alias("text"), F.xxhash64(text_of("text")).alias("mark"))
    met = _met(rows, reach, threshold, filter_bits)
    release(rows.sparkSession)
    # a key is a row, in however many documents it stands
    sets = pin(_sets(rows, met, reach, threshold, filter_bits), "zstd")
    release(rows.sparkSession)
    classes = _classes(sets, reach, threshold, filter_bits)
    forget(sets)
    release(rows.sparkSession)
    places = pin(_places(rows, met, classes, reach, filter_bits), "zstd")
    named = pin(places.join(classes, "key", "left").select(F.coalesce("comp", "key").alias("class"), "doc_id", "mark", "w", "c"), "zstd")
    forget(places, classes)
    release(rows.sparkSession)
    document = [F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark")]
    groups = named.groupBy("class").agg(F.min(F.struct(*document, "w")).alias("first"), F.max(F.struct(*document)).alias("last"))
    other = ~F.col("first.doc_id").eqNullSafe(F.col("last.doc_id")) | (F.col("first.mark") != F.col("last.mark"))
    groups = pin(groups.filter(other).select("class", "first"))
    release(rows.sparkSession)
    shared = named.join(groups, "class")
    # paragraphs overlap: one that lies over the first place is no repetition of it
    is_first = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("mark") == F.col("first.mark")) & (
        F.shiftrightunsigned("w", 32) < F.col("first.w").bitwiseAND(0xFFFFFFFF))
    spans = shared.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(
        "w", "c", is_first.alias("first"), F.col("first.doc_id").alias("id"))).alias("spans"))  # at most a document's own paragraphs
    told = pin(_runs(spans, least_words, gap), "zstd")
    forget(groups, named)
    release(rows.sparkSession)
    joined = rows.select("doc_id", "mark").join(told.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}),
                                                F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    kinds = told.schema
    zero = {"n_shared": F.lit(0), "n_removed": F.lit(0), "shared": F.lit(""), "removed": F.lit(""), "first_ids": F.array()}
    return joined.select("doc_id", *[F.coalesce(name, value.cast(kinds[name].dataType)).alias(name) for name, value in zero.items()])


def _runs(spans: DataFrame, least_words: int, gap: int) -> DataFrame:
    """What is told of a document's shared paragraphs that stand in runs of enough words."""
    kind = spans.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "mark", "n_shared", "n_removed", "shared", "removed", "first_ids"]

    def runs(found: list) -> list:
        """Those of the spans (w, c, first, id), in order, that stand in runs of enough words."""
        good, run, start, stop, before = [], [], 0, -1, None
        for span in found:
            a, b = span[0] >> 32, span[0] & 0xFFFFFFFF
            if run and (a <= stop or (span[3] == before and a <= stop + gap)):
                run.append(span)
                stop = max(stop, b)
            else:
                if run and stop - start >= least_words:
                    good += run
                run, start, stop = [span], a, b
            before = span[3]
        return good + run if run and stop - start >= least_words else good

    def said(found: list) -> str:
        return ",".join(f"{s[1] >> 32}:{s[1] & 0xFFFFFFFF}" for s in found)

    def tell(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2)
            edges = lists.offsets.to_pylist()
            values = lists.values
            w, c, first, ids = (values.field(k).to_pylist() for k in range(4))
            out: list = [[] for _ in range(5)]
            for a, z in zip(edges, edges[1:], strict=False):
                # rows that repeat id and text are one document, whose paragraphs begin at different words
                own = {w[k]: (w[k], c[k], first[k], ids[k]) for k in range(a, z)}
                good = runs([own[k] for k in sorted(own)])
                gone = [s for s in good if not s[2]]
                known = {s[3] for s in gone}
                row = len(good), len(gone), said(good), said(gone), sorted(known - {None}) + ([None] if None in known else [])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(values.field(3).type)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=names)

    return spans.select("doc_id", "mark", "spans").mapInArrow(
        tell, f"doc_id {kind}, mark bigint, n_shared bigint, n_removed bigint, shared string, removed string, first_ids array<{kind}>")
