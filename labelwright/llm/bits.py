"""Filters of bounded size over any number of keys: they never miss one, a false hit costs a row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_filter(hashes: DataFrame, bits: int) -> list[tuple[int, bytes]]:
    """Bit array, in segments, of the 64-bit numbers in the only column of ``hashes``; ``bits`` is a power of two, 2^18 at least.

    Each segment is filled in one task from its distinct places, so neither a task nor the driver gets more than the bits themselves.
    """
    segments = bits >> 18
    size = 1 << 18
    rows = hashes.toDF("h").select(F.col("h").bitwiseAND(bits - 1).alias("p"))
    spots = rows.select(F.shiftright("p", 18).cast("int").alias("segment"), F.col("p").bitwiseAND(size - 1).cast("int").alias("at")).distinct()

    def fill(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found: dict = {}
        for batch in batches:
            segment, at = (batch.column(k).to_numpy() for k in (0, 1))
            for k in np.unique(segment).tolist():
                found.setdefault(k, np.zeros(size, bool))[at[segment == k]] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(b).tobytes() for b in found.values()], pa.binary())],
                                             names=["segment", "bits"])

    return [(r[0], bytes(r[1])) for r in spots.repartition(min(segments, 64), "segment").mapInArrow(fill, "segment int, bits binary").collect()]


def opened(segments: list[tuple[int, bytes]], bits: int, *, twofold: bool = False):
    """A function from an array of 64-bit numbers to the truth of being in the filter; ``twofold`` for those of ``repeated_filter``."""
    import numpy as np

    table = np.zeros(bits // 8, np.uint8)
    for k, packed in segments:
        table[k << 15:(k << 15) + len(packed)] = np.frombuffer(packed, np.uint8)

    def stands(place):
        return (table[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1

    def within(hashes):
        hashes = hashes.astype(np.uint64)
        first = stands(hashes & np.uint64(bits - 1))
        return first & stands(_second(hashes, bits)) if twofold else first

    return within


def _second(hashes, bits: int):
    """Another place of a number, in the same piece of the filter, from the bits behind those of the first."""
    import numpy as np

    share = np.uint64(bits // PIECES)
    return (hashes & np.uint64(bits - 1)) // share * share + ((hashes >> np.uint64(bits.bit_length() - 1)) & (share - np.uint64(1)))


#: Pieces that the bits of a filter of repeated numbers are filled in.
PIECES = 256
#: Input partitions whose numbers one task may hold at a time.
TOGETHER = 64
#: Low bits of the numbers of a checked filter: who has the number, or 0 where every row counts.
CHECK = 0xFFFF


def repeated_filter(df: DataFrame, numbers, bits: int, *, checked: bool = False) -> list[tuple[int, bytes]]:
    """Bit array, in segments as in ``bit_filter``, of the 64-bit numbers that two rows of ``df`` or more have; each sets two bits.

    ``numbers`` maps an Arrow batch of ``df`` to arrays of numbers without repetitions inside a row. A task sends each
    number twice at most, sorted and packed by place, so a number that every row has is a few bytes per task, and no row is made per number. Six
    bytes of each are sent: numbers that differ in the others only pass for one, which is a false hit like others.

    With ``checked`` the low bits (``CHECK``) of a number say who has it, and are no part of it: it counts if two have it, or, where they
    are 0, if two rows do. The filter holds what stands above them.
    """
    import math

    # more slices of each piece as the input grows, so that a task's share stays the same
    slices = max(1, math.ceil(df.rdd.getNumPartitions() / TOGETHER))
    share = bits // PIECES
    wide = 8 if checked else 6

    def numbered(found):
        """Of sorted ones those that count, and their numbers, without the low bits if these say who has it."""
        if not checked:
            return found, found
        import numpy as np

        again = np.concatenate(([False], (found[1:] == found[:-1]) & (found[1:] & np.uint64(CHECK) != 0))) if len(found) else np.zeros(0, bool)
        found = found[~again]
        return found, found >> np.uint64(CHECK.bit_length())

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def out():
            found, number = numbered(np.sort(np.concatenate(held)))
            held.clear()
            thrice = np.concatenate(([False, False], number[2:] == number[:-2])) if len(found) > 2 else np.zeros(len(found), bool)
            found, number = found[~thrice], number[~thrice]
            part = ((number & np.uint64(bits - 1)) // np.uint64(share)).astype(np.int64) * slices
            part += ((number >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            found, part = found[order], part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = np.append(at[1:], len(part))
            yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array([found[a:b].view(np.uint8).reshape(-1, 8)[:, :wide].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())],
                                             names=["part", "packed"])

        for batch in batches:
            for found in numbers(batch):
                if len(found):
                    held.append(found)
                    size += len(found)
                    if size > 4_000_000:
                        yield from out()
                        size = 0
        if size:
            yield from out()

    def fill(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, now = [], None

        def out():
            sent = np.frombuffer(b"".join(held), np.uint8).reshape(-1, wide)
            found = np.zeros((len(sent), 8), np.uint8)
            found[:, :wide] = sent
            _, found = numbered(np.sort(found.view("<u8").reshape(-1)))
            twice = found[1:][found[1:] == found[:-1]]
            piece = now // slices
            table = np.zeros(share, bool)
            for place in (twice & np.uint64(bits - 1), _second(twice, bits)):
                table[place.astype(np.int64) - piece * share] = True
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["piece", "bits"])

        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is not None and part != now:
                    yield from out()
                    held = []
                now = part
                held.append(packed)
        if held:
            yield from out()

    packed = df.mapInArrow(pack, "part int, packed binary")
    filled = packed.repartition(PIECES * min(slices, 16) // 4, "part").sortWithinPartitions("part").mapInArrow(fill, "piece int, bits binary")
    tables: dict[int, int] = {}
    for piece, table in filled.toLocalIterator():
        tables[piece] = tables.get(piece, 0) | int.from_bytes(table, "little")
    whole = b"".join(tables.get(k, 0).to_bytes(share // 8, "little") for k in range(PIECES))
    return [(k, whole[k << 15:(k + 1) << 15]) for k in range(bits >> 18)]
