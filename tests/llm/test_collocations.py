import random
import re
from collections import Counter

import numpy as np

from labelwright.llm.collocations import collocations, pack_pairs, summed_pairs, tile_counts, unpack_pairs

from .fixtures import SCHEMA, no_documents, odd_documents, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least, longest=4, top=2_000):
    f, out = {}, set()
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            own.update(tuple(words[i:i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        found = []
        candidates = [p for p, c in own.items() if len(p) > 1 and c >= least]
        covered = Counter()
        for q in candidates:
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    covered[q[i:i + m]] = max(covered[q[i:i + m]], own[q])
        for p in candidates:
            a = own[p]
            if 100 * covered[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(sorted(found)[:top])}
    return out


def answer(docs, **options):
    return {tuple(r) for r in collocations(docs, **options).collect()}


def chatter(seed, n):
    rnd = random.Random(seed)
    words = ["The", "of", "naïve", "Ärger", "x", "12", "don't", "日本語", "🙂", "st", "new", "york", "city", "a", "b"]
    return [(rnd.choice(["en", "de", None, "und"]), rnd.choice([" ", "\t", "  "]).join(
        rnd.choice([rnd.choice(words), "New York City", "a b a b", "the of"]) + rnd.choice(["", "", "", ",", ".", "\n", "\r"]) for _ in range(rnd.randint(0, 60))))
        for _ in range(n)]


def test_matches_brute_force_whatever_the_tasks_hold(spark):
    rows = chatter(3, 150)
    docs = spark.createDataFrame([(i, t, lang, None, None, "clash", None, 1) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(4)
    want = brute_force(rows, 3)
    assert len(want) > 200
    for head, bits in ((300_000, 1 << 20), (5, 1 << 20), (0, 1 << 18), (40, 1 << 18)):
        assert answer(docs, least=3, head=head, filter_bits=bits) == want
    assert answer(docs, least=3, top=7) == brute_force(rows, 3, top=7)
    assert answer(docs, least=2, longest=3) == brute_force(rows, 2, longest=3)


def test_odd_rows_and_empty_table(spark):
    rows = [(r[2], r[1]) for r in odd_rows()]
    for head in (300_000, 3):
        assert answer(odd_documents(spark), least=2, head=head) == brute_force(rows, 2)
    assert answer(no_documents(spark)) == set()


def test_copies_count_and_nested_phrases_go(spark):
    rows = [("en", "one two three four. one two")] * 40 + [("en", "two three")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert answer(docs) == brute_force(rows, 30)


def test_tiles_count_like_a_dictionary():
    rnd = np.random.default_rng(1)
    for n, side in ((0, 4), (1, 4), (5_000, 8), (5_000, 64), (200, 1_024)):
        a, b = (np.minimum((rnd.pareto(0.8, n) * 3).astype(np.int64), 1 << 40) for _ in range(2))
        x, y, f = tile_counts(a, b, side)
        assert Counter(dict(zip(zip(x.tolist(), y.tolist(), strict=True), f.tolist(), strict=True))) == Counter(zip(a.tolist(), b.tolist(), strict=True))


def test_packed_pairs_come_back():
    rnd = np.random.default_rng(2)
    for n, top in ((0, 9), (1, 9), (4_000, 50), (4_000, 1 << 45)):
        a, b, f = (rnd.integers(0, top, n) for _ in range(3))
        x, y, z = summed_pairs(a, b, f)
        want = Counter()
        for p, q, r in zip(a.tolist(), b.tolist(), f.tolist(), strict=True):
            want[p, q] += r
        assert [*zip(x.tolist(), y.tolist(), z.tolist(), strict=True)] == [(*k, want[k]) for k in sorted(want)]
        for one, other in zip(unpack_pairs(pack_pairs(x, y, z)), (x, y, z), strict=True):
            assert one.tolist() == other.tolist()
