import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from labelwright.llm import near_dedup
from labelwright.llm.linking import components, crowded, linked_classes
from labelwright.llm.near_dedup import drop_near_copies, near_duplicates, prob_minhash

from .fixtures import SCHEMA, no_documents, odd_documents, odd_rows


def shingle_set(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows, threshold=0.8):
    sets = {}
    for _, t in rows:
        sets.setdefault(shingle_set(t) if len(shingle_set(t)) else frozenset(), None)
    keys = list(sets)
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(a & b) >= threshold * len(a | b):
                up[root(a)] = root(b)
    groups = {}
    for i, t in rows:
        groups.setdefault(root(shingle_set(t)), []).append(i)
    return Counter(tuple(sorted(g, key=str)) for g in groups.values())


def got_classes(df):
    groups = {}
    rows = df.collect()
    for r in rows:
        groups.setdefault(r.class_id, []).append(r)
    for members in groups.values():
        assert sum(m.kept for m in members) == 1 and {m.class_size for m in members} == {len(members)}
    return Counter(tuple(sorted((m.doc_id for m in g), key=str)) for g in groups.values())


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    rows, n = [], 0
    base = [word() for _ in range(120)]
    for k in range(60):  # copies of one original, far from each other
        copy = list(base)
        for at in rnd.sample(range(120), 2):
            copy[at] = f"x{k}y{at}"
        rows.append((n := n + 1, " ".join(copy)))
    rows.append((n := n + 1, " ".join(base)))
    chain = [word() for _ in range(300)]
    for k in range(6):  # a chain: neighbours are near, ends are not
        rows.append((n := n + 1, " ".join(chain[k * 20:k * 20 + 200])))
    shared = [word() for _ in range(80)]
    for _ in range(30):  # share a passage, but are not near
        rows.append((n := n + 1, " ".join([word() for _ in range(60)] + shared)))
    for _ in range(60):
        rows.append((n := n + 1, " ".join(word() for _ in range(rnd.randint(1, 90)))))
    return rows


def test_classes_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA)
    assert got_classes(near_duplicates(docs)) == brute_classes(rows)


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got_classes(near_duplicates(docs)) == brute_classes(rows)


def test_no_similar_pair_is_told_apart_without_its_texts(spark, monkeypatch):
    """Pairs of similarity 0.8 and more, one text of which repeats a stretch, stay candidates wherever they meet."""
    rnd, rows, seen = random.Random(12), [], {}
    some = lambda n: ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    for k in range(25):
        core = some(214)
        rows += [(2 * k, " ".join(core + some(22))), (2 * k + 1, " ".join(core + core[100:144] * 4 + some(9)))]
    assert sum(len(g) == 2 for g in brute_classes(rows)) == 25

    def asked(rows, verify, threshold, **more):
        seen.update(more, rows=rows)
        raise InterruptedError

    monkeypatch.setattr(near_dedup, "linked_classes", asked)
    with pytest.raises(InterruptedError):
        near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    left = seen["rows"].select("bucket", "key").join(seen["sketches"], "key")
    meet = left.alias("x").join(left.alias("y"), "bucket").filter("x.key < y.key")
    alike = left.alias("x").join(left.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") < F.col("y.key")) & seen["alike"]("x", "y"))
    assert alike.count() == meet.select("x.key", "y.key").distinct().count() >= 15


def test_texts_that_repeat_lines_unequally_meet(spark):
    """Nearly equal shingle sets, one text of which has many shingles a hundred times."""
    rnd, rows = random.Random(13), []
    for k in range(40):
        core = ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(254)]
        rows += [(2 * k, " ".join(core)), (2 * k + 1, " ".join(core + core[100:204] * 99))]
    assert all(len(g) == 2 for g in brute_classes(rows))
    bands = {r.doc_id: set(r.bands) for r in near_dedup.signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(bands[2 * k] & bands[2 * k + 1] for k in range(40))


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 3]
    got = got_classes(near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute_classes([r[:2] for r in rows])
    whole = near_duplicates(odd_documents(spark)).collect()
    assert Counter(r.doc_id for r in whole) == Counter(r[0] for r in odd_rows())
    stay = drop_near_copies(odd_documents(spark))
    assert stay.columns == SCHEMA.names and stay.count() == sum(r.kept for r in whole)


def test_empty_table(spark):
    assert near_duplicates(no_documents(spark)).collect() == []
    assert drop_near_copies(no_documents(spark)).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.key: r.comp for r in components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_links_away_from_the_hub_are_found(spark):
    """Hub 0 is near nobody; 1-2 and 3-4 are near."""
    sims = {(1, 2): 0.9, (3, 4): 0.85}
    asked = []

    def verify(pairs):
        rows = [(r.a, r.b) for r in pairs.collect()]
        asked.extend(rows)
        return spark.createDataFrame([(a, b, sims.get((a, b), 0.5)) for a, b in rows] or [(0, 0, 0.0)], "a long, b long, similarity double").filter("a != b")

    cells = spark.createDataFrame([(7, k) for k in range(5)] + [(8, 0), (8, 9)], "bucket long, key long")
    classes, links = linked_classes(crowded(cells), verify)
    assert {r.key: r.comp for r in classes.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert len(asked) == len(set(asked))


@pytest.mark.parametrize("weights", [(1, 1), (1, 3)])
def test_signature_agreement_is_probability_jaccard(weights):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.arange(0, 200), np.arange(60, 300)
    wa, wb = np.ones(300), np.ones(300)
    wa[100:], wb[100:] = weights[0], weights[1]
    value, doc = np.r_[h[a], h[b]], np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    kept = prob_minhash(value, np.r_[wa[a], wb[b]], doc, 2, 4096)
    x, y = np.zeros(300), np.zeros(300)
    x[a], y[b] = wa[a], wb[b]
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(300) if x[i] and y[i])
    assert abs((kept[0] == kept[1]).mean() - want) < 0.03
