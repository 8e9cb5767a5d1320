import random
from collections import Counter

import numpy as np
import pytest

from labelwright.llm.linking import components, crowded, linked_classes, rare_shingles
from labelwright.llm.passages import FILL, LEAST_WORDS, REACH, bands_of, cutter, paragraph_cutter, shared_passages, signatures, similar_sets

from .fixtures import SCHEMA, no_documents, odd_documents, odd_rows


def rnd_words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def spans(said):
    return [tuple(map(int, s.split(":"))) for s in said.split(",")] if said else []


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rnd = random.Random(8)
    passages = [" ".join(rnd_words(rnd, rnd.randint(51, 120))) for _ in range(60)]
    rows, planted = [], {}
    for k, passage in enumerate(passages):
        for j in range(rnd.choice([2, 2, 3, 6])):
            doc_id = len(rows)
            before, after = rnd_words(rnd, rnd.randint(0, 200)), rnd_words(rnd, rnd.randint(0, 200))
            text = " ".join(before) + rnd.choice([" ", "\n", "\t"]) + passage + " " + " ".join(after)
            at = text.index(passage)
            planted[doc_id] = (k, j, at, at + len(passage))
            rows.append((doc_id, text))
    clean = range(10_000, 10_150)
    rows += [(i, " ".join(rnd_words(rnd, rnd.randint(1, 300))) + "\nLicensed under the Apache License, Version 2.0.") for i in clean]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in shared_passages(docs).collect()}
    assert set(got) == {i for i, _ in rows}
    firsts = {k: min(i for i, p in planted.items() if p[0] == k) for k in range(60)}
    missed = [i for i, (k, _, _, _) in planted.items() if not got[i].n_shared]
    assert not missed
    for i, (k, _, a, b) in planted.items():
        # a long paragraph at the edge may be similar enough with a word or two more
        assert all(a - 30 <= x < y <= b + 30 for x, y in spans(got[i].shared))
        # a paragraph at the edge can be cut in the first document as it is in no other
        assert (firsts[k] in got[i].first_ids) == (i != firsts[k]), (i, firsts[k], got[i])
        assert all(planted[x][0] == k and x < i for x in got[i].first_ids if x != firsts[k])
    assert all(got[i].n_shared == 0 for i in clean)


def test_altered_paragraphs_are_linked(spark):
    rnd = random.Random(9)
    found = 0
    for trial in range(1):
        rows = []
        for k in range(40):
            passage = rnd_words(rnd, 90)
            rows.append((2 * k, " ".join(rnd_words(rnd, 30) + passage)))
            passage[rnd.randint(30, 60)] = "altered"
            rows.append((2 * k + 1, " ".join(rnd_words(rnd, 30) + passage)))
        got = {r.doc_id: r for r in shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        found = sum(got[2 * k + 1].first_ids == [2 * k] for k in range(40))
    assert found == 40


def test_a_document_that_repeats_itself_is_left_alone(spark):
    rnd = random.Random(10)
    passage = " ".join(rnd_words(rnd, 80))
    rows = [(1, passage + "\n" + passage), (2, " ".join(rnd_words(rnd, 100)))]
    assert {r.doc_id: r.n_shared for r in shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 0, 2: 0}


def test_cuts_inside_a_passage_do_not_depend_on_its_surroundings():
    rnd, cut = random.Random(11), cutter(5, 2)
    for _ in range(50):
        passage = " ".join(rnd_words(rnd, 200))
        found = []
        for _ in range(2):
            text = " ".join(rnd_words(rnd, rnd.randint(20, 60))) + " " + passage + " " + " ".join(rnd_words(rnd, 40))
            at = text.index(passage)
            keys, _, _, chars = cut(text)
            found.append({(int(k), int(a) - at, int(b) - at) for k, a, b in zip(keys[0], *chars, strict=True) if a > at + 60 and b < at + len(passage) - 60})
        assert found[0] == found[1] and len(found[0]) > 5


def test_odd_rows_and_empty_table(spark):
    got = Counter(r.doc_id for r in shared_passages(odd_documents(spark)).collect())
    assert got == Counter(r[0] for r in odd_rows())
    assert shared_passages(no_documents(spark)).collect() == []


def test_every_run_of_51_words_gives_20_shared_words():
    cut = cutter(REACH, 2)
    for seed in range(3_000):
        rnd = random.Random(seed)
        n, found = 51 + seed % 10, []
        passage = rnd_words(rnd, n)
        for _ in range(2):
            before = rnd.randint(0, 60)
            text = " ".join(rnd_words(rnd, before) + passage + rnd_words(rnd, rnd.randint(0, 60)))
            keys, _, places, _ = cut(text)
            found.append({(int(k), int(a) - before, int(b) - before) for k, a, b in zip(keys[0], *places, strict=True)})
        longest = start = stop = 0
        for a, b in sorted((a, b) for _, a, b in found[0] & found[1] if a >= 0 and b <= n):
            start, stop = (start, max(stop, b)) if a <= stop else (a, b)
            longest = max(longest, stop - start)
        assert longest >= LEAST_WORDS, seed


def plain_passages(rows, least=LEAST_WORDS, gap=24):
    """``shared``, ``removed`` and ``first_ids`` of documents with ids of their own, from all pairs of paragraphs."""
    import re

    cut = cutter(REACH, 1)
    places = []
    for i, text in rows:
        if (found := cut(text)) is not None:
            _, _, (a, b), (x, y) = found
            places += [(i, int(p), int(q), int(s), int(t), tuple(re.findall(r"[^ \t-\r]+", text[s:t]))) for p, q, s, t in zip(a, b, x, y, strict=True)]
    keys = sorted({p[5] for p in places})
    sets = [{k[n:n + 5] for n in range(len(k) - 4)} for k in keys]
    head = list(range(len(keys)))

    def root(n):
        while head[n] != n:
            n = head[n]
        return n

    for m in range(len(keys)):
        for n in range(m):
            if len(sets[m] & sets[n]) >= 0.8 * len(sets[m] | sets[n]):
                head[root(m)] = root(n)
    groups = {}
    for p in places:
        groups.setdefault(root(keys.index(p[5])), []).append(p[:5])
    own = {i: [] for i, _ in rows}
    for members in groups.values():
        if len({m[0] for m in members}) > 1:
            first = min(members)
            for i, a, b, s, t in members:
                own[i].append((a, b, s, t, i == first[0] and a < first[2], first[0]))
    out = {}
    for i, spans in own.items():
        good, run, before = [], [], None
        for s in sorted(spans):
            if run and (s[0] <= max(r[1] for r in run) or (s[5] == before and s[0] <= max(r[1] for r in run) + gap)):
                run.append(s)
            else:
                good += run if run and max(r[1] for r in run) - run[0][0] >= least else []
                run = [s]
            before = s[5]
        good += run if run and max(r[1] for r in run) - run[0][0] >= least else []
        gone = [s for s in good if not s[4]]
        said = [",".join(f"{s[2]}:{s[3]}" for s in x) for x in (good, gone)]
        out[i] = (len(good), len(gone), *said, sorted({s[5] for s in gone}))
    return out


def test_shared_removed_and_first_ids_equal_a_plain_recomputation(spark):
    rnd = random.Random(21)
    passages = [rnd_words(rnd, rnd.randint(10, 90)) for _ in range(14)]
    rows = []
    for i in range(70):
        words = []
        for _ in range(rnd.randint(0, 4)):
            part = list(rnd.choice(passages))
            if rnd.random() < 0.5:
                part[rnd.randrange(len(part))] = "altered"
            words += rnd_words(rnd, rnd.randint(0, 40)) + part[rnd.randint(0, 8):]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(words)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, ""), (201, "a b c d e f g"), (202, "same same " * 40), (203, "same same " * 30)]
    want = plain_passages(rows)
    assert sum(w[1] for w in want.values()) > 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shared, r.n_removed, r.shared, r.removed, r.first_ids) for r in shared_passages(docs).collect()}
    assert got == want


def test_altered_passages_are_seldom_missed(spark):
    rnd, rows, planted = random.Random(22), [], {}
    kinds = [(60, 1), (60, 2), (90, 3), (100, 4), (120, 6)]
    for kind in kinds:
        for _ in range(60):
            passage, i = rnd_words(rnd, kind[0]), len(rows)
            for k in range(2):
                for at in rnd.sample(range(kind[0]), kind[1]) if k else ():
                    passage[at] = "altered"
                rows.append((i + k, " ".join(rnd_words(rnd, rnd.randint(5, 50)) + passage + rnd_words(rnd, rnd.randint(5, 50)))))
            planted[i + 1] = kind
    got = {r.doc_id: r.first_ids for r in shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    missed = Counter(kind for i, kind in planted.items() if got[i] != [i - 1])
    assert all(missed[kind] <= 0.1 * 60 for kind in kinds), missed


def test_many_texts_are_cut_like_one():
    rnd, many, one = random.Random(23), paragraph_cutter(REACH, 2), cutter(REACH, 2)
    texts = [" ".join(rnd_words(rnd, rnd.choice([0, 3, 6, 7, 12, 13, 14, 15, 40, 300]))) + rnd.choice(["", " ", "\n\n"]) for _ in range(80)]
    texts += ["", " ", "x", "a a a a a a a a", "\U0001f642 " * 30]
    text, keys, minima, words, chars = many(texts)
    for k, t in enumerate(texts):
        mine, alone = text == k, one(t)
        assert (alone is None) == (not mine.any())
        if alone is not None:
            for a, b in zip((*keys, *minima, *words, *chars), (*alone[0], *alone[1], *alone[2], *alone[3]), strict=True):
                assert a[mine].tolist() == b.tolist()


def test_a_bucket_around_a_common_line_is_not_compared_pair_by_pair(spark):
    """Keys of one bucket that share a frequent half were all compared with each other: 300 keys, 44,850 pairs less the hub's."""
    rnd = random.Random(12)
    common = list(range(1, 7))
    sets = {f"k{i:03d}": sorted(common + rnd.sample(range(1_000, 60_000), 6)) for i in range(300)}
    for i in range(0, 40, 2):  # pairs of similarity 0.85 that the hub is not similar to
        sets[f"k{i:03d}"] = sorted(sets[f"k{i:03d}"] + [100_000 + i])
        sets[f"k{i + 1:03d}"] = sets[f"k{i:03d}"][:-1]
    table = spark.createDataFrame(list(sets.items()), "key string, tokens array<bigint>")
    asked = []

    def verify(pairs):
        rows = [tuple(r) for r in pairs.select("a", "b").collect()]
        asked.extend(rows)
        return spark.createDataFrame([(a, b, len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})) for a, b in rows],
                                     "a string, b string, similarity double")

    cells = crowded(spark.createDataFrame([(b, k) for k in sets for b in (1, 2)], "bucket bigint, key string"))
    classes, _ = linked_classes(cells, verify, finer=lambda keys: rare_shingles(table.join(keys, "key")))
    got = {r.key: r.comp for r in classes.collect()}
    assert {k: v for k, v in got.items() if int(k[1:]) >= 40} == {}
    assert all(got.get(f"k{i:03d}") == got.get(f"k{i + 1:03d}") == f"k{i:03d}" for i in range(0, 40, 2))
    assert len(asked) < 2_000


def test_similar_sets_share_a_rare_shingle(spark):
    rnd = random.Random(13)
    sets = [rnd.sample(range(-20, 20), rnd.randint(1, 15)) for _ in range(60)]
    sets += [[*s[:-1], 99] if rnd.random() < 0.5 else [*s, 98] for s in sets]
    rows = rare_shingles(spark.createDataFrame(list(enumerate(sets)), "key int, tokens array<bigint>")).collect()
    rare = {}
    for r in rows:
        rare.setdefault(r.key, set()).add(r.token)
    similar = [(i, j) for i in range(120) for j in range(i) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})]
    assert len(similar) > 20 and all(rare[i] & rare[j] for i, j in similar)
    assert all(rare[i] <= {*sets[i]} and len(rare[i]) <= 1 + 0.2 * len(sets[i]) + 1e-6 for i in range(120))


def heads_of(links):
    """The smallest member of each one's component."""
    head = {}

    def root(n):
        while head.setdefault(n, n) != n:
            n = head[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        head[b] = a
    return {n: root(n) for n in [*head]}


def similar_pairs(sets, threshold=0.8):
    return [(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= threshold * len({*sets[a]} | {*sets[b]})]


def families(rnd, n):
    """Sets of up to 14 numbers, many of them similar: members of a family lack or add a few."""
    sets = {}
    while len(sets) < n:
        core = rnd.sample(range(2**62), rnd.randint(1, 14))
        for _ in range(rnd.randint(1, 8)):
            own = core[:]
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                own.pop(rnd.randrange(len(own))) if rnd.random() < 0.6 and len(own) > 1 else own.append(rnd.randrange(2**62)) if len(own) < 14 else None
            sets[f"k{len(sets):04d}".encode()] = sorted(own, key=lambda t: t % 2**64)
    return sets


def matrix(sets):
    out = np.full((len(sets), 15), FILL, np.uint64)
    for k, own in enumerate(sets.values()):
        out[k, :len(own)] = [t % 2**64 for t in own]
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_similar_sets_always_meet_in_a_band_and_in_a_signature(threshold):
    sets = families(random.Random(31), 300)
    pairs, at = similar_pairs(sets, threshold), {k: n for n, k in enumerate(sets)}
    assert len(pairs) > 20
    for row, number in (bands_of(matrix(sets), threshold), signatures(matrix(sets), threshold)[:2]):
        own = [{*()} for _ in sets]
        for r, n in zip(row.tolist(), number.tolist(), strict=True):
            own[r].add(n)
        assert all(own[at[a]] & own[at[b]] for a, b in pairs)


def test_links_of_similar_sets_grow_with_the_sets_and_connect_what_all_pairs_do(spark):
    """Sets in one bucket that the hub was not similar to were compared pair by pair: 12 times the rows at five times the input."""
    rnd = random.Random(32)
    sets = families(rnd, 400)
    line = sorted(rnd.sample(range(2**62), 12))  # a common line, each time with another word behind it
    sets |= {f"x{k:04d}".encode(): sorted([*line, 2**62 + k]) for k in range(300)}
    table = spark.createDataFrame(list(sets.items()), "key binary, tokens array<bigint>")
    links = [(bytes(r.a), bytes(r.b)) for r in similar_sets(table.repartition(3), 0.8, 1 << 20).collect()]
    pairs = similar_pairs(sets)
    assert {*links} <= {*pairs} and len(pairs) > 44_850
    assert heads_of(links) == heads_of(pairs)
    assert len(links) < 3 * len(sets)


def test_components_of_chains_stars_and_random_links(spark):
    rnd = random.Random(33)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(90)]
    chain = rnd.sample(range(500, 540), 40)
    links = [(min(p), max(p)) for p in links + list(zip(chain, chain[1:])) if p[0] != p[1]]
    got = components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert {r.key: r.comp for r in got} == heads_of(links) and len(got) == len(heads_of(links))


def test_repeated_rows_count_once_and_long_paragraphs_are_linked_too(spark):
    rnd = random.Random(34)
    passage = " ".join(rnd_words(rnd, 80))
    texts = [(1, passage), (1, passage), (2, passage + " " + " ".join(rnd_words(rnd, 30)))]
    got = [(r.doc_id, r.n_shared, r.shared) for r in shared_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    once = [(r.doc_id, r.n_shared, r.shared) for r in shared_passages(spark.createDataFrame(texts[1:], "doc_id long, text string"), reach=60).collect()]
    assert sorted(got)[0] == sorted(got)[1] and sorted(got)[0][1] == len(sorted(got)[0][2].split(",")) == len({*sorted(got)[0][2].split(",")})
    assert all(n for _, n, _ in once)
