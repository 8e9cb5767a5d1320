import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelwright.llm.common import take
from labelwright.llm.quality import CUTOFFS, binomial_tail, fit_cutoffs, keep_quality, quality_rules, text_features

from .fixtures import SCHEMA, no_documents, odd_documents, odd_rows


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def test_features_of_odd_rows_and_documents(spark, sf):
    cases = [(i, t) for i, t in enumerate([r[1] for r in odd_rows()] + ["a b c a b c a b", "x y z\n\nx y z\n q", "a " * 60, " ".join(map(str, range(80)))])]
    cases += [(1_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in text_features(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert got == {i: plain(t) for i, t in cases}


@pytest.mark.parametrize("n, p", [(10, 0.3), (2_000, 0.01), (400_000, 0.005)])
def test_binomial_tail(spark, n, p):
    import math

    ks = sorted({0, 1, int(n * p * 0.5), max(0, math.ceil(n * p) - 1), math.ceil(n * p)})
    got = {r.k: r.tail for r in spark.createDataFrame([(k, n) for k in ks], "k long, n long").select(
        "k", binomial_tail(F.col("k"), F.col("n"), p).alias("tail")).collect()}
    for k in ks:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))
                   for j in range(k + 1))
        assert got[k] == pytest.approx(want if k < n * p else 1.0, rel=1e-6, abs=1e-12)


def labelled(spark, n=4_000, symbols=0):
    """Good documents of 60 words; the first ``symbols`` of them hold a symbol in every tenth character."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + (" " + "#" * 40 if i < symbols else ""), "en", "s", 1, None, None, 1) for i in range(n)]
    labels = [(i, 1, 0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def cutoffs(spark, docs, labels):
    features = text_features(take(docs, "doc_id", "text", "lang").withColumnRenamed("lang", "stratum"))
    return {r.stratum: r for r in fit_cutoffs(features, labels).collect()}


def test_cutoffs_are_strict_only_where_good_documents_stay_below(spark):
    few = cutoffs(spark, *labelled(spark, 300))
    assert few["en"].cut_symbols is None  # too few labels to prove anything
    many = cutoffs(spark, *labelled(spark))
    assert many["en"].cut_symbols == min(CUTOFFS["symbols"]) and many["en"].cut_length == min(CUTOFFS["length"])
    some = cutoffs(spark, *labelled(spark, symbols=400))  # one in ten good documents is at 0.1
    assert some["en"].cut_symbols >= 0.1


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = labelled(spark)
    bad = [(9_000, " ".join(f"b{j}##" for j in range(70)), "en", "s", 1, None, None, 1), (9_001, "too short", "en", "s", 1, None, None, 1),
           (9_002, " ".join(f"b{j}##" for j in range(70)), "xx", "s", 1, None, None, 1), (None, None, None, None, None, None, None, None)]
    both = docs.union(spark.createDataFrame(bad, SCHEMA))
    verdict = {r.doc_id: r.kept for r in quality_rules(both, labels).collect()}
    assert [verdict[i] for i in (0, 3_999, 9_000, 9_001, 9_002, None)] == [True, True, False, False, True, False]
    kept = keep_quality(both, labels)
    assert kept.columns == SCHEMA.names and kept.count() == sum(verdict.values())


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (4, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = Counter((r.doc_id, r.n_words, r.base_failed) for r in quality_rules(odd_documents(spark), labels).collect())
    assert got == Counter((r[0], plain(r[1])[0], plain(r[1])[5]) for r in odd_rows())
    assert quality_rules(no_documents(spark), labels).collect() == []
    assert quality_rules(odd_documents(spark), labels.limit(0)).count() == len(odd_rows())
