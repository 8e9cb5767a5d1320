"""Quality rules with cutoffs that reject few good documents, by proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin, take, text_of, unpack_row, with_row, without_blanks

#: White space between words, as a regular expression.
_BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Cutoffs tried per rule, from lenient to strict. Fixed before any label is read, so that the
#: correction for the number of tests holds.
CUTOFFS = {
    "symbols": [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01],  # symbols per character of a word
    "lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],  # share of lines that repeat
    "repeats": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05],  # share of words in repeated windows
    "length": [100.0, 60.0, 40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0],  # characters per word
}
#: Good documents of a stratum that the rules together may reject, as a share, and the probability
#: that any stratum breaks this.
RISK, DOUBT = 0.02, 0.05


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _covered(windows: Column) -> Column:
    """Words in 3-word windows that occur twice or more, from the windows' hashes in order of place.

    Sorting (hash, place) brings equal windows together; each of them covers three words from its place on.
    """
    def repeated(pairs: Column) -> Column:
        same = F.transform(pairs, lambda p, i: F.when(
            (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]), p["i"]))
        return F.array_sort(F.filter(same, lambda i: i.isNotNull()))

    def words(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, g: total + g)

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(
        _let(_let(pairs, repeated), words))


def text_features(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` plus n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and base_failed.

    Built-in functions only. Null text has no words and fails the base rules.
    """
    text = text_of(text_col)
    bare = text
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    staged = rows.withColumns({"_words": F.array_remove(F.split(text, _BLANK), ""), "_lines": lines})
    window = F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(
        w, F.get("_words", i + 1), F.get("_words", i + 2)))
    staged = staged.withColumns({
        "n_words": F.size("_words").cast("bigint"), "word_chars": F.char_length(without_blanks(text)).cast("bigint"),
        "n_symbols": (F.octet_length(text) - F.octet_length(bare)).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"), "_windows": window}).drop("_words", "_lines")
    done = staged.withColumn("n_repeat_words", _covered(F.col("_windows"))).drop("_windows")
    # one array of one struct, unpacked again: whatever reads the features then, each of them is computed once a row
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    done = done.select(*[c for c in done.columns if c not in own], F.inline(F.array(F.struct(*own))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return done.withColumn("base_failed", failed)


def rule_values() -> dict[str, Column]:
    """The number that each rule compares with its cutoff."""
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {"symbols": share("n_symbols", "word_chars"), "lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"), "length": share("word_chars", "n_words")}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), exact: a fold over the terms, in logarithms.

    From k = n p on it is given as 1, since no test accepts there.
    """
    import math

    odds = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(s, j):
        term = s["term"] + F.log(F.try_divide(n - j + 1, j.cast("double"))) + odds
        high, low = F.greatest(term, s["total"]), F.least(term, s["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, add, lambda s: s["total"])))


def fit_cutoffs(features: DataFrame, labels: DataFrame, *, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """One row per stratum: ``stratum`` and a cutoff per rule, null where none is safe.

    ``features`` has doc_id, stratum and the columns of ``text_features``; ``labels`` has doc_id and
    quality (1: good, 0: bad). The holdout of a stratum is all its labelled good documents that
    pass the base rules; one with contradicting labels is not good. A cutoff is safe if the
    exact one-sided binomial bound on its false rejections is at most ``risk`` / number of rules;
    ``doubt`` is divided by all tests made: strata, rules and cutoffs (Bonferroni). So with
    probability 1 - ``doubt`` no stratum loses more than ``risk`` of its good documents. Of the
    safe cutoffs the strictest is taken. A stratum with too few labels gets none.
    """
    good = take(labels, "doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("_q")).filter("_q >= 1").select(F.col("doc_id").alias("_labelled"))
    held = features.filter(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_labelled"))
    values = rule_values()
    hits = {f"{r}_{i}": F.sum((values[r] > c).cast("bigint")) for r, cuts in CUTOFFS.items() for i, c in enumerate(cuts)}
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in hits.items()])
    tests = F.struct(*[F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"{r}_{i}").alias("k")) for i, c in enumerate(cuts)]).alias(r)
                       for r, cuts in CUTOFFS.items()])
    strata = counts.select(F.count("*").alias("_strata"))
    share = risk / len(CUTOFFS)
    size = sum(map(len, CUTOFFS.values()))
    tested = counts.select("stratum", "n", tests.alias("t")).join(strata)  # one row
    allowed = doubt / (F.col("_strata") * size)

    def strictest(rule: str) -> Column:
        safe = F.filter(F.col("t")[rule], lambda t: binomial_tail(t["k"], F.col("n"), share) <= allowed)
        return F.array_min(F.transform(safe, lambda t: t["cut"]))

    return tested.select("stratum", *[strictest(r).alias(f"cut_{r}") for r in CUTOFFS])


def _verdict(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``features`` plus ``kept``: no failed base rule, no value above the cutoff of its stratum."""
    cuts = pin(cutoffs.withColumnRenamed("stratum", "_stratum"))
    joined = features.join(cuts, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    above = F.lit(False)
    for rule, value in rule_values().items():
        above = above | F.coalesce(value > F.col(f"cut_{rule}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~above)


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts of ``text_features``, base_failed, kept, stratum.

    Features are computed once over whole texts and written; cutoffs are fitted on them
    (``fit_cutoffs``) and applied to all. Null text: no words, fails. Null stratum: a stratum of
    its own. Null or repeated ids are rows like others. Empty tables: empty result, or no cutoffs.
    """
    rows = take(docs, id_col, text_col, stratum_col).toDF("doc_id", "text", "stratum")
    features = pin(text_features(rows).drop("text"))
    return _verdict(features, fit_cutoffs(features, labels, risk=risk, doubt=doubt)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")


def keep_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
                 risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    A null text has no words and goes; a null id has no label, a null stratum is a stratum of its own. Rows that repeat are judged alike and
    all stay or go. An empty table stays empty; columns that differ in case only come back as they were.
    """
    rows = take(docs, id_col, text_col, stratum_col).toDF("doc_id", "text", "stratum")
    labelled = take(labels, "doc_id").distinct()
    fitted = rows.join(labelled, "doc_id", "left_semi")
    cutoffs = fit_cutoffs(text_features(fitted).drop("text"), labels, risk=risk, doubt=doubt)
    whole = with_row(docs, text_col, stratum_col).toDF("text", "stratum", "_row")
    return unpack_row(_verdict(text_features(whole).drop("text"), cutoffs).filter("kept").select("_row"), docs.columns)
