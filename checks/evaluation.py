"""Classification, ranking, calibration, resampling, splits and token jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.operators import classification as cl
from labelwright.operators import masks, ranking, resampling, splits
from labelwright.operators import models as md
from labelwright.plans.run_logs import summarize_runs

from . import views as v
from .registry import check, nudged, read, with_ctes

CELLS = """count(*) FILTER (gold=0 AND label=0) AS tn, count(*) FILTER (gold=0 AND label=1) AS fp,
  count(*) FILTER (gold=1 AND label=0) AS fn, count(*) FILTER (gold=1 AND label=1) AS tp"""
CONFUSION = f"cells AS (SELECT Segment, {CELLS}, count(*) AS n_all, count(label) AS n_scored FROM scored GROUP BY 1)"
METRICS = """tn+fp+fn+tp AS n, round((tp+fn)/(tn+fp+fn+tp),6) AS pos_rate, round((tp+tn)/(tn+fp+fn+tp),6) AS acc,
  round(coalesce(tp/nullif(tp+fp,0),0),6) AS "precision", round(coalesce(tp/nullif(tp+fn,0),0),6) AS recall,
  round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) AS f1, fp+fn AS errors"""
Z = "1.959963984540054"


@check("confusion", with_ctes("SELECT Segment, tn, fp, fn, tp FROM cells", *v.RECORD_CTES, CONFUSION))
def confusion(spark, sf):
    return cl.confusion(v.scored_records(spark, sf), "gold", "label", ["Segment"])


@check("classification_metrics", with_ctes(f"SELECT Segment, tn, fp, fn, tp, {METRICS} FROM cells", *v.RECORD_CTES, CONFUSION))
def classification_metrics(spark, sf):
    return cl.classification_metrics(v.scored_records(spark, sf), "gold", "label", ["Segment"])


@check("wilson_ci", with_ctes(f"""
SELECT Segment, k, n, round(greatest(0, centre-half),6) AS acc_lo, round(least(1, centre+half),6) AS acc_hi
FROM (SELECT *, (p+{Z}*{Z}/(2*n))/(1+{Z}*{Z}/n) AS centre, {Z}*sqrt(p*(1-p)/n+{Z}*{Z}/(4*n*n))/(1+{Z}*{Z}/n) AS half
FROM (SELECT Segment, tn+tp AS k, CAST(tn+fp+fn+tp AS DOUBLE) AS nd, tn+fp+fn+tp AS n, (tn+tp)/(tn+fp+fn+tp) AS p FROM cells))""",
                              *v.RECORD_CTES, CONFUSION))
def wilson_ci(spark, sf):
    counts = cl.confusion(v.scored_records(spark, sf), "gold", "label", ["Segment"]).select(
        "Segment", (F.col("tn") + F.col("tp")).alias("k"), (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"))
    return cl.with_wilson(counts, "k", "n", "acc")


#: Binomial tails by logarithms, and 60 halvings of [0, 1] for both ends of each interval.
_EXACT = """ends AS (SELECT Segment, tn+tp AS k, tn+fp+fn+tp AS n, side FROM cells, (VALUES ('lo'), ('hi')) s(side)),
 halved AS (SELECT Segment, k, n, side, 0 AS step, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM ends UNION ALL
  SELECT Segment, k, n, side, step+1, CASE WHEN low THEN m ELSE a END, CASE WHEN low THEN b ELSE m END FROM (SELECT *,
   CASE side WHEN 'lo' THEN tail < 0.025 ELSE tail > 0.025 END AS low FROM (SELECT *, (a+b)/2 AS m, list_sum(list_transform(
    CASE side WHEN 'lo' THEN range(k, n+1) ELSE range(0, k+1) END,
    lambda j: exp(lgamma(n+1)-lgamma(j+1)-lgamma(n-j+1)+j*ln((a+b)/2)+(n-j)*ln(1-(a+b)/2)))) AS tail FROM halved WHERE step < 60))),
 bounds AS (SELECT Segment, max(CASE WHEN side='lo' THEN CASE WHEN k=0 THEN 0 ELSE (a+b)/2 END END) AS acc_lo,
  max(CASE WHEN side='hi' THEN CASE WHEN k=n THEN 1 ELSE (a+b)/2 END END) AS acc_hi FROM halved WHERE step=60 GROUP BY 1)"""


@check("clopper_pearson", "WITH RECURSIVE " + with_ctes(f"""SELECT Segment, tn, fp, fn, tp, {METRICS}, round(acc_lo,6) AS acc_exact_lo, round(acc_hi,6) AS acc_exact_hi,
  round(greatest(0, centre-half),6) AS acc_wilson_lo, round(least(1, centre+half),6) AS acc_wilson_hi
  FROM (SELECT *, (r+{Z}*{Z}/(2*m))/(1+{Z}*{Z}/m) AS centre, {Z}*sqrt(r*(1-r)/m+{Z}*{Z}/(4*m*m))/(1+{Z}*{Z}/m) AS half
   FROM (SELECT *, CAST(tn+fp+fn+tp AS DOUBLE) AS m, (tn+tp)/(tn+fp+fn+tp) AS r FROM cells)) JOIN bounds USING (Segment)""", *v.RECORD_CTES, CONFUSION, _EXACT).removeprefix("WITH "))
def clopper_pearson(spark, sf):
    metrics = cl.classification_metrics(v.scored_records(spark, sf), "gold", "label", ["Segment"])
    return cl.with_accuracy_intervals(metrics)


@check("scored_metrics", with_ctes(f"""SELECT Segment, tn, fp, fn, tp, {METRICS}, n_scored, n_all-n_scored AS unparsable,
  round((tn+tp)/n_all,6) AS acc_unparsable_wrong FROM cells""", *v.RECORD_CTES, CONFUSION))
def scored_metrics(spark, sf):
    return cl.scored_metrics(v.scored_records(spark, sf), "gold", "label", ["Segment"])


@check("rule_agreement", with_ctes("""SELECT Segment, count(*) AS n, count(*) FILTER (label=rule) AS agreeing,
  round(count(*) FILTER (label=rule)/count(*),6) AS agreement, round(count(*) FILTER (label=1)/count(*),6) AS positive_rate
  FROM scored GROUP BY 1""", *v.RECORD_CTES))
def rule_agreement(spark, sf):
    return cl.rule_agreement(v.scored_records(spark, sf), "label", "rule", ["Segment"])


@check("error_rows", with_ctes("""SELECT row_id, Shipment_Status, Traffic_Status, raw, CAST(gold AS BIGINT) AS gold, label
  FROM scored WHERE label IS DISTINCT FROM gold""", *v.RECORD_CTES))
def error_rows(spark, sf):
    return cl.error_rows(v.scored_records(spark, sf), "gold", "label", ["row_id", "Shipment_Status", "Traffic_Status", "raw"])


_SEEDED = """runs AS (SELECT row_id, CAST(gold AS BIGINT) AS gold, s.seed, CASE WHEN (row_id*7+s.seed*13)%17=0 THEN NULL
  WHEN (row_id+s.seed*5)%11=0 THEN 1-label ELSE label END AS pred FROM scored, (VALUES (0),(1),(2)) s(seed))"""


def _seed_runs(spark, sf):
    base = v.scored_records(spark, sf).select("row_id", "gold", "label", F.explode(F.array(*map(F.lit, range(3)))).alias("seed"))
    r, s = F.col("row_id"), F.col("seed")
    pred = F.when((r * 7 + s * 13) % 17 == 0, F.lit(None)).when((r + s * 5) % 11 == 0, 1 - F.col("label")).otherwise(F.col("label"))
    return base.select("row_id", "gold", "seed", pred.alias("pred"))


@check("repeat_stability", with_ctes("""
SELECT CAST(seed AS BIGINT) AS seed, count(*) AS n, round(count(*) FILTER (pred=gold)/count(*),6) AS acc_unparsable_wrong,
  count(*) FILTER (pred IS NULL) AS unparsable, count(*) FILTER (prev <> coalesce(pred,-1)) AS changed_rows
FROM (SELECT *, lag(coalesce(pred,-1)) OVER (PARTITION BY row_id ORDER BY seed) AS prev FROM runs) GROUP BY 1""",
                                     *v.RECORD_CTES, _SEEDED))
def repeat_stability(spark, sf):
    return cl.repeat_stability(_seed_runs(spark, sf), "row_id", "seed", "gold", "pred")


@check("margin_summary", with_ctes("""
SELECT event_type, count(*) AS n, round(min(m),6) AS margin_min, round(max(m),6) AS margin_max,
  round(min(abs(m)),6) AS margin_abs_min, round(avg(top),6) AS flag_share, round(median(abs(m)),6) AS margin_abs_median
FROM (SELECT *, score*2-0.7 AS m, CAST(row_id%3<2 AS INT) AS top FROM scores) GROUP BY 1""", v.SCORES))
def margin_summary(spark, sf):
    scored = v.scores_table(spark, sf).withColumns({
        "m": F.col("score") * 2 - 0.7, "top": (F.col("row_id") % 3 < 2).cast("int")})
    return cl.margin_summary(scored, "m", ["event_type"], "top")


# ------------------------------------------------------------------------------ ranking
def ranking_sql(source: str, score: str = "score", y: str = "y", by: str = "") -> str:
    """CTEs ``pts`` (distinct scores with running counts) and ``ranked`` (auroc, auprc) of a source."""
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""cells AS (SELECT {lead}{score} AS score, count(*) FILTER ({y}=1) AS pos, count(*) FILTER ({y}=0) AS neg
  FROM {source} GROUP BY {lead}{score}),
 pts AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM cells
  WINDOW w AS ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 ranked AS (SELECT {lead}sum(pos)::BIGINT AS positives, sum(pos+neg)::BIGINT AS n, count(*) AS distinct_scores,
  sum(CAST(neg AS DOUBLE)*(cum_pos-pos/2.0)) / nullif(CAST(sum(pos) AS DOUBLE)*sum(neg),0) AS auroc,
  CASE WHEN sum(pos)>0 AND sum(neg)>0 THEN sum(CAST(pos AS DOUBLE)*cum_pos/(cum_pos+cum_neg))/sum(pos) END AS auprc,
  sum(score*(pos+neg))/sum(pos+neg) AS mean_predicted,
  sum(pos*(score-1)*(score-1)+neg*score*score)/sum(pos+neg) AS brier FROM pts {group})"""


@check("auroc", with_ctes("""SELECT n, positives, round(auroc,6) AS auroc, distinct_scores, distinct_scores<=2 AS hard_scores
  FROM ranked""", v.SCORES, ranking_sql("scores")))
def auroc(spark, sf):
    return ranking.auroc(v.scores_table(spark, sf), "y", "score")


@check("average_precision", with_ctes("SELECT n, positives, round(auprc,6) AS auprc FROM ranked", v.SCORES, ranking_sql("scores")))
def average_precision(spark, sf):
    # small limits: the same numbers through the many-range path
    return ranking.average_precision(v.scores_table(spark, sf), "y", "score", small=500, range_cells=2000)


@check("roc_points", with_ctes("""SELECT round(score,6) AS score, pos, neg, cum_pos::BIGINT AS cum_pos,
  cum_neg::BIGINT AS cum_neg FROM pts""", v.SCORES, ranking_sql("scores")))
def roc_points(spark, sf):
    cells = ranking.score_cells(v.scores_table(spark, sf), "y", "score")
    return ranking.roc_points(cells, small=500, range_cells=2000).drop("all_pos", "all_neg")


@check("brier", with_ctes("SELECT event_type, count(*) AS n, round(avg((score-y)*(score-y))+1e-9,6) AS brier FROM scores GROUP BY 1",
                          v.SCORES))
def brier(spark, sf):
    return nudged(ranking.brier(v.scores_table(spark, sf), "y", "score", ["event_type"]), "brier")


@check("metric_bundle", with_ctes("""
SELECT strftime(block,'%Y-%m-%d') AS block, n, positives, round(auroc,6) AS auroc, round(auprc,6) AS auprc, distinct_scores,
  distinct_scores<=2 AS hard_scores, round(positives/n,6) AS prevalence, round(mean_predicted+1e-9,6) AS mean_predicted,
  round(brier+1e-9,6) AS brier FROM ranked""", v.SCORES, ranking_sql("scores", by="block")))
def metric_bundle(spark, sf):
    return nudged(ranking.metric_bundle(v.scores_table(spark, sf), "y", "score", ["block"]), "mean_predicted", "brier")


def _thresholds_sql(values) -> str:
    rows = ", ".join(f"({t!r}::DOUBLE)" for t in values)
    return with_ctes(f"""
SELECT round(threshold,6) AS threshold, flagged, tp, round(flagged/n,6) AS flagged_share, round(tp/greatest(1,p),6) AS recall,
  round(tp/nullif(flagged,0),6) AS "precision"
FROM (SELECT t.threshold, count(*) FILTER (score>=t.threshold) AS flagged, count(*) FILTER (score>=t.threshold AND y=1) AS tp,
  count(*) AS n, count(*) FILTER (y=1) AS p FROM scores CROSS JOIN (VALUES {rows}) t(threshold) GROUP BY 1)""", v.SCORES)


@check("threshold_sweep", _thresholds_sql(ranking.SWEEP_THRESHOLDS))
def threshold_sweep(spark, sf):
    return ranking.threshold_sweep(v.scores_table(spark, sf), "y", "score")


@check("pr_curve", _thresholds_sql(ranking.curve_thresholds()))
def pr_curve(spark, sf):
    return ranking.pr_curve(v.scores_table(spark, sf), "y", "score")


_EDGES = ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(
    zip(ranking.BIN_EDGES, ranking.BIN_EDGES[1:], strict=False)))


@check("reliability", with_ctes(f"""
SELECT round(lo,2) AS bin_lo, round(hi,2) AS bin_hi, count(*) AS n, round(avg(score)+1e-9,6) AS mean_pred, round(avg(y),6) AS observed_rate
FROM scores JOIN (VALUES {_EDGES}) e(i,lo,hi) ON score>=lo AND (score<hi OR (hi=1 AND score<=hi)) GROUP BY 1,2""", v.SCORES))
def reliability(spark, sf):
    return nudged(ranking.reliability(v.scores_table(spark, sf), "y", "score"), "mean_pred")


# --------------------------------------------------------------------------- resampling
@check("bootstrap_ci", with_ctes("""
SELECT count(*) AS replicates, round(quantile_cont(acc,0.025),6) AS acc_lo, round(quantile_cont(acc,0.975),6) AS acc_hi,
  round(quantile_cont(f1,0.025),6) AS f1_lo, round(quantile_cont(f1,0.975),6) AS f1_hi, any_value(degenerate) AS degenerate
FROM (SELECT (tp+tn)/(tn+fp+fn+tp) AS acc, 2*tp/nullif(2*tp+fp+fn,0) AS f1, degenerate FROM reps
  WHERE tn+fp>0 AND fn+tp>0)""", *v.RECORD_CTES, f"""
 cell AS (SELECT unnest(['tn','fp','fn','tp']) AS cell, unnest([tn,fp,fn,tp]) AS m, fp+fn=0 AS degenerate
  FROM (SELECT {CELLS} FROM scored)),
 pmf AS (SELECT m, k, exp(-m + k*ln(m) - lgamma(k+1)) AS p FROM (SELECT DISTINCT CAST(m AS DOUBLE) AS m FROM cell WHERE m>0),
  LATERAL (SELECT unnest(range(CAST(greatest(0, m-10*sqrt(m)-20) AS BIGINT), CAST(m+10*sqrt(m)+21 AS BIGINT))) AS k)),
 cdf AS (SELECT m, k, sum(p) OVER (PARTITION BY m ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM pmf),
 draws AS (SELECT cell, m, r, degenerate, (CAST('0x' || substr(md5('7|' || r || '|' || cell),1,8) AS BIGINT)+0.5::DOUBLE)/4294967296.0::DOUBLE AS u
  FROM cell, range(1000) t(r)),
 weights AS (SELECT cell, r, any_value(degenerate) AS degenerate, CASE WHEN any_value(d.m)=0 THEN 0 ELSE min(k) END AS w
  FROM draws d LEFT JOIN cdf ON cdf.m=d.m AND c>=u GROUP BY 1,2),
 reps AS (SELECT r, any_value(degenerate) AS degenerate, sum(w) FILTER (cell='tn') AS tn, sum(w) FILTER (cell='fp') AS fp,
  sum(w) FILTER (cell='fn') AS fn, sum(w) FILTER (cell='tp') AS tp FROM weights GROUP BY 1)"""))
def bootstrap_ci(spark, sf):
    return resampling.bootstrap_counts(v.scored_records(spark, sf), "gold", "label", n_boot=1000, seed=7)


@check("bootstrap_rank_ci")
def bootstrap_rank_ci(spark, sf):
    return resampling.bootstrap_ranking(v.scores_table(spark, sf), "y", "score", n_boot=1000, seed=3)


@check("block_bootstrap_ci", with_ctes("""
SELECT count(*) AS replicates, round(quantile_cont(auroc,0.025),6) AS auroc_lo, round(quantile_cont(auroc,0.975),6) AS auroc_hi,
  any_value(b) AS blocks FROM (SELECT r, any_value(b) AS b,
  sum(CAST(neg AS DOUBLE)*(cum_pos-pos/2.0))/(CAST(sum(pos) AS DOUBLE)*sum(neg)) AS auroc
  FROM (SELECT *, sum(pos) OVER (PARTITION BY r ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos FROM weighed) GROUP BY r
  HAVING sum(pos)>0 AND sum(neg)>0)""", v.SCORES, """
 numbered AS (SELECT block, row_number() OVER (ORDER BY block)-1 AS block_no, count(*) OVER () AS b FROM (SELECT DISTINCT block FROM scores)),
 draws AS (SELECT r, CAST('0x' || substr(md5('11|' || r || '|' || d),1,8) AS BIGINT) % b AS block_no
  FROM range(300) t(r), (SELECT DISTINCT b FROM numbered), LATERAL (SELECT unnest(range(b)) AS d)),
 times AS (SELECT r, block_no, count(*) AS w FROM draws GROUP BY 1,2),
 weighed AS (SELECT r, score, any_value(b) AS b, sum(w*CAST(y=1 AS INT))::BIGINT AS pos, sum(w*CAST(y=0 AS INT))::BIGINT AS neg
  FROM scores JOIN numbered USING (block) JOIN times USING (block_no) GROUP BY 1,2)"""))
def block_bootstrap_ci(spark, sf):
    return resampling.bootstrap_blocks(v.scores_table(spark, sf), "y", "score", "block", n_boot=300, seed=11)


@check("block_bootstrap_by_group", with_ctes("""
SELECT event_type, count(*) AS replicates, round(quantile_cont(auroc,0.025),6) AS auroc_lo, round(quantile_cont(auroc,0.975),6) AS auroc_hi,
  any_value(b) AS blocks FROM (SELECT event_type, r, any_value(b) AS b,
  sum(CAST(neg AS DOUBLE)*(cum_pos-pos/2.0))/(CAST(sum(pos) AS DOUBLE)*sum(neg)) AS auroc
  FROM (SELECT *, sum(pos) OVER (PARTITION BY event_type, r ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos FROM weighed) GROUP BY event_type, r
  HAVING sum(pos)>0 AND sum(neg)>0) GROUP BY 1""", v.SCORES, """
 even AS (SELECT *, CAST(row_id%3=0 AS INT) AS odd FROM scores WHERE NOT (event_type='error' AND row_id%7>2)),
 numbered AS (SELECT event_type, block, row_number() OVER (PARTITION BY event_type ORDER BY block)-1 AS block_no,
  count(*) OVER (PARTITION BY event_type) AS b FROM (SELECT DISTINCT event_type, block FROM even)),
 draws AS (SELECT b, r, CAST('0x' || substr(md5('5|' || r || '|' || d),1,8) AS BIGINT) % b AS block_no
  FROM range(200) t(r), (SELECT DISTINCT b FROM numbered), LATERAL (SELECT unnest(range(b)) AS d)),
 times AS (SELECT b, r, block_no, count(*) AS w FROM draws GROUP BY ALL),
 weighed AS (SELECT event_type, r, score, b, sum(w*CAST(odd=1 AS INT))::BIGINT AS pos, sum(w*CAST(odd=0 AS INT))::BIGINT AS neg
  FROM even JOIN numbered USING (event_type, block) JOIN times USING (b, block_no) GROUP BY ALL)"""))
def block_bootstrap_by_group(spark, sf):
    few = (F.col("event_type") == "error") & (F.col("row_id") % 7 > 2)
    rows = v.scores_table(spark, sf).filter(~few).withColumn("odd", (F.col("row_id") % 3 == 0).cast("int"))
    return resampling.bootstrap_blocks(rows, "odd", "score", "block", n_boot=200, seed=5, by=["event_type"])


# ------------------------------------------------------------------------------- splits
@check("seeded_split", """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('5|' || o_orderkey)) <= floor(n*0.8)
  THEN 'train' ELSE 'test' END AS split FROM orders, (SELECT count(*) AS n FROM orders)""")
def seeded_split(spark, sf):
    return splits.seeded_split(read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.8, 5)


@check("stratified_folds", with_ctes(" SELECT row_id, CAST(gold AS BIGINT) AS gold, "
       + ", ".join(f"(row_number() OVER (PARTITION BY gold ORDER BY md5('0.{r}|' || row_id))-1)%5 AS fold_{r}" for r in range(2))
       + " FROM records", v.RECORDS_SQL))
def stratified_folds(spark, sf):
    return splits.stratified_folds(v.records_table(spark, sf).select("row_id", "gold"), "gold", ["row_id"], 5, 2, 0)


def _doc_split(spark, sf):
    docs = splits.seeded_split(read(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], 0.8, 1)
    return docs.filter("split = 'train'").drop("split"), docs.filter("split = 'test'").drop("split")


_DOC_SPLIT = """split AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('1|' || doc_id)) <= floor(n*0.8) AS train
  FROM documents, (SELECT count(*) AS n FROM documents))"""


@check("split_overlap", with_ctes("""SELECT count(*) AS test_rows, count(*) FILTER (hit) AS test_rows_in_train,
  count(DISTINCT text) FILTER (hit) AS distinct_shared_texts
  FROM (SELECT text, text IN (SELECT text FROM split WHERE train) AS hit FROM split WHERE NOT train)""", _DOC_SPLIT))
def split_overlap(spark, sf):
    return splits.split_overlap(*_doc_split(spark, sf), "text")


@check("union_splits", with_ctes("SELECT doc_id, CASE WHEN train THEN 'train' ELSE 'test' END AS split FROM split", _DOC_SPLIT))
def union_splits(spark, sf):
    train, test = _doc_split(spark, sf)
    return splits.union_splits({"train": train, "test": test}).select("doc_id", "split")


def _bag_sql(parts: str) -> str:
    """Copies missing from and extra in ``parts``, counted by whole rows."""
    return f"""WITH {_DOC_SPLIT}, parts AS ({parts}),
 gap AS (SELECT doc_id, text, sum(one) AS s FROM (SELECT doc_id, text, 1 AS one FROM documents UNION ALL SELECT doc_id, text, -1 FROM parts)
  GROUP BY 1,2)
SELECT coalesce(sum(s) FILTER (s>0),0)::BIGINT AS missing_rows, coalesce(-sum(s) FILTER (s<0),0)::BIGINT AS extra_rows,
  count(*) FILTER (s<>0) = 0 AS is_permutation FROM gap"""


@check("split_is_permutation", _bag_sql("SELECT doc_id, text FROM split WHERE train UNION ALL SELECT doc_id, text FROM split WHERE NOT train"))
def split_is_permutation(spark, sf):
    train, test = _doc_split(spark, sf)
    return splits.permutation_check(read(spark, sf, "documents").select("doc_id", "text"), train.unionByName(test))


@check("split_damage", _bag_sql("""SELECT doc_id, CASE WHEN doc_id%70=3 THEN text || ' ' ELSE text END AS text FROM split WHERE train
 UNION ALL SELECT doc_id, text FROM split WHERE NOT train AND doc_id%50<>0 UNION ALL SELECT doc_id, text FROM split WHERE NOT train AND doc_id%40=1"""))
def split_damage(spark, sf):
    """A split with lost, doubled and altered rows."""
    train, test = _doc_split(spark, sf)
    altered = train.withColumn("text", F.when(F.col("doc_id") % 70 == 3, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    parts = altered.unionByName(test.filter("doc_id % 50 <> 0")).unionByName(test.filter("doc_id % 40 = 1"))
    return splits.permutation_check(read(spark, sf, "documents").select("doc_id", "text"), parts)


@check("first_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def first_k(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return splits.first_k(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 25)


@check("distinct_outputs", with_ctes("""SELECT raw, count(*) AS n, list(row_id ORDER BY row_id)[:3]::VARCHAR AS examples
  FROM scored GROUP BY 1""", *v.RECORD_CTES))
def distinct_outputs(spark, sf):
    scored = v.scored_records(spark, sf)
    shown = splits.examples(scored, ["raw"], "row_id", "row_id", 3)
    return splits.distinct_outputs(scored, "raw").join(shown, "raw").select(
        "raw", "n", F.concat(F.lit("["), F.array_join(F.col("examples").cast("array<string>"), ", "), F.lit("]")).alias("examples"))


# ------------------------------------------------------------------------------- models
_TRIVIAL = """preds AS (SELECT CAST(gold AS BIGINT) AS gold, row_id, 'all_positive' AS model, 1 AS label FROM records UNION ALL
  SELECT gold, row_id, 'rule_delayed_or_heavy', CAST(Shipment_Status='Delayed' OR Traffic_Status='Heavy' AS BIGINT) FROM records)"""


@check("trivial_baselines", with_ctes(f"SELECT model, tn, fp, fn, tp, {METRICS} FROM (SELECT model, {CELLS} FROM preds GROUP BY 1)",
                                      v.RECORDS_SQL, _TRIVIAL))
def trivial_baselines(spark, sf):
    preds = md.trivial_predictions(v.records_table(spark, sf), v.RECORDS, ["gold"])
    return cl.classification_metrics(preds, "gold", "pred", ["model"])


@check("cv_summary", with_ctes("""
SELECT model, count(*) AS folds, round(avg(acc),6) AS acc_mean, round(min(acc),6) AS acc_min, round(max(acc),6) AS acc_max
FROM (SELECT model, r, fold, count(*) FILTER (gold=label)/count(*) AS acc FROM preds JOIN folds USING (row_id) GROUP BY 1,2,3) GROUP BY 1""",
                               v.RECORDS_SQL, _TRIVIAL, """folds AS (SELECT row_id, r,
  (row_number() OVER (PARTITION BY r, gold ORDER BY md5('0.' || r || '|' || row_id))-1)%5 AS fold FROM records, range(3) t(r))"""))
def cv_summary(spark, sf):
    rows = md.fold_rows(v.records_table(spark, sf), "gold", ["row_id"], 5, 3, 0)
    preds = md.trivial_predictions(rows, v.RECORDS, ["gold", "repeat", "fold"])
    return md.cv_summary(preds, "gold")


def _record_split(spark, sf):
    records = md.with_time_parts(v.records_table(spark, sf))
    parts = splits.seeded_split(records, ["row_id"], 0.8, 0)
    return parts.filter("split = 'train'"), parts.filter("split = 'test'")


@check("baseline_models")
def baseline_models(spark, sf):
    train, test = _record_split(spark, sf)
    preds = md.fit_and_score(train, test, md.baseline_specs(v.RECORDS), "gold", ["gold"])
    from labelwright.session import pin

    preds = pin(preds)
    metrics = cl.with_accuracy_intervals(cl.classification_metrics(preds, "gold", "pred", ["model"]))
    return metrics.join(ranking.auroc(preds, "gold", "p1", ["model"]).select("model", "auroc", "hard_scores"), "model")


@check("cv_models")
def cv_models(spark, sf):
    records = md.with_time_parts(v.records_table(spark, sf))
    return md.cv_summary(md.cross_validate(records, "gold", ["row_id"], md.baseline_specs(v.RECORDS)), "gold", "p1")


@check("model_margins")
def model_margins(spark, sf):
    train, test = _record_split(spark, sf)
    spec = md.ModelSpec("logistic_regression", "logistic", *md.variant_columns(v.RECORDS, "without_rule_fields"))
    return cl.margin_summary(md.fit_and_score(train, test, [spec], "gold", ["gold"]), "margin", ["model"])


# ------------------------------------------------------------------------- token arrays
ROLE_IDS = {"system": 2, "user": 3, "assistant": 4}
OPEN, CLOSE = 0, 1


@check("response_mask", """
SELECT count(*) AS records, sum(tokens)::BIGINT AS tokens, sum(kept)::BIGINT AS kept_tokens, round(sum(kept)/sum(tokens),6) AS kept_share
FROM (SELECT conv_id, sum(words+3) AS tokens, sum(CASE WHEN role='assistant' THEN words+1 ELSE 0 END)
  + CAST(arg_max(role, turn)<>'assistant' AS INT) AS kept
  FROM (SELECT *, len(regexp_extract_all(text, '\\S+')) AS words FROM conversations) GROUP BY 1)""")
def response_mask(spark, sf):
    # token ids: open, role, one id per word, close - for every turn of a conversation
    words = F.transform(F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0)), lambda w: (F.crc32(w) % 1000 + 1010).cast("int"))
    role = F.create_map(*[F.lit(x) for pair in ROLE_IDS.items() for x in pair])[F.col("from")]
    turns = read(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("from"), F.col("text").alias("value"))
    ids = turns.select("conv_id", "turn", F.concat(F.array(F.lit(OPEN), role), words, F.array(F.lit(CLOSE))).alias("ids"))
    per_conv = ids.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ids"))).alias("t"))
    tokens = per_conv.select(F.flatten(F.col("t.ids")).alias("tokens"))
    return masks.mask_profile(tokens, "tokens", [OPEN, ROLE_IDS["assistant"]], [CLOSE])


@check("length_profile", with_ctes("""
SELECT has_system, count(*) AS records, sum(n)::BIGINT AS tokens, max(n) AS longest, sum(least(n,300))::BIGINT AS tokens_after_cut,
  count(*) FILTER (n>300) AS cut_records FROM (SELECT conv_id, bool_or(role='system') AS has_system,
  sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS n FROM conversations GROUP BY 1) GROUP BY 1"""))
def length_profile(spark, sf):
    turns = read(spark, sf, "conversations").withColumn("has_system", F.col("role") == "system")
    return masks.length_profile(turns, F.col("text"), 300, ["has_system"], ["conv_id"])


@check("runlog_summary", """
SELECT event_type AS run, count(*) AS points, min(event_id) AS first_step, round(arg_min(value,event_id),6) AS first_value,
  round(min(value),6) AS min_value, arg_min(event_id,(value,event_id)) AS min_step, max(event_id) AS last_step,
  round(arg_max(value,event_id),6) AS last_value, min(event_id) FILTER (value<1) AS first_reached_step FROM events GROUP BY 1""")
def runlog_summary(spark, sf):
    log = read(spark, sf, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")
    return summarize_runs(log, reached=F.col("value") < 1)
