"""Order study: rollups, features, cohorts, splits, fitted and constant models."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import checkout as co
from labelwright.operators import ranking
from labelwright.plans import order_study as st
from labelwright.plans import study_run

from . import views as v
from .evaluation import ranking_sql
from .registry import check, nudged, read, with_ctes

_TIES = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
_FIRST = f"first({{}} ORDER BY {_TIES})"
IN_FLIGHT, NOT_A_DELIVERY = ("O",), ("P",)


@check("first_item", f"""
SELECT l_orderkey AS order_id, first(s ORDER BY {_TIES}) FILTER (s IS NOT NULL) AS seller_id,
  first(l_partkey ORDER BY {_TIES}) AS product_id
FROM (SELECT *, CASE WHEN l_linenumber=1 AND l_orderkey%5=0 THEN NULL ELSE l_suppkey END AS s FROM lineitem) GROUP BY 1""")
def first_item(spark, sf):
    items = v.study_items(spark, sf)
    gone = (F.col("item_no") == 1) & (F.col("order_id") % 5 == 0)
    keep = items.withColumns({"seller_id": F.when(~gone, F.col("seller_id")), "_s": F.col("seller_id")})
    return st.first_item(keep, ("item_no", "product_id", "_s", "shipped", "price"))


@check("order_totals", """
SELECT l_orderkey AS order_id, count(l_linenumber) AS n_items,
  round(coalesce(sum(CASE WHEN l_orderkey%6<>0 THEN l_extendedprice END),0)+1e-9,6) AS total_price,
  round(sum(l_tax*l_extendedprice)+1e-9,6) AS total_freight FROM lineitem GROUP BY 1""")
def order_totals(spark, sf):
    items = v.study_items(spark, sf).withColumn("price", F.when(F.col("order_id") % 6 != 0, F.col("price")))
    return st.order_totals(items).withColumns({c: F.col(c) + 1e-9 for c in ("total_price", "total_freight")})


@check("payment_rollup", f"""SELECT l_orderkey AS order_id, {_FIRST.format('l_returnflag')} AS payment_type,
  max(l_linenumber)::BIGINT AS payment_installments FROM lineitem GROUP BY 1""")
def payment_rollup(spark, sf):
    return st.payment_rollup(v.study_payments(spark, sf), v.PAY_ORDER)


@check("zip_centroid", with_ctes("SELECT CAST(zip AS BIGINT) AS zip, round(lat+1e-9,6) AS lat, round(lng+1e-9,6) AS lng FROM centroid",
                                 v.PLACES))
def zip_centroid(spark, sf):
    return st.zip_centroid(v.places_table(spark, sf), small=50, range_cells=2000).select(
        "zip", (F.col("lat") + 1e-9).alias("lat"), (F.col("lng") + 1e-9).alias("lng"))


KM = """2*6371.0*asin(sqrt(pow(sin((radians({b}.lat)-radians({a}.lat))/2),2)
  + cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lng-{a}.lng)/2),2)))"""


@check("distance_km", with_ctes(f"""SELECT p.c_custkey, round({KM.format(a='p', b='c')},6) AS km
  FROM places p JOIN centroid c USING (zip)""", v.PLACES))
def distance_km(spark, sf):
    places = v.places_table(spark, sf)
    centre = st.zip_centroid(places).select("zip", F.col("lat").alias("b"), F.col("lng").alias("d"))
    return places.join(centre, "zip").select("c_custkey", co.great_circle_km(
        F.col("lat"), F.col("lng"), F.col("b"), F.col("d")).alias("km"))


@check("role_playing_join", with_ctes(f"""
SELECT o_orderkey AS order_id, round({KM.format(a='a', b='b')},6) AS distance_km
FROM orders JOIN customer ON o_custkey=c_custkey LEFT JOIN centroid a ON a.zip=c_nationkey
LEFT JOIN centroid b ON b.zip=o_orderkey%40""", v.PLACES))
def role_playing_join(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("customer_zip"))
    orders = read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_id"), "customer_zip", (F.col("o_orderkey") % 40).cast("int").alias("seller_zip"))
    placed = st.with_distance(orders, st.zip_centroid(v.places_table(spark, sf)))
    return placed.select("order_id", "distance_km")


@check("calendar_features", """
SELECT event_id, CAST(month(ts) AS VARCHAR) AS purchase_month, CAST((dayofweek(ts)+6)%7 AS VARCHAR) AS purchase_weekday,
  CASE WHEN hour(ts)<=5 THEN 'night' WHEN hour(ts)<=11 THEN 'morning' WHEN hour(ts)<=17 THEN 'afternoon' ELSE 'evening' END
  AS purchase_hour_bin FROM events""")
def calendar_features(spark, sf):
    return st.calendar_features(read(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@check("lead_days", with_ctes("SELECT order_id, date_diff('day', CAST(purchased AS DATE), CAST(promised AS DATE)) AS lead FROM study",
                              v.STUDY))
def lead_days(spark, sf):
    return v.study_orders(spark, sf).select("order_id", co.lead_days(F.col("promised"), F.col("purchased")).alias("lead"))


@check("late_label", with_ctes("SELECT order_id, CAST(CAST(delivered AS DATE) > CAST(promised AS DATE) AS BIGINT) AS late FROM study",
                               v.STUDY))
def late_label(spark, sf):
    return v.study_orders(spark, sf).select("order_id", co.late(F.col("delivered"), F.col("promised")).alias("late"))


@check("fill_defaults", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey%3<>0 THEN 'x' END,'unknown') AS category, 'unknown' AS seller_state,
  coalesce(CASE WHEN o_orderkey%4<>0 THEN 'card' END,'unknown') AS payment_type,
  coalesce(CASE WHEN o_orderkey%5<>0 THEN 7 END,1)::BIGINT AS payment_installments,
  coalesce(CASE WHEN o_orderkey%6<>0 THEN 2 END,0)::BIGINT AS n_items,
  round(coalesce(CASE WHEN o_orderkey%2<>0 THEN o_totalprice END,0),6) AS total_price, 0.0::DOUBLE AS total_freight,
  'S' AS customer_state, 3::BIGINT AS promised_lead_days FROM orders WHERE o_orderkey%7<>0 AND o_orderkey%11<>0""")
def fill_defaults(spark, sf):
    k = F.col("o_orderkey")
    raw = read(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 3 != 0, "x").alias("category"), F.lit(None).cast("string").alias("seller_state"),
        F.when(k % 4 != 0, "card").alias("payment_type"), F.when(k % 5 != 0, 7).alias("payment_installments"),
        F.when(k % 6 != 0, F.lit(2).cast("bigint")).alias("n_items"), F.when(k % 2 != 0, F.col("o_totalprice")).alias("total_price"),
        F.lit(None).cast("double").alias("total_freight"), F.when(k % 7 != 0, "S").alias("customer_state"),
        F.when(k % 11 != 0, 3).alias("promised_lead_days"))
    return st.fill_defaults(raw)


_FEATURES = f"""
 item AS (SELECT l_orderkey, {_FIRST.format('l_suppkey')} AS seller_id, {_FIRST.format('l_partkey')} AS product_id,
  {_FIRST.format('l_returnflag')} AS payment_type, max(l_linenumber) AS inst, count(*) AS n_items, sum(l_extendedprice) AS price,
  sum(l_tax*l_extendedprice) AS freight FROM lineitem GROUP BY 1),
 features AS (SELECT f.order_id, split, late, CAST(month(purchased) AS VARCHAR) AS purchase_month,
  CAST((dayofweek(purchased)+6)%7 AS VARCHAR) AS purchase_weekday, 'night' AS purchase_hour_bin, cn.n_name AS customer_state,
  coalesce(sn.n_name,'unknown') AS seller_state, coalesce(p_type,'unknown') AS category,
  coalesce(payment_type,'unknown') AS payment_type, coalesce(inst,1)::BIGINT AS payment_installments,
  coalesce(n_items,0) AS n_items, coalesce(price,0) AS total_price, coalesce(freight,0) AS total_freight,
  date_diff('day', CAST(purchased AS DATE), CAST(promised AS DATE)) AS promised_lead_days,
  {KM.format(a='a', b='b')} AS distance_km
  FROM parts f LEFT JOIN customer ON customer_id=c_custkey LEFT JOIN nation cn ON cn.n_nationkey=c_nationkey
  LEFT JOIN item ON l_orderkey=order_id LEFT JOIN supplier ON s_suppkey=seller_id LEFT JOIN nation sn ON sn.n_nationkey=s_nationkey
  LEFT JOIN part ON p_partkey=product_id LEFT JOIN centroid a ON a.zip=c_nationkey LEFT JOIN centroid b ON b.zip=s_nationkey)"""


def _features(spark, sf):
    t = v.study_tables(spark, sf)
    parts = st.with_split(st.labelled(st.before_cutoff(t.orders), "F"), v.TRAIN_END)
    return st.attach_features(parts, t, v.ITEM_ORDER, v.PAY_ORDER)


@check("feature_table", with_ctes("""
SELECT order_id, split, late, purchase_month, purchase_weekday, purchase_hour_bin, customer_state, seller_state, category,
  payment_type, payment_installments, n_items, round(total_price+1e-9,6) AS total_price, round(total_freight+1e-9,6) AS total_freight,
  promised_lead_days, round(distance_km,6) AS distance_km FROM features WHERE customer_state IS NOT NULL""",
                                  v.STUDY, v.PLACES, _FEATURES))
def feature_table(spark, sf):
    table = _features(spark, sf).withColumns({c: F.col(c) + 1e-9 for c in ("total_price", "total_freight")})
    return table.select("order_id", "split", "late", *st.CATEGORICAL, *st.NUMERIC)


@check("censor_cutoff", with_ctes("""
SELECT strftime(max(purchased),'%Y-%m-%d %H:%M:%S') AS last_purchase,
  strftime(max(purchased) - INTERVAL 60 DAYS,'%Y-%m-%d %H:%M:%S') AS cutoff, (SELECT count(*) FROM pre) AS orders_before_cutoff
FROM study""", v.STUDY))
def censor_cutoff(spark, sf):
    return st.censor_cutoff(v.study_orders(spark, sf))


@check("undelivered", with_ctes("SELECT order_id, status FROM pre WHERE order_id NOT IN (SELECT order_id FROM late)", v.STUDY))
def undelivered(spark, sf):
    return st.undelivered(st.before_cutoff(v.study_orders(spark, sf)), "F").select("order_id", "status")


@check("cohort_notes", with_ctes("""
SELECT status, count(*) AS orders, count(*) FILTER (status='O') AS in_flight, count(*) FILTER (status='P') AS not_a_delivery,
  count(*) FILTER (promised < (SELECT max(purchased) FROM study)) AS past_promise
FROM pre WHERE order_id NOT IN (SELECT order_id FROM late) GROUP BY 1""", v.STUDY))
def cohort_notes(spark, sf):
    orders = v.study_orders(spark, sf)
    return st.cohort_notes(st.before_cutoff(orders), st.last_purchase(orders), "F", IN_FLIGHT, NOT_A_DELIVERY)


def _parts(spark, sf):
    return st.with_split(st.labelled(st.before_cutoff(v.study_orders(spark, sf)), "F"), v.TRAIN_END)


@check("temporal_split", with_ctes("""SELECT split, count(*) AS n, sum(late)::BIGINT AS late, round(avg(late),6) AS late_rate
  FROM parts GROUP BY 1""", v.STUDY))
def temporal_split(spark, sf):
    return st.split_rates(_parts(spark, sf))


SCORE = "(order_id*37%1000)/1000.0"


@check("by_month", with_ctes(f"""SELECT split, strftime(purchased,'%Y-%m') AS month, count(*) AS n, round(avg(late),6) AS late_rate,
  round(avg({SCORE})+1e-9,6) AS mean_predicted FROM parts GROUP BY 1,2""", v.STUDY))
def by_month(spark, sf):
    scored = _parts(spark, sf).withColumn("p", F.col("order_id") * 37 % 1000 / 1000.0)
    return st.by_month(scored, score="p", by=["split"]).withColumn("mean_predicted", F.col("mean_predicted") + 1e-9)


@check("prevalence_baseline", with_ctes("""
SELECT count(*) AS n, round(avg(p),6) AS mean_predicted, 0.5::DOUBLE AS auroc, round(avg(late),6) AS auprc,
  round(avg((p-late)*(p-late)),6) AS brier FROM parts, (SELECT avg(late) AS p FROM parts WHERE split='train') WHERE split='test'""",
                                        v.STUDY))
def prevalence_baseline(spark, sf):
    parts = _parts(spark, sf)
    return ranking.prevalence_baseline(parts.filter("split = 'train'"), parts.filter("split = 'test'"), "late")


@check("single_feature_rank", with_ctes("SELECT n, positives, round(auroc,6) AS auroc, round(auprc,6) AS auprc FROM ranked",
                                        v.STUDY, """leads AS (SELECT late AS y,
  -CAST(date_diff('day', CAST(purchased AS DATE), CAST(promised AS DATE)) AS DOUBLE) AS score FROM parts WHERE split='test')""",
                                        ranking_sql("leads")))
def single_feature_rank(spark, sf):
    test = _parts(spark, sf).filter("split = 'test'").withColumn("lead", co.lead_days(F.col("promised"), F.col("purchased")))
    return ranking.single_feature_rank(test, "late", "lead")


@check("sensitivity_metrics", with_ctes("""
SELECT n, positives, round(auroc,6) AS auroc, round(auprc,6) AS auprc, distinct_scores, distinct_scores<=2 AS hard_scores,
  round(positives/n,6) AS prevalence, round(mean_predicted+1e-9,6) AS mean_predicted, round(brier+1e-9,6) AS brier FROM ranked""",
                                        v.STUDY, f"""mixed AS (SELECT {SCORE} AS score, late AS y FROM parts WHERE split='test'
  UNION ALL SELECT {SCORE}, 1 FROM pre WHERE status='O' AND purchased >= TIMESTAMP '1999-01-01')""", ranking_sql("mixed")))
def sensitivity_metrics(spark, sf):
    score = F.col("order_id") * 37 % 1000 / 1000.0
    orders = st.before_cutoff(v.study_orders(spark, sf))
    test = st.with_split(st.labelled(orders, "F"), v.TRAIN_END).filter("split = 'test'").withColumn("p", score)
    flight = st.in_flight_cohort(orders, "F", IN_FLIGHT).withColumn("p", score)
    bundle = ranking.metric_bundle(st.with_in_flight(test, flight, v.TRAIN_END), "late", "p")
    return nudged(bundle, "mean_predicted", "brier")


def study_sections(spark, sf, **options):
    """The whole study over the test tables; ``options`` go to ``study_run.run``."""
    return study_run.run(v.study_tables(spark, sf), train_end=v.TRAIN_END, delivered="F", in_flight=IN_FLIGHT, not_delivery=NOT_A_DELIVERY,
                         item_order=v.ITEM_ORDER, pay_order=v.PAY_ORDER, **options)


@check("study_models")
def study_models(spark, sf):
    """Metrics with row and month intervals of the three models at their defaults, and the sensitivity model."""
    return study_sections(spark, sf, wanted=["models"])["models"]
