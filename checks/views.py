"""Analog views on the test tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.operators.records import render
from labelwright.operators.scoring import keyword_answer
from labelwright.plans.order_study import StudyTables
from labelwright.session import spread
from labelwright.vocab import LOGISTICS, Vocabulary

from .registry import read

TRAIN_END = "1999-01-01"
AUDIT_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                 "o_orderstatus", "o_orderpriority"]
NEGATIVE_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]

#: The vocabulary of the record view (seven fields).
RECORDS = Vocabulary(
    fields=("Timestamp", "Segment", "Shipment_Status", "Traffic_Status", "Waiting_Time", "Temperature",
            "Logistics_Delay_Reason"),
    target=LOGISTICS.target, clauses=LOGISTICS.clauses, system=LOGISTICS.system,
    numeric=("Waiting_Time", "Temperature"),
    categorical=("Segment", "Shipment_Status", "Traffic_Status", "Logistics_Delay_Reason"),
    non_rule_edits={"Timestamp": "2024-12-30", "Segment": "MACHINERY", "Waiting_Time": "59", "Temperature": "30",
                    "Logistics_Delay_Reason": "Traffic"},
    extra_edits=LOGISTICS.extra_edits, paired_edits=LOGISTICS.paired_edits,
    trigger_fields=(("Heavy", "Logistics_Delay_Reason"), ("Delayed", "Logistics_Delay_Reason"), ("Delayed", "Segment")),
)
STEMS = ("delay", "heav")


def audit_table(spark: SparkSession, sf: str) -> DataFrame:
    li, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    hit = (F.col("l_returnflag") == "R") | (F.col("o_orderpriority") == "1-URGENT")
    return joined.select(*AUDIT_COLUMNS, hit.cast("int").alias("target"))


AUDIT = """audit AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, l_tax, o_orderstatus,
  o_orderpriority, CAST(l_returnflag='R' OR o_orderpriority='1-URGENT' AS INT) AS target
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""


def negative_table(spark: SparkSession, sf: str) -> DataFrame:
    parity = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")) % 2
    return read(spark, sf, "lineitem").select(*NEGATIVE_COLUMNS, parity.cast("int").alias("target"))


NEGATIVE = """negative AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, l_tax,
  CAST((l_orderkey*7+l_linenumber*13+l_partkey)%2 AS INT) AS target FROM lineitem)"""


def stump_table(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_quantity", (F.col("l_quantity") > 40).cast("int").alias("target"))


STUMP = "stump AS (SELECT l_quantity, CAST(l_quantity>40 AS INT) AS target FROM lineitem)"


def records_table(spark: SparkSession, sf: str) -> DataFrame:
    o, c = spread(read(spark, sf, "orders")), read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    quarter = F.col("o_orderkey") % 4
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Timestamp"),
        F.col("c_mktsegment").alias("Segment"),
        F.when(status == "F", "Delayed").when(status == "O", "In Transit").otherwise("Delivered").alias("Shipment_Status"),
        F.when(priority == "1-URGENT", "Heavy").when(priority.isin("2-HIGH", "3-MEDIUM"), "Detour").otherwise("Clear")
        .alias("Traffic_Status"),
        (F.col("o_orderkey") % 60).cast("string").alias("Waiting_Time"),
        (F.col("o_custkey") % 13 + 18).cast("string").alias("Temperature"),
        F.when(quarter == 1, "Weather").when(quarter == 2, "Traffic").when(quarter == 3, "Mechanical Failure")
        .alias("Logistics_Delay_Reason"),
        ((status == "F") | (priority == "1-URGENT")).cast("int").alias("gold"))


RECORDS_SQL = """records AS (SELECT o_orderkey AS row_id, strftime(o_orderdate,'%Y-%m-%d') AS "Timestamp",
  c_mktsegment AS Segment,
  CASE o_orderstatus WHEN 'F' THEN 'Delayed' WHEN 'O' THEN 'In Transit' ELSE 'Delivered' END AS Shipment_Status,
  CASE WHEN o_orderpriority='1-URGENT' THEN 'Heavy'
       WHEN o_orderpriority IN ('2-HIGH','3-MEDIUM') THEN 'Detour' ELSE 'Clear' END AS Traffic_Status,
  CAST(o_orderkey%60 AS VARCHAR) AS Waiting_Time, CAST(18+o_custkey%13 AS VARCHAR) AS Temperature,
  CASE o_orderkey%4 WHEN 0 THEN NULL WHEN 1 THEN 'Weather' WHEN 2 THEN 'Traffic'
       ELSE 'Mechanical Failure' END AS Logistics_Delay_Reason,
  CAST(o_orderstatus='F' OR o_orderpriority='1-URGENT' AS INT) AS gold
  FROM orders JOIN customer ON o_custkey=c_custkey)"""

_RENDERED = " || chr(10) || ".join(f"'{f}: ' || coalesce(nullif(trim(\"{f}\"),''),'None')" for f in RECORDS.fields)
TEXTS_SQL = f"texts AS (SELECT *, {_RENDERED} AS text FROM records)"


def texts_table(spark: SparkSession, sf: str) -> DataFrame:
    # every text becomes many probes, whatever the join with the customers made of the partitions
    return render(spread(records_table(spark, sf), read(spark, sf, "orders").count()), RECORDS.fields)


def answer_of(text: str = "text", row_id: str = "row_id"):
    """The deterministic stand-in scorer's raw answer."""
    return F.when(F.col(row_id) % 50 == 0, "n/a").otherwise(keyword_answer(F.col(text), RECORDS.target, STEMS))


def scorer(df: DataFrame) -> DataFrame:
    return df.withColumn("raw", answer_of())


ANSWER_SQL = """CASE WHEN row_id % 50 = 0 THEN 'n/a'
  WHEN regexp_matches(text, '(?im)^[^:\\n]*:[^\\n]*(delay|heav)') THEN 'Logistics_Delay: 1' ELSE 'Logistics_Delay: 0' END"""
LABEL_SQL = "CAST(nullif(regexp_extract({raw}, '^\\s*Logistics_Delay:\\s*([01])\\b', 1), '') AS BIGINT)"
SCORED_SQL = (f"answered AS (SELECT *, {ANSWER_SQL} AS raw FROM texts), "
              f"scored AS (SELECT *, {LABEL_SQL.format(raw='raw')} AS label, "
              "CAST(Shipment_Status='Delayed' OR Traffic_Status='Heavy' AS BIGINT) AS rule FROM answered)")
RECORD_CTES = (RECORDS_SQL, TEXTS_SQL, SCORED_SQL)


def scored_records(spark: SparkSession, sf: str) -> DataFrame:
    from labelwright.operators.scoring import score_table

    return score_table(records_table(spark, sf), scorer, RECORDS)


def scores_table(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), (F.col("event_type") == "error").cast("int").alias("y"),
        (F.col("value") / 500).alias("score"), F.to_date("ts").alias("block"), "event_type")


SCORES = """scores AS (SELECT event_id AS row_id, CAST(event_type='error' AS INT) AS y, value/500 AS score,
  CAST(ts AS DATE) AS block, event_type FROM events)"""


def chat_table(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as one array of turns each (a conversation is a bounded record)."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))))
    grouped = read(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("_t"))
    return grouped.select("conv_id", F.transform("_t", lambda t: F.struct(
        t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


CHAT = """chat AS (SELECT conv_id, list(struct_pack("from" := role, "value" := text) ORDER BY turn) AS conversations
  FROM conversations GROUP BY conv_id)"""


# ------------------------------------------------------------------------------ study
def study_orders(spark: SparkSession, sf: str) -> DataFrame:
    o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    shipped = li.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = shipped.filter(F.col("l_shipdate") >= F.col("o_orderdate")).groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("delivered"))
    days = F.substring("o_orderpriority", 1, 1).cast("int") * 200 + 100
    return o.join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("purchased"),
        (F.col("o_orderdate") + F.make_dt_interval(days)).alias("promised"), "delivered")


STUDY = """study AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
  o_orderdate AS purchased, o_orderdate + to_days(100+200*CAST(left(o_orderpriority,1) AS INT)) AS promised,
  m.delivered FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS delivered FROM lineitem
  JOIN orders ON l_orderkey=o_orderkey WHERE l_shipdate>=o_orderdate GROUP BY 1) m ON m.l_orderkey=o_orderkey),
 pre AS (SELECT * FROM study WHERE purchased <= (SELECT max(purchased) FROM study) - INTERVAL 60 DAYS),
 late AS (SELECT *, CAST(CAST(delivered AS DATE) > CAST(promised AS DATE) AS BIGINT) AS late FROM pre
  WHERE status='F' AND delivered IS NOT NULL),
 parts AS (SELECT *, CASE WHEN purchased >= TIMESTAMP '1999-01-01' THEN 'test'
  WHEN delivered < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'straddling' END AS split FROM late)"""

ITEM_ORDER = ("item_no", "product_id", "seller_id", "shipped", "price")
PAY_ORDER = ("pay_no", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def study_items(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("item_no"), F.col("l_suppkey").alias("seller_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("price"),
        (F.col("l_tax") * F.col("l_extendedprice")).alias("freight"), F.col("l_shipdate").alias("shipped"))


def study_payments(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("pay_no"), F.col("l_returnflag").alias("payment_type"),
        F.col("l_linenumber").alias("instalments"), "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def places_table(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("zip"), ((key * 37) % 18000 / 100.0 - 90).alias("lat"),
        ((key * 91) % 36000 / 100.0 - 180).alias("lng"))


PLACES = """places AS (SELECT c_custkey, c_nationkey AS zip, ((c_custkey*37)%18000)/100.0-90 AS lat,
  ((c_custkey*91)%36000)/100.0-180 AS lng FROM customer),
 centroid AS (SELECT zip, median(CAST(lat AS DOUBLE)) AS lat, median(CAST(lng AS DOUBLE)) AS lng FROM places GROUP BY zip)"""


def study_tables(spark: SparkSession, sf: str) -> StudyTables:
    nation = read(spark, sf, "nation").select("n_nationkey", "n_name")
    customers = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state"),
        F.col("c_nationkey").alias("customer_zip"))
    sellers = read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state"), F.col("s_nationkey").alias("seller_zip"))
    products = read(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))
    return StudyTables(study_orders(spark, sf), customers, study_items(spark, sf), sellers, products,
                       study_payments(spark, sf), places_table(spark, sf))


def claim_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with front matter, a fence, a link and a line of quoted figures added."""
    d = F.col("doc_id")
    added = F.concat(
        F.lit("---\nid: "), d.cast("string"), F.lit("\n---\n"), F.col("text"), F.lit("\n```\nrun 1234\n```\nsee [page "),
        d.cast("string"), F.lit("](docs/p.md) at https://example.com/a/9 and deadbeef0123456789\nscore "),
        (d % 97).cast("string"), F.lit("."), F.lpad((d % 1000).cast("string"), 3, "0"), F.lit(" of 1,"),
        F.lpad((d % 1000).cast("string"), 3, "0"), F.lit(" rows, "), (d % 100).cast("string"), F.lit("% flagged"))
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", added.alias("text"))


CLAIM_DOCS = """docs AS (SELECT doc_id, '---' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10) || text ||
  chr(10) || '```' || chr(10) || 'run 1234' || chr(10) || '```' || chr(10) || 'see [page ' || doc_id ||
  '](docs/p.md) at https://example.com/a/9 and deadbeef0123456789' || chr(10) || 'score ' || (doc_id%97) || '.' ||
  lpad(CAST(doc_id%1000 AS VARCHAR),3,'0') || ' of 1,' || lpad(CAST(doc_id%1000 AS VARCHAR),3,'0') || ' rows, ' ||
  (doc_id%100) || '% flagged' AS text FROM documents)"""

