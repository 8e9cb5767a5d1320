"""Sources, record rendering and parsing, rules and single edits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.operators import records as rec
from labelwright.operators import rule_tables as rt
from labelwright.operators.edits import Step, edit_column, reorder, set_to
from labelwright.operators.scoring import fit_line_weights, line_weight_scorer, score_table, score_texts
from labelwright.session import new_path
from labelwright.sources import chat, fingerprints, reports, tables
from labelwright.vocab import SYSTEM_TEXT

from . import views as v
from .registry import check, read, with_ctes

FIELDS = ", ".join(f'"{f}"' for f in v.RECORDS.fields)


# ------------------------------------------------------------------------------ sources
@check("csv_typed_load", """
SELECT o_orderkey, CASE WHEN o_orderkey%13=0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey%7=0 THEN NULL WHEN o_orderkey%11=0 THEN 'None' ELSE o_orderpriority END AS o_orderpriority,
  CAST(o_orderstatus='F' AS BIGINT) AS target FROM (SELECT *, round(o_totalprice,6) AS o_totalprice_ FROM orders)""")
def csv_typed_load(spark, sf):
    o, key = read(spark, sf, "orders"), F.col("o_orderkey")
    text = o.select(
        key.cast("string").alias("o_orderkey"),
        F.when(key % 13 == 0, "unknown").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, "None").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        (F.col("o_orderstatus") == "F").cast("int").cast("string").alias("target"))
    path = new_path(spark, "csv")
    text.write.option("header", True).option("emptyValue", "").csv(path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()),
                           T.StructField("o_orderpriority", T.StringType()), T.StructField("target", T.IntegerType())])
    return tables.read_labelled_csv(spark, path, schema, "target")


@check("chat_roundtrip", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations""")
def chat_roundtrip(spark, sf):
    before = v.chat_table(spark, sf)
    path = new_path(spark, "chat")
    chat.write_chat_jsonl(before, path)
    extra = T.StructType([T.StructField("conv_id", T.LongType())])
    after = chat.read_chat_jsonl(spark, path, extra)
    return after.select("conv_id", F.posexplode("conversations").alias("turn", "t")).select(
        "conv_id", "turn", F.col("t.from").alias("role"), F.col("t.value").alias("text"))


@check("prediction_audit", with_ctes(f"""
SELECT row_id, {FIELDS}, CAST(gold AS BIGINT) AS gold, rule, raw AS model_raw, coalesce(CAST(label AS VARCHAR),'') AS model_label
FROM scored""", *v.RECORD_CTES))
def prediction_audit(spark, sf):
    table = reports.prediction_table(v.scored_records(spark, sf), ["row_id", *v.RECORDS.fields])
    path = new_path(spark, "predictions")
    reports.write_predictions(table, path)
    return spark.read.parquet(path)


@check("report_roundtrip", """
SELECT 'status' AS section, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'priority', CASE WHEN o_orderpriority='5-LOW' THEN NULL ELSE o_orderpriority END, count(*) FROM orders GROUP BY 2""")
def report_roundtrip(spark, sf):
    o = read(spark, sf, "orders")
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    sections = {"status": o.groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n")),
                "priority": o.groupBy(priority.alias("name")).agg(F.count("*").alias("n"))}
    folder = new_path(spark, "report")
    reports.write_report(sections, folder)
    parts = [spark.read.schema("name string, n bigint").json(f"{folder}/{s}").select(F.lit(s).alias("section"), "name", "n") for s in sections]
    return parts[0].unionByName(parts[1])


@check("order_tables", """
SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_orderdate)::DOUBLE AS total FROM orders
UNION ALL SELECT 'customers', count(*), sum(c_custkey%90000)::DOUBLE FROM customer
UNION ALL SELECT 'order_items', count(*), round(sum(l_extendedprice),2) FROM lineitem
UNION ALL SELECT 'sellers', count(*), sum(s_suppkey)::DOUBLE FROM supplier
UNION ALL SELECT 'products', count(*), count(DISTINCT p_type)::DOUBLE FROM part
UNION ALL SELECT 'order_payments', count(*), sum(l_linenumber)::DOUBLE FROM lineitem
UNION ALL SELECT 'geolocation', count(*), sum(c_custkey%180-90)::DOUBLE FROM customer""")
def order_tables(spark, sf):
    """The seven order files, written from the test tables and read with their types."""
    o, c, li = (read(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    none = F.lit(None).cast("string")
    stamps = ["order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"]
    made = {
        "orders": o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"),
                           F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_purchase_timestamp"), *[none.alias(s) for s in stamps]),
        "customers": c.select(F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 90000).alias("customer_zip_code_prefix"),
                              F.lit("SP").alias("customer_state")),
        "order_items": li.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_partkey").alias("product_id"),
                                 F.col("l_suppkey").alias("seller_id"), F.col("l_extendedprice").alias("price"), F.lit(1.5).alias("freight_value")),
        "sellers": read(spark, sf, "supplier").select(F.col("s_suppkey").alias("seller_id"), F.col("s_suppkey").alias("seller_zip_code_prefix"),
                                                      F.lit("RJ").alias("seller_state")),
        "products": read(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name")),
        "order_payments": li.select(F.col("l_orderkey").alias("order_id"), F.lit(1).alias("payment_sequential"), F.lit("card").alias("payment_type"),
                                    F.col("l_linenumber").alias("payment_installments")),
        "geolocation": c.select((F.col("c_custkey") % 90000).alias("geolocation_zip_code_prefix"), (F.col("c_custkey") % 180 - 90).alias("geolocation_lat"),
                                F.lit(0.5).alias("geolocation_lng")),
    }
    folder = new_path(spark, "shop")
    for name, table in made.items():
        table.write.option("header", True).csv(f"{folder}/{name}.csv")
    found = tables.read_order_tables(spark, folder)
    totals = {"orders": F.count_distinct("order_purchase_timestamp"), "customers": F.sum("customer_zip_code_prefix"), "order_items": F.round(F.sum("price"), 2),
              "sellers": F.sum("seller_zip_code_prefix"), "products": F.count_distinct("product_category_name"),
              "order_payments": F.sum("payment_installments"), "geolocation": F.sum("geolocation_lat")}
    parts = [found[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), t.cast("double").alias("total")) for n, t in totals.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@check("file_fingerprint")
def file_fingerprint(spark, sf):
    return fingerprints.fingerprint_files(spark, sf, "*.parquet")


# ------------------------------------------------------------------------------ records
@check("conform_schema", with_ctes("""
SELECT row_id, Segment, TRY_CAST(Waiting_Time AS DOUBLE) AS Waiting_Time,
  TRY_CAST(Logistics_Delay_Reason AS DOUBLE) AS Logistics_Delay_Reason, CAST(NULL AS VARCHAR) AS Humidity FROM records""",
                                   v.RECORDS_SQL))
def conform_schema(spark, sf):
    return rec.conform(v.records_table(spark, sf), ["Segment", "Waiting_Time", "Logistics_Delay_Reason", "Humidity"],
                       ["Waiting_Time", "Logistics_Delay_Reason"], keep=["row_id"])


@check("render_records", with_ctes("SELECT row_id, text FROM texts", v.RECORDS_SQL, v.TEXTS_SQL))
def render_records(spark, sf):
    return v.texts_table(spark, sf).select("row_id", "text")


@check("render_sparse", with_ctes("""
SELECT row_id, concat_ws(chr(10), 'Segment: ' || Segment, 'Waiting_Time: ' || Waiting_Time,
  'Logistics_Delay_Reason: ' || Logistics_Delay_Reason) AS text FROM records""", v.RECORDS_SQL))
def render_sparse(spark, sf):
    return rec.render_sparse(v.records_table(spark, sf), ["Segment", "Waiting_Time", "Logistics_Delay_Reason"]).select(
        "row_id", "text")


_PLAIN = " || chr(10) || ".join(f"'{f}: ' || coalesce(trim(\"{f}\"),'')" for f in v.RECORDS.fields)


@check("to_chat_records", with_ctes(f"""
SELECT row_id, t.turn, t.role, t.value, m.first_role FROM (SELECT row_id, unnest([
  {{turn: 0, role: 'system', value: '{SYSTEM_TEXT}'}}, {{turn: 1, role: 'user', value: {_PLAIN}}},
  {{turn: 2, role: 'assistant', value: 'Logistics_Delay: ' || gold}}]) AS t FROM records)
CROSS JOIN (SELECT 'system' AS first_role) m""", v.RECORDS_SQL).replace("t.turn", "CAST(t.turn AS BIGINT) AS turn"))
def to_chat_records(spark, sf):
    source = v.records_table(spark, sf).select("row_id", *v.RECORDS.fields, F.col("gold").alias(v.RECORDS.target))
    chats = rec.to_chat(source, v.RECORDS.target, SYSTEM_TEXT, keep=["row_id"])
    prompts = rec.to_messages(chats.withColumn("text", rec.turn_value("conversations", 1)), "text", SYSTEM_TEXT)
    return prompts.select("row_id", F.posexplode("conversations").alias("turn", "t"), "messages").select(
        "row_id", "turn", F.col("t.from").alias("role"), F.col("t.value").alias("value"),
        F.col("messages")[0]["role"].alias("first_role"))


def _field(name: str) -> str:
    hit = (f"list_extract(list_filter(string_split(noisy, chr(10)), lambda l: contains(l, ':') AND "
           f"trim(split_part(l, ':', 1)) = '{name}'), -1)")
    return f"trim(substr({hit}, instr({hit}, ':') + 1))"


@check("decode_records", with_ctes(f"""
SELECT row_id, {_field('Timestamp')} AS "Timestamp", {_field('Segment')} AS Segment,
  TRY_CAST({_field('Waiting_Time')} AS DOUBLE) AS Waiting_Time, {_field('Logistics_Delay_Reason')} AS Logistics_Delay_Reason,
  CAST(NULL AS VARCHAR) AS Humidity, CAST(8 AS BIGINT) AS n_fields, {_field('Extra')} AS extra FROM noisy""",
                                   v.RECORDS_SQL, v.TEXTS_SQL, """noisy AS (SELECT row_id, text || chr(10) || 'no colon here' ||
  chr(10) || ' Segment :  again: ' || (row_id%9) || ' ' || chr(10) || 'Extra: ' || row_id AS noisy FROM texts)"""))
def decode_records(spark, sf):
    noisy = v.texts_table(spark, sf).select("row_id", F.concat(
        F.col("text"), F.lit("\nno colon here\n Segment :  again: "), (F.col("row_id") % 9).cast("string"),
        F.lit(" \nExtra: "), F.col("row_id").cast("string")).alias("noisy"))
    mapped = rec.decode(noisy, "noisy")
    columns = rec.decode(mapped.withColumns({"n_fields": F.size("fields"), "extra": F.col("fields")["Extra"]}), "noisy",
                         ["Timestamp", "Segment", "Waiting_Time", "Logistics_Delay_Reason", "Humidity"], ["Waiting_Time"],
                         keep=["row_id", "n_fields", "extra"])
    return columns


# Answer forms that the parser must tell apart
_RAW = """CASE row_id % 9 WHEN 0 THEN 'Logistics_Delay: ' || gold WHEN 1 THEN 'Logistics_Delay:' || gold
  WHEN 2 THEN '  Logistics_Delay: ' || gold || chr(10) WHEN 3 THEN 'Logistics_Delay: ' || gold || '0'
  WHEN 4 THEN 'assistant' || chr(10) || 'Logistics_Delay: ' || gold WHEN 5 THEN 'The answer is ' || gold
  WHEN 6 THEN 'Logistics_Delay: 2' WHEN 7 THEN '' ELSE NULL END"""


def _raw_answers(spark, sf):
    g, r = F.col("gold").cast("string"), F.col("row_id") % 9
    full = F.concat(F.lit("Logistics_Delay: "), g)
    raw = (F.when(r == 0, full).when(r == 1, F.concat(F.lit("Logistics_Delay:"), g))
           .when(r == 2, F.concat(F.lit("  "), full, F.lit("\n"))).when(r == 3, F.concat(full, F.lit("0")))
           .when(r == 4, F.concat(F.lit("assistant\n"), full)).when(r == 5, F.concat(F.lit("The answer is "), g))
           .when(r == 6, "Logistics_Delay: 2").when(r == 7, ""))
    return v.records_table(spark, sf).select("row_id", raw.alias("raw"))


@check("parse_answers", with_ctes(f"SELECT row_id, {v.LABEL_SQL.format(raw='raw')} AS label FROM raws",
                                  v.RECORDS_SQL, f"raws AS (SELECT row_id, {_RAW} AS raw FROM records)"))
def parse_answers(spark, sf):
    return rec.parse_answers(_raw_answers(spark, sf), "raw", v.RECORDS.target).select("row_id", "label")


@check("clean_output", with_ctes("""
SELECT row_id, CASE WHEN lower(lines[1]) LIKE 'assistant%' THEN array_to_string(lines[2:], chr(10))
  ELSE array_to_string(lines, chr(10)) END AS cleaned
FROM (SELECT row_id, list_filter(list_transform(string_split(raw || chr(10) || ' ' || chr(10) || '  done ', chr(10)),
  lambda l: trim(l)), lambda l: l <> '') AS lines FROM raws)""",
                                 v.RECORDS_SQL, f"raws AS (SELECT row_id, {_RAW} AS raw FROM records)"))
def clean_output(spark, sf):
    noisy = _raw_answers(spark, sf).withColumn("raw", F.concat(F.col("raw"), F.lit("\n \n  done ")))
    return rec.clean_outputs(noisy, "raw").select("row_id", "cleaned")


@check("gold_from_chat", with_ctes("""
SELECT conv_id, conversations[2]."value" AS user_text, CASE WHEN n > 2 AND n % 3 < 2 THEN CAST(n % 3 AS BIGINT) END AS gold
FROM (SELECT *, length(conversations[3]."value") AS n FROM chat)""", v.CHAT))
def gold_from_chat(spark, sf):
    # the third turn becomes an answer whose digit is 0, 1 or (unparsable) 2
    answer = F.transform("conversations", lambda t, i: F.struct(t["from"].alias("from"), F.when(
        i == 2, F.concat(F.lit("Label: "), (F.length(t["value"]) % 3).cast("string"), F.lit(" "), t["value"])
    ).otherwise(t["value"]).alias("value")))
    chats = v.chat_table(spark, sf).withColumn("conversations", answer)
    return rec.gold_from_chat(chats, "Label", on_error="null").select("conv_id", "user_text", "gold")


# ------------------------------------------------------------------------------ rules
@check("rule_predict", with_ctes("""SELECT row_id, CAST(coalesce(trim(s)='Delayed', false) OR
  coalesce(trim(Traffic_Status)='Heavy', false) AS BIGINT) AS rule FROM (SELECT *, CASE row_id%5 WHEN 0 THEN NULL
  WHEN 1 THEN '  ' || Shipment_Status || ' ' ELSE Shipment_Status END AS s FROM records)""", v.RECORDS_SQL))
def rule_predict(spark, sf):
    status, r = F.col("Shipment_Status"), F.col("row_id") % 5
    noisy = v.records_table(spark, sf).withColumn("Shipment_Status", F.when(r == 0, F.lit(None)).when(
        r == 1, F.concat(F.lit("  "), status, F.lit(" "))).otherwise(status))
    return rt.apply_rule(noisy, v.RECORDS.clauses).select("row_id", "rule")


def _thinned(spark, sf):
    """Texts with the first, second, both or no rule line removed or renamed."""
    t, r = F.col("text"), F.col("row_id") % 5
    texts = v.texts_table(spark, sf)
    from labelwright.functions import text as tx

    return texts.select("row_id", F.when(r == 0, t).when(r == 1, tx.drop_lines(t, ["Shipment_Status"])).when(
        r == 2, tx.drop_lines(t, ["Traffic_Status"])).when(r == 3, tx.drop_lines(t, ["Shipment_Status", "Traffic_Status"]))
        .otherwise(tx.rename_line(t, F.lit("Shipment_Status"), F.lit("Status"))).alias("text"))


@check("rule_on_text", with_ctes("""SELECT row_id, CASE WHEN row_id%5=0 THEN CAST(gold AS BIGINT) END AS rule_on_text
FROM records""", v.RECORDS_SQL))
def rule_on_text(spark, sf):
    return rt.rule_on_text(_thinned(spark, sf), v.RECORDS).select("row_id", "rule_on_text")


@check("remaining_clause", with_ctes("""SELECT row_id, CASE row_id%5 WHEN 1 THEN CAST(Traffic_Status='Heavy' AS BIGINT)
  WHEN 2 THEN CAST(Shipment_Status='Delayed' AS BIGINT) END AS remaining FROM records""", v.RECORDS_SQL))
def remaining_clause(spark, sf):
    return rt.remaining_clause(_thinned(spark, sf), v.RECORDS).select("row_id", "remaining")


@check("flip_by_rule", with_ctes("""
SELECT row_id, CASE WHEN d AND h THEN 'Shipment_Status -> In Transit and Traffic_Status -> Clear'
  WHEN d THEN 'Shipment_Status -> In Transit' WHEN h THEN 'Traffic_Status -> Clear'
  ELSE 'Shipment_Status -> Delayed' END AS flip_note, CASE WHEN d OR h THEN 0::BIGINT ELSE 1::BIGINT END AS flipped_rule,
  CASE WHEN d THEN 'In Transit' WHEN NOT h THEN 'Delayed' ELSE Shipment_Status END AS flipped_Shipment_Status,
  CASE WHEN h THEN 'Clear' ELSE Traffic_Status END AS flipped_Traffic_Status
FROM (SELECT *, Shipment_Status='Delayed' AS d, Traffic_Status='Heavy' AS h FROM records)""", v.RECORDS_SQL))
def flip_by_rule(spark, sf):
    return rt.flip_by_rule(v.records_table(spark, sf), v.RECORDS.clauses).select(
        "row_id", "flip_note", "flipped_rule", "flipped_Shipment_Status", "flipped_Traffic_Status")


@check("rule_clauses", with_ctes("""
SELECT count(*) FILTER (d) AS first_rows, coalesce(sum(gold) FILTER (d),0)::BIGINT AS first_positives,
  count(*) FILTER (h) AS second_rows, coalesce(sum(gold) FILTER (h),0)::BIGINT AS second_positives,
  count(*) FILTER (d AND h) AS both_rows, coalesce(sum(gold) FILTER (d AND h),0)::BIGINT AS both_positives,
  count(*) FILTER (NOT (d OR h)) AS neither_rows, coalesce(sum(gold) FILTER (NOT (d OR h)),0)::BIGINT AS neither_positives,
  count(*) FILTER (Shipment_Status='Delivered' AND h) AS delivered_heavy_rows,
  coalesce(sum(gold) FILTER (Shipment_Status='Delivered' AND h),0)::BIGINT AS delivered_heavy_positives,
  count(*) FILTER (CAST(d OR h AS INT) <> gold) AS mismatches, count(*) AS n
FROM (SELECT *, Shipment_Status='Delayed' AS d, Traffic_Status='Heavy' AS h FROM records)""", v.RECORDS_SQL))
def rule_clauses(spark, sf):
    return rt.rule_clauses(v.records_table(spark, sf), v.RECORDS.clauses, "gold", {
        "delivered_heavy": {"Shipment_Status": "Delivered", "Traffic_Status": "Heavy"}})


@check("rule_crosstab", with_ctes("""
SELECT s.v AS Shipment_Status, r.v AS Logistics_Delay_Reason, count(row_id) AS n_rows, coalesce(sum(gold),0)::BIGINT AS positives
FROM (SELECT DISTINCT Shipment_Status AS v FROM kept) s CROSS JOIN (SELECT DISTINCT reason AS v FROM kept) r
LEFT JOIN kept ON Shipment_Status=s.v AND reason=r.v GROUP BY 1,2""", v.RECORDS_SQL, """kept AS (SELECT *,
  coalesce(Logistics_Delay_Reason,'nan') AS reason FROM records WHERE NOT (Shipment_Status='Delayed' AND row_id%4=1))"""))
def rule_crosstab(spark, sf):
    kept = v.records_table(spark, sf).filter(~((F.col("Shipment_Status") == "Delayed") & (F.col("row_id") % 4 == 1)))
    return rt.rule_crosstab(kept, "Shipment_Status", "Logistics_Delay_Reason", "gold")


@check("rate_matrix", with_ctes("""
SELECT Shipment_Status, nullif(count(*) FILTER (Traffic_Status='Heavy'),0) AS Heavy_n,
  round(avg(gold) FILTER (Traffic_Status='Heavy'),6) AS Heavy_rate,
  nullif(count(*) FILTER (Traffic_Status='Detour'),0) AS Detour_n, round(avg(gold) FILTER (Traffic_Status='Detour'),6) AS Detour_rate,
  nullif(count(*) FILTER (Traffic_Status='Clear'),0) AS Clear_n, round(avg(gold) FILTER (Traffic_Status='Clear'),6) AS Clear_rate
FROM records GROUP BY 1""", v.RECORDS_SQL))
def rate_matrix(spark, sf):
    return rt.rate_matrix(v.records_table(spark, sf), "Shipment_Status", "Traffic_Status", "gold", ["Heavy", "Detour", "Clear"])


@check("category_counts", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce(\"{c}\",'None') AS value, count(*) AS n FROM records GROUP BY 2"
    for c in v.RECORDS.categorical), v.RECORDS_SQL))
def category_counts(spark, sf):
    return rt.category_counts(v.records_table(spark, sf), v.RECORDS.categorical)


@check("label_summary", with_ctes("""SELECT Segment, count(*) AS n, sum(gold)::BIGINT AS positives,
  (count(*)-sum(gold))::BIGINT AS negatives, round(sum(gold)/count(*),6) AS rate FROM records GROUP BY 1""", v.RECORDS_SQL))
def label_summary(spark, sf):
    return rt.label_summary(v.records_table(spark, sf), "gold", ["Segment"])


@check("present_by_label", with_ctes("""SELECT CAST(gold AS BIGINT) AS label, count(*) AS n,
  count(Logistics_Delay_Reason) AS present FROM records GROUP BY 1""", v.RECORDS_SQL))
def present_by_label(spark, sf):
    return rt.present_by_label(v.records_table(spark, sf), "Logistics_Delay_Reason", "gold")


# ------------------------------------------------------------------------------ edits
def _edit(name: str, steps, sql: str):
    @check(name, with_ctes(f"SELECT row_id, {sql} AS text FROM texts", v.RECORDS_SQL, v.TEXTS_SQL))
    def run(spark, sf):
        return edit_column(v.texts_table(spark, sf), "text", steps).select("row_id", "text")

    return run


def _set_sql(text: str, name: str, value: str) -> str:
    return f"regexp_replace({text}, '(?m)^{name}: .*$', '{name}: {value}')"


_edit("edit_set", [set_to("Traffic_Status", " $9\\1 ")],
      "regexp_replace(text, '(?m)^Traffic_Status: .*$', 'Traffic_Status: $9\\\\1')")
_edit("edit_set_two", [set_to("Waiting_Time", "60"), set_to("Temperature", "30.0")],
      _set_sql(_set_sql("text", "Waiting_Time", "60"), "Temperature", "30.0"))
_edit("edit_drop", [Step("drop", "Shipment_Status"), Step("drop", "Logistics_Delay_Reason")],
      "array_to_string(list_filter(string_split(text, chr(10)), lambda l: split_part(l, ':', 1) NOT IN "
      "('Shipment_Status','Logistics_Delay_Reason')), chr(10))")
_edit("edit_rename", [Step("rename", "Shipment_Status", "Status")],
      "regexp_replace(text, '(?m)^Shipment_Status: ', 'Status: ')")
_ORDER = list(reversed(v.RECORDS.fields))
_edit("edit_reorder", [reorder(_ORDER)], " || chr(10) || ".join(
    f"regexp_extract(text, '(?m)^{f}:.*$')" for f in _ORDER))
_edit("edit_append", [Step("append", "", "Note: the depot supervisor is Mr. Heavy")],
      "text || chr(10) || 'Note: the depot supervisor is Mr. Heavy'")


# ------------------------------------------------------------------------------ scoring
@check("batch_score", with_ctes(f"""
SELECT row_id, raw, label, rule, label = rule AS agrees_with_rule
FROM (SELECT *, {v.LABEL_SQL.format(raw='raw')} AS label FROM (SELECT row_id, {v.ANSWER_SQL} AS raw, rule
FROM (SELECT row_id, rule, array_to_string(list_filter(string_split(text, chr(10)), lambda l: split_part(l, ':', 1) NOT IN
('Shipment_Status','Traffic_Status')), chr(10)) AS text FROM scored)))""", *v.RECORD_CTES))
def batch_score(spark, sf):
    scored = score_table(v.records_table(spark, sf), v.scorer, v.RECORDS, drop_rule_fields=True)
    return scored.select("row_id", "raw", "label", "rule", "agrees_with_rule")


@check("scored_by_model", with_ctes(f"""
SELECT row_id, raw, {v.LABEL_SQL.format(raw='raw')} AS label, round(margin,6) AS margin, round(1/(1+exp(-margin)),6) AS p1
FROM (SELECT row_id, margin, 'Logistics_Delay: ' || CAST(margin > 0 AS INT) AS raw
 FROM (SELECT row_id, any_value(ln(p+1) - ln(z+1)) + coalesce(sum(w),0) AS margin FROM said CROSS JOIN sizes LEFT JOIN weights USING (line) GROUP BY 1))""",
                                   v.RECORDS_SQL, v.TEXTS_SQL,
                                   "said AS (SELECT row_id, gold, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM texts)",
                                   "sizes AS (SELECT sum(gold) AS p, count(*) - sum(gold) AS z FROM texts)",
                                   """weights AS (SELECT line, ln(y+1) - ln(n-y+1) - (ln(p+2) - ln(z+2)) AS w
  FROM (SELECT line, count(*) AS n, sum(gold) AS y FROM said GROUP BY 1 ORDER BY n DESC, line LIMIT 500) CROSS JOIN sizes)"""))
def scored_by_model(spark, sf):
    texts = v.texts_table(spark, sf)
    prior, weights = fit_line_weights(texts, "gold", most=500)
    scored = score_texts(texts.select("row_id", "text"), line_weight_scorer(spark, prior, weights, v.RECORDS.target), v.RECORDS.target)
    return scored.select("row_id", "raw", "label", "margin", "p1")
