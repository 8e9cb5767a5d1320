import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelwright.functions import checkout as co
from labelwright.operators import classification as cl
from labelwright.operators import models as md
from labelwright.operators import ranking
from labelwright.plans import order_study as st
from labelwright.sources.tables import read_order_tables


@pytest.fixture(scope="module")
def order_folder(tmp_path_factory):
    """Eight small related CSV tables with the awkward cases in them."""
    folder = tmp_path_factory.mktemp("orders")
    files = {
        "orders": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date,extra
a,c1,delivered,2018-01-01 05:59:00,,,2018-01-10 23:00:00,2018-01-10 00:00:00,x
b,c2,delivered,2018-02-25 12:00:00,,,2018-03-05 00:00:00,2018-03-04 00:00:00,x
c,c1,delivered,2018-04-02 18:00:00,,,2018-04-09 01:00:00,2018-04-08 00:00:00,x
d,c3,shipped,2018-04-03 06:00:00,,,,2018-04-20 00:00:00,x
e,c9,delivered,2018-04-03 06:00:00,,,,2018-04-20 00:00:00,x
f,c1,canceled,2018-01-05 00:00:00,,,,2018-01-20 00:00:00,x
z,c1,delivered,2018-09-01 00:00:00,,,2018-09-02 00:00:00,2018-09-10 00:00:00,x
""",
        "customers": "customer_id,customer_zip_code_prefix,customer_state\nc1,100,SP\nc2,200,RJ\nc3,999,MG\n",
        "order_items": "order_id,order_item_id,product_id,seller_id,price,freight_value\na,2,p2,s2,5.0,1.0\na,1,,s1,10.0,2.5\nb,1,p1,s1,7.0,\n",
        "sellers": "seller_id,seller_zip_code_prefix,seller_state\ns1,200,RJ\ns2,100,SP\n",
        "products": "product_id,product_category_name\np1,toys\np2,\n",
        "order_payments": "order_id,payment_sequential,payment_type,payment_installments\na,2,voucher,1\na,1,card,3\n",
        "geolocation": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng\n100,-23.5,-46.6\n100,-23.6,-46.7\n200,-22.91,-43.17\n",
    }
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_order_study_from_files(spark, order_folder):
    t = st.from_order_tables(read_order_tables(spark, order_folder))
    pre = st.before_cutoff(t.orders)
    assert {r.order_id for r in pre.collect()} == set("abcdef")
    notes = {r.status: tuple(r)[1:] for r in st.cohort_notes(pre, st.last_purchase(t.orders)).collect()}
    assert notes == {"shipped": (1, 1, 0, 1), "delivered": (1, 0, 0, 1), "canceled": (1, 0, 1, 1)}
    parts = st.with_split(st.labelled(pre))
    table = {r.order_id: r for r in st.attach_features(parts, t).collect()}
    assert set(table) == set("abc")  # no join fans out
    a, b, c = table["a"], table["b"], table["c"]
    assert (a.late, b.late, c.late) == (0, 1, 1) and (a.split, b.split, c.split) == ("train", "straddling", "test")
    # first seller from line 1, first known product from line 2
    assert (a.seller_state, a.category, a.n_items, a.total_price, a.total_freight) == ("RJ", "unknown", 2, 15.0, 3.5)
    assert (a.payment_type, a.payment_installments) == ("card", 3)
    assert (b.total_freight, b.category, b.payment_type, b.payment_installments) == (0.0, "toys", "unknown", 1)
    assert (c.n_items, c.total_price, c.seller_state, c.distance_km) == (0, 0.0, "unknown", None)
    assert a.distance_km == pytest.approx(360, abs=20) and b.distance_km == pytest.approx(0, abs=1e-9)
    assert (a.purchase_hour_bin, b.purchase_hour_bin, c.purchase_hour_bin) == ("night", "afternoon", "evening")
    assert (a.purchase_weekday, a.purchase_month, a.promised_lead_days) == ("0", "1", 9)
    flight = st.in_flight_cohort(pre)
    assert [(r.order_id, r.late) for r in flight.collect()] == [("d", 1)]
    both = st.with_in_flight(parts.filter("split='test'"), flight)
    assert {(r.order_id, r.late) for r in both.collect()} == {("c", 1), ("d", 1)}


def test_distance_of_two_known_cities(spark):
    km = spark.range(1).select(co.great_circle_km(*map(F.lit, (-23.55, -46.63, -22.91, -43.17))).alias("k")).first()["k"]
    assert 340 < km < 380


def test_null_coordinates_give_null(spark):
    assert spark.range(1).select(co.great_circle_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("k")).first()["k"] is None


@pytest.fixture(scope="module")
def rule_table():
    rng = np.random.default_rng(0)
    n = 600
    status, traffic = rng.choice(["Delayed", "Delivered"], n), rng.choice(["Heavy", "Clear"], n)
    return pd.DataFrame({"id": range(n), "status": status, "traffic": traffic, "noise": rng.random(n),
                         "other": rng.choice(list("abc"), n), "gold": ((status == "Delayed") | (traffic == "Heavy")).astype(int)})


def test_rule_columns_decide_and_their_absence_shows(spark, rule_table):
    df = spark.createDataFrame(rule_table)
    train, test = df.filter("id < 450"), df.filter("id >= 450")
    full, bare = ("status", "traffic", "other"), ("other",)
    specs = [md.ModelSpec("tree", "tree", ("noise",), full), md.ModelSpec("logistic", "logistic", ("noise",), full),
             md.ModelSpec("bare", "boosting", ("noise",), bare, {"maxIter": 5})]
    preds = md.fit_and_score(train, test, specs, "gold", ["gold"])
    out = {r.model: r for r in cl.classification_metrics(preds, "gold", "pred", ["model"]).collect()}
    assert out["tree"].acc == 1.0 and out["logistic"].acc == 1.0 and out["bare"].acc < 0.85
    assert all(r.n == 150 for r in out.values())
    au = {r.model: r.auroc for r in ranking.auroc(preds, "gold", "p1", ["model"]).collect()}
    assert au["logistic"] == 1.0 and au["bare"] < 0.65
    row = preds.filter("model = 'logistic'").first()
    assert row.p1 == pytest.approx(1 / (1 + np.exp(-row.margin)))


def test_unseen_is_all_zero_rare_is_one_category_and_medians_come_from_train(spark):
    train = spark.createDataFrame(
        [("a", 1.0)] * 3 + [("b", 2.0)] * 3 + [("x", 9.0), ("y", None)], "c string, v double").withColumn("y", F.lit(1))
    enc = md.learn_encoding(train, ["v"], ["c"], min_count=3)
    assert {(r.column, r.value, r.slot) for r in enc.levels.collect()} == {("c", "a", 0), ("c", "b", 1), ("c", "x", 2), ("c", "y", 2)}
    assert enc.slots == {"c": 3} and enc.medians["v"] == 2.0
    from pyspark.ml import Pipeline

    test = spark.createDataFrame([("a", None), ("x", 0.0), ("new", 0.0), (None, 0.0)], "c string, v double")
    ready = md.prepare(train, enc, ["v"], ["c"])
    model = Pipeline(stages=md.encoder_stages(enc, ["v"], ["c"], scale=False)).fit(ready)
    rows = [list(r.features.toArray()) for r in model.transform(md.prepare(test, enc, ["v"], ["c"])).collect()]
    assert rows == [[2.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]]


def test_cross_validation_covers_every_row_once_per_repeat(spark, rule_table):
    df = spark.createDataFrame(rule_table.head(120))
    preds = md.cross_validate(df, "gold", ["id"], [md.ModelSpec("tree", "tree", (), ("status", "traffic"))], k=3, repeats=2)
    counted = preds.groupBy("repeat", "id").count()
    assert counted.count() == 240 and counted.filter("count <> 1").count() == 0
    row = md.cv_summary(preds, "gold", "p1").first()
    assert row.folds == 6 and row.acc_min == 1.0 and row.auroc_min == 1.0


def test_time_parts_and_variants(spark):
    from labelwright.vocab import LOGISTICS

    df = spark.createDataFrame([("2024-07-18 12:19:20",), ("bad",)], "Timestamp string")
    rows = [tuple(r)[1:] for r in md.with_time_parts(df).collect()]
    assert rows == [("7", str(dt.date(2024, 7, 18).weekday()), "12"), (None, None, None)]
    cats = {v: md.variant_columns(LOGISTICS, v)[1] for v in md.VARIANTS}
    assert cats["default"] == LOGISTICS.categorical
    assert cats["without_rule_fields_and_reason"] == ("Asset_ID",)
    assert cats["without_rule_fields_plus_time"][-3:] == md.TIME_PARTS


def test_equal_training_rows_are_fitted_once_with_a_weight(spark, monkeypatch):
    """A table of copies gives the models of one of its copies, from as many training rows, in tasks of bounded size."""
    from labelwright.operators import models as md

    one = spark.range(600).selectExpr("id", "cast(id % 7 as double) AS x", "if(id % 11 = 0, NULL, cast(id % 5 as double)) AS z",
                                      "cast(id % 3 AS string) AS c", "cast(id % 7 + id % 3 > 4 OR id % 13 = 0 AS int) AS y")
    many = one.crossJoin(spark.range(20).selectExpr("id AS copy"))
    specs = [md.ModelSpec("l", "logistic", ("x", "z"), ("c",)), md.ModelSpec("t", "tree", ("x", "z"), ("c",))]
    seen, fit = [], md.fit

    def counted(prepared, *args):
        seen.append((prepared.count(), prepared.rdd.getNumPartitions()))
        return fit(prepared, *args)

    monkeypatch.setattr(md, "fit", counted)
    monkeypatch.setattr(md, "FIT_ROWS", 10)
    got = md.fit_and_score(many, one, specs, "y", ["id"]).toPandas().sort_values(["model", "id"])
    cells = one.select("x", "z", "c", "y").distinct().count()
    assert cells < 600 and all(n <= cells and parts >= n / 10 for n, parts in seen)
    # the same rows, each for itself and scaled by Spark's own scaler
    enc = md.learn_encoding(many, ["x", "z"], ["c"])
    assert enc.rows == 12_000 and enc == md.replace(md.learn_encoding(md.distinct_rows(many, ["x", "z", "c"]), ["x", "z"], ["c"], weight=md.COPIES), levels=enc.levels)
    plain = [md.score(fit(md.prepare(many, enc, ["x", "z"], ["c"]), enc, s, "y"), s, md.prepare(one, enc, ["x", "z"], ["c"]), ["id"]) for s in specs]
    want = plain[0].unionByName(plain[1]).toPandas().sort_values(["model", "id"])
    assert (got["pred"].to_numpy() == want["pred"].to_numpy()).all()
    assert abs(got["p1"].to_numpy() - want["p1"].to_numpy()).max() < 1e-4


def test_baseline_models_are_fitted_at_their_defaults(spark, sf, monkeypatch):
    """The query asks for all rounds of boosting, on every variant of the inputs."""
    from checks import evaluation

    asked = {}
    monkeypatch.setattr(md, "fit_and_score", lambda train, test, specs, *args, **options: asked.update(specs=specs, options=options) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        evaluation.baseline_models(spark, sf)
    rounds = [md.estimator(s.kind, "y", 10, **s.params).getMaxIter() for s in asked["specs"] if s.kind == "boosting"]
    assert rounds == [100] * len(md.VARIANTS) and len(asked["specs"]) == 6 and not asked["options"]


def test_each_model_is_fitted_on_the_distinct_rows_of_its_own_inputs(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "cast(id % 5 as double) AS x", "cast(id as double) AS z", "cast(id % 3 AS string) AS c", "cast(id % 5 > 2 AS int) AS y")
    seen, fit = {}, md.fit

    def counted(prepared, enc, spec, *args):
        rows = prepared.agg(F.count("*"), F.sum(md.COPIES)).first()
        seen[spec.name] = (*rows, prepared.rdd.getNumPartitions())
        return fit(prepared, enc, spec, *args)

    monkeypatch.setattr(md, "fit", counted)
    monkeypatch.setattr(md, "FIT_ROWS", 100)
    got = md.fit_and_score(df, df, [md.ModelSpec("few", "tree", ("x",), ("c",)), md.ModelSpec("all", "tree", ("x", "z"), ("c",))], "y", ["id", "y"])
    assert seen == {"few": (15, 400, 1), "all": (400, 400, 4)}
    assert got.count() == 800 and got.filter("pred <> y").count() == 0


def test_cross_validated_models_cover_all_models_and_repeats(spark, sf, monkeypatch):
    """The query leaves no model, fold or repeat of the defaults out, and has the columns of every variant."""
    import inspect

    from checks import evaluation

    asked, plain = {}, inspect.signature(md.cross_validate)
    monkeypatch.setattr(md, "cross_validate", lambda *args, **options: asked.update(plain.bind(*args, **options).arguments) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        evaluation.cv_models(spark, sf)
    assert [s.name for s in asked["specs"]] == [s.name for s in md.baseline_specs(evaluation.v.RECORDS)]
    assert not any(s.params for s in asked["specs"])
    assert asked.get("k", plain.parameters["k"].default) == 5 and asked.get("repeats", plain.parameters["repeats"].default) == 3
    assert {c for s in asked["specs"] for c in (*s.numeric, *s.categorical)} <= set(asked["df"].columns)
