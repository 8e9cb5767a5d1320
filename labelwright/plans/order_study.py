"""The prospective study: from raw order tables to a checkout-time table with a late label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checkout as co
from ..functions.intervals import ratio
from ..operators.ordered import grouped_median

CENSOR_DAYS = 60
# --- Fixed values: statuses and feature names ----------------------------------------------
DELIVERED = "delivered"
IN_FLIGHT = ("shipped", "invoiced", "processing", "approved", "created")
NOT_A_DELIVERY = ("canceled", "unavailable")
TRAIN_END = "2018-03-01"
NUMERIC = ("promised_lead_days", "n_items", "total_price", "total_freight", "payment_installments", "distance_km")
CATEGORICAL = ("purchase_month", "purchase_weekday", "purchase_hour_bin", "customer_state", "seller_state",
               "category", "payment_type")
# --- end of fixed values -------------------------------------------------------------------


@dataclass(frozen=True)
class StudyTables:
    """The related inputs under the study's own column names.

    orders: order_id, customer_id, status, purchased, promised, delivered;
    customers: customer_id, customer_state, customer_zip; items: order_id, item_no, seller_id,
    product_id, price, freight; sellers: seller_id, seller_state, seller_zip;
    products: product_id, category; payments: order_id, pay_no, payment_type, instalments;
    places: zip, lat, lng.
    """

    orders: DataFrame
    customers: DataFrame
    items: DataFrame
    sellers: DataFrame
    products: DataFrame
    payments: DataFrame
    places: DataFrame


def from_order_tables(t: dict[str, DataFrame]) -> StudyTables:
    """The study's names for tables read by ``read_order_tables``."""
    def pick(table: str, **names: str) -> DataFrame:
        return t[table].select(*[F.col(old).alias(new) for new, old in names.items()])

    return StudyTables(
        pick("orders", order_id="order_id", customer_id="customer_id", status="order_status",
             purchased="order_purchase_timestamp", promised="order_estimated_delivery_date",
             delivered="order_delivered_customer_date"),
        pick("customers", customer_id="customer_id", customer_state="customer_state",
             customer_zip="customer_zip_code_prefix"),
        pick("order_items", order_id="order_id", item_no="order_item_id", seller_id="seller_id",
             product_id="product_id", price="price", freight="freight_value"),
        pick("sellers", seller_id="seller_id", seller_state="seller_state", seller_zip="seller_zip_code_prefix"),
        pick("products", product_id="product_id", category="product_category_name"),
        pick("order_payments", order_id="order_id", pay_no="payment_sequential", payment_type="payment_type",
             instalments="payment_installments"),
        pick("geolocation", zip="geolocation_zip_code_prefix", lat="geolocation_lat", lng="geolocation_lng"))


# ------------------------------------------------------------------------------ rollups
def first_known(value: str, order: Sequence[str]) -> Column:
    """The first non-null value by ``order`` (a total order), each column on its own."""
    place = F.struct(*[F.col(c) for c in order])
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), place))


def first_item(items: DataFrame, order: Sequence[str] = ("item_no",), key: str = "order_id",
               values: Sequence[str] = ("seller_id", "product_id")) -> DataFrame:
    return items.groupBy(key).agg(*[first_known(v, order).alias(v) for v in values])


def _totals() -> list[Column]:
    return [F.count("item_no").alias("n_items"), F.coalesce(F.sum("price"), F.lit(0.0)).alias("total_price"),
            F.coalesce(F.sum("freight"), F.lit(0.0)).alias("total_freight")]


def order_totals(items: DataFrame, key: str = "order_id") -> DataFrame:
    """Item count and sums per order; an order whose values are all null sums to 0."""
    return items.groupBy(key).agg(*_totals())


def item_rollup(items: DataFrame, order: Sequence[str] = ("item_no",), key: str = "order_id") -> DataFrame:
    """First item and totals together: one shuffle of the items."""
    return items.groupBy(key).agg(*[first_known(v, order).alias(v) for v in ("seller_id", "product_id")], *_totals())


def payment_rollup(payments: DataFrame, order: Sequence[str] = ("pay_no",), key: str = "order_id") -> DataFrame:
    """First payment type by sequence, and the most instalments."""
    return payments.groupBy(key).agg(
        first_known("payment_type", order).alias("payment_type"), F.max("instalments").alias("payment_installments"))


def zip_centroid(places: DataFrame, **limits: int) -> DataFrame:
    """Median latitude and longitude per zip, each on its own."""
    return grouped_median(places, ["zip"], ["lat", "lng"], **limits)


# ------------------------------------------------------------------------------ features
def calendar_features(df: DataFrame, ts: str = "purchased") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({"purchase_month": co.month_text(t), "purchase_weekday": co.weekday_text(t),
                           "purchase_hour_bin": co.hour_bin(t)})


def fill_defaults(df: DataFrame) -> DataFrame:
    """Defaults for what an order may lack; rows without customer state or lead time are dropped."""
    filled = df.na.fill("unknown", ["category", "seller_state", "payment_type"])
    filled = filled.na.fill({"payment_installments": 1, "n_items": 0, "total_price": 0.0, "total_freight": 0.0})
    return filled.na.drop(subset=["customer_state", "promised_lead_days"])


def with_distance(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """Join the zip centroids in both roles and add ``distance_km``."""
    def role(name: str) -> DataFrame:
        return centroids.select(F.col("zip").alias(f"{name}_zip"), F.col("lat").alias(f"_{name}_lat"),
                                F.col("lng").alias(f"_{name}_lng"))

    placed = df.join(role("customer"), "customer_zip", "left").join(role("seller"), "seller_zip", "left")
    km = co.great_circle_km(*[F.col(f"_{r}_{c}") for r in ("customer", "seller") for c in ("lat", "lng")])
    return placed.withColumn("distance_km", km).drop(*[f"_{r}_{c}" for r in ("customer", "seller") for c in ("lat", "lng")])


def attach_features(orders: DataFrame, t: StudyTables, item_order: Sequence[str] = ("item_no",),
                    pay_order: Sequence[str] = ("pay_no",)) -> DataFrame:
    """Checkout-time features of every order.

    Items and payments are rolled up before they meet the orders, so no join fans out; which
    side is broadcast is left to the optimizer, which knows the sizes.
    """
    wide = (orders
            .join(t.customers.select("customer_id", "customer_state", "customer_zip"), "customer_id", "left")
            .join(item_rollup(t.items, item_order), "order_id", "left")
            .join(payment_rollup(t.payments, pay_order), "order_id", "left")
            .join(t.sellers.select("seller_id", "seller_state", "seller_zip"), "seller_id", "left")
            .join(t.products.select("product_id", "category"), "product_id", "left"))
    placed = calendar_features(with_distance(wide, zip_centroid(t.places)))
    return fill_defaults(placed.withColumn("promised_lead_days", co.lead_days(F.col("promised"), F.col("purchased"))))


# ------------------------------------------------------------------------------- cohorts
def last_purchase(orders: DataFrame) -> Column:
    return orders.agg(F.max("purchased")).scalar()


def censor_cutoff(orders: DataFrame, days: int = CENSOR_DAYS) -> DataFrame:
    """One row: last purchase, cut-off, and how many orders lie before it."""
    last = orders.agg(F.max("purchased").alias("last_purchase"))
    cut = F.col("last_purchase") - F.expr(f"INTERVAL {days} DAYS")
    kept = before_cutoff(orders, days).agg(F.count("*")).scalar()
    return last.select("last_purchase", cut.alias("cutoff"), kept.alias("orders_before_cutoff"))


def before_cutoff(orders: DataFrame, days: int = CENSOR_DAYS) -> DataFrame:
    """Orders old enough that their outcome is known."""
    return orders.filter(F.col("purchased") <= last_purchase(orders) - F.expr(f"INTERVAL {days} DAYS"))


def is_delivered(status: str = DELIVERED) -> Column:
    return F.coalesce((F.col("status") == status) & F.col("delivered").isNotNull(), F.lit(False))


def undelivered(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    """The complement of the delivered orders, nulls included."""
    return orders.filter(~is_delivered(status))


def cohort_notes(pre: DataFrame, last: Column, delivered: str = DELIVERED, in_flight: Sequence[str] = IN_FLIGHT,
                 not_delivery: Sequence[str] = NOT_A_DELIVERY) -> DataFrame:
    """Undelivered orders by status: rows, in flight, not a delivery, past their promise."""
    status = F.col("status")
    past = F.col("promised") < last
    return undelivered(pre, delivered).groupBy("status").agg(
        F.count("*").alias("orders"), F.count_if(status.isin(*in_flight)).alias("in_flight"),
        F.count_if(status.isin(*not_delivery)).alias("not_a_delivery"), F.count_if(past).alias("past_promise"))


def labelled(orders: DataFrame, delivered: str = DELIVERED) -> DataFrame:
    """Delivered orders with ``late``."""
    return orders.filter(is_delivered(delivered)).withColumn("late", co.late(F.col("delivered"), F.col("promised")))


def in_flight_cohort(orders: DataFrame, delivered: str = DELIVERED, in_flight: Sequence[str] = IN_FLIGHT) -> DataFrame:
    """Orders still on their way when the data ends, all counted late (sensitivity analysis)."""
    return undelivered(orders, delivered).filter(F.col("status").isin(*in_flight)).withColumn("late", F.lit(1))


def with_split(df: DataFrame, train_end: str = TRAIN_END) -> DataFrame:
    """``train``: outcome known before the date; ``test``: bought on or after it; else ``straddling``."""
    end = F.lit(train_end).cast("timestamp_ntz")
    bought = F.col("purchased") < end
    return df.withColumn("split", F.when(F.col("purchased") >= end, "test").when(
        bought & F.coalesce(F.col("delivered") < end, F.lit(False)), "train").when(bought, "straddling"))


def split_rates(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.sum("late").cast("bigint").alias("late"),
                                   ratio(F.sum("late"), F.count("*")).alias("late_rate"))


def by_month(df: DataFrame, ts: str = "purchased", label: str = "late", score: str | None = None,
             by: Sequence[str] = ()) -> DataFrame:
    """Rows, label rate and optional mean score per calendar month, in order."""
    aggs = [F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("late_rate")]
    if score:
        aggs.append(F.avg(score).alias("mean_predicted"))
    return df.groupBy(*by, F.date_format(ts, "yyyy-MM").alias("month")).agg(*aggs).orderBy(*by, "month")


def with_in_flight(test: DataFrame, flight: DataFrame, train_end: str = TRAIN_END) -> DataFrame:
    """Scored test rows plus the scored in-flight rows bought in the test window (late = 1)."""
    window = flight.filter(F.col("purchased") >= F.lit(train_end).cast("timestamp_ntz"))
    columns = [c for c in test.columns if c in window.columns and c != "late"]
    return test.select(*columns, "late").unionByName(window.select(*columns, F.lit(1).alias("late")))
