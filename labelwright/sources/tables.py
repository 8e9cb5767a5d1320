"""Typed CSV readers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()


def _raw_csv(spark: SparkSession, path: str, columns: list[str] | None, **options: str) -> DataFrame:
    """All columns as text; only an empty field is null (``None``, ``NA`` and blanks stay text)."""
    reader = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "")
    reader = reader.option("mode", "FAILFAST").option("multiLine", False)
    for key, value in options.items():
        reader = reader.option(key, value)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, _TEXT) for c in columns])).option("enforceSchema", False)
    return reader.csv(path)


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType, target: str, **options: str) -> DataFrame:
    """A labelled table: bad numbers become null, a bad or missing label is an error."""
    raw = _raw_csv(spark, path, schema.fieldNames(), **options)

    def typed(f: T.StructField):
        if f.name == target:
            return F.coalesce(F.col(target).cast("int"), F.raise_error(F.lit(f"null label in column {target}"))).alias(target)
        if isinstance(f.dataType, T.StringType):
            return F.col(f.name)
        return F.col(f.name).try_cast(f.dataType).alias(f.name)

    return raw.select(*[typed(f) for f in schema.fields])


def read_text_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Any CSV with every column kept as text."""
    return _raw_csv(spark, path, None, **options)


#: The seven related order tables: file stem -> (column, type) list.
ORDER_TABLES: dict[str, list[tuple[str, str]]] = {
    "orders": [("order_id", "string"), ("customer_id", "string"), ("order_status", "string"),
               ("order_purchase_timestamp", "timestamp_ntz"), ("order_approved_at", "timestamp_ntz"),
               ("order_delivered_carrier_date", "timestamp_ntz"), ("order_delivered_customer_date", "timestamp_ntz"),
               ("order_estimated_delivery_date", "timestamp_ntz")],
    "customers": [("customer_id", "string"), ("customer_zip_code_prefix", "int"), ("customer_state", "string")],
    "order_items": [("order_id", "string"), ("order_item_id", "int"), ("product_id", "string"),
                    ("seller_id", "string"), ("price", "double"), ("freight_value", "double")],
    "sellers": [("seller_id", "string"), ("seller_zip_code_prefix", "int"), ("seller_state", "string")],
    "products": [("product_id", "string"), ("product_category_name", "string")],
    "order_payments": [("order_id", "string"), ("payment_sequential", "int"), ("payment_type", "string"),
                       ("payment_installments", "int")],
    "geolocation": [("geolocation_zip_code_prefix", "int"), ("geolocation_lat", "double"), ("geolocation_lng", "double")],
}


def read_order_tables(spark: SparkSession, folder: str, pattern: str = "{table}.csv") -> dict[str, DataFrame]:
    """The seven order tables, typed; columns beyond the ones used are ignored.

    ``pattern`` names the files, e.g. ``"shop_{table}_dataset.csv"``.
    """
    out = {}
    for table, columns in ORDER_TABLES.items():
        raw = read_text_csv(spark, os.path.join(folder, pattern.format(table=table)))
        out[table] = raw.select(*[F.col(c).cast(t).alias(c) for c, t in columns])
    return out
