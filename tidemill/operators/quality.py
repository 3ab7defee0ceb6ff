"""Validity rules per dataset, null-safe splits, record hashes and keep-last normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(column: str) -> Column:
    return F.trim(column) != ""


def rules() -> dict[str, Column]:
    """What makes a row of each historical dataset valid. Null counts as failing once it is wrapped by split()."""
    price = F.col("unit_price") >= 0
    return {
        "customers": filled("customer_id"),
        "products": filled("product_id") & price,
        "orders": filled("order_id") & F.col("order_timestamp").isNotNull() & F.col("is_cancelled").isin("true", "false"),
        "order_items": filled("order_id") & filled("product_id") & (F.col("quantity") > 0) & price,
    }


def split(frame: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows. A rule that is null rejects, so every row is on exactly one side."""
    sure = F.coalesce(rule, F.lit(False))
    return frame.where(sure), frame.where(~sure)


def quarantine(frame: DataFrame, dataset: str, message: str) -> DataFrame:
    """Rejected rows as records of one shape, whatever their table."""
    return frame.select(
        F.lit(dataset).alias("dataset_name"),
        record_hash(frame, frame.columns).alias("_record_hash"),
        F.lit("BUSINESS_RULE").alias("error_type"),
        F.lit(message).alias("error_message"),
        F.to_json(F.struct(*frame.columns)).alias("raw_record_json"),
    )


def record_hash(frame: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the values as texts; null and missing alike, fields are set apart by a unit separator."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def keep_last(frame: DataFrame, key: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """The last row per key in source order; rows without a key are left out."""
    rest = [c for c in frame.columns if c not in key and c not in sequence]
    known = frame
    for k in key:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*key).agg(F.max(F.struct(*sequence, *rest)).alias("r")).select(*key, "r.*").select(*frame.columns)


def normalize_invoices(lines: DataFrame, sequence: str) -> dict[str, DataFrame]:
    """Invoice lines into customers, products, orders and order items, the last row of a key winning.

    Lines without invoice or stock code are left out. ``sequence`` gives source order. The money stays exact.
    """
    t = {c: F.trim(c) for c in ("InvoiceNo", "StockCode", "CustomerID", "Description", "Country")}
    clean = lines.withColumns(t).where((F.col("InvoiceNo") != "") & (F.col("StockCode") != ""))
    customer = F.when(F.col("CustomerID") != "", F.col("CustomerID"))
    when = F.coalesce(F.col("InvoiceDate").try_cast("timestamp_ntz"), F.try_to_timestamp("InvoiceDate", F.lit("M/d/yyyy H:mm")).cast("timestamp_ntz"))
    money = F.col("UnitPrice").try_cast("decimal(12,2)")
    seq = F.col(sequence).alias("__seq")
    customers = keep_last(clean.select(customer.alias("customer_id"), F.col("Country").alias("country"), seq), ["customer_id"], ["__seq"])
    products = keep_last(clean.select(F.col("StockCode").alias("product_id"), F.col("Description").alias("description"), money.alias("unit_price"), seq), ["product_id"], ["__seq"])
    orders = keep_last(
        clean.select(
            F.col("InvoiceNo").alias("order_id"), customer.alias("customer_id"), when.alias("order_timestamp"), F.col("Country").alias("country"),
            F.col("InvoiceNo").startswith("C").cast("string").alias("is_cancelled"), seq,
        ),
        ["order_id"],
        ["__seq"],
    )
    items = clean.select(F.col("InvoiceNo").alias("order_id"), F.col("StockCode").alias("product_id"), F.col("Quantity").try_cast("int").alias("quantity"), money.alias("unit_price"))
    made = {"customers": customers, "products": products, "orders": orders}
    return {n: f.drop("__seq") for n, f in made.items()} | {"order_items": items}
