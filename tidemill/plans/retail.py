"""Queries of the retail engine over the test tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import contract
from tidemill.functions.identifiers import hash_bucket, uuid_bytes
from tidemill.operators import checks, dedup, history, quality
from tidemill.plans import contract_sql, gold, kpi
from tidemill.plans.problems_sql import _uuid
from tidemill.session import work_path
from tidemill.sources.tables import load
from tidemill.sources.versioned import VersionedTable

#: Reports that depend on the clock take it as a parameter.
AS_OF = "2015-04-10 00:00:00"
#: The second of two deliveries begins here.
SECOND = "2015-02-15 00:00:00"

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _stg(spark, sf):
    return gold.stg_events(load(spark, sf, "silver_events"))


def _orders(spark, sf):
    return gold.current_orders(load(spark, sf, "silver_orders"))


def _items(spark, sf):
    return gold.distinct_items(load(spark, sf, "order_items"))


def _products(spark, sf):
    return gold.current_products(load(spark, sf, "products"))


def _facts(spark, sf):
    return gold.fact_orders(_items(spark, sf), _orders(spark, sf))


def _health(spark, sf):
    return gold.inventory_health(_stg(spark, sf), F.lit(AS_OF).cast("timestamp_ntz"))


# The base tables in SQL: one row per message, order, product and item.
_STG_COLUMNS = "event_timestamp, event_type, customer_id, product_id, order_id, country, quantity, price"
STG = f"""stg AS (SELECT k AS event_id, ingestion_timestamp, {_STG_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY ingestion_timestamp, {", ".join(c.strip() + " NULLS FIRST" for c in _STG_COLUMNS.split(","))}) AS n
  FROM (SELECT * EXCLUDE (event_id), {_uuid('event_id')} AS k FROM silver_events)) WHERE n = 1 AND k IS NOT NULL)"""
BUY = STG + ", buy AS (SELECT *, CAST(CAST(quantity AS BIGINT) * price AS DECIMAL(18,2)) AS line_total FROM stg WHERE event_type = 'purchase')"
ORD = """ord AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ingestion_timestamp DESC, customer_id DESC NULLS LAST,
  order_timestamp DESC NULLS LAST, country DESC NULLS LAST, is_cancelled DESC NULLS LAST, pipeline_run_id DESC NULLS LAST) AS n FROM silver_orders WHERE order_id IS NOT NULL) WHERE n = 1)"""
ITM = """itm AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY _record_hash ORDER BY ingestion_timestamp, order_id NULLS FIRST, product_id NULLS FIRST,
  quantity NULLS FIRST, unit_price NULLS FIRST) AS n FROM order_items) WHERE n = 1)"""
PRD = """prd AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ingestion_timestamp DESC, description DESC NULLS LAST,
  unit_price DESC NULLS LAST) AS n FROM products WHERE product_id IS NOT NULL) WHERE n = 1)"""
FOI = f"""{ORD}, {ITM}, foi AS (SELECT i._record_hash AS order_item_id, i.order_id, o.customer_id, i.product_id, i.quantity, i.unit_price,
  CAST(CAST(i.quantity AS BIGINT) * i.unit_price AS DECIMAL(18,2)) AS line_total, o.country, o.order_timestamp AS event_timestamp,
  greatest(i.ingestion_timestamp, o.ingestion_timestamp) AS ingestion_timestamp FROM itm i JOIN ord o ON i.order_id = o.order_id)"""
FO = f"""{FOI}, fo AS (SELECT o.order_id, o.customer_id, o.order_timestamp, o.country, CAST(sum(f.quantity) AS BIGINT) AS units, CAST(sum(f.line_total) AS DECIMAL(18,2)) AS order_total,
  max(f.ingestion_timestamp) AS ingestion_timestamp FROM ord o JOIN foi f ON o.order_id = f.order_id GROUP BY ALL)"""
FOE = f"""{BUY}, foe AS (SELECT order_id, max(nullif(customer_id, '')) AS customer_id, min(event_timestamp) AS order_timestamp, max(nullif(country, '')) AS country, CAST(sum(quantity) AS BIGINT) AS units,
  CAST(sum(line_total) AS DECIMAL(18,2)) AS order_total, max(ingestion_timestamp) AS ingestion_timestamp FROM buy GROUP BY order_id)"""
_DAILY = """SELECT CAST(order_timestamp AS DATE) AS order_date, count(*) AS orders, CAST(sum(units) AS BIGINT) AS units, CAST(sum(order_total) AS DECIMAL(18,2)) AS revenue,
  CAST(sum(order_total) AS DOUBLE) / count(*) AS average_order_value, max(ingestion_timestamp) AS ingestion_timestamp FROM {t} GROUP BY 1"""
DIMC = """dimc AS (SELECT c.customer_id, c.country, coalesce(min(o.order_timestamp), c.ingestion_timestamp) AS first_seen_at, coalesce(max(o.order_timestamp), c.ingestion_timestamp) AS last_seen_at
  FROM customers c LEFT JOIN ord o ON o.customer_id = c.customer_id GROUP BY c.customer_id, c.country, c.ingestion_timestamp)"""
C360 = f"""{FO}, {DIMC}, c360 AS (SELECT d.*, count(o.order_id) AS lifetime_orders, CAST(coalesce(sum(o.order_total), 0) AS DECIMAL(18,2)) AS lifetime_value
  FROM dimc d LEFT JOIN fo o ON o.customer_id = d.customer_id GROUP BY d.customer_id, d.country, d.first_seen_at, d.last_seen_at)"""
INV = f"""{STG}, inv0 AS (SELECT product_id, CAST(sum(CASE WHEN event_type = 'inventory_update' THEN quantity ELSE 0 END) AS BIGINT) AS units_updated,
  max(CASE WHEN event_type = 'inventory_update' THEN event_timestamp END) AS last_inventory_update FROM stg WHERE product_id IS NOT NULL GROUP BY product_id),
inv AS (SELECT *, date_sub('minute', last_inventory_update, TIMESTAMP '{AS_OF}') AS freshness_minutes,
  CASE WHEN last_inventory_update IS NULL THEN 'unknown' WHEN date_sub('minute', last_inventory_update, TIMESTAMP '{AS_OF}') > 60 THEN 'stale' ELSE 'healthy' END AS inventory_status FROM inv0)"""

# staging and facts ---------------------------------------------------------------------------------------------------


@query(f"WITH {STG} SELECT * FROM stg")
def stg_events(spark: SparkSession, sf: str) -> DataFrame:
    return _stg(spark, sf)


@query(f"WITH {BUY} SELECT event_id, order_id, quantity, price, line_total FROM buy")
def purchases_line_total(spark, sf):
    return gold.purchases(_stg(spark, sf)).select("event_id", "order_id", "quantity", "price", "line_total")


@query(
    f"WITH {BUY} SELECT event_id AS order_item_id, order_id, customer_id, product_id, quantity, price AS unit_price, line_total, country, event_timestamp, ingestion_timestamp FROM buy"
)
def fact_order_items_events(spark, sf):
    return gold.fact_order_items_from_events(_stg(spark, sf))


@query(f"WITH {FOI} SELECT * FROM foi")
def fact_order_items(spark, sf):
    return gold.fact_order_items(_items(spark, sf), _orders(spark, sf))


@query(f"WITH {FOE} SELECT * FROM foe")
def fact_orders_events(spark, sf):
    return gold.fact_orders_from_events(_stg(spark, sf))


@query(f"WITH {FO} SELECT * FROM fo")
def fact_orders_joined(spark, sf):
    return _facts(spark, sf)


@query(f"WITH {FO} {_DAILY.format(t='fo')}")
def daily_sales(spark, sf):
    return gold.daily_sales(_facts(spark, sf))


@query(f"WITH {FOE} {_DAILY.format(t='foe')}")
def daily_sales_events(spark, sf):
    return gold.daily_sales(gold.fact_orders_from_events(_stg(spark, sf)))


@query(
    f"WITH {STG} SELECT customer_id, max(country) AS country, min(event_timestamp) AS first_seen_at, max(event_timestamp) AS last_seen_at FROM stg WHERE customer_id IS NOT NULL GROUP BY customer_id"
)
def dim_customer_events(spark, sf):
    return gold.dim_customer_from_events(_stg(spark, sf))


@query(f"WITH {ORD}, {DIMC} SELECT * FROM dimc")
def dim_customer_orders(spark, sf):
    return gold.dim_customer(load(spark, sf, "customers"), _orders(spark, sf))


@query(
    f"WITH {STG} SELECT product_id, min(event_timestamp) AS first_seen_at, max(event_timestamp) AS last_seen_at, CAST(sum(price) AS DOUBLE) / nullif(count(price), 0) AS average_price "
    "FROM stg WHERE product_id IS NOT NULL GROUP BY product_id"
)
def dim_product_events(spark, sf):
    return gold.dim_product_from_events(_stg(spark, sf))


@query(
    f"WITH {ORD}, {ITM}, {PRD} SELECT p.product_id, coalesce(min(o.order_timestamp), p.ingestion_timestamp) AS first_seen_at, coalesce(max(o.order_timestamp), p.ingestion_timestamp) AS last_seen_at, "
    "CAST(p.unit_price AS DECIMAL(12,2)) AS average_price FROM prd p LEFT JOIN itm i ON i.product_id = p.product_id LEFT JOIN ord o ON o.order_id = i.order_id "
    "GROUP BY p.product_id, p.unit_price, p.ingestion_timestamp"
)
def dim_product_catalog(spark, sf):
    return gold.dim_product(_products(spark, sf), _items(spark, sf), _orders(spark, sf))


@query(
    f"WITH {FO}, days AS (SELECT CAST(unnest(generate_series(min(CAST(order_timestamp AS DATE)), max(CAST(order_timestamp AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d FROM fo) "
    "SELECT d AS date_key, CAST(year(d) AS INT) AS calendar_year, CAST(quarter(d) AS INT) AS calendar_quarter, CAST(month(d) AS INT) AS calendar_month, CAST(day(d) AS INT) AS calendar_day, dayname(d) AS day_name FROM days"
)
def dim_date(spark, sf):
    return gold.dim_date(_facts(spark, sf))


def _c360(spark, sf):
    return gold.customer_360(gold.dim_customer(load(spark, sf, "customers"), _orders(spark, sf)), _facts(spark, sf))


@query(f"WITH {C360} SELECT * FROM c360")
def customer_360(spark, sf):
    return _c360(spark, sf)


@query(f"WITH {INV} SELECT * FROM inv")
def inventory_health(spark, sf):
    return _health(spark, sf)


# reports -------------------------------------------------------------------------------------------------------------


@query(
    f"WITH {FO} SELECT count(*) AS orders, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, CAST(coalesce(sum(order_total), 0) AS DECIMAL(18,2)) AS revenue, "
    "coalesce(CAST(sum(order_total) AS DOUBLE) / count(*), 0.0) AS average_order_value, min(CAST(order_timestamp AS DATE)) AS window_start, max(CAST(order_timestamp AS DATE)) AS window_end, "
    "max(ingestion_timestamp) AS updated_at FROM fo"
)
def kpi_summary(spark, sf):
    return kpi.summary(_facts(spark, sf))


@query(
    f"WITH {STG}, c AS (SELECT count(*) FILTER (WHERE event_type = 'product_view') AS product_views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM stg) "
    "SELECT *, CAST(CAST(round(purchases::DOUBLE / nullif(product_views, 0), 4) AS DECIMAL(20,4)) AS DECIMAL(20,4)) AS ratio FROM c"
)
def view_purchase_ratio(spark, sf):
    return kpi.conversion(_stg(spark, sf))


@query(f"WITH {FO} SELECT country, count(*) AS orders, CAST(sum(order_total) AS DECIMAL(18,2)) AS revenue FROM fo GROUP BY country ORDER BY revenue DESC, country NULLS FIRST LIMIT 12")
def country_sales_top12(spark, sf):
    return kpi.by_country(_facts(spark, sf))


@query(
    f"WITH {FOI} SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(line_total) AS DECIMAL(18,2)) AS revenue FROM foi GROUP BY product_id ORDER BY revenue DESC, product_id NULLS FIRST LIMIT 10"
)
def top_products(spark, sf):
    return kpi.by_product(gold.fact_order_items(_items(spark, sf), _orders(spark, sf)))


@query(
    f"WITH {FOI} SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(quantity * CAST(unit_price * 100 AS BIGINT)) AS BIGINT) AS revenue_cents FROM foi GROUP BY product_id ORDER BY revenue_cents DESC, product_id NULLS FIRST LIMIT 10"
)
def top_products_cents(spark, sf):
    return kpi.by_product_cents(gold.fact_order_items(_items(spark, sf), _orders(spark, sf)))


@query(f"WITH {C360} SELECT customer_id, country, lifetime_orders AS orders, lifetime_value FROM c360 ORDER BY lifetime_value DESC, customer_id LIMIT 10")
def top_customers(spark, sf):
    return kpi.by_customer(_c360(spark, sf))


@query(f"WITH {INV} SELECT count(*) FILTER (WHERE inventory_status = 'healthy') AS healthy, count(*) FILTER (WHERE inventory_status = 'stale') AS stale, count(*) FILTER (WHERE inventory_status = 'unknown') AS unknown FROM inv")
def inventory_summary(spark, sf):
    return kpi.inventory_counts(_health(spark, sf))


@query(f"WITH {INV} SELECT * FROM inv ORDER BY CASE inventory_status WHEN 'healthy' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END, last_inventory_update DESC NULLS LAST, product_id LIMIT 10")
def inventory_top(spark, sf):
    return kpi.inventory_top(_health(spark, sf))


@query("SELECT date_trunc('minute', ingestion_timestamp) AS minute, count(*) AS events FROM silver_events GROUP BY 1")
def events_per_minute(spark, sf):
    return kpi.per_minute(load(spark, sf, "silver_events"))


@query("SELECT coalesce(scenario, 'unknown') AS scenario, count(*) AS records FROM bronze_events GROUP BY 1")
def scenario_counts(spark, sf):
    return load(spark, sf, "bronze_events").groupBy(F.coalesce("scenario", F.lit("unknown")).alias("scenario")).agg(F.count(F.lit(1)).alias("records"))


@query(
    "WITH l AS (SELECT epoch_ms(ingestion_timestamp) - epoch_ms(kafka_timestamp) AS ms FROM bronze_events) SELECT CAST(sum(ms) AS DOUBLE) / nullif(count(ms), 0) AS average_latency_ms, max(ms) AS maximum_latency_ms FROM l"
)
def ingest_latency(spark, sf):
    return kpi.latency(load(spark, sf, "bronze_events"), "kafka_timestamp", "ingestion_timestamp")


@query(f"SELECT count(*) AS rows_, count(DISTINCT {_uuid('event_id')}) AS events, count(DISTINCT customer_id) AS customers, count(DISTINCT order_id) AS orders FROM silver_events")
def distinct_keys(spark, sf):
    e = load(spark, sf, "silver_events")
    return e.agg(
        F.count(F.lit(1)).alias("rows_"), F.countDistinct(uuid_bytes(F.col("event_id"))).alias("events"), F.countDistinct("customer_id").alias("customers"), F.countDistinct("order_id").alias("orders")
    )


@query(
    f"""WITH {FO} SELECT (SELECT count(*) FROM itm) AS items, (SELECT count(*) FROM foi) AS fact_items, (SELECT count(*) FROM ord) AS orders, (SELECT count(*) FROM fo) AS fact_orders,
  (SELECT CAST(coalesce(sum(line_total), 0) AS DECIMAL(18,2)) FROM foi) AS item_revenue, (SELECT CAST(coalesce(sum(order_total), 0) AS DECIMAL(18,2)) FROM fo) AS order_revenue,
  (SELECT CAST(coalesce(sum(revenue), 0) AS DECIMAL(18,2)) FROM ({_DAILY.format(t='fo')})) AS daily_revenue"""
)
def reconciliation_row(spark, sf):
    items, orders = _items(spark, sf), _orders(spark, sf)
    fi, fo = gold.fact_order_items(items, orders), gold.fact_orders(items, orders)
    n = F.count(F.lit(1))
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(gold.TOTAL)
    return kpi.reconcile(
        {
            "items": (items, n), "fact_items": (fi, n), "orders": (orders, n), "fact_orders": (fo, n),
            "item_revenue": (fi, money("line_total")), "order_revenue": (fo, money("order_total")), "daily_revenue": (gold.daily_sales(fo), money("revenue")),
        }
    )


@query("SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units, max(event_timestamp) AS last_update FROM silver_events WHERE event_type = 'inventory_update' GROUP BY product_id")
def inventory_by_product(spark, sf):
    e = load(spark, sf, "silver_events").where(F.col("event_type") == "inventory_update")
    return e.groupBy("product_id").agg(F.sum(F.col("quantity").cast("long")).alias("units"), F.max("event_timestamp").alias("last_update"))


# joins and tests -----------------------------------------------------------------------------------------------------


@query(f"WITH {ORD}, {ITM} SELECT i._record_hash, i.order_id FROM itm i WHERE i.order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ord o WHERE o.order_id = i.order_id)")
def orphan_items(spark, sf):
    return kpi.relationship(_items(spark, sf), "order_id", _orders(spark, sf), "order_id").select("_record_hash", "order_id")


@query(f"WITH {ORD}, {ITM} SELECT o.order_id FROM ord o WHERE NOT EXISTS (SELECT 1 FROM itm i WHERE o.order_id = i.order_id)")
def orders_without_items(spark, sf):
    return _orders(spark, sf).join(_items(spark, sf).select("order_id"), "order_id", "left_anti").select("order_id")


@query(
    f"""WITH {ORD}, {ITM}, {PRD} SELECT 'order_items.order_id' AS reference, count(*) AS failures FROM itm WHERE order_id IS NOT NULL AND order_id NOT IN (SELECT order_id FROM ord)
UNION ALL SELECT 'order_items.product_id', count(*) FROM itm WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM prd)
UNION ALL SELECT 'orders.customer_id', count(*) FROM ord WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM customers)"""
)
def referential_checks(spark, sf):
    items, orders = _items(spark, sf), _orders(spark, sf)
    checks = {
        "order_items.order_id": kpi.relationship(items, "order_id", orders, "order_id"),
        "order_items.product_id": kpi.relationship(items, "product_id", _products(spark, sf), "product_id"),
        "orders.customer_id": kpi.relationship(orders, "customer_id", load(spark, sf, "customers"), "customer_id"),
    }
    out = None
    for name, failing in checks.items():
        part = failing.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("reference"), "failures")
        out = part if out is None else out.unionAll(part)
    return out


@query(
    """SELECT 'not_null:customer_id' AS test, count(*) AS failures FROM silver_orders WHERE customer_id IS NULL UNION ALL SELECT 'not_null:country', count(*) FROM silver_orders WHERE country IS NULL
UNION ALL SELECT 'accepted:is_cancelled', count(*) FROM silver_orders WHERE is_cancelled NOT IN ('true', 'false')
UNION ALL SELECT 'unique:order_id', count(*) FROM (SELECT order_id FROM silver_orders WHERE order_id IS NOT NULL GROUP BY order_id HAVING count(*) > 1)"""
)
def uniqueness_null_checks(spark, sf):
    return kpi.column_tests(load(spark, sf, "silver_orders"), not_null=("customer_id", "country"), unique=("order_id",), accepted={"is_cancelled": ("true", "false")})


@query(
    f"""WITH {ORD}, {ITM}, {PRD}, c AS (SELECT (SELECT count(*) FROM ord) AS orders, (SELECT count(*) FROM itm) AS items, (SELECT count(*) FROM prd) AS products,
  (SELECT count(*) FROM itm WHERE order_id IS NOT NULL AND order_id NOT IN (SELECT order_id FROM ord)) AS orphans) SELECT *, orders > 0 AND items > 0 AND products > 0 AND orphans = 0 AS ready FROM c"""
)
def readiness(spark, sf):
    orders, items = _orders(spark, sf), _items(spark, sf)
    return kpi.readiness({"orders": orders, "items": items, "products": _products(spark, sf)}, kpi.relationship(items, "order_id", orders, "order_id"))


_VALID_ITEM = "trim(order_id) != '' AND trim(product_id) != '' AND quantity > 0 AND unit_price >= 0"


@query(f"SELECT * FROM order_items WHERE coalesce({_VALID_ITEM}, false)")
def quality_split_valid(spark, sf):
    return quality.split(load(spark, sf, "order_items"), quality.rules()["order_items"])[0]


@query(f"SELECT * FROM order_items WHERE NOT coalesce({_VALID_ITEM}, false)")
def quality_split_rejected(spark, sf):
    return quality.split(load(spark, sf, "order_items"), quality.rules()["order_items"])[1]


@query(
    f"""SELECT 'order_items' AS dataset_name, 'BUSINESS_RULE' AS error_type, _record_hash AS key FROM order_items WHERE NOT coalesce({_VALID_ITEM}, false)
UNION ALL SELECT 'products', 'BUSINESS_RULE', product_id FROM products WHERE NOT coalesce(trim(product_id) != '' AND unit_price >= 0, false)"""
)
def quarantine_union(spark, sf):
    parts = []
    for table, rule, key in (("order_items", "order_items", "_record_hash"), ("products", "products", "product_id")):
        bad = quality.split(load(spark, sf, table), quality.rules()[rule])[1]
        parts.append(quality.quarantine(bad, table, "row breaks the rules of its dataset").select("dataset_name", "error_type", F.get_json_object("raw_record_json", f"$.{key}").alias("key")))
    return parts[0].unionByName(parts[1])


@query("SELECT product_id, sha256(concat_ws(chr(31), coalesce(product_id, ''), coalesce(description, ''), coalesce(CAST(unit_price AS VARCHAR), ''))) AS record_hash FROM products")
def record_hash(spark, sf):
    p = load(spark, sf, "products")
    return p.select("product_id", quality.record_hash(p, ("product_id", "description", "unit_price")).alias("record_hash"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) * CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(0.125 AS DECIMAL(4,3)) AS DECIMAL(12,2)) AS DECIMAL(18,2)) AS total FROM lineitem")
def half_up_line_totals(spark, sf):
    price = (F.col("l_extendedprice").cast("decimal(14,2)") * F.lit("0.125").cast("decimal(4,3)")).cast("decimal(12,2)")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", gold.line_total(F.col("l_quantity").cast("long"), price).alias("total"))


@query(
    f"""WITH c AS (SELECT customer_id FROM customers ORDER BY customer_id LIMIT 2500), {ORD}, {ITM}, {PRD}, o AS (SELECT * FROM ord WHERE customer_id IN (SELECT customer_id FROM c) ORDER BY order_id LIMIT 200),
p AS (SELECT product_id FROM prd ORDER BY product_id LIMIT 60)
SELECT i._record_hash, i.order_id, i.product_id FROM itm i WHERE i.order_id IN (SELECT order_id FROM o) AND i.product_id IN (SELECT product_id FROM p) ORDER BY i.order_id, i._record_hash LIMIT 400"""
)
def bounded_items(spark, sf):
    """A relational subset with a cap on each table, which is its feature: the first customers by id, then their first
    orders, the first products, and the first items of both."""
    customers = load(spark, sf, "customers").select("customer_id").orderBy("customer_id").limit(2500)
    orders = _orders(spark, sf).join(customers, "customer_id", "left_semi").orderBy("order_id").limit(200)
    products = _products(spark, sf).select("product_id").orderBy("product_id").limit(60)
    items = _items(spark, sf).join(orders, "order_id", "left_semi").join(products, "product_id", "left_semi")
    return items.orderBy("order_id", "_record_hash").limit(400).select("_record_hash", "order_id", "product_id")


# incremental runs and merges -----------------------------------------------------------------------------------------


def _two_deliveries(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(SECOND).cast("timestamp_ntz")
    return frame.where(F.col("ingestion_timestamp") < cut), frame.where(F.col("ingestion_timestamp") >= cut)


def _table(spark) -> VersionedTable:
    return VersionedTable(spark, work_path(spark, "tables"))


@query(f"WITH {ORD}, {ITM} SELECT order_id FROM ord WHERE ingestion_timestamp >= TIMESTAMP '{SECOND}' UNION SELECT order_id FROM itm WHERE ingestion_timestamp >= TIMESTAMP '{SECOND}'")
def changed_orders_union(spark, sf):
    return gold.changed_orders(_items(spark, sf), _orders(spark, sf), SECOND)


def _incremental(spark, sf) -> tuple[VersionedTable, DataFrame]:
    """fact_orders over the first delivery, then the delta of all data merged in."""
    items, orders = load(spark, sf, "order_items"), load(spark, sf, "silver_orders")
    table = _table(spark)
    table.overwrite(gold.fact_orders(gold.distinct_items(_two_deliveries(items)[0]), gold.current_orders(_two_deliveries(orders)[0])))
    stored = table.read()
    table.merge_current(gold.fact_orders_delta(items, orders, stored), ["order_id"])
    return table, stored


@query(f"WITH {FO} SELECT * FROM fo")
def incremental_fact_orders(spark, sf):
    """Equals the full refresh."""
    return _incremental(spark, sf)[0].read()


@query(f"WITH {FO} {_DAILY.format(t='fo')}")
def incremental_daily_sales(spark, sf):
    """Only days of changed orders are summed anew; those without orders are deleted, the others merged. Equals the full refresh."""
    table, stored = _incremental(spark, sf)
    sales = _table(spark)
    sales.overwrite(gold.daily_sales(stored))
    facts = table.read()
    days = gold.changed_days(facts.subtract(stored.select(*facts.columns)), stored)
    touched = facts.join(days, F.to_date("order_timestamp") == F.col("order_date"), "left_semi")
    sales.delete_keys(gold.without_parent(days, touched), ["order_date"])
    fresh = gold.daily_sales(touched)
    sales.merge_current(fresh.subtract(sales.read().select(*fresh.columns)), ["order_date"])
    return sales.read()


@query("SELECT 0 AS inserted, 0 AS updated, 0 AS deleted, 0 AS new_versions")
def incremental_unchanged(spark, sf):
    """A further run over unchanged tables: nothing is merged and no version made."""
    table, _ = _incremental(spark, sf)
    before = len(table.versions())
    done = table.merge_current(gold.fact_orders_delta(load(spark, sf, "order_items"), load(spark, sf, "silver_orders"), table.read()), ["order_id"])
    return spark.range(1).select(*(F.lit(done[c]).alias(c) for c in ("inserted", "updated", "deleted")), F.lit(len(table.versions()) - before).alias("new_versions"))


@query("SELECT DISTINCT * FROM daily_sales_copy EXCEPT SELECT * FROM daily_sales")
def except_unchanged(spark, sf):
    copy = load(spark, sf, "daily_sales_copy")
    return copy.subtract(load(spark, sf, "daily_sales").select(*copy.columns))


@query(f"WITH {ORD} SELECT order_date, orders FROM daily_sales s WHERE NOT EXISTS (SELECT 1 FROM ord WHERE CAST(order_timestamp AS DATE) = s.order_date AND is_cancelled = 'true')")
def prune_empty_dates(spark, sf):
    """Days to delete from a mart of cancelled orders: those without any."""
    cancelled = gold.current_orders(load(spark, sf, "silver_orders"), ("customer_id", "order_timestamp", "country", "is_cancelled")).where(F.col("is_cancelled") == "true")
    return gold.without_parent(load(spark, sf, "daily_sales"), cancelled).select("order_date", "orders")


@query(
    f"""SELECT * FROM order_items WHERE ingestion_timestamp < TIMESTAMP '{SECOND}' UNION ALL
SELECT * FROM order_items WHERE ingestion_timestamp >= TIMESTAMP '{SECOND}' AND _record_hash NOT IN (SELECT _record_hash FROM order_items WHERE ingestion_timestamp < TIMESTAMP '{SECOND}')"""
)
def merge_insert_only(spark, sf):
    """Two deliveries, the second one twice: the repeat inserts nothing. Repeats within a delivery stay."""
    first, second = _two_deliveries(load(spark, sf, "order_items"))
    table = _table(spark)
    table.merge_insert_only(first, ["_record_hash"])
    table.merge_insert_only(second, ["_record_hash"])
    table.merge_insert_only(second, ["_record_hash"])
    return table.read()


@query(f"WITH {PRD} SELECT product_id, description, unit_price, ingestion_timestamp FROM prd")
def merge_current(spark, sf):
    """The products' state after two deliveries, merged by key."""
    first, second = _two_deliveries(load(spark, sf, "products"))
    table = _table(spark)
    for delivery in (first, second):
        table.merge_current(gold.current_products(delivery).select("product_id", "description", "unit_price", "ingestion_timestamp"), ["product_id"])
    return table.read()


@query(f"WITH {ORD} SELECT order_id, customer_id, country, order_timestamp, is_cancelled, ingestion_timestamp FROM ord")
def merge_upsert(spark, sf):
    """Orders after two deliveries, the later row of a key replacing the earlier."""
    columns = ("order_id", "customer_id", "country", "order_timestamp", "is_cancelled", "ingestion_timestamp")
    first, second = _two_deliveries(load(spark, sf, "silver_orders"))
    table = _table(spark)
    for delivery in (first, second):
        table.merge_upsert(gold.current_orders(delivery, ("customer_id", "order_timestamp", "country", "is_cancelled")).select(*columns), ["order_id"])
    return table.read()


_EVENT_COLUMNS = (
    "event_type", "customer_id", "product_id", "order_id", "quantity", "price", "country", "search_query", "event_timestamp", "ingestion_timestamp", "source_topic", "pipeline_run_id",
)


@query(
    f"SELECT * EXCLUDE (n) FROM (SELECT {_uuid('event_id')} AS event_id, {', '.join(_EVENT_COLUMNS)}, row_number() OVER (PARTITION BY {_uuid('event_id')} "
    f"ORDER BY ingestion_timestamp NULLS FIRST, {', '.join(f'{c} NULLS FIRST' for c in _EVENT_COLUMNS)}) AS n FROM silver_events) WHERE n = 1"
)
def dedupe_first_arrival(spark, sf):
    """Whole rows: of each event the one that arrived first, of equal ones the smallest."""
    e = load(spark, sf, "silver_events").select(contract.canonical_uuid(F.col("event_id")).alias("event_id"), *_EVENT_COLUMNS)
    return dedup.dedupe_rows(e, ["event_id"], [F.col("ingestion_timestamp")])


@query(
    f"WITH {PRD} SELECT product_id, description, unit_price, ingestion_timestamp, pipeline_run_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ingestion_timestamp DESC, description DESC NULLS LAST, unit_price DESC NULLS LAST, pipeline_run_id DESC NULLS LAST) AS n FROM products WHERE product_id IS NOT NULL) WHERE n = 1"
)
def normalize_keep_last(spark, sf):
    return quality.keep_last(load(spark, sf, "products"), ["product_id"], ["ingestion_timestamp"])


@query(f"WITH {PRD} SELECT product_id, description, unit_price FROM prd")
def scd2_current(spark, sf):
    """The open version of every product's history."""
    book = history.ledger(load(spark, sf, "products"), ["product_id"], "ingestion_timestamp", "ingestion_timestamp", ["description", "unit_price"])
    return history.versions(book, ["product_id"]).where(F.col("valid_to").isNull()).select("product_id", "attrs.description", "attrs.unit_price")


# events --------------------------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN event_timestamp < ingestion_timestamp - INTERVAL 30 MINUTE THEN 'LATE_EVENT' ELSE 'ACCEPTED' END AS verdict, count(*) AS events FROM silver_events GROUP BY 1")
def late_classification(spark, sf):
    late = F.col("event_timestamp") < F.col("ingestion_timestamp") - F.expr("INTERVAL 30 MINUTES")
    return load(spark, sf, "silver_events").groupBy(F.when(late, "LATE_EVENT").otherwise("ACCEPTED").alias("verdict")).agg(F.count(F.lit(1)).alias("events"))


@query(contract_sql.ORACLE["topic_routing_mismatch"])
def topic_routing_mismatch(spark, sf):
    """Messages of a known type that came by another topic than their type's, whatever else is wrong with them."""
    raw = load(spark, sf, "bronze_events")
    told = raw.select("topic", F.try_variant_get(contract.whole_json(F.col("raw_payload")), "$.event_type", "string").alias("event_type"))
    wrong = told.where(F.col("event_type").isin(*contract.TOPIC_OF) & ~F.col("topic").eqNullSafe(contract.expected_topic(F.col("event_type"))))
    return wrong.groupBy("event_type", F.col("topic").alias("source_topic")).agg(F.count(F.lit(1)).alias("events"))


@query(contract_sql.ORACLE["contract_verdicts"])
def contract_verdicts(spark, sf):
    """The verdict of every raw message, and its time in UTC."""
    made = contract.classify(load(spark, sf, "bronze_events"))
    return made.select("topic", "kafka_partition", "kafka_offset", "error_type", "event_timestamp")


@query(contract_sql.ORACLE["contract_classify"])
def contract_classify(spark, sf):
    """Every raw message with its verdict: contract, topic, lateness."""
    made = contract.classify(load(spark, sf, "bronze_events"))
    return made.select("topic", "kafka_partition", "kafka_offset", "event_id", "event_type", "quantity", "price", "event_timestamp", "error_type", "error_message")


@query("SELECT topic, kafka_partition, kafka_offset, scenario, stream_run_id FROM bronze_events")
def header_lookup(spark, sf):
    """Values found by name in a list of headers; a missing header gives null."""
    from tidemill.sources.stream import header

    raw = load(spark, sf, "bronze_events")
    headers = F.array(*(F.struct(F.lit(n).alias("key"), F.encode(F.col(n), "UTF-8").alias("value")) for n in ("scenario", "stream_run_id")))
    sent = raw.select("topic", "kafka_partition", "kafka_offset", headers.alias("headers"))
    return sent.select("topic", "kafka_partition", "kafka_offset", header("headers", "scenario").alias("scenario"), header("headers", "stream_run_id").alias("stream_run_id"))


def _runs(spark, sf) -> DataFrame:
    """One row per streaming run, its counts taken from what the contract says of each raw message."""
    made = contract.classify(load(spark, sf, "bronze_events"))
    ok = F.col("error_type").isNull()
    return made.groupBy(F.col("stream_run_id").alias("run_id")).agg(
        F.lit("SUCCESS").alias("status"),
        F.count(F.lit(1)).alias("records_read"),
        (F.count_if(ok) - F.countDistinct(F.when(ok, F.col("event_id")))).alias("records_duplicate"),
        F.count_if(F.col("error_type").isin(contract.SCHEMA_VALIDATION, contract.TOPIC_MISMATCH)).alias("records_rejected"),
        F.count_if(F.col("error_type") == contract.LATE_EVENT).alias("records_late"),
        F.max("ingestion_timestamp").alias("completed_at"),
    )


_RUNS = f"""{contract_sql.VERDICTS}, runs AS (SELECT stream_run_id AS run_id, 'SUCCESS' AS status, count(*) AS records_read,
  count(*) FILTER (WHERE error_type IS NULL) - count(DISTINCT CASE WHEN error_type IS NULL THEN event_key END) AS records_duplicate,
  count(*) FILTER (WHERE error_type IN ('SCHEMA_VALIDATION', 'TOPIC_MISMATCH')) AS records_rejected, count(*) FILTER (WHERE error_type = 'LATE_EVENT') AS records_late,
  max(ingestion_timestamp) AS completed_at FROM v GROUP BY stream_run_id),
rates AS (SELECT *, records_duplicate::DOUBLE / records_read AS duplicate_rate, records_rejected::DOUBLE / records_read AS rejection_rate, records_late::DOUBLE / records_read AS late_event_rate FROM runs)"""


@query(f"WITH {_RUNS} SELECT * FROM rates")
def run_rates(spark, sf):
    return kpi.run_rates(_runs(spark, sf))


@query(
    f"""WITH {_RUNS} SELECT run_id, 'duplicate_rate' AS metric, duplicate_rate AS value, CAST(0.05 AS DOUBLE) AS threshold, 'warning' AS severity FROM rates WHERE duplicate_rate > 0.05
UNION ALL SELECT run_id, 'rejection_rate', rejection_rate, 0.02, 'warning' FROM rates WHERE rejection_rate > 0.02 UNION ALL SELECT run_id, 'late_event_rate', late_event_rate, 0.05, 'warning' FROM rates WHERE late_event_rate > 0.05"""
)
def dq_alerts(spark, sf):
    return kpi.alerts(kpi.run_rates(_runs(spark, sf)))


@query(f"WITH {_RUNS} SELECT run_id, completed_at, records_read FROM runs ORDER BY completed_at DESC, run_id LIMIT 20")
def latest_runs(spark, sf):
    return _runs(spark, sf).orderBy(F.col("completed_at").desc(), "run_id").limit(20).select("run_id", "completed_at", "records_read")


@query(
    """SELECT 'batch' AS stage, max(ingestion_timestamp) AS latest_success FROM silver_events UNION ALL SELECT 'stream', max(ingestion_timestamp) FROM bronze_events
UNION ALL SELECT 'any', greatest((SELECT max(ingestion_timestamp) FROM silver_events), (SELECT max(ingestion_timestamp) FROM bronze_events))"""
)
def latest_success(spark, sf):
    """The newest successful run of the batch and of the streaming stage."""
    batch = load(spark, sf, "silver_events").groupBy("pipeline_run_id").agg(F.lit("SUCCESS").alias("status"), F.max("ingestion_timestamp").alias("completed_at"))
    return checks.latest_success({"batch": batch, "stream": _runs(spark, sf)})


@query("SELECT count(*) AS read, count(*) FILTER (WHERE topic IS NULL OR kafka_partition IS NULL OR kafka_offset IS NULL OR kafka_timestamp IS NULL OR stream_run_id IS NULL) AS incomplete FROM bronze_events")
def transport_nulls(spark, sf):
    return checks.transport_nulls(load(spark, sf, "bronze_events"))


@query(
    """WITH g AS (SELECT scenario, count(*) AS records FROM bronze_events WHERE scenario IS NOT NULL GROUP BY scenario), e AS (SELECT * FROM (VALUES ('normal', 1000), ('traffic-spike', 0), ('nothing', 0)) AS t(scenario, expected))
SELECT coalesce(e.scenario, g.scenario) AS scenario, CAST(coalesce(expected, 0) AS BIGINT) AS expected, coalesce(records, 0) AS records, coalesce(expected, 0) = coalesce(records, 0) AS ok FROM e FULL JOIN g ON e.scenario = g.scenario"""
)
def scenario_verdicts(spark, sf):
    """Records per scenario against expected numbers; scenarios on either side come out."""
    found = load(spark, sf, "bronze_events").where(F.col("scenario").isNotNull()).groupBy("scenario").agg(F.count(F.lit(1)).alias("records"))
    return checks.verify_scenarios(found, {"normal": 1000, "traffic-spike": 0, "nothing": 0})


def _tested(name: str, table: str, kind: str, column: str) -> str:
    """One data test in SQL over the CTEs below."""
    of = {"unique": f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1)", "not_null": f"{table} WHERE {column} IS NULL"}
    return f"SELECT '{name}.{kind}:{column}' AS check, count(*) AS failures FROM {of.get(kind) or column}"


_KINDS = "'product_view', 'search', 'add_to_cart', 'checkout', 'purchase', 'payment', 'inventory_update'"
_TESTS = " UNION ALL ".join(
    [
        *(_tested(n, t, k, c) for n, t, c in (("stg_events", "stg", "event_id"), ("dim_customer", "dimc", "customer_id"), ("dim_product", "prd", "product_id"), ("dim_date", "days", "date_key"), ("fact_orders", "fo", "order_id"), ("fact_order_items", "foi", "order_item_id"), ("daily_sales", "sales", "order_date")) for k in ("unique", "not_null")),
        *(_tested(n, t, "not_null", c) for n, t, c in (("stg_events", "stg", "event_type"), ("fact_orders", "fo", "order_total"), ("fact_order_items", "foi", "quantity"), ("fact_order_items", "foi", "unit_price"))),
        "SELECT 'dim_product.not_null:average_price', count(*) FROM prd WHERE unit_price IS NULL",
        f"SELECT 'stg_events.accepted:event_type', count(*) FROM stg WHERE event_type NOT IN ({_KINDS})",
        "SELECT 'fact_orders.relationship:customer_id', count(*) FROM fo WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM dimc)",
        "SELECT 'fact_order_items.relationship:product_id', count(*) FROM foi WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM prd)",
        "SELECT 'fact_order_items.relationship:order_id', count(*) FROM foi WHERE order_id NOT IN (SELECT order_id FROM fo)",
        "SELECT 'fact_orders.rows:order_total < 0', count(*) FROM fo WHERE order_total < 0", "SELECT 'fact_order_items.rows:unit_price < 0', count(*) FROM foi WHERE unit_price < 0",
        "SELECT 'fact_order_items.rows:quantity <= 0', count(*) FROM foi WHERE quantity <= 0",
    ]
)


@query(
    f"WITH {STG}, {FO}, {PRD}, {DIMC}, days AS (SELECT CAST(unnest(generate_series(min(CAST(order_timestamp AS DATE)), max(CAST(order_timestamp AS DATE)), INTERVAL 1 DAY)) AS DATE) AS date_key FROM fo), "
    f"sales AS ({_DAILY.format(t='fo')}) {_TESTS}"
)
def data_tests(spark, sf):
    """The 23 generic and 3 singular tests of the marts, with their failures."""
    items, orders = _items(spark, sf), _orders(spark, sf)
    facts = gold.fact_orders(items, orders)
    return checks.run(
        {
            "stg_events": _stg(spark, sf), "dim_customer": gold.dim_customer(load(spark, sf, "customers"), orders), "dim_product": gold.dim_product(_products(spark, sf), items, orders),
            "dim_date": gold.dim_date(facts), "fact_orders": facts, "fact_order_items": gold.fact_order_items(items, orders), "daily_sales": gold.daily_sales(facts),
        }
    )


_TAKEN = """cal AS (SELECT DISTINCT snapshot_date AS d FROM dim_product), k AS (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM cal),
taken AS (SELECT DISTINCT product_id, average_price, snapshot_date AS d FROM dim_product WHERE snapshot_date IN (SELECT d FROM k WHERE k IN (1, (n + 1) // 2, n))),
m AS (SELECT *, lag(d) OVER w AS pd, lag(average_price) OVER w AS pp FROM taken WINDOW w AS (PARTITION BY product_id ORDER BY d)),
starts AS (SELECT product_id, average_price, CAST(d AS TIMESTAMP) AS valid_from FROM m WHERE pd IS NULL OR average_price IS DISTINCT FROM pp)"""


def _snapshots(spark, sf) -> tuple[VersionedTable, DataFrame]:
    """A history kept by merging the first, the middle and the last snapshot of the dimension, the last one twice."""
    dim, table = load(spark, sf, "dim_product"), _table(spark)
    days = [r["d"] for r in dim.select(F.col("snapshot_date").alias("d")).distinct().orderBy("d").collect()]
    for d in (*dict.fromkeys((days[0], days[(len(days) + 1) // 2 - 1], days[-1])), days[-1]):
        now = dim.where(F.col("snapshot_date") == F.lit(d)).select("product_id", "average_price").distinct()
        history.merge_snapshot(table, now, ["product_id"], ["average_price"], datetime.datetime.combine(d, datetime.time()))
    return table, dim


@query(f"WITH {_TAKEN} SELECT *, lead(valid_from) OVER (PARTITION BY product_id ORDER BY valid_from) AS valid_to FROM starts")
def scd2_merged(spark, sf):
    return _snapshots(spark, sf)[0].read()


@query(f"WITH {_TAKEN} SELECT product_id, count(*) AS versions, CAST(1 AS BIGINT) AS open_versions, count(*) >= 2 AS ok FROM starts GROUP BY product_id")
def scd2_acceptance(spark, sf):
    """Products by whether their merged history has two versions or more, and exactly one current."""
    return checks.accept_history(_snapshots(spark, sf)[0].read(), "product_id")


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT % 97 AS INTEGER) AS bucket FROM orders")
def hash_buckets(spark, sf):
    """Orders dealt to 97 buckets by the first eight bytes of a SHA-256."""
    return load(spark, sf, "orders").select("o_orderkey", hash_bucket(F.col("o_orderkey").cast("string"), 97).alias("bucket"))


def _stream(spark, sf, times: int = 1):
    from tidemill.sources.stream import parquet_files
    from tidemill.sources.tables import table_path
    from tidemill.streaming import bronze_silver

    root = work_path(spark, "streams")
    house = bronze_silver.Lakehouse(spark, root)
    for n in range(times):
        source = parquet_files(spark, table_path(sf, "bronze_events"), files_per_trigger=64)
        bronze_silver.run(source, house, f"{root}/checkpoints", namespace=f"pass-{n}", partitions=spark.sparkContext.defaultParallelism)
    return house


@query(contract_sql.ORACLE["stream_silver"])
def stream_silver(spark, sf):
    """Silver after streaming all raw messages through contract, quarantine and merge."""
    return _stream(spark, sf).silver.read().select("event_id", "event_type", "customer_id", "product_id", "order_id", "quantity", "price", "country", "event_timestamp", "ingestion_timestamp")


@query("SELECT topic, kafka_partition, kafka_offset FROM bronze_events")
def stream_bronze_replayed(spark, sf):
    """Bronze after the whole stream ran twice: every transport coordinate once."""
    return _stream(spark, sf, times=2).bronze.read().select("topic", "kafka_partition", "kafka_offset")


@query(contract_sql.ORACLE["stream_silver_ids"])
def stream_silver_ids(spark, sf):
    return _stream(spark, sf).silver.read().select("event_id")


@query(contract_sql.ORACLE["stream_audit_totals"])
def stream_audit_totals(spark, sf):
    """The audit of a run and of its replay: the replay writes nothing and counts accepted rows as duplicates."""
    audit = _stream(spark, sf, times=2).audit.read()
    return audit.groupBy("checkpoint_namespace").agg(*(F.sum(c).alias(c) for c in ("records_read", "records_written", "records_rejected", "records_late", "records_duplicate")))
