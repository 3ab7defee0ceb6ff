"""The pN_ queries of the general problems in SQL, for DuckDB over the same tables."""

_UUID = (
    "CASE WHEN regexp_full_match({x}, '(urn:uuid:)?[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}|[0-9a-fA-F]{{32}}|"
    "\\{{[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}\\}}') "
    "THEN regexp_replace(regexp_replace(lower({x}), '^urn:uuid:|[{{}}-]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') END"
)


def _uuid(x: str) -> str:
    return _UUID.format(x=x)


_FACT = ("order_id", "customer_id", "product_id", "quantity", "unit_price", "line_total", "country", "event_timestamp", "ingestion_timestamp")
_DAILY = ("orders", "units", "revenue", "average_order_value", "ingestion_timestamp")


def _diff(table: str, key: str, fields: tuple[str, ...]) -> str:
    sides = f"(SELECT DISTINCT * FROM {table}) b FULL JOIN (SELECT DISTINCT * FROM {table}_copy) c ON b.{key} = c.{key}"
    one = f"SELECT '{table}' AS table_name, CAST(coalesce(b.{key}, c.{key}) AS VARCHAR) AS row_key, "
    parts = [f"{one} CASE WHEN c.{key} IS NULL THEN 'only_in_base' ELSE 'only_in_copy' END AS field_name FROM {sides} WHERE b.{key} IS NULL OR c.{key} IS NULL"]
    parts += [f"{one} '{f}' AS field_name FROM {sides} WHERE b.{key} IS NOT NULL AND c.{key} IS NOT NULL AND b.{f} IS DISTINCT FROM c.{f}" for f in fields]
    return " UNION ALL ".join(parts)


_P1 = _diff("fact_order_items", "order_item_id", _FACT) + " UNION ALL " + _diff("daily_sales", "order_date", _DAILY)

_MESSAGES = f"""messages AS (
  SELECT {_uuid('event_id')} AS id, event_type, order_id, quantity, price, event_timestamp, ingestion_timestamp,
         row_number() OVER (PARTITION BY {_uuid('event_id')} ORDER BY ingestion_timestamp, event_timestamp, event_type NULLS FIRST, order_id NULLS FIRST,
                            quantity NULLS FIRST, price NULLS FIRST) AS n
  FROM silver_events WHERE {_uuid('event_id')} IS NOT NULL
), firsts AS (SELECT * FROM messages WHERE n = 1),
bought AS (
  SELECT CAST(event_timestamp AS DATE) AS order_date, date_trunc('hour', ingestion_timestamp) AS arrival_batch, order_id, quantity, price,
         ingestion_timestamp > event_timestamp + INTERVAL 30 MINUTE AS is_late
  FROM firsts WHERE event_type = 'purchase' AND ingestion_timestamp <= event_timestamp + INTERVAL 48 HOUR
)"""

_DIM = """cal AS (SELECT DISTINCT snapshot_date AS d FROM dim_product), ranked AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM cal),
rows_ AS (SELECT DISTINCT product_id, snapshot_date, average_price, k FROM dim_product JOIN ranked ON d = snapshot_date),
marked AS (SELECT *, lag(k) OVER w AS pk, lag(average_price) OVER w AS pp FROM rows_ WINDOW w AS (PARTITION BY product_id ORDER BY k)),
dim_starts AS (SELECT product_id, average_price, snapshot_date, k FROM marked WHERE pk IS NULL OR pk < k - 1 OR average_price IS DISTINCT FROM pp)"""

_PROD = """ups AS (SELECT DISTINCT product_id, description, unit_price, ingestion_timestamp AS seen FROM products),
pmarked AS (SELECT *, lag(seen) OVER w AS pat, lag(description) OVER w AS pd, lag(unit_price) OVER w AS pu FROM ups WINDOW w AS (PARTITION BY product_id ORDER BY seen)),
prod_starts AS (SELECT product_id, description, unit_price, seen FROM pmarked WHERE pat IS NULL OR description IS DISTINCT FROM pd OR unit_price IS DISTINCT FROM pu)"""


#: Prices that events told: i in order of valid time, t in order of recording.
_TOLD = """u AS (SELECT DISTINCT product_id, price, event_timestamp AS v, coalesce(ingestion_timestamp, event_timestamp) AS r FROM silver_events
  WHERE price IS NOT NULL AND product_id IS NOT NULL AND event_timestamp IS NOT NULL),
told AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY v, r, price) AS i, row_number() OVER (PARTITION BY product_id ORDER BY r, v, price) AS t FROM u)"""


def _orphan(table: str, row_key: str, ref: str, parent: str, key: str, died: str | None) -> str:
    dead = f"min(p.{died})" if died else "CAST(NULL AS TIMESTAMP)"
    return f"""SELECT '{table}' AS table_name, r.{row_key} AS row_key, '{ref}' AS ref_column, r.{ref} AS ref, CAST(r.ingestion_timestamp AS DATE) AS period
FROM {table} r LEFT JOIN (SELECT {key} AS k, min(ingestion_timestamp) AS born, {dead} AS died FROM {parent} p GROUP BY {key}) q ON r.{ref} = q.k
WHERE r.{ref} IS NOT NULL AND (q.born IS NULL OR q.born > r.ingestion_timestamp OR coalesce(q.died <= r.ingestion_timestamp, false))"""


_ORPHANS = " UNION ALL ".join(
    (
        _orphan("silver_orders", "order_id", "customer_id", "customers", "customer_id", "deleted_at"),
        _orphan("order_items", "_record_hash", "order_id", "silver_orders", "order_id", None),
        _orphan("order_items", "_record_hash", "product_id", "products", "product_id", None),
    )
)

_BRONZE_ID = _uuid("CASE WHEN json_valid(raw_payload) THEN json_extract_string(raw_payload, '$.event_id') END")


def _once(table: str, id_: str, order: str, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT *, {id_} AS k, row_number() OVER (PARTITION BY {id_} ORDER BY {order}) AS n FROM {table}) WHERE k IS NULL OR n = 1"""


ORACLE = {
    "p1_found": f"SELECT DISTINCT * FROM ({_P1})",
    "p1_summary": f"SELECT table_name, field_name, count(*) AS cases FROM (SELECT DISTINCT * FROM ({_P1})) GROUP BY ALL",
    "p2_found": f"WITH {_MESSAGES} SELECT id AS event_id, strftime(event_timestamp, '%Y-%m-%d') AS event_date FROM firsts "
    "WHERE ingestion_timestamp > event_timestamp + INTERVAL 30 MINUTE AND ingestion_timestamp <= event_timestamp + INTERVAL 48 HOUR",
    "p2_daily": f"WITH {_MESSAGES} SELECT order_date, count(DISTINCT order_id) AS orders, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units, "
    "CAST(coalesce(sum(quantity * price), 0) AS DECIMAL(18,2)) AS revenue, count(*) FILTER (WHERE is_late) AS late_lines FROM bought GROUP BY order_date",
    "p2_incremental": f"WITH {_MESSAGES} SELECT order_date, count(DISTINCT order_id) AS orders, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units, "
    "CAST(coalesce(sum(quantity * price), 0) AS DECIMAL(18,2)) AS revenue, count(*) FILTER (WHERE is_late) AS late_lines FROM bought GROUP BY order_date",
    "p2_refused": f"""WITH {_MESSAGES}, cuts AS (SELECT unnest([TIMESTAMP '2015-01-06 03:17:41', TIMESTAMP '2015-01-15 12:07:00', TIMESTAMP '2015-02-02 00:00:01', TIMESTAMP '2015-02-10 12:07:00',
  TIMESTAMP '2015-02-27 23:59:59']) AS c), judged AS (SELECT id AS event_id, strftime(event_timestamp, '%Y-%m-%d') AS event_date, CASE WHEN ingestion_timestamp > event_timestamp + INTERVAL 48 HOUR THEN 'refused'
  WHEN CAST(event_timestamp AS DATE) < (SELECT max(CAST(c - INTERVAL 12 HOUR AS DATE)) FROM cuts WHERE c <= ingestion_timestamp) THEN 'closed' END AS reason FROM firsts WHERE event_type = 'purchase')
SELECT * FROM judged WHERE reason IS NOT NULL""",
    "p2_corrections": f"""WITH {_MESSAGES}, o AS (SELECT order_date, order_id, min(arrival_batch) AS arrival_batch FROM bought WHERE order_id IS NOT NULL GROUP BY ALL),
b AS (SELECT order_date, arrival_batch, sum(quantity) AS u, sum(quantity * price) AS r FROM bought GROUP BY ALL),
c AS (SELECT b.*, (SELECT count(*) FROM o WHERE o.order_date = b.order_date AND o.arrival_batch = b.arrival_batch) AS n FROM b)
SELECT order_date, arrival_batch, CAST(sum(n) OVER w AS BIGINT) AS orders, CAST(coalesce(sum(u) OVER w, 0) AS BIGINT) AS units,
  CAST(coalesce(sum(r) OVER w, 0) AS DECIMAL(18,2)) AS revenue FROM c WINDOW w AS (PARTITION BY order_date ORDER BY arrival_batch)""",
    "p3_found": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, country FROM {t} WHERE country IS NOT NULL GROUP BY country HAVING count(*) * 20 >= (SELECT count(*) FROM {t})"
        for t in ("silver_events", "silver_orders")
    ),
    "p3_country_figures": "SELECT country, count(*) AS events, CAST(sum(quantity) AS BIGINT) AS units, max(ingestion_timestamp) AS last_ingestion, "
    "count(DISTINCT customer_id) AS customers, count(DISTINCT product_id) AS products FROM silver_events GROUP BY country",
    "p4_found": f"SELECT 'silver_events' AS table_name, k AS event_id FROM (SELECT {_uuid('event_id')} AS k FROM silver_events) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1 "
    f"UNION ALL SELECT 'bronze_events', k FROM (SELECT {_BRONZE_ID} AS k FROM bronze_events) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1",
    "p4_silver_once": _once(
        "silver_events",
        _uuid("event_id"),
        "ingestion_timestamp, event_id, country NULLS LAST",
        "event_id, event_type, customer_id, product_id, order_id, quantity, price, country, search_query, event_timestamp, ingestion_timestamp, source_topic, pipeline_run_id",
    ),
    "p4_bronze_once": _once(
        "bronze_events", _BRONZE_ID, "ingestion_timestamp, topic, kafka_partition, kafka_offset",
        "raw_payload, topic, kafka_partition, kafka_offset, kafka_timestamp, ingestion_timestamp, scenario, stream_run_id",
    ),
    "p5_found": f"WITH {_PROD}, {_DIM} SELECT 'products' AS table_name, product_id, strftime(seen, '%Y-%m-%d %H:%M:%S') AS valid_from FROM prod_starts "
    "UNION ALL SELECT 'dim_product', product_id, strftime(snapshot_date, '%Y-%m-%d') FROM dim_starts",
    "p5_product_history": f"WITH {_PROD} SELECT product_id, description, unit_price, seen AS valid_from, lead(seen) OVER (PARTITION BY product_id ORDER BY seen) AS valid_to FROM prod_starts",
    "p5_price_history": f"""WITH {_DIM}, ends AS (SELECT r.product_id, n.d FROM rows_ r JOIN ranked n ON n.k = r.k + 1 WHERE NOT EXISTS (SELECT 1 FROM rows_ x WHERE x.product_id = r.product_id AND x.k = n.k)),
cuts AS (SELECT product_id, snapshot_date AS d FROM dim_starts UNION SELECT product_id, d FROM ends)
SELECT s.product_id, average_price, snapshot_date AS valid_from, (SELECT min(c.d) FROM cuts c WHERE c.product_id = s.product_id AND c.d > s.snapshot_date) AS valid_to FROM dim_starts s""",
    "p5_ledger": """WITH u AS (SELECT DISTINCT product_id, description, unit_price, ingestion_timestamp AS seen FROM products),
n AS (SELECT *, lead(seen) OVER (PARTITION BY product_id ORDER BY seen) AS nxt FROM u)
SELECT product_id, description, unit_price, seen AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, seen AS recorded_from, nxt AS recorded_to FROM n
UNION ALL SELECT product_id, description, unit_price, seen, nxt, nxt, NULL FROM n WHERE nxt IS NOT NULL""",
    "p5_event_ledger": f"""WITH {_TOLD}, near AS (SELECT a.product_id, a.i, max(CASE WHEN b.i < a.i THEN b.i END) AS p, min(CASE WHEN b.i > a.i THEN b.i END) AS s
  FROM told a LEFT JOIN told b ON a.product_id = b.product_id AND b.t < a.t GROUP BY a.product_id, a.i),
linked AS (SELECT u.*, p, x.v AS sv FROM told u JOIN near USING (product_id, i) LEFT JOIN told x ON x.product_id = u.product_id AND x.i = near.s),
pieces AS (SELECT product_id, i AS owner, r AS recorded_from, t, sv AS valid_to FROM linked UNION ALL SELECT product_id, p, r, t, v FROM linked WHERE p IS NOT NULL),
turned AS (SELECT *, lead(recorded_from) OVER (PARTITION BY product_id, owner ORDER BY t) AS recorded_to FROM pieces)
SELECT product_id, price, v AS valid_from, valid_to, recorded_from, recorded_to FROM turned JOIN (SELECT product_id, i AS owner, price, v FROM told) USING (product_id, owner)
WHERE (recorded_to IS NULL OR recorded_to > recorded_from) AND (valid_to IS NULL OR valid_to > v)""",
    "p5_event_prices": f"""WITH {_TOLD}, last AS (SELECT product_id, v, arg_max(price, t) AS price FROM told GROUP BY ALL),
marked AS (SELECT *, lag(v) OVER w AS pv, lag(price) OVER w AS pp FROM last WINDOW w AS (PARTITION BY product_id ORDER BY v))
SELECT product_id, price, v AS valid_from, lead(v) OVER (PARTITION BY product_id ORDER BY v) AS valid_to FROM marked WHERE pv IS NULL OR price IS DISTINCT FROM pp""",
    "p7_found": f"SELECT DISTINCT table_name, row_key, ref_column FROM ({_ORPHANS})",
    "p7_report": f"SELECT table_name, ref_column, period, count(*) AS orphan_rows, count(DISTINCT ref) AS orphan_keys FROM ({_ORPHANS}) GROUP BY table_name, ref_column, period",
}
