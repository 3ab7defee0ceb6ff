"""The event contract and the invoice grammar in SQL, for DuckDB: a second statement of the rules, for comparison."""

from tidemill.plans.problems_sql import _uuid

_FIELDS = "['event_id', 'event_type', 'customer_id', 'product_id', 'order_id', 'quantity', 'price', 'country', 'query', 'event_timestamp', 'schema_version']"
_NUMBER = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"


def _kind(f: str) -> str:
    return f"coalesce(json_type(j, '$.{f}'), 'NULL')"


def _text(f: str) -> str:
    return f"json_extract_string(j, '$.{f}')"


_TS = r"\d{4}-\d{2}-\d{2}[T _]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)"
#: UTC time of an ISO text: the wall clock minus its offset.
UTC = f"""(try_cast(replace(regexp_replace(regexp_replace(substr({_text('event_timestamp')}, 1, 10) || ' ' || substr({_text('event_timestamp')}, 12), '(Z|[+-]\\d\\d:?\\d\\d)$', ''), '^(.{{16}})$', '\\1:00'), ',', '.') AS TIMESTAMP)
  - CASE WHEN {_text('event_timestamp')} LIKE '%Z' THEN INTERVAL 0 MINUTE ELSE to_minutes(TRY_CAST((TRY_CAST(substr(regexp_extract({_text('event_timestamp')}, '[+-]\\d\\d:?\\d\\d$'), 2, 2) AS INT) * 60
  + TRY_CAST(right({_text('event_timestamp')}, 2) AS INT)) * CASE WHEN regexp_matches({_text('event_timestamp')}, '-\\d\\d:?\\d\\d$') THEN -1 ELSE 1 END AS BIGINT)) END)"""

_BLANK = lambda f: f"NOT coalesce({_kind(f)} = 'VARCHAR' AND regexp_matches({_text(f)}, '\\S'), false)"
_INTS = "('BIGINT', 'UBIGINT')"

#: True where ``j`` (a JSON object or null) meets the contract.
EVENT_OK = f"""coalesce(j IS NOT NULL AND json_type(j) = 'OBJECT' AND len(list_filter(json_keys(j), lambda k: NOT list_contains({_FIELDS}, k))) = 0
  AND {_kind('event_id')} = 'VARCHAR' AND ({_uuid(_text('event_id'))}) IS NOT NULL
  AND {_kind('event_type')} = 'VARCHAR' AND {_text('event_type')} IN ('product_view', 'search', 'add_to_cart', 'checkout', 'purchase', 'payment', 'inventory_update')
  AND {' AND '.join(_kind(f) + " IN ('VARCHAR', 'NULL')" for f in ('customer_id', 'product_id', 'order_id', 'country', 'query'))}
  AND ({_kind('quantity')} = 'NULL' OR ({_kind('quantity')} IN {_INTS} AND try_cast({_text('quantity')} AS INTEGER) IS NOT NULL))
  AND ({_kind('price')} = 'NULL' OR (({_kind('price')} IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR ({_kind('price')} = 'VARCHAR' AND regexp_full_match({_text('price')}, '{_NUMBER}')))
       AND NOT regexp_matches({_text('price')}, '^\\s*-[^eE]*[1-9]')))
  AND {_kind('event_timestamp')} = 'VARCHAR' AND regexp_full_match({_text('event_timestamp')}, '{_TS}') AND {UTC} IS NOT NULL
  AND {_kind('schema_version')} IN {_INTS} AND {_text('schema_version')} = '1'
  AND NOT ({_text('event_type')} IN ('product_view', 'add_to_cart', 'purchase', 'inventory_update') AND {_BLANK('product_id')})
  AND NOT ({_text('event_type')} IN ('purchase', 'inventory_update') AND NOT coalesce(try_cast({_text('quantity')} AS INTEGER) > 0, false))
  AND NOT ({_text('event_type')} = 'purchase' AND ({_BLANK('order_id')} OR {_kind('price')} = 'NULL')), false)"""

#: The payload as JSON, null where it is none. Trailing commas, which this parser forgives, are ruled out.
JSON = "CASE WHEN json_valid({raw}) AND NOT regexp_matches({raw}, ',\\s*[}}\\]]\\s*$') THEN CAST({raw} AS JSON) END"

_F = r"(\"(?:[^\"]|\"\")*\"|[^\",\r\n]*)"
_RECORD = "^" + ",".join([_F] * 8) + "$"
_NAMES = "['a', 'b', 'c', 'q', 'd', 'p', 'u', 'l']"
_BARE = lambda n: f"regexp_replace(f.{n}, '^\"|\"$', '', 'g')"
INVOICE_OK = f"""coalesce(regexp_full_match(raw_payload, '{_RECORD}') AND {_BARE('a')} != '' AND {_BARE('b')} != '' AND regexp_full_match({_BARE('q')}, '[+-]?\\d+') AND try_cast({_BARE('q')} AS INTEGER) IS NOT NULL
  AND regexp_full_match({_BARE('d')}, '\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') AND try_cast({_BARE('d')} AS TIMESTAMP) IS NOT NULL AND {_BARE('d')} NOT LIKE '% 24:%'
  AND regexp_full_match({_BARE('p')}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') AND NOT regexp_matches({_BARE('p')}, '^-[^eE]*[1-9]'), false)"""

_QUARANTINE = f"""q AS (SELECT *, {JSON.format(raw='raw_payload')} AS j, regexp_extract(raw_payload, '{_RECORD}', {_NAMES}) AS f FROM quarantine),
judged AS (SELECT *, CASE record_format WHEN 'csv' THEN {INVOICE_OK} WHEN 'json' THEN {EVENT_OK} ELSE false END AS ok FROM q)"""

_VALUE = lambda n: f"""CASE WHEN f.{n} != '' THEN replace(regexp_replace(f.{n}, '^"|"$', '', 'g'), '""', '"') END"""

_TOPIC = f"""CASE WHEN {_text('event_type')} IN ('product_view', 'search', 'add_to_cart') THEN 'customer-events' WHEN {_text('event_type')} IN ('checkout', 'purchase', 'payment') THEN 'order-events' ELSE 'inventory-events' END"""
_BRONZE = f"""b AS (SELECT *, {JSON.format(raw='raw_payload')} AS j FROM bronze_events),
c AS (SELECT *, {EVENT_OK} AS ok FROM b),
v AS (SELECT *, CASE WHEN ok THEN {UTC} END AS utc, CASE WHEN NOT ok THEN 'SCHEMA_VALIDATION' WHEN topic IS DISTINCT FROM {_TOPIC} THEN 'TOPIC_MISMATCH'
  WHEN {UTC} < ingestion_timestamp - INTERVAL 30 MINUTE THEN 'LATE_EVENT' END AS error_type FROM c)"""

_KNOWN = f"coalesce({_kind('event_type')} = 'VARCHAR' AND {_text('event_type')} IN ('product_view', 'search', 'add_to_cart', 'checkout', 'purchase', 'payment', 'inventory_update'), false)"
_PRICE_OK = f"""({_kind('price')} = 'NULL' OR {_kind('price')} IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR ({_kind('price')} = 'VARCHAR' AND regexp_full_match({_text('price')}, '{_NUMBER}')))"""
#: Every rule that a JSON object may break, in the order of the messages; null counts as broken.
_RULES = [
    (f"len(list_filter(json_keys(j), lambda k: NOT list_contains({_FIELDS}, k))) > 0", "payload: unknown field"),
    (f"NOT ({_kind('event_id')} = 'VARCHAR' AND ({_uuid(_text('event_id'))}) IS NOT NULL)", "event_id: not a UUID"),
    (f"NOT {_KNOWN}", "event_type: not one of the known types"),
    *((f"{_kind(f)} NOT IN ('VARCHAR', 'NULL')", f"{f}: not a text") for f in ("customer_id", "product_id", "order_id", "country", "query")),
    (f"NOT ({_kind('quantity')} = 'NULL' OR ({_kind('quantity')} IN {_INTS} AND try_cast({_text('quantity')} AS INTEGER) IS NOT NULL))", "quantity: not an integer of 32 bits"),
    (f"NOT {_PRICE_OK}", "price: not a finite decimal number"),
    (f"NOT ({_kind('event_timestamp')} = 'VARCHAR' AND regexp_full_match({_text('event_timestamp')}, '{_TS}') AND {UTC} IS NOT NULL)", "event_timestamp: not an ISO time with a zone"),
    (f"NOT ({_kind('schema_version')} IN {_INTS} AND {_text('schema_version')} = '1')", "schema_version: not the integer 1"),
    (f"{_KNOWN} AND {_text('event_type')} IN ('product_view', 'add_to_cart', 'purchase', 'inventory_update') AND {_BLANK('product_id')}", "product_id: needed for this event type"),
    (f"{_KNOWN} AND {_text('event_type')} IN ('purchase', 'inventory_update') AND NOT coalesce({_kind('quantity')} IN {_INTS} AND try_cast({_text('quantity')} AS HUGEINT) > 0, false)", "quantity: must be positive"),
    (f"{_PRICE_OK} AND {_kind('price')} != 'NULL' AND regexp_matches({_text('price')}, '^\\s*-[^eE]*[1-9]')", "price: below zero"),
    (f"{_KNOWN} AND {_text('event_type')} = 'purchase' AND {_BLANK('order_id')}", "order_id: needed for a purchase"),
    (f"{_KNOWN} AND {_text('event_type')} = 'purchase' AND {_kind('price')} = 'NULL'", "price: needed for a purchase"),
]
_WHY = f"""CASE WHEN j IS NULL THEN 'payload: not one JSON value' WHEN json_type(j) != 'OBJECT' THEN 'payload: not a JSON object'
  ELSE array_to_string(list_filter([{', '.join(f"CASE WHEN coalesce({bad}, true) THEN '{why}' END" for bad, why in _RULES)}], lambda x: x IS NOT NULL), '; ') END"""

#: The verdict of every raw message: v with j, ok, utc, error_type and event_key.
VERDICTS = f"{_BRONZE.rsplit('v AS (SELECT *', 1)[0]}v AS (SELECT *, {_uuid(_text('event_id'))} AS event_key{_BRONZE.rsplit('v AS (SELECT *', 1)[1]}"

_INVOICE_WHY = f"""CASE WHEN NOT regexp_full_match(raw_payload, '{_F}(,{_F})*') THEN 'a quote is open, unpaired or inside a field'
  WHEN NOT regexp_full_match(raw_payload, '{_RECORD}') THEN CAST(len(regexp_replace(raw_payload, '"[^"]*"', '', 'g')) - len(replace(regexp_replace(raw_payload, '"[^"]*"', '', 'g'), ',', '')) + 1 AS VARCHAR) || ' fields instead of 8'
  ELSE array_to_string(list_filter([CASE WHEN {_BARE('a')} = '' THEN 'InvoiceNo: empty' END, CASE WHEN {_BARE('b')} = '' THEN 'StockCode: empty' END,
  CASE WHEN NOT coalesce(regexp_full_match({_BARE('q')}, '[+-]?\\d+') AND try_cast({_BARE('q')} AS INTEGER) IS NOT NULL, false) THEN 'Quantity: not an integer of 32 bits' END,
  CASE WHEN NOT coalesce(regexp_full_match({_BARE('d')}, '\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') AND try_cast({_BARE('d')} AS TIMESTAMP) IS NOT NULL AND {_BARE('d')} NOT LIKE '% 24:%', false) THEN 'InvoiceDate: not a time YYYY-MM-DD HH:MM:SS' END,
  CASE WHEN NOT coalesce(regexp_full_match({_BARE('p')}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') AND NOT regexp_matches({_BARE('p')}, '^-[^eE]*[1-9]'), false) THEN 'UnitPrice: not a decimal number of zero or more' END],
  lambda x: x IS NOT NULL), '; ') END"""

ORACLE = {
    "p6_found": f"WITH {_QUARANTINE} SELECT record_id FROM judged WHERE NOT ok",
    "p6_error_types": f"""WITH {_QUARANTINE} SELECT record_id, CASE WHEN record_format = 'csv' THEN CASE
  WHEN NOT regexp_full_match(raw_payload, '{_F}(,{_F})*') THEN 'BROKEN_QUOTING' WHEN NOT regexp_full_match(raw_payload, '{_RECORD}') THEN 'COLUMN_COUNT' ELSE 'INVALID_VALUE' END
  WHEN j IS NULL OR json_type(j) != 'OBJECT' THEN 'MALFORMED_JSON' ELSE 'SCHEMA_VALIDATION' END AS error_type FROM judged WHERE NOT ok""",
    "p6_rejected": f"""WITH {_QUARANTINE} SELECT record_id, source_file, line_number, raw_payload, CASE WHEN coalesce(raw_payload, '') = '' THEN 'EMPTY_RECORD' WHEN record_format = 'csv' THEN CASE
  WHEN NOT regexp_full_match(raw_payload, '{_F}(,{_F})*') THEN 'BROKEN_QUOTING' WHEN NOT regexp_full_match(raw_payload, '{_RECORD}') THEN 'COLUMN_COUNT' ELSE 'INVALID_VALUE' END
  WHEN j IS NULL OR json_type(j) != 'OBJECT' THEN 'MALFORMED_JSON' ELSE 'SCHEMA_VALIDATION' END AS error_type,
  CASE WHEN coalesce(raw_payload, '') = '' THEN 'nothing to load' WHEN record_format = 'csv' THEN {_INVOICE_WHY} ELSE {_WHY} END AS error_message FROM judged WHERE NOT ok""",
    "p6_invoices": f"""WITH {_QUARANTINE} SELECT record_id, {_VALUE('a')} AS InvoiceNo, {_VALUE('b')} AS StockCode, {_VALUE('c')} AS Description, CAST({_VALUE('q')} AS INTEGER) AS Quantity,
  CAST({_VALUE('d')} AS TIMESTAMP) AS InvoiceDate, {_VALUE('p')} AS UnitPrice, try_cast({_VALUE('p')} AS DECIMAL(38,18)) AS UnitPriceValue, {_VALUE('u')} AS CustomerID, {_VALUE('l')} AS Country FROM judged WHERE ok AND record_format = 'csv'""",
    "p6_events": f"""WITH {_QUARANTINE} SELECT record_id, {_uuid(_text('event_id'))} AS event_id, {', '.join(f"{_text(c)} AS {c}" for c in ('event_type', 'customer_id', 'product_id', 'order_id'))},
  CAST({_text('quantity')} AS INTEGER) AS quantity, {', '.join(f"{_text(c)} AS {c}" for c in ('price', 'country', 'query'))}, {UTC} AS event_timestamp, 1 AS schema_version
  FROM judged WHERE ok AND record_format = 'json'""",
    "contract_verdicts": f"WITH {_BRONZE} SELECT topic, kafka_partition, kafka_offset, error_type, utc AS event_timestamp FROM v",
    "contract_classify": f"""WITH {VERDICTS} SELECT topic, kafka_partition, kafka_offset, CASE WHEN ok THEN event_key WHEN {_kind('event_id')} = 'VARCHAR' THEN {_text('event_id')} END AS event_id,
  CASE WHEN ok THEN {_text('event_type')} END AS event_type, CASE WHEN ok THEN CAST({_text('quantity')} AS INTEGER) END AS quantity, CASE WHEN ok THEN {_text('price')} END AS price, utc AS event_timestamp, error_type,
  CASE error_type WHEN 'SCHEMA_VALIDATION' THEN {_WHY} WHEN 'TOPIC_MISMATCH' THEN {_text('event_type')} || ' belongs to ' || {_TOPIC} WHEN 'LATE_EVENT' THEN 'event time is more than 30 minutes before ingestion' END AS error_message FROM v""",
    "topic_routing_mismatch": f"WITH {VERDICTS} SELECT {_text('event_type')} AS event_type, topic AS source_topic, count(*) AS events FROM v WHERE {_KNOWN} AND topic IS DISTINCT FROM {_TOPIC} GROUP BY ALL",
    "stream_silver": f"""WITH {VERDICTS}, n AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY topic, kafka_partition, kafka_offset) AS n FROM v WHERE error_type IS NULL)
SELECT event_key AS event_id, {', '.join(f"{_text(c)} AS {c}" for c in ('event_type', 'customer_id', 'product_id', 'order_id'))}, CAST({_text('quantity')} AS INTEGER) AS quantity,
  {_text('price')} AS price, {_text('country')} AS country, utc AS event_timestamp, ingestion_timestamp FROM n WHERE n = 1""",
    "stream_silver_ids": f"WITH {_BRONZE} SELECT DISTINCT {_uuid(_text('event_id'))} AS event_id FROM v WHERE error_type IS NULL",
    "stream_audit_totals": f"""WITH {_BRONZE}, t AS (SELECT count(*) AS records_read, count(DISTINCT CASE WHEN error_type IS NULL THEN {_uuid(_text('event_id'))} END) AS w,
  count(*) FILTER (WHERE error_type IN ('SCHEMA_VALIDATION', 'TOPIC_MISMATCH')) AS records_rejected, count(*) FILTER (WHERE error_type = 'LATE_EVENT') AS records_late, count(*) FILTER (WHERE error_type IS NULL) AS a FROM v)
SELECT 'pass-0' AS checkpoint_namespace, records_read, w AS records_written, records_rejected, records_late, a - w AS records_duplicate FROM t
UNION ALL SELECT 'pass-1', records_read, 0, records_rejected, records_late, a FROM t""",
}
