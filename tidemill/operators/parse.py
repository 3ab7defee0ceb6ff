"""Rows that fail to parse, with the reason, beside the rows that load.

Every csv and json record is read permissively under an explicit schema that retains the raw text of corrupt ones.
Corrupt csv records, those with a field that can't be cast, and those where the reader is lenient (it closes open
quotes and takes quotes and line breaks inside a field, so any record with one of these characters) are reclassified:
quoting first, by a grammar over the raw text without backtracking, then the number of fields, then the casts. Records
without any of these load as read. Corrupt json records fail as MALFORMED_JSON; the others are held against the event
contract, which also rules out what the reader forgives.

Defined results: a null or empty record fails as EMPTY_RECORD; a format other than csv and json fails as
UNKNOWN_FORMAT; surrounding blanks make a number invalid; a field may hold line breaks inside quotes; very long
records are classified like others. UnitPrice keeps its exact text, however large or fine; UnitPriceValue is the same
as decimal(38,18), null where its whole part has more than 20 digits and rounded half up beyond 18 places. An empty
table gives no rows. Columns of the input keep their names; error_type, error_message, loaded_invoice and loaded_event
replace existing columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import contract
from tidemill.functions.identifiers import free_prefix

# The fields of an invoice record.
INVOICE_FIELDS = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")
BROKEN_QUOTING, COLUMN_COUNT, INVALID_VALUE = "BROKEN_QUOTING", "COLUMN_COUNT", "INVALID_VALUE"
EMPTY_RECORD, UNKNOWN_FORMAT, MALFORMED_JSON = "EMPTY_RECORD", "UNKNOWN_FORMAT", "MALFORMED_JSON"

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)'
_RECORD = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
_CSV_SCHEMA = ", ".join(f"{c} STRING" for c in INVOICE_FIELDS) + ", __corrupt STRING"
_JSON_SCHEMA = ", ".join(f"{c} STRING" for c in contract.FIELDS) + ", __corrupt STRING"
#: Fields that the reader has room for; a record with more commas is read only once the grammar finds eight fields in it.
_MOST_FIELDS = 20_000


def csv_fields(raw: Column) -> Column:
    """Number of fields of a record whose quoting is sound."""
    bare = F.regexp_replace(raw, r'"[^"]*+"', "")
    return F.length(bare) - F.length(F.translate(bare, ",", "")) + 1


def csv_struct(raw: Column) -> Column:
    """The eight fields as texts, read permissively; records in which the reader finds another number keep __corrupt."""
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(_MOST_FIELDS + 10), "nullValue": "\u0000", "emptyValue": ""}
    return F.from_csv(raw, _CSV_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"} | options)


def json_corrupt(raw: Column) -> Column:
    """The raw text of a record that the permissive reader can't take for a JSON object of the event's fields, else null."""
    return F.from_json(raw, _JSON_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})["__corrupt"]


def invoice_reasons(rec: Column) -> Column:
    """Texts for every field of an invoice record that can't be loaded."""
    quantity, date, price = rec["Quantity"], rec["InvoiceDate"], rec["UnitPrice"]
    blank = lambda c: c.isNull() | (c == "")
    number = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
    date_ok = date.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z") & ~date.startswith("0000") & date.try_cast("timestamp_ntz").isNotNull()
    price_ok = price.rlike(number) & ~price.rlike(r"^-[^eE]*[1-9]")
    checks = [
        (blank(rec["InvoiceNo"]), "InvoiceNo: empty"),
        (blank(rec["StockCode"]), "StockCode: empty"),
        (~(quantity.rlike(r"^[+-]?[0-9]+\z") & quantity.try_cast("int").isNotNull()), "Quantity: not an integer of 32 bits"),
        (~date_ok, "InvoiceDate: not a time YYYY-MM-DD HH:MM:SS"),
        (~price_ok, "UnitPrice: not a decimal number of zero or more"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in checks)))


def classify_records(records: DataFrame, payload: str = "raw_payload", record_format: str = "record_format") -> DataFrame:
    """All rows with error_type and error_message (null where the record loads), loaded_invoice and loaded_event."""
    h = free_prefix(records.columns)
    raw, kind = F.col(f"{h}payload"), F.col(f"{h}kind")
    empty = raw.isNull() | (raw == "")
    kept = [c for c in records.columns if c not in ("error_type", "error_message", "loaded_invoice", "loaded_event")]
    source = records.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{payload}`").alias(f"{h}payload"), F.col(f"`{record_format}`").alias(f"{h}kind"))
    is_csv = F.coalesce((kind == "csv") & ~empty, F.lit(False))
    fits = (F.length(raw) - F.length(F.translate(raw, ",", "")) < _MOST_FIELDS) | (raw.rlike(_RECORD) & (csv_fields(raw) == len(INVOICE_FIELDS)))
    rec = F.col(f"{h}rec")
    read = source.withColumn(f"{h}rec", csv_struct(F.when(is_csv & fits, raw)))
    read = read.withColumn(f"{h}why_csv", F.when(rec.isNotNull(), invoice_reasons(rec)))
    # corrupt, not read at all, not castable, or with a character that the reader is lenient about
    doubtful = rec.isNull() | rec["__corrupt"].isNotNull() | (F.size(f"{h}why_csv") > 0) | raw.rlike('["\r\n]')
    read = read.withColumn(f"{h}doubt", is_csv & F.coalesce(doubtful, F.lit(True)))
    doubt, sound, eight = F.col(f"{h}doubt"), F.col(f"{h}sound"), F.col(f"{h}eight")
    read = read.withColumn(f"{h}sound", F.when(doubt, raw.rlike(_RECORD)))
    read = read.withColumn(f"{h}eight", F.when(sound, csv_fields(raw) == len(INVOICE_FIELDS)))
    json_only = F.when((kind == "json") & ~empty, raw)
    read = read.withColumn(f"{h}json", json_only).withColumn(f"{h}corrupt", json_corrupt(json_only))
    read = contract.parse_events(read, f"{h}json", f"{h}event")
    event = F.col(f"{h}event")
    csv_bad = F.when(doubt, F.when(~sound, BROKEN_QUOTING).when(~eight, COLUMN_COUNT).when(F.size(f"{h}why_csv") > 0, INVALID_VALUE))
    csv_why = (
        F.when(~sound, "a quote is open, unpaired or inside a field")
        .when(~eight, F.concat(csv_fields(raw).cast("string"), F.lit(" fields instead of 8")))
        .otherwise(F.array_join(f"{h}why_csv", "; "))
    )
    # the reader's verdict counts where the contract finds fault too; a record that meets the contract loads
    shape = event["error_message"].startswith("payload: not") | (event["error_type"].isNotNull() & F.col(f"{h}corrupt").isNotNull())
    json_bad = F.when(shape, MALFORMED_JSON).otherwise(event["error_type"])
    error = F.when(empty, EMPTY_RECORD).when(kind == "csv", csv_bad).when(kind == "json", json_bad).otherwise(UNKNOWN_FORMAT)
    why = F.when(empty, "nothing to load").when(kind == "csv", F.when(csv_bad.isNotNull(), csv_why)).when(kind == "json", event["error_message"]).otherwise("no loader for this format")
    loaded = F.struct(
        *(rec[c].alias(c) for c in ("InvoiceNo", "StockCode", "Description")),
        rec["Quantity"].try_cast("int").alias("Quantity"),
        rec["InvoiceDate"].try_cast("timestamp_ntz").alias("InvoiceDate"),
        rec["UnitPrice"].alias("UnitPrice"),
        rec["UnitPrice"].try_cast("decimal(38,18)").alias("UnitPriceValue"),
        *(rec[c].alias(c) for c in ("CustomerID", "Country")),
    )
    verdict = F.struct(
        error.alias("error_type"),
        why.alias("error_message"),
        F.when(F.coalesce(kind == "csv", F.lit(False)) & csv_bad.isNull() & ~empty, loaded).alias("loaded_invoice"),
        F.when(F.coalesce(kind == "json", F.lit(False)) & json_bad.isNull() & ~empty, event.dropFields("error_type", "error_message")).alias("loaded_event"),
    )
    once = read.select(*(F.col(f"`{c}`") for c in kept), contract.computed_once(verdict).alias(f"{h}verdict"))
    return once.select(*(F.col(f"`{c}`") for c in kept), f"{h}verdict.*")


def rejected(records: DataFrame, **names: str) -> DataFrame:
    return classify_records(records, **names).where(F.col("error_type").isNotNull())


def loaded(records: DataFrame, **names: str) -> DataFrame:
    return classify_records(records, **names).where(F.col("error_type").isNull())
