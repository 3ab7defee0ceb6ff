"""The retail event contract, version 1, as Catalyst expressions: no Python runs per row.

A payload is parsed once into a VARIANT, whose types tell a JSON number from a numeric text. Each rule is a nullable
reason; all reasons of a row are kept. Rules about the topic and about lateness are separate columns, since the
contract proper doesn't depend on either.

Known deviations: a price given as a JSON number keeps all its digits (as text); a price text with an exponent keeps
its exponent form in upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.identifiers import UUID_SPELLINGS, canonical_uuid, free_prefix

# Fixed values of the contract.
FIELDS = ("event_id", "event_type", "customer_id", "product_id", "order_id", "quantity", "price", "country", "query", "event_timestamp", "schema_version")
TOPIC_OF = {
    "product_view": "customer-events",
    "search": "customer-events",
    "add_to_cart": "customer-events",
    "checkout": "order-events",
    "purchase": "order-events",
    "payment": "order-events",
    "inventory_update": "inventory-events",
}
NEEDS_PRODUCT = ("product_view", "add_to_cart", "purchase", "inventory_update")
NEEDS_QUANTITY = ("purchase", "inventory_update")
SCHEMA_VALIDATION, TOPIC_MISMATCH, SILVER_REPRESENTATION, LATE_EVENT = "SCHEMA_VALIDATION", "TOPIC_MISMATCH", "SILVER_REPRESENTATION", "LATE_EVENT"

_INT_MIN, _INT_MAX = -(2**31), 2**31 - 1
_TIME = r"^(\d{4}-\d{2}-\d{2})[T _](\d{2}:\d{2})(?:(:\d{2})(?:[.,](\d+))?)?(Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)\z"
_NUMBER = r"(?U)^[\s\x{1c}-\x{1f}]*[+-]?(?:\p{Nd}+(?:\.\p{Nd}*)?|\.\p{Nd}+)(?:[eE][+-]?\p{Nd}+)?[\s\x{1c}-\x{1f}]*\z"
_BELOW_ZERO = r"(?U)^[\s\x{1c}-\x{1f}]*-[^eE]*[\p{Nd}&&[^0\x{ff10}\x{660}]]"
_NOT_BLANK = r"(?U)[^\s\x{1c}-\x{1f}]"


def computed_once(value: Column) -> Column:
    """The value, by way of a list of one. A later filter on it then runs on the result: pushed through projections, it
    would repeat every shared expression below in one huge predicate that is never compiled to machine code."""
    return F.explode_outer(F.array(value))


def _type(v: Column, name: str) -> Column:
    """The kind of a field's JSON value; a missing field counts as VOID, like null."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.coalesce(kind, F.lit("VOID"))


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def whole_json(raw: Column) -> Column:
    """The parsed payload, or null where it isn't exactly one JSON value (text behind the value included).

    The parser stops behind the first value, so a stray text would pass; inside either wrapper it doesn't.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    return F.when(boxed.isNotNull() & ~raw.startswith("\ufeff"), F.try_variant_get(named, "$.v", "variant"))


def _utc_time(parts: Column, text: Column) -> Column:
    """The time whose parts are [date, hours and minutes, seconds, fraction, zone], as UTC without zone."""
    local = F.concat(
        parts[0],
        F.lit(" "),
        parts[1],
        F.when(parts[2] == "", ":00").otherwise(parts[2]),
        F.when(parts[3] == "", "").otherwise(F.concat(F.lit("."), F.substring(parts[3], 1, 6))),
    )
    zone = F.translate(parts[4], ":", "")
    minutes = F.when(zone == "Z", 0).otherwise(
        (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
    )
    return F.when(text.rlike(_TIME) & ~parts[0].startswith("0000"), local.try_cast("timestamp_ntz") - F.make_dt_interval(mins=minutes))


def _time_parts(text: Column) -> Column:
    """One match instead of five: the groups are joined by a character that can't occur in them, then split."""
    return F.split(F.when(text.rlike(_TIME), F.regexp_replace(text, _TIME, "$1|$2|$3|$4|$5")), "[|]")


def _tidy_price(text: Column) -> Column:
    """A price text trimmed, without underscores, plus and needless zeros before the point."""
    given = F.regexp_replace(F.translate(text, "_", ""), r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+\z", "")
    # full-width digits are decimal digits too
    ascii_ = F.upper(F.translate(given, "０１２３４５６７８９", "0123456789"))
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_, r"^\+", ""), r"^(-?)0+(?=\d)", "$1"), r"^(-?)\.", "$10.")
    return F.regexp_replace(F.regexp_replace(tidy, r"\.(?=\z|E)", ""), r"E(?=\d)", "E+")


#: A price text that is tidy as it stands: the usual case takes no further expression.
_PLAIN_PRICE = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"


def _reasons(keys: Column, kind: dict[str, Column], text: dict[str, Column], number: Column, version: Column, time: Column, value: Column) -> Column:
    """All contract violations of a JSON object, as texts; empty if it is fine."""
    event = text["event_type"]
    is_text = lambda f: kind[f] == "STRING"
    known = F.coalesce(is_text("event_type") & event.isin(*TOPIC_OF), F.lit(False))
    whole = kind["quantity"] == "BIGINT"
    price_kind = kind["price"]
    price_is_number = (price_kind == "BIGINT") | price_kind.startswith("DECIMAL") | price_kind.isin("DOUBLE", "FLOAT")
    price = F.translate(text["price"], "_", "")
    price_ok = (
        F.when(price_kind == "VOID", True)
        .when(is_text("price"), price.rlike(_PLAIN_PRICE) | price.rlike(_NUMBER))
        .when(price_is_number, value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
        .otherwise(False)
    )
    negative = F.when(is_text("price"), price.contains("-") & price.rlike(_BELOW_ZERO)).when(price_is_number, value < 0).otherwise(False)
    filled = lambda f: is_text(f) & text[f].rlike(_NOT_BLANK)

    def rule(bad: Column, why: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(why))

    found = [
        rule(F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0, "payload: unknown field"),
        rule(~(is_text("event_id") & text["event_id"].rlike(UUID_SPELLINGS)), "event_id: not a UUID"),
        rule(~known, "event_type: not one of the known types"),
        *(rule(~kind[f].isin("STRING", "VOID"), f"{f}: not a text") for f in ("customer_id", "product_id", "order_id", "country", "query")),
        rule(~((kind["quantity"] == "VOID") | (whole & number.between(_INT_MIN, _INT_MAX))), "quantity: not an integer of 32 bits"),
        rule(~price_ok, "price: not a finite decimal number"),
        rule(~(is_text("event_timestamp") & time.isNotNull()), "event_timestamp: not an ISO time with a zone"),
        rule(~((kind["schema_version"] == "BIGINT") & (version == 1)), "schema_version: not the integer 1"),
        rule(known & event.isin(*NEEDS_PRODUCT) & ~filled("product_id"), "product_id: needed for this event type"),
        rule(known & event.isin(*NEEDS_QUANTITY) & ~F.coalesce(whole & (number > 0), F.lit(False)), "quantity: must be positive"),
        rule(price_ok & negative, "price: below zero"),
        rule(known & (event == "purchase") & ~filled("order_id"), "order_id: needed for a purchase"),
        rule(known & (event == "purchase") & (price_kind == "VOID"), "price: needed for a purchase"),
    ]
    return F.array_compact(F.array(*found))


def parse_events(raw: DataFrame, payload: str = "raw_payload", out: str = "event") -> DataFrame:
    """All columns of ``raw`` (but one named like ``out``) and ``out``: a struct of the typed fields (null where they fail), error_type, error_message.

    Each step is a projection of its own, so that a value used by several rules is computed once per row.
    """
    h = free_prefix(raw.columns)
    v = F.col(f"{h}v")
    kind, text = {f: F.col(f"{h}k_{f}") for f in FIELDS}, {f: F.col(f"{h}t_{f}") for f in FIELDS}
    step = raw.withColumns({f"{h}v": whole_json(F.col(f"`{payload}`")), f"{h}keys": F.json_object_keys(F.col(f"`{payload}`"))})
    step = step.withColumns({f"{h}k_{f}": _type(v, f) for f in FIELDS} | {f"{h}t_{f}": _text(v, f) for f in FIELDS})
    step = step.withColumns(
        {
            f"{h}number": F.try_variant_get(v, "$.quantity", "bigint"),
            f"{h}version": F.try_variant_get(v, "$.schema_version", "bigint"),
            f"{h}value": F.try_variant_get(v, "$.price", "double"),
            f"{h}parts": _time_parts(text["event_timestamp"]),
        }
    ).withColumn(f"{h}time", _utc_time(F.col(f"{h}parts"), text["event_timestamp"]))
    keys = F.col(f"{h}keys")
    shape = F.when(v.isNull(), F.array(F.lit("payload: not one JSON value"))).when(keys.isNull(), F.array(F.lit("payload: not a JSON object")))
    why = F.coalesce(shape, _reasons(keys, kind, text, F.col(f"{h}number"), F.col(f"{h}version"), F.col(f"{h}time"), F.col(f"{h}value")))
    with_v = step.withColumn(f"{h}why", why).withColumn(f"{h}ok", F.size(f"{h}why") == 0)
    ok = F.col(f"{h}ok")
    price = F.when(text["price"].rlike(_PLAIN_PRICE), text["price"]).otherwise(_tidy_price(text["price"]))
    fields = {
        "event_id": F.when(ok, canonical_uuid(text["event_id"])).otherwise(F.when(kind["event_id"] == "STRING", text["event_id"])),
        **{f: F.when(ok, text[f]) for f in ("event_type", "customer_id", "product_id", "order_id")},
        "quantity": F.when(ok, F.col(f"{h}number").try_cast("int")),
        "price": F.when(ok & (kind["price"] != "VOID"), price),
        **{f: F.when(ok, text[f]) for f in ("country", "query")},
        "event_timestamp": F.when(ok, F.col(f"{h}time")),
        "schema_version": F.when(ok, F.lit(1)),
        "error_type": F.when(~ok, F.lit(SCHEMA_VALIDATION)),
        "error_message": F.when(~ok, F.array_join(f"{h}why", "; ")),
    }
    made = computed_once(F.struct(*(c.alias(n) for n, c in fields.items())))
    return with_v.select(*(F.col(f"`{c}`") for c in raw.columns if c != out), made.alias(out))


def expected_topic(event_type: Column) -> Column:
    return F.coalesce(*(F.when(event_type == e, F.lit(t)) for e, t in TOPIC_OF.items()))


def classify(
    raw: DataFrame, payload: str = "raw_payload", topic: str = "topic", ingested: str = "ingestion_timestamp", price_type: str | None = None, grace: str = "INTERVAL 30 MINUTES"
) -> DataFrame:
    """Source columns, the event fields, error_type and error_message, in the order schema, topic, representation, late.

    ``price_type`` 'decimal(p,s)' rejects prices that an older table of that type can't hold exactly.
    Names of event fields must not occur among the source columns (ValueError otherwise).
    """
    if clash := set(raw.columns) & {*FIELDS, "error_type", "error_message"}:
        raise ValueError(f"source columns clash with event fields: {sorted(clash)}")
    e = F.col("event")
    wanted = expected_topic(e["event_type"])
    wrong_topic = e["error_type"].isNull() & ~F.col(topic).eqNullSafe(wanted)
    unfit = F.lit(False)
    if price_type:
        as_exact, as_stored = e["price"].try_cast("decimal(38,18)"), e["price"].try_cast(price_type)
        unfit = e["price"].isNotNull() & ~F.coalesce(as_exact == as_stored, F.lit(False))
    late = e["event_timestamp"] < F.col(ingested).cast("timestamp_ntz") - F.expr(grace)
    kind = F.coalesce(e["error_type"], F.when(wrong_topic, TOPIC_MISMATCH), F.when(unfit, SILVER_REPRESENTATION), F.when(late, LATE_EVENT))
    why = F.coalesce(
        e["error_message"],
        F.when(wrong_topic, F.concat(e["event_type"], F.lit(" belongs to "), wanted)),
        F.when(unfit, F.lit(f"price does not fit {price_type}")),
        F.when(late, F.lit("event time is more than 30 minutes before ingestion")),
    )
    price = F.when(unfit, None).otherwise(e["price"])
    fields = [F.col("event")[f].alias(f) if f != "price" else (price.try_cast(price_type) if price_type else price).alias("price") for f in FIELDS]
    return parse_events(raw, payload).select(*(F.col(f"`{c}`") for c in raw.columns), *fields, kind.alias("error_type"), why.alias("error_message"))
