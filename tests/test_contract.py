import json
from datetime import datetime as D

import pytest

from tidemill.functions import contract

GOOD = {
    "event_id": "5021dc2f-001f-4627-a4be-0b543624c791", "event_type": "purchase", "customer_id": "C1", "product_id": "P1", "order_id": "O1", "quantity": 2,
    "price": "1.005", "country": None, "query": None, "event_timestamp": "2026-10-04T12:00:00+05:30", "schema_version": 1,
}
DROP = object()


def raw(**changes):
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if v is not DROP})


BAD = [
    raw(event_id="x"), raw(event_id=5), raw(event_id=None), raw(event_id=DROP), raw(event_type="Purchase"), raw(event_type=None), raw(event_type=3),
    raw(customer_id=1), raw(country=False), raw(query=[1]), raw(order_id={}), raw(quantity=0), raw(quantity=-1), raw(quantity=1.5), raw(quantity=2.0), raw(quantity=True),
    raw(quantity="2"), raw(quantity=2**31), raw(quantity=10**25), raw(quantity=None), raw(price=None), raw(price=DROP), raw(price="NaN"), raw(price="Infinity"), raw(price="-0.01"),
    raw(price=-1), raw(price=""), raw(price="abc"), raw(price="1,5"), raw(price=True), raw(price="0x1"), raw(price=1e400), raw(schema_version=2), raw(schema_version=True),
    raw(schema_version="1"), raw(schema_version=1.0), raw(schema_version=DROP), raw(extra=None), raw(Country="x"), raw(product_id=""), raw(product_id="\t "), raw(product_id=None),
    raw(order_id=" "), raw(order_id=DROP), raw(event_timestamp=0), raw(event_timestamp="0"), raw(event_timestamp=None), raw(event_timestamp="2026-10-04T12:00:00"),
    raw(event_timestamp="2026-10-04"), raw(event_timestamp="2026-02-30T00:00:00Z"), raw(event_timestamp="2026-10-04T24:00:00Z"), raw(event_timestamp="2026-10-04T12:00:60Z"),
    raw(event_timestamp="2026-10-04T12:00:00+05"), raw(event_timestamp="2026-10-04T12:00:00 UTC"), raw(event_timestamp="2026-10-04T12:00:00+24:00"), raw(event_timestamp="10000-10-04T12:00:00Z"),
    raw(event_timestamp="0000-10-04T12:00:00Z"), raw(event_timestamp="20261004T120000Z"), raw(event_timestamp="2026-10-04t12:00:00z"),
    "{broken", "[]", "null", '"text"', "", None, raw() + "}", raw() + "]", raw() + " x", "[" + raw() + "]", "\ufeff" + raw(), raw()[:-1] + ",}", raw().replace('"', "'"), raw() + raw(),
]
FINE = [
    raw(), "  " + raw() + " ", raw(price="1.10"), raw(price=1), raw(price=1.25), raw(price=" 1.5 "), raw(price=".5"), raw(price="5."), raw(price="+1"), raw(price="1e3"), raw(price="1_000"),
    raw(price="-0"), raw(price="１"), raw(price="0.1234567890123456789012345"), raw(customer_id=DROP), raw(quantity=2**31 - 1), raw(event_id=GOOD["event_id"].upper()),
    raw(event_id="{" + GOOD["event_id"] + "}"), raw(event_timestamp="2026-10-04T12:00Z"), raw(event_timestamp="2026-10-04 12:00:00,123Z"), raw(event_timestamp="2026-10-04_12:00:00.1234567-23:59"),
    raw(event_timestamp="2026-10-04T12:00:00+0530"), raw(event_type="search", product_id=None, order_id=None, quantity=None, price=None),
    raw(event_type="checkout", quantity=-5), raw(event_type="inventory_update", price=None), raw(event_type="product_view", quantity=None), raw(country="x" * 100_000),
]


def test_verdicts(spark):
    rows = [(i, t, i >= len(BAD)) for i, t in enumerate(BAD + FINE)]
    frame = spark.createDataFrame(rows, "i int, raw_payload string, fine boolean")
    wrong = [(r.raw_payload[:90] if r.raw_payload else r.raw_payload, r.event.error_message) for r in contract.parse_events(frame).collect() if (r.event.error_type is None) != r.fine]
    assert wrong == []


@pytest.mark.parametrize(
    ("given", "text"),
    [("1.10", "1.10"), (1.5, "1.5"), (" 1.5 ", "1.5"), (".5", "0.5"), ("5.", "5"), ("+1", "1"), ("1e3", "1E+3"), ("1_000", "1000"), ("１", "1"), ("007.50", "7.50"), ("-0", "-0"), (None, None)],
)
def test_price_text(spark, given, text):
    row = contract.parse_events(spark.createDataFrame([(raw(event_type="payment", price=given),)], "raw_payload string")).first()
    assert row.event.error_type is None and row.event.price == text


@pytest.mark.parametrize(
    ("given", "utc"),
    [
        ("2026-10-04T12:00:00+05:30", D(2026, 10, 4, 6, 30)), ("2026-10-04T12:00Z", D(2026, 10, 4, 12)), ("2026-10-04 12:00:00,5-0100", D(2026, 10, 4, 13, 0, 0, 500_000)),
        ("2026-10-04T00:00:00.1234569Z", D(2026, 10, 4, 0, 0, 0, 123_456)), ("2026-10-04T12:00:00+23:59", D(2026, 10, 3, 12, 1)),
    ],
)
def test_time(spark, given, utc):
    row = contract.parse_events(spark.createDataFrame([(raw(event_timestamp=given),)], "raw_payload string")).first()
    assert row.event.event_timestamp == utc


def test_duplicate_keys_last_wins(spark):
    text = raw()[:-1] + ', "quantity": 7}'
    assert contract.parse_events(spark.createDataFrame([(text,)], "raw_payload string")).first().event.quantity == 7


def test_precedence_topic_representation_late(spark):
    t = D(2026, 10, 4, 7, 0)  # exactly 30 minutes after
    rows = [
        (raw(), "order-events", t), (raw(), "order-events", D(2026, 10, 4, 7, 0, 0, 1)), (raw(), "customer-events", D(2030, 1, 1)), (raw(), None, t), ("{", "order-events", t),
        (raw(price="1.200"), "order-events", t), (raw(price="10000000000.00"), "order-events", t),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw_payload string, topic string, ingestion_timestamp timestamp_ntz")
    kinds = [r.error_type for r in contract.classify(frame).orderBy("i").collect()]
    assert kinds == [None, "LATE_EVENT", "TOPIC_MISMATCH", "TOPIC_MISMATCH", "SCHEMA_VALIDATION", None, None]
    stored = contract.classify(frame, price_type="decimal(12,2)").orderBy("i").collect()
    assert [r.error_type for r in stored] == ["SILVER_REPRESENTATION"] * 2 + ["TOPIC_MISMATCH"] * 2 + ["SCHEMA_VALIDATION", None, "SILVER_REPRESENTATION"]
    with pytest.raises(ValueError):
        contract.classify(frame.withColumnRenamed("i", "country"))
