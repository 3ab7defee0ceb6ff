from decimal import Decimal

import pytest

from tests.test_contract import raw
from tidemill.operators import parse

OK = '536365,85123A,"A ""big"" one, really",6,2010-12-01 08:26:00,2.55,17850,United Kingdom'


def kinds(spark, rows):
    frame = spark.createDataFrame([(i, f, t, "old", "old") for i, (f, t) in enumerate(rows)], "record_id long, record_format string, raw_payload string, error_type string, error_message string")
    return [(r.error_type, r.loaded_invoice, r.loaded_event) for r in parse.classify_records(frame).orderBy("record_id").collect()]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (OK, None), ('"a","b","","1","2010-12-01 08:26:00","0","",""', None), ("a,b,,-7,2010-12-01 08:26:00,.5,,", None), ('a,b,"x\ny",+3,2010-12-01 08:26:00,0,,', None),
        ("a,b," + "x" * 300_000 + ",1,2010-12-01 08:26:00,1,,", None), ("a,b,c,1,2010-12-01 08:26:00,1,", "COLUMN_COUNT"), (OK + ",", "COLUMN_COUNT"), ("a;b;c", "COLUMN_COUNT"),
        ('a,b,"open,1,2010-12-01 08:26:00,1,,', "BROKEN_QUOTING"), ('a,b,5" wide,1,2010-12-01 08:26:00,1,,', "BROKEN_QUOTING"), ('a,b,"x" y,1,2010-12-01 08:26:00,1,,', "BROKEN_QUOTING"),
        ('a,b,"x "y" z",1,2010-12-01 08:26:00,1,,', "BROKEN_QUOTING"), ("a,b,x\ny,1,2010-12-01 08:26:00,1,,", "BROKEN_QUOTING"), (",b,c,1,2010-12-01 08:26:00,1,,", "INVALID_VALUE"),
        ("a,,c,1,2010-12-01 08:26:00,1,,", "INVALID_VALUE"), ('a,"",c,1,2010-12-01 08:26:00,1,,', "INVALID_VALUE"), ("a,b,c,1.5,2010-12-01 08:26:00,1,,", "INVALID_VALUE"),
        ("a,b,c,2147483648,2010-12-01 08:26:00,1,,", "INVALID_VALUE"), ("a,b,c,,2010-12-01 08:26:00,1,,", "INVALID_VALUE"), ("a,b,c,1,2010-02-30 08:26:00,1,,", "INVALID_VALUE"),
        ("a,b,c,1,2010-12-01T08:26:00,1,,", "INVALID_VALUE"), ("a,b,c,1,2010-12-01 24:00:00,1,,", "INVALID_VALUE"), ("a,b,c,1,2010-12-01 08:26:00,-1,,", "INVALID_VALUE"),
        ('a,b,c,1,2010-12-01 08:26:00,"1,5",,', "INVALID_VALUE"), ("a,b,c,1,2010-12-01 08:26:00,NaN,,", "INVALID_VALUE"), ("a,b,c,1,2010-12-01 08:26:00, 1,,", "INVALID_VALUE"),
        ("", "EMPTY_RECORD"), (None, "EMPTY_RECORD"), ("," * 30_000, "COLUMN_COUNT"),
    ],
)
def test_csv(spark, text, error):
    [(kind, invoice, event)] = kinds(spark, [("csv", text)])
    assert kind == error and (invoice is not None) == (error is None) and event is None


def test_values_come_out(spark):
    [(_, invoice, _)] = kinds(spark, [("csv", OK)])
    assert invoice.Description == 'A "big" one, really' and invoice.Quantity == 6 and invoice.UnitPrice == "2.55" and invoice.UnitPriceValue == Decimal("2.55")


def test_no_price_is_lost(spark):
    """Prices beyond any decimal type, of many digits and with an exponent load as they stand."""
    prices = ["1e20", "1234567890123.5", "0.1234567", "1e400", "." + "3" * 60, "-0.0"]
    got = kinds(spark, [("csv", f"a,b,c,1,2010-12-01 08:26:00,{p},,") for p in prices])
    assert [g[0] for g in got] == [None] * len(prices) and [g[1].UnitPrice for g in got] == prices
    value = [g[1].UnitPriceValue for g in got]
    assert value[1:3] == [Decimal("1234567890123.5"), Decimal("0.1234567")] and value[3] is None and value[4] == Decimal("0." + "3" * 18)


def test_many_commas(spark):
    """More commas than the reader has room for: quoted they load, bare they don't."""
    commas = "," * 50_000
    got = kinds(spark, [("csv", f'a,b,"{commas}",1,2010-12-01 08:26:00,1,,'), ("csv", f'a,b,"{commas},1,2010-12-01 08:26:00,1,,'), ("csv", commas)])
    assert [g[0] for g in got] == [None, "BROKEN_QUOTING", "COLUMN_COUNT"] and got[0][1].Description == commas


def test_what_the_reader_forgives(spark):
    """Text behind a JSON value, single quotes and trailing commas fail; blanks around a value and any field order don't."""
    good = raw()
    got = kinds(spark, [("json", good + " x"), ("json", good.replace('"', "'")), ("json", good[:-1] + ",}"), ("json", f" {good}\n"), ("json", good + good), ("json", "[" + good + "]")])
    assert [g[0] for g in got] == ["MALFORMED_JSON"] * 3 + [None] + ["MALFORMED_JSON"] * 2


def test_json_and_formats(spark):
    got = kinds(spark, [("json", raw()), ("json", raw(quantity="2")), ("json", "{"), ("json", "[]"), ("json", None), ("xml", "<a/>"), (None, "x")])
    assert [g[0] for g in got] == [None, "SCHEMA_VALIDATION", "MALFORMED_JSON", "MALFORMED_JSON", "EMPTY_RECORD", "UNKNOWN_FORMAT", "UNKNOWN_FORMAT"]
    assert got[0][2].quantity == 2 and all(g[2] is None for g in got[1:])


def test_every_row_is_on_one_side(spark):
    frame = spark.createDataFrame([(1, "csv", OK), (2, "csv", "a"), (3, None, None)], "record_id long, record_format string, raw_payload string")
    assert parse.rejected(frame).count() == 2 and parse.loaded(frame).count() == 1 and parse.rejected(frame.limit(0)).count() == 0


def test_clashing_columns(spark):
    names = ("event", "__v", "__rec", "__json", "__raw", "__row", "__k_price", "__why_csv", "loaded_event", "__kind", "__record")
    frame = spark.createDataFrame([(1, "csv", OK, *range(len(names))), (2, "json", raw(), *range(len(names)))], "record_id long, record_format string, raw_payload string, " + ", ".join(f"{n} int" for n in names))
    got = parse.classify_records(frame).orderBy("record_id").collect()
    assert [r.error_type for r in got] == [None, None] and got[0]["event"] == 0 and got[1]["__record"] == 10 and got[1].loaded_event.quantity == 2
