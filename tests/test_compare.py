from decimal import Decimal

from tidemill.operators import compare


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def got(frame, *keys):
    return sorted((*(str(r[k]) for k in keys), r.field_name) for r in frame.collect())


def test_values_and_sides(spark):
    a = rows(spark, [("1", 2, Decimal("1.50"), None), ("2", 1, Decimal("3.00"), "x"), ("3", 1, Decimal("1.00"), "y"), ("3", 1, Decimal("1.00"), "y")], "k string, q int, p decimal(12,2), t string")
    b = rows(spark, [("1", 2, Decimal("1.5000"), None), ("2", 1, Decimal("3.0001"), None), ("4", 1, None, None)], "k string, q long, p decimal(14,4), t string")
    assert got(compare.differences(a, b, "k"), "k") == [("2", "p"), ("2", "t"), ("3", "only_in_base"), ("4", "only_in_copy")]


def test_repeats_are_no_difference_unless_asked(spark):
    a = rows(spark, [("1", 1), ("1", 1)], "k string, v int")
    b = rows(spark, [("1", 1)], "k string, v int")
    assert got(compare.differences(a, b, "k"), "k") == []
    assert got(compare.differences(a, b, "k", repeats=True), "k") == [("1", "row_count")]
    left = compare.except_all(a, b).collect()
    assert [(r.k, r["__side"], r["__times"]) for r in left] == [("1", "base", 1)]


def test_null_keys_empty_tables_and_ambiguous_keys(spark):
    ddl = "k string, v int"
    none = rows(spark, [], ddl)
    a = rows(spark, [(None, 1), ("1", 1)], ddl)
    assert got(compare.differences(a, none, "k"), "k") == [("1", "only_in_base"), ("None", "only_in_base")]
    assert got(compare.differences(rows(spark, [("1", 1), ("1", 2)], ddl), none, "k"), "k") == [("1", "distinct_rows"), ("1", "only_in_base")]
    assert got(compare.differences(none, none, "k"), "k") == []
    assert got(compare.differences(a, rows(spark, [(None, 2), ("1", 1)], ddl), "k"), "k") == [("None", "v")]
    many = rows(spark, [("1", 1), ("1", 2)], ddl)
    assert got(compare.differences(many, rows(spark, [("1", 3)], ddl), "k"), "k") == [("1", "distinct_rows"), ("1", "v")]


def test_extra_and_clashing_columns(spark):
    a = rows(spark, [("1", 1, 5)], "k string, c0 int, n_base int")
    b = rows(spark, [("1", 2, 9)], "k string, c0 int, other int")
    assert compare.columns_apart(a, b) == {"only_in_base": ["n_base"], "only_in_copy": ["other"]}
    assert got(compare.differences(a, b, "k"), "k") == [("1", "c0")]


def test_several_key_columns(spark):
    a = rows(spark, [(1, 1, "a"), (1, 2, "b")], "x int, y int, v string")
    b = rows(spark, [(1, 1, "z"), (1, 2, "b")], "x int, y int, v string")
    found = compare.differences(a, b, ["x", "y"]).collect()
    assert [(r.x, r.y, r.field_name, r.base_value, r.copy_value) for r in found] == [(1, 1, "v", "a", "z")]
