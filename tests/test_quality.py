from pyspark.sql import functions as F

from tidemark.operators import quality as Q


def test_missingness_counts_blanks(spark):
    d = spark.createDataFrame([(1, " "), (2, None), (3, "x")], "a int, b string")
    assert {(r.column_name, r.missing_count) for r in Q.missingness(d, "t").collect()} == {("a", 0), ("b", 2)}


def test_keys(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, " "), (None, "x"), (3, "y")], "a int, b string")
    r = Q.key_check(d, "t", ["a", "b"]).first()
    assert (r.null_key_rows, r.duplicate_groups, r.excess_rows) == (2, 1, 2)


def test_empty_table(spark):
    d = spark.createDataFrame([], "a int, b string")
    assert Q.key_check(d, "t", ["a"]).first().excess_rows == 0
    assert Q.missingness(d, "t").count() == 2
    assert Q.reference_check(d, d, "a", "a", "r").first().status == "PASS"


def test_references(spark):
    c, p = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (2,)], "k int")
    r = Q.reference_check(c, p, "k", "k", "r").first()
    assert (r.checked_rows, r.orphan_rows, r.orphan_keys, r.status) == (3, 2, 1, "REVIEW")


def test_dates_and_numbers(spark):
    d = spark.createDataFrame([("2020-01-01",), ("2020-13-01",), ("x",), (" ",), ("2030-01-01",)], "x string")
    r = Q.date_check(d, "x", "c", "2025-01-01").first()
    assert (r.missing_rows, r.invalid_rows, r.future_rows, str(r.maximum_date)) == (1, 2, 1, "2030-01-01")
    n = spark.createDataFrame([("5",), ("-1",), ("200",), ("x",), (None,)], "x string")
    r = Q.number_check(n, "x", "c", 0, 100).first()
    assert (r.missing_rows, r.invalid_rows, r.below_rows, r.above_rows) == (1, 1, 1, 1)


def test_ledger_lets_null_pass(spark):
    d = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    rows = {r.check_name: (r.actual, r.status) for r in Q.contracts([("bad", d.where(~(F.col("x") > 0))), ("good", d.where("x > 5"))]).collect()}
    assert rows == {"bad": (1, "FAIL"), "good": (0, "PASS")}


def test_mapping_takes_null_for_empty(spark):
    d, m = spark.createDataFrame([(None,), ("a",), ("b",)], "k string"), spark.createDataFrame([("",), ("a",)], "k string")
    assert {(r.k, r.is_mapped) for r in Q.mapping_coverage(d, m, ["k"]).collect()} == {(None, True), ("a", True), ("b", False)}


def test_ledger_has_notes_and_an_exit_status(spark):
    none, some = spark.range(0), spark.range(2)
    fine = Q.contracts([("a", none)], [("n", some)])
    assert {r.check_name: (r.expected, r.actual, r.status) for r in fine.collect()} == {"a": (0, 0, "PASS"), "n": (None, 2, "INFO")}
    assert Q.exit_status(fine) == 0 and Q.exit_status(Q.contracts([("a", none), ("b", some)])) == 1


def test_page_size_and_filters():
    import pytest

    from tidemark.plans.dashboard import checked, page_size

    assert [page_size(n) for n in (None, 0, 5, 50, 5000)] == [600, 10, 10, 50, 2000]
    assert checked({"season": 1997, "position": ""}, {"season": {1997}}) == {"season": 1997}
    for bad in ({"season": 1890}, {"club": 1}):
        with pytest.raises(ValueError, match="unsupported"):
            checked(bad, {"season": {1997}})


def test_adequate_periods(spark):
    rows = [("a", k, n, 1) for k, n in enumerate([10, 10, 8, 10, 9])] + [("b", k, 5, int(k > 1)) for k in range(5)]
    d = Q.period_coverage(spark.createDataFrame(rows, "g string, p int, n int, c int"), "g", "p", "n", "c")
    assert {(r.g, r.p) for r in d.where("coverage_status = 'REVIEW'").collect()} == {("a", 2), ("b", 0), ("b", 1)}
    assert [r.p for r in Q.common_periods(d, "g", "p", ["a", "b"]).collect()] == [4, 3]
