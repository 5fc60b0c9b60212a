"""The fused audit, funnels and payloads on small tables."""

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.operators.audit import Dated, Known, Missing, Unique, Within, audit_table
from tidemark.operators.funnel import funnel
from tidemark.plans import payloads


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(1, "a", 5.0, "2020-01-01", 1), (1, "a", -1.0, "2021-05-05", 9), (2, " ", 99.0, None, None), (None, "b", None, "1999-12-31", 9), (3, None, 7.0, "2020-02-02", 8), (1, "b", 1.0, "2020-01-01", 2)]
    child = spark.createDataFrame(rows, "k int, name string, x double, d string, p int").withColumn("d", F.col("d").cast("date"))
    return {"child": child, "parent": spark.createDataFrame([(1,), (2,), (None,), (2,)], "id int")}


RULES = [Missing("name"), Unique(("k",)), Unique(("k", "name")), Known("p", "parent", "id"), Within("x", 0, 50), Dated("d", "2020-12-31")]


def found(df):
    return {(r.check_name, r.metric): r.actual for r in df.collect()}


def test_findings_are_those_of_the_single_checks(tables):
    c = tables["child"]
    got = found(audit_table(c, "child", RULES, tables.get))
    for keys in (["k"], ["k", "name"]):
        want = quality.key_check(c, "child", keys).first()
        assert [got["+".join(keys) + "_unique", m] for m in ("null_key_rows", "duplicate_groups", "excess_rows")] == [want.null_key_rows, want.duplicate_groups, want.excess_rows]
    want = quality.reference_check(c, tables["parent"], "p", "id", "r").first()
    assert [got["p_in_parent", m] for m in ("checked_rows", "orphan_rows", "orphan_keys")] == [want.checked_rows, want.orphan_rows, want.orphan_keys]
    want = {r.column_name: r.missing_count for r in quality.missingness(c, "child").collect()}
    assert got["name_present", "missing_rows"] == want["name"] == 2
    assert (got["x_in_range", "below_rows"], got["x_in_range", "above_rows"], got["table", "row_count"]) == (1, 1, 6)
    assert got["d_not_later", "future_rows"] == 1 and got["d_not_later", "first_day"] == (date(1999, 12, 31) - date(1970, 1, 1)).days
    assert got["d_not_later", "last_day"] == (date(2021, 5, 5) - date(1970, 1, 1)).days


def test_an_empty_table_has_no_findings(tables):
    got = found(audit_table(tables["child"].limit(0), "child", RULES, tables.get))
    assert all(v == 0 for (c, m), v in got.items() if m not in ("first_day", "last_day"))


def test_one_scan_gives_all_findings(spark, tmp_path, tables):
    tables["child"].write.parquet(f"{tmp_path}/child")
    c = spark.read.parquet(f"{tmp_path}/child")
    plan = audit_table(c, "child", [r for r in RULES if not isinstance(r, Known)], tables.get)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_funnel_counts_each_row_at_its_deepest_stage(spark):
    d = spark.createDataFrame([("a", True, True), ("a", True, None), ("a", False, True), ("b", None, True)], "g string, x boolean, y boolean")
    got = {(r.g, r.stage): (r.place, r.passed, r.dropped, r.share_pct) for r in funnel(d, {"x": F.col("x"), "y": F.col("y")}, ["g"]).collect()}
    assert got == {("a", "all"): (0, 3, 0, 100.0), ("a", "x"): (1, 2, 1, 66.6667), ("a", "y"): (2, 1, 1, 33.3333), ("b", "all"): (0, 1, 0, 100.0), ("b", "x"): (1, 0, 1, 0.0), ("b", "y"): (2, 0, 0, 0.0)}
    assert [r.passed for r in funnel(d.limit(0), {"x": F.col("x")}).collect()] == [0, 0]


def test_payloads_are_safe_json(spark):
    d = spark.createDataFrame([(Decimal("1.50"), date(2020, 1, 2), datetime(2020, 1, 2, 3, 4, 5), float("nan"), [Decimal("2.25")], {"a": date(2021, 1, 1)})], "m decimal(9,2), d date, t timestamp, x double, l array<decimal(9,2)>, o map<string,date>")
    got = json.loads(payloads.document(n=F.lit(3), one=payloads.single(d), none=payloads.single(d.limit(0)), rows=payloads.listed(d, ["m"])).first().payload)
    row = {"m": 1.5, "d": "2020-01-02", "t": "2020-01-02T03:04:05.000000", "x": None, "l": [2.25], "o": {"a": "2021-01-01"}}
    assert got == {"n": 3, "one": row, "none": None, "rows": [row]}


def test_parts_keep_their_order_and_their_limit(spark):
    d = spark.range(30).select((F.col("id") * 7 % 30).alias("v"))
    assert [x["v"] for x in json.loads(payloads.document(r=payloads.listed(d, [F.desc("v")])).first().payload)["r"]] == list(range(29, -1, -1))
    with pytest.raises(Exception, match="too many rows"):
        payloads.document(r=payloads.listed(d, ["v"], 10)).collect()


@pytest.mark.parametrize(("call", "error"), [
    (lambda d: payloads.transfers(d, d, 7), ValueError), (lambda d: payloads.transfers(d, d, "x"), ValueError), (lambda d: payloads.transfers(d, d, 12, "cheap"), ValueError),
    (lambda d: payloads.team(d, {}, {}, 3), ValueError), (lambda d: payloads.team(d, {"season": 1997}, {"season": {1997}}, -3), ValueError),
    (lambda d: payloads.team(d, {"season": 1900}, {"season": {1997}}, 3), ValueError), (lambda d: payloads.team(d, {"season": 1997}, {"season": {1997}}, 3), LookupError),
])
def test_bad_parameters_are_errors(spark, call, error):
    d = spark.createDataFrame([], "valid_appearances bigint, season_key int, club_key bigint")
    with pytest.raises(error):
        call(d)
