import gzip

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.sources.files import header_of, markdown, read_csv, write_csv, write_table


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write('﻿a,b\n1,"two\nlines"\n,"say ""x"""\n"  ",\n')
    rows = read_csv(spark, str(path)).orderBy("_source_row_number").collect()
    assert [(r.a, r.b, r._source_row_number) for r in rows] == [("1", "two\nlines", 1), (None, 'say "x"', 2), ("  ", None, 3)]


@pytest.mark.parametrize("head", ["a,a", "a,,b"])
def test_bad_headers(spark, tmp_path, head):
    (tmp_path / "x.csv").write_text(head + "\n1,2,3\n")
    with pytest.raises(ValueError):
        header_of(spark, str(tmp_path / "x.csv"))


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, True, None), (2, False, "x|y")], "a int, b boolean, c string")
    write_csv(d, str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("part-*")).read_text()
    assert text.splitlines()[0] == "a,b,c" and "1,true," in text
    assert "| 1 | true |  |" in markdown(d)
    write_table(d, str(tmp_path / "t"), sort=["a"])
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        write_table(d, str(tmp_path / "t"))
    write_table(d, str(tmp_path / "t"), replace=True)


def test_json_and_markdown(spark, tmp_path):
    from tidemark.sources.files import markdown, write_json

    d = spark.createDataFrame([(1, "a|b", True), (2, None, False)], "k int, t string, f boolean")
    write_json(d, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in spark.read.schema(d.schema).json(str(tmp_path / "out")).collect()) == sorted(map(tuple, d.collect()), key=lambda r: r[0])
    assert markdown(d) == "| k | t | f |\n| --- | --- | --- |\n| 1 | a\\|b | true |\n| 2 |  | false |"
    with pytest.raises(ValueError, match="too many"):
        markdown(d, 1)


def test_manifest_tells_every_kind_of_difference(spark, tmp_path):
    import hashlib

    from tidemark.sources.files import manifest_check

    for name in ("good", "changed", "extra"):
        (tmp_path / name).write_text(name)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = spark.createDataFrame([("good", 4, sha("good").upper()), ("changed", 7, sha("before")), ("absent", 1, sha("x"))], "file_name string, bytes int, sha256 string")
    got = {r.file_name: r.status for r in manifest_check(spark, str(tmp_path), listed).collect()}
    assert got == {"good": "MATCH", "changed": "MISMATCH", "absent": "MISSING", "extra": "UNLISTED"}


def test_model_tables_are_not_overwritten(spark, tmp_path):
    from tidemark.sources.files import write_table

    d = spark.range(3)
    write_table(d, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        write_table(d, str(tmp_path / "t"))
    write_table(d.limit(1), str(tmp_path / "t"), replace=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_quoted_empty_is_text_and_unquoted_is_null(spark, tmp_path):
    """With quoted line ends, doubled quotes and blank fields beside them."""
    (tmp_path / "x.csv").write_text('a,b,c\n1,"",x\n2,,"line\nend ""q"""\n"",3,\n"",,""\n4," ",""\n', "utf-8")
    got = [(r.a, r.b, r.c) for r in files.read_csv(spark, f"{tmp_path}/x.csv").orderBy("_source_row_number").collect()]
    assert got == [("1", "", "x"), ("2", None, 'line\nend "q"'), ("", "3", None), ("", None, ""), ("4", " ", "")]


@pytest.fixture
def indexed(spark, tmp_path):
    o, l = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("orders", "lineitem"))
    files.write_indexed(o, "indexed_orders", f"{tmp_path}/orders", ["o_orderkey"], 8)
    files.write_indexed(l, "indexed_lines", f"{tmp_path}/lines", ["l_orderkey"], 8)
    yield o, l
    for t in ("indexed_orders", "indexed_lines"):
        spark.sql(f"DROP TABLE {t}")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_reads_one_bucket_and_a_join_shuffles_nothing(spark, indexed):
    o, l = indexed
    key = o.orderBy(F.desc("o_orderkey")).first().o_orderkey
    found = spark.table("indexed_orders").where(F.col("o_orderkey") == key)
    assert found.count() == 1
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)  # the plan says the buckets then
    try:
        assert "SelectedBucketsCount: 1 out of 8" in plan_of(spark.table("indexed_orders").where(F.col("o_orderkey") == key))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    both = spark.table("indexed_orders").join(spark.table("indexed_lines").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    assert "Exchange" not in plan_of(both) and "Exchange" in plan_of(o.join(l.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")))
    assert both.count() == o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).count()


def test_statistics_are_recorded_and_used(spark, indexed):
    o, _ = indexed
    found = {r.column_name: r for r in files.statistics(spark, "indexed_orders").collect()}
    assert set(found) == set(o.columns) and found["o_orderkey"].null_count == "0" and int(found["o_orderkey"].max) == o.agg(F.max("o_orderkey")).first()[0]
    rows = lambda: spark.sql("SELECT * FROM indexed_orders WHERE o_orderkey < 0")._jdf.queryExecution().optimizedPlan().stats().rowCount().toString()
    spark.conf.set("spark.sql.cbo.enabled", True)
    try:
        with_statistics = rows()
    finally:
        spark.conf.unset("spark.sql.cbo.enabled")
    assert with_statistics == "Some(0)" and rows() != with_statistics


def test_statistics_change_the_order_of_joins(spark, tmp_path):
    """Before ANALYZE the joins stand as written, the fact table with the large side first; with statistics the selective side comes first."""
    name = f"t{tmp_path.name.replace('-', '_')}"
    options = {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    frames = {
        "fact": spark.range(20_000).selectExpr("id AS f", "id % 5000 AS big_key", "id % 5000 AS small_key"),
        "big": spark.range(5_000).selectExpr("id AS b"),
        "small": spark.range(5_000).selectExpr("id AS s", "id AS tag"),
    }
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        for t, df in frames.items():
            df.write.option("path", f"{tmp_path}/{t}").saveAsTable(f"{name}_{t}")
        query = f"SELECT f FROM {name}_fact JOIN {name}_big ON big_key = b JOIN {name}_small ON small_key = s WHERE tag = 7"
        first = lambda: spark.sql(query)._jdf.queryExecution().optimizedPlan().toString()
        depth = lambda plan, t: next(len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines() if f"{name}_{t}" in line)
        written = first()
        assert depth(written, "small") < depth(written, "big")
        rows = sorted(r.f for r in spark.sql(query).collect())
        for t in frames:
            spark.sql(f"ANALYZE TABLE {name}_{t} COMPUTE STATISTICS FOR ALL COLUMNS")
        ordered = first()
        assert depth(ordered, "small") > depth(ordered, "big")
        assert sorted(r.f for r in spark.sql(query).collect()) == rows == [7, 5007, 10007, 15007]
    finally:
        for t in frames:
            spark.sql(f"DROP TABLE IF EXISTS {name}_{t}")
        for k, v in before.items():
            spark.conf.set(k, v)
