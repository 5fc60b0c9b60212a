"""Order statistics without a task that sees a group, against numpy and against Spark's own on small groups."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ranks

GROUP = ["g"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(8)
    data = [(i, "all" if i % 10 else rnd.choice("abc"), rnd.choice([None, float(rnd.randrange(40)), round(rnd.gauss(0, 9), 3)])) for i in range(6000)]
    return spark.createDataFrame(data + [(-1, "alone", 4.0), (-2, None, 1.0), (-3, None, 2.0), (-4, "none", None)], "id int, g string, v double")


def test_percentiles_are_exact(rows):
    values = ranks.ranked(rows.where("g is not null"), GROUP, "v")
    shares = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    got = {r.g: r for r in ranks.percentiles(values, GROUP, "v", shares).collect()}
    data = rows.where("v is not null and g is not null").toPandas()
    assert set(got) == set(data.g)
    for g, d in data.groupby("g"):
        for n, q in shares.items():
            assert np.isclose(got[g][n], np.percentile(d.v, q * 100), rtol=1e-12, atol=1e-12)


def test_ranks_and_shares_are_those_of_windows(rows):
    d = rows.where("v is not null and g is not null")
    w = Window.partitionBy("g")
    want = d.select("id", F.rank().over(w.orderBy("v")).cast("bigint").alias("r"), F.rank().over(w.orderBy(F.desc("v"))).cast("bigint").alias("t"), F.cume_dist().over(w.orderBy("v")).alias("s"))
    got = ranks.with_ranks(d, GROUP, "v", "r", "t", "s").select("id", "r", "t", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_large_groups_are_cut_and_nothing_else_changes(rows, monkeypatch):
    d = rows.where("v is not null")
    columns = ["g", "v", "rows", "less", "upto", "of"]
    want = sorted(map(str, ranks.ranked(d, GROUP, "v").select(columns).collect()))
    monkeypatch.setattr(ranks, "FLOOR", 20)
    got = ranks.ranked(d, GROUP, "v")
    assert "_tm_range" in got._jdf.queryExecution().toString()
    assert sorted(map(str, got.select(columns).collect())) == want


def test_one_group_of_all_rows_is_cut(spark):
    """With all rows in one group no task of the running sums has more than a bounded share of its values."""
    d = spark.range(40_000).select(F.lit("g").alias("g"), F.xxhash64("id").alias("v"))
    values = ranks.ranked(d, ["g"], "v")
    r = values.agg(F.max("upto"), F.min("less"), F.countDistinct("less"), F.max("of")).first()
    assert tuple(r) == (40_000, 0, 40_000, 40_000)
    shares = [k / ranks.RANGES for k in range(1, ranks.RANGES)]
    cuts = d.agg(F.percentile_approx(F.col("v").cast("double"), F.lit(shares), F.lit(20 * ranks.RANGES)).alias("c")).first().c
    sizes = d.groupBy(F.size(F.filter(F.lit(cuts), lambda c: c < F.col("v").cast("double"))).alias("s")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 3 * 40_000 / ranks.RANGES


def test_top_sum_counts_ties_as_far_as_it_goes(spark):
    d = spark.createDataFrame([("a", x) for x in (5, 5, 5, 4, 1)] + [("b", 2)], "g string, v bigint")
    got = dict(map(tuple, ranks.top_sum(ranks.ranked(d, ["g"], "v"), ["g"], "v", 2).collect()))
    assert got == {"a": 10, "b": 2}
