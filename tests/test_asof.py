import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_backward, peak_to_date, top_one

D = date(2020, 1, 1)


def frames(spark, seed):
    rnd = random.Random(seed)
    right = {(rnd.randrange(5), D + timedelta(rnd.randrange(60))): rnd.choice([None, 1, 2, 3]) for _ in range(80)}
    left = [(i, rnd.choice([None, 0, 1, 2, 3, 4, 9]), rnd.choice([None, D + timedelta(rnd.randrange(-5, 70))])) for i in range(200)]
    return left, right, spark.createDataFrame(left, "id int, k int, at date"), spark.createDataFrame([(*k, v) for k, v in right.items()] + [(None, D, 1), (1, None, 1)], "k int, t date, v int")


@pytest.mark.parametrize("span", [None, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_latest_row_up_to_a_date(spark, span, seed):
    left, right, l, r = frames(spark, seed)
    got = {x.id: (x.hit, x.hv) for x in asof_backward(l, r, "k", "at", "t", {"hit": "t", "hv": "v"}, span_days=span).collect()}
    for i, k, at in left:
        times = [t for (key, t) in right if key == k and at and t <= at] if k is not None else []
        assert got[i] == ((max(times), right[k, max(times)]) if times else (None, None))


def test_window_is_open_below(spark):
    l = spark.createDataFrame([(1, 0, D, D + timedelta(5)), (2, 0, D - timedelta(1), D + timedelta(5))], "id int, k int, since date, at date")
    r = spark.createDataFrame([(0, D, 7)], "k int, t date, v int")
    got = {x.id: x.v2 for x in asof_backward(l, r, "k", "at", "t", {"v2": "v"}, after="since").collect()}
    assert got == {1: None, 2: 7}


@pytest.mark.parametrize("span", [None, 7])
def test_peak_is_the_earliest_of_the_highest(spark, span):
    left, right, l, r = frames(spark, 3)
    got = {x.id: (x.pv, x.pt) for x in peak_to_date(l, r, "k", "at", "t", "v", {"pv": "v", "pt": "t"}, span_days=span).collect()}
    for i, k, at in left:
        seen = [(-v, t) for (key, t), v in right.items() if key == k and at and t <= at and v is not None] if k is not None else []
        assert got[i] == ((-min(seen)[0], min(seen)[1]) if seen else (None, None))


def test_nothing_on_either_side(spark):
    _, _, l, r = frames(spark, 4)
    assert asof_backward(l.limit(0), r, "k", "at", "t", {"v2": "v"}).count() == 0
    assert asof_backward(l, r.limit(0), "k", "at", "t", {"v2": "v"}).where("v2 is not null").count() == 0


def test_top_one(spark):
    d = spark.createDataFrame([(1, None, "a"), (1, 3, "b"), (1, 3, "c"), (2, None, "d")], "g int, n int, x string")
    assert {r.x for r in top_one(d, ["g"], [F.desc_nulls_last("n"), F.col("x")]).collect()} == {"b", "d"}


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_keys_are_split_and_nothing_else_changes(spark, seed, monkeypatch):
    """Half of all rows under one key: the same rows come out, and the hot key's largest span has a bounded share."""
    from tidemark.operators import asof

    left, right, l, r = frames(spark, seed)
    hot = spark.range(3000).select((F.col("id") + 1000).cast("int").alias("id"), F.lit(2).alias("k"), F.date_add(F.lit(D), (F.col("id") % 997).cast("int")).alias("at"))
    seen = spark.range(2000).select(F.lit(2).alias("k"), F.date_add(F.lit(D), F.pmod(F.col("id") * 7, F.lit(991)).cast("int")).alias("t"), (F.col("id") % 5).cast("int").alias("v")).dropDuplicates(["k", "t"])
    l, r = l.unionAll(hot), r.where("k <> 2 or k is null").unionAll(seen)
    plain = [f(l, r) for f in (lambda l, r: asof_backward(l, r, "k", "at", "t", {"hit": "t", "hv": "v"}), lambda l, r: peak_to_date(l, r, "k", "at", "t", "v", {"hit": "t", "hv": "v"}))]
    monkeypatch.setattr(asof, "FLOOR", 50)
    cuts = asof.hot_cuts(l.select("k", "at"), r, "k", "t").collect()
    assert 2 in {c._tm_key for c in cuts}
    split = [asof_backward(l, r, "k", "at", "t", {"hit": "t", "hv": "v"}, like=l.select("k", "at")), peak_to_date(l, r, "k", "at", "t", "v", {"hit": "t", "hv": "v"}, like=l.select("k", "at"))]
    for a, b in zip(plain, split, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    r = r.where("v is not null")
    fused = asof.latest_and_peak(l, r, "k", "at", "t", "v", {"a": "t", "b": "v"}, {"c": "t", "d": "v"}, like=l.select("k", "at"))
    apart = peak_to_date(asof_backward(l, r, "k", "at", "t", {"a": "t", "b": "v"}), r, "k", "at", "t", "v", {"c": "t", "d": "v"})
    assert sorted(map(str, fused.collect())) == sorted(map(str, apart.collect()))
    both = l.select(F.col("k"), F.col("at").alias("t")).unionAll(r.select("k", "t")).where("k = 2")
    own = next(c._tm_cuts for c in cuts if c._tm_key == 2)
    span = F.size(F.filter(F.lit(own), lambda c: c < asof.micros(F.col("t"))))
    assert both.groupBy(span.alias("s")).count().agg(F.max("count")).first()[0] <= both.count() / 16


def test_no_hot_key_is_one_pass(spark):
    from tidemark.operators import asof

    _, _, l, r = frames(spark, 1)
    assert asof.hot_cuts(l.select("k", "at"), r, "k", "t") is None
