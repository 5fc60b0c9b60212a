from dataclasses import replace

import numpy as np
import pytest

from tidemark.plans.bindings import PARAMS, Model
from tidemark.plans.dashboard import checked, page_size
from tidemark.plans.scoring import peer_benchmark, value_efficiency
from tidemark.plans.season import development

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scores(spark):
    return Model(spark, SF, replace(PARAMS, minimum_peers=3)).scores().toPandas()


def test_scores_are_standard_within_their_group(scores):
    g = scores.groupby(["competition_key", "season_key", "position_group"]).performance_z
    assert np.allclose(g.mean(), 0, atol=1e-9)
    assert np.allclose(g.std()[g.std() > 0], 1)


def test_no_value_lies_after_its_season(scores):
    assert len(scores) and (scores.value_date <= scores.season_end_date).all()


def test_groups_without_weights_are_left_out(scores):
    assert set(scores.position_group) <= set(PARAMS.weights)


def test_small_groups_are_left_out(spark, scores):
    assert scores.peers.min() >= 3
    kpi = Model(spark, SF).kpi()
    assert value_efficiency(kpi.limit(0), PARAMS).count() == 0


def test_constant_group_has_no_correlation(spark):
    rows = [(i, "c", 1, "BUILDING", 5, 0.0, None, 1.0, 1.0) for i in range(4)]
    d = spark.createDataFrame(rows, "entity_key int, competition_key string, season_key int, position_group string, value bigint, performance_z double, value_date date, goals_per_90 double, goal_contributions_per_90 double")
    r = peer_benchmark(d).first()
    assert r.spearman is None and r.top_10_pct == 100.0


def test_development_needs_neighbouring_seasons(spark):
    rows = [(1, 2000, "a", 90, 10, True), (1, 2001, "a", 50, 20, True), (1, 2001, "b", 60, 30, True), (1, 2003, "a", 90, 50, True), (1, 2004, "a", 90, 60, False)]
    d = spark.createDataFrame(rows, "entity_key int, season_key int, competition_key string, minutes_played bigint, value bigint, is_eligible boolean").selectExpr("*", "date'2000-01-01' AS value_date")
    got = {r.season_key: (r.competition_key, r.season_gap, r.has_comparison, r.value_change, r.value_growth_pct) for r in development(d).collect()}
    assert got == {2000: ("a", None, None, None, None), 2001: ("b", 1, True, 20, 200.0), 2003: ("a", 2, False, None, None), 2004: ("a", 1, False, None, None)}


def test_filters_are_checked():
    assert checked({"season": 2000, "position": ""}, {"season": {2000}}) == {"season": 2000}
    with pytest.raises(ValueError):
        checked({"season": 1900}, {"season": {2000}})
    assert [page_size(n) for n in (None, 1, 50, 9999)] == [600, 10, 50, 2000]


def test_large_groups_give_the_same(spark, monkeypatch):
    """Every group as if it were large: the same scores, ranks and benchmarks as by windows."""
    from tidemark.plans import scoring

    p = replace(PARAMS, minimum_peers=3)
    kpi = Model(spark, SF).kpi()
    keys = ["entity_key", "competition_key", "season_key"]
    exact, near = [*keys, "position_group", "peers", "efficiency_rank", "efficiency_band"], ["score", "performance_z", "efficiency_pct", "log_value_z"]
    want = value_efficiency(kpi, p)
    bench = {tuple(r[c] for c in scoring.GROUP): r for r in peer_benchmark(want).collect()}
    want = {tuple(r[k] for k in keys): r for r in want.collect()}
    monkeypatch.setattr(scoring, "FLOOR", 0)
    monkeypatch.setattr(scoring, "LARGE", 0)
    got = value_efficiency(kpi, p)
    rows = {tuple(r[k] for k in keys): r for r in got.collect()}
    assert rows.keys() == want.keys() and len(rows) > 50
    for k, r in rows.items():
        assert [r[c] for c in exact] == [want[k][c] for c in exact]
        assert np.allclose([r[c] for c in near], [want[k][c] for c in near], atol=1e-8)
    again = peer_benchmark(got).collect()
    assert len(again) == len(bench)
    for r in again:
        other = bench[tuple(r[c] for c in scoring.GROUP)].asDict()
        for c, v in r.asDict().items():
            assert v == other[c] or (isinstance(v, float) and np.isclose(v, other[c], atol=1e-6)), c
