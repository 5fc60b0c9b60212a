"""Routes: documents from small tables, and what a bad request gets."""

import json
from datetime import date

import pytest

from tidemark.plans import routes

ALLOWED = {"season": {1996, 1997}, "competition": {"A", "B"}, "position": {"Attack"}}


@pytest.fixture(scope="module")
def tables(spark):
    day = date(1997, 5, 1)
    frames = {
        "entities": spark.createDataFrame([(1, "Ana Silva", "Attack", "PT", date(1975, 1, 2)), (2, "Bo Lind", "Attack", "SE", None)], "entity_key bigint, entity_name string, position_group string, country string, date_of_birth date"),
        "clubs": spark.createDataFrame([(10, "North"), (11, "South")], "club_key bigint, club_name string"),
        "kpi": spark.createDataFrame(
            [(1, "A", 1996, 10, 900, 3, 1, 50, day, 4), (1, "A", 1997, None, 800, 2, 2, None, None, None)],
            "entity_key bigint, competition_key string, season_key int, primary_club_key bigint, minutes_played bigint, goals bigint, assists bigint, value bigint, value_date date, value_lag_days int",
        ),
        "scores": spark.createDataFrame(
            [(1, "A", 1996, 10, "Attack", 50, 0.1234567, 1, 9), (2, "A", 1996, 77, "Attack", 40, -0.5, 2, 9)],
            "entity_key bigint, competition_key string, season_key int, primary_club_key bigint, position_group string, value bigint, score double, efficiency_rank int, peers bigint",
        ),
        "valuations": spark.createDataFrame([(1, day, 50), (2, day, 40)], "entity_key bigint, valuation_date date, market_value bigint"),
        "transfers": spark.createDataFrame(
            [(5, 1, day, "numeric_fee", 7, 50, day, True), (6, 1, day, "numeric_fee", 8, 50, day, False)],
            "transfer_key bigint, entity_key bigint, transfer_date date, fee_status string, fee bigint, value_at_transfer bigint, matched_date date, is_historical boolean",
        ),
        "stints": spark.createDataFrame([(10, "A", 1996, "Attack", 2), (10, "A", 1996, "Attack", 0), (11, "B", 1996, "Attack", 1)], "club_key bigint, competition_key string, season_key int, position_group string, valid_appearances bigint"),
    }
    return frames.__getitem__


def asked(tables, route, **given):
    return json.loads(routes.answer(tables, route, given, ALLOWED).first().payload)


def test_efficiency_lists_the_best_first(tables):
    got = asked(tables, "efficiency", season="1996", limit="10")
    assert got["filters"] == {"competition": None, "season": 1996, "position": None} and got["returnedRows"] == 2
    assert [(r["entity_name"], r["primary_club_name"], r["score"]) for r in got["rows"]] == [("Ana Silva", "North", 0.123457), ("Bo Lind", None, -0.5)]
    assert asked(tables, "efficiency", season="1997") == {"filters": {"competition": None, "season": 1997, "position": None}, "rows": [], "returnedRows": 0}


def test_players_are_found_by_name_or_by_their_latest_season(tables):
    found = asked(tables, "players", query=" ANA ")
    assert found["query"] == "ANA" and [r["entity_key"] for r in found["rows"]] == [1]
    assert asked(tables, "players", query="bo")["rows"] == []  # without a season
    assert asked(tables, "players", query="a%b")["rows"] == []  # a sign of LIKE is a letter
    assert [r["entity_key"] for r in asked(tables, "players")["rows"]] == [1, 2]


def test_a_player_is_one_document(tables):
    got = asked(tables, "player", player_key="1")
    assert got["profile"] == {"entity_key": 1, "entity_name": "Ana Silva", "position_group": "Attack", "country": "PT", "date_of_birth": "1975-01-02"}
    assert [(s["season_key"], s["primary_club_name"], s["score"]) for s in got["seasons"]] == [(1996, "North", 0.123457), (1997, None, None)]
    assert got["valuations"] == [{"valuation_date": "1997-05-01", "market_value": 50, "age_at_valuation": 22}]
    assert [t["transfer_key"] for t in got["transfers"]] == [5]
    assert asked(tables, "player", player_key="2")["seasons"] == []


def test_team_options_count_those_who_played(tables):
    got = asked(tables, "team-options", season="1996", position="Attack")
    assert [(r["club_name"], r["contributors"]) for r in got["rows"]] == [("North", 1), ("South", 1)]
    assert [r["club_name"] for r in asked(tables, "team-options", season="1996", competition="B")["rows"]] == ["South"]


def test_health_says_what_it_stands_on(tables):
    got = asked(tables, "health")
    assert got["status"] == "ok" and got["model"] == {"scored_rows": 2}


@pytest.mark.parametrize(("route", "given", "error", "says"), [
    ("nowhere", {}, LookupError, "nowhere"), ("player", {"player_key": "99"}, LookupError, "player"), ("player", {}, ValueError, "player_key"),
    ("player", {"player_key": "-1"}, ValueError, "player_key"), ("player", {"player_key": "1 or 1=1"}, ValueError, "player_key"), ("efficiency", {"limit": "many"}, ValueError, "limit"),
    ("efficiency", {"season": "now"}, ValueError, "season"), ("efficiency", {"season": "1900"}, ValueError, "season"), ("efficiency", {"competition": "C"}, ValueError, "competition"),
    ("team-options", {}, ValueError, "season"), ("team", {"club_key": "10"}, ValueError, "season"), ("team", {"season": "1996", "club_key": "x"}, ValueError, "club_key"),
    ("transfers", {"horizon": "7"}, ValueError, "horizon"),
])
def test_bad_requests_are_errors_that_name_what_is_wrong(tables, route, given, error, says):
    with pytest.raises(error, match=says):
        routes.answer(lambda n: None if n in ("outcomes",) else tables(n), route, given, ALLOWED)
