"""Queries of the routes: each document from the committed tables, beside the JSON that DuckDB makes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import dashboard, routes
from .bindings import PARAMS, Model, age_sql, sql
from .inventory_audit import ALLOWED, CTES, SAID, array_sql, built, ledger_sql, snapshot
from .registry import register

#: The tables that a route reads.
READS = {
    "efficiency": ("scores", "entities", "clubs"), "players": ("scores", "kpi", "entities"), "player": ("scores", "kpi", "entities", "clubs", "valuations", "transfers"),
    "clubs": ("development", "clubs"), "team-options": ("stints", "clubs"), "quality": tuple(CTES),
}


def answered(m: Model, route: str, **given: str) -> DataFrame:
    store = built(m, *READS[route])

    def tables(name: str) -> DataFrame:
        match name:
            case "snapshot":
                return snapshot(m)
            case "ledger":
                ledger = store.ledger()
                return ledger.where(ledger.table_name.isin(list(CTES)))
            case "parameters":
                return dashboard.parameters(m.spark, PARAMS)
        return store.table(name)

    return routes.answer(tables, route, given, ALLOWED)


def json_sql(ctes: str, **parts: str) -> str:
    return sql(ctes, "SELECT to_json({" + ", ".join(f"'{n}': {p}" for n, p in parts.items()) + "})::VARCHAR AS payload")


BEST = """SELECT e.entity_key, entity_name, e.competition_key, e.season_key, club_name AS primary_club_name, value, round(score, 6) AS score, efficiency_rank
    FROM (SELECT * FROM eff WHERE season_key = 1997 ORDER BY score DESC, entity_key, season_key, competition_key LIMIT 50) e
    JOIN (SELECT entity_key, entity_name FROM ent) n ON n.entity_key = e.entity_key LEFT JOIN club ON club_key = primary_club_key"""
register(
    "api_route_efficiency",
    lambda m: answered(m, "efficiency", season="1997", limit="50"),
    json_sql("eff ent club", filters=SAID, rows=array_sql(BEST, "score DESC, entity_key, season_key, competition_key"), returnedRows=f"(SELECT count(*) FROM ({BEST}))"),
)

FOUND = """SELECT entity_key, entity_name, position_group, country FROM ent
    WHERE entity_name ILIKE '%0001%' AND entity_key IN (SELECT entity_key FROM kpi) ORDER BY entity_name, entity_key LIMIT 30"""
register("api_route_players", lambda m: answered(m, "players", query=" 0001 "), json_sql("ent kpi", query="'0001'", rows=array_sql(FOUND, "entity_name, entity_key")))

LATEST = """SELECT entity_key, entity_name, season_key, round(score, 6) AS score FROM
    (SELECT DISTINCT ON (entity_key) entity_key, season_key, score FROM eff ORDER BY entity_key, season_key DESC, score DESC, competition_key)
    JOIN (SELECT entity_key, entity_name FROM ent) USING (entity_key) ORDER BY score DESC, entity_name, entity_key LIMIT 30"""
register("api_route_players_latest", lambda m: answered(m, "players"), json_sql("eff ent", query="''", rows=array_sql(LATEST, "score DESC, entity_name, entity_key")))

WHO = "SELECT entity_key, entity_name, position_group, country, date_of_birth::VARCHAR AS date_of_birth FROM ent WHERE entity_key = 7"
SEASONS = """SELECT k.season_key, k.competition_key, club_name AS primary_club_name, k.minutes_played, k.goals, k.assists, k.value, k.value_date::VARCHAR AS value_date,
    k.value_lag_days, round(e.score, 6) AS score, e.efficiency_rank, e.peers
    FROM kpi k LEFT JOIN eff e ON e.entity_key = k.entity_key AND e.competition_key = k.competition_key AND e.season_key = k.season_key
    LEFT JOIN club ON club_key = k.primary_club_key WHERE k.entity_key = 7"""
VALUES = f"""SELECT valuation_date::VARCHAR AS valuation_date, market_value, {age_sql('valuation_date', 'date_of_birth')} AS age_at_valuation
    FROM val JOIN (SELECT entity_key, date_of_birth FROM ent) USING (entity_key) WHERE entity_key = 7"""
MOVES = """SELECT transfer_key, transfer_date::VARCHAR AS transfer_date, fee_status, fee, value_at_transfer, matched_date::VARCHAR AS matched_date
    FROM tr WHERE entity_key = 7 AND is_historical"""
register(
    "api_route_player",
    lambda m: answered(m, "player", player_key="7"),
    json_sql(
        "ent kpi eff club val tr", profile=f"(SELECT x FROM ({WHO}) x)", seasons=array_sql(SEASONS, "season_key, competition_key"),
        valuations=array_sql(VALUES, "valuation_date"), transfers=array_sql(MOVES, "transfer_date, transfer_key"),
    ),
)

CLUBS = """SELECT season_end_club_key AS club_key, count(*) AS comparisons, sum(value_change)::BIGINT AS total_change, quantile_cont(value_change, 0.5) AS median_change,
    count(*) FILTER (value_change > 0) AS gains, club_name FROM dev JOIN club ON club_key = season_end_club_key WHERE has_comparison AND season_key = 1997
    GROUP BY season_end_club_key, club_name HAVING count(*) >= 10 ORDER BY median_change DESC, comparisons DESC, 1 LIMIT 60"""
register("api_route_clubs", lambda m: answered(m, "clubs", season="1997"), json_sql("dev club", filters=SAID, clubs=array_sql(CLUBS, "median_change DESC, comparisons DESC, club_key")))

OPTIONS = """SELECT club_key, club_name, stint.competition_key, count(*) AS contributors FROM stint JOIN (SELECT club_key, club_name FROM club) USING (club_key)
    WHERE season_key = 1997 AND valid_appearances > 0 GROUP BY ALL"""
register("api_route_team_options", lambda m: answered(m, "team-options", season="1997"), json_sql("stint club", filters=SAID, rows=array_sql(OPTIONS, "competition_key, club_name, club_key")))


def quality_sql() -> str:
    ctes, ledger = ledger_sql(), "ledger"
    by_table = f"SELECT table_name, count(*) AS checks, count(*) FILTER (status = 'PASS') AS passed FROM {ledger} GROUP BY 1"
    failed = f"SELECT table_name, check_name, actual FROM {ledger} WHERE status <> 'PASS'"
    p = PARAMS
    said = (
        f"{{'version': '{p.version}', 'minimum_minutes': {p.minimum_minutes}, 'maximum_valuation_lag_days': {p.maximum_valuation_lag_days}, 'minimum_peers': {p.minimum_peers}, "
        f"'low': {p.low}::DOUBLE, 'high': {p.high}::DOUBLE, 'maximum_target_lag_days': {p.maximum_target_lag_days}, 'horizons': {list(p.horizons)}}}"
    )
    parts = f"{{'tables': {array_sql(by_table, 'table_name')}, 'failed': {array_sql(failed, 'table_name, check_name')}, 'parameters': {said}}}"
    return f"WITH {ledger} AS ({ctes}) SELECT to_json({parts})::VARCHAR AS payload"


register("api_route_quality", lambda m: answered(m, "quality"), quality_sql())
