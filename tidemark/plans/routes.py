"""A dashboard's questions by name and text parameters, each answered by one nested document.

``tables`` gives the frame of a name: the model's tables (scores, kpi, ...), ``snapshot``,
``ledger`` and ``parameters``. Parameters are text, as a caller sends them; what isn't allowed
is a ValueError that names it, what isn't there a LookupError.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dashboard, payloads
from .payloads import document, listed, said, single, whole

Tables = Callable[[str], DataFrame]

ROW = ("entity_key", "entity_name", "competition_key", "season_key", "primary_club_name", "value", "score", "efficiency_rank")
SEASON = (
    "season_key", "competition_key", "primary_club_name", "minutes_played", "goals", "assists", "value", "value_date", "value_lag_days",
    "score", "efficiency_rank", "peers",
)
#: A listed score has this many decimals.
DECIMALS = 6


def filters_of(given: Mapping[str, str], allowed: dict[str, set]) -> dict:
    """competition, season and position among ``given``, checked; a season is a whole number."""
    chosen = {n: given[n] for n in dashboard.FILTERS if given.get(n) not in (None, "")}
    if "season" in chosen:
        chosen["season"] = whole(chosen["season"], "season")
    return dashboard.checked(chosen, allowed)


def with_season(given: Mapping[str, str], allowed: dict[str, set]) -> dict:
    f = filters_of(given, allowed)
    if "season" not in f:
        raise ValueError("season is required for team analysis")
    return f


def efficiency(tables: Tables, given: Mapping[str, str], allowed: dict[str, set]) -> DataFrame:
    """The highest scores with names, as many as ``limit`` says within the bounds of a page."""
    f = filters_of(given, allowed)
    limit = given.get("limit")
    best = dashboard.efficiency(tables("scores"), tables("entities"), tables("clubs"), f, None if limit is None else whole(limit, "limit"))
    best = best.withColumn("score", F.round("score", DECIMALS)).select(*ROW)
    rows = listed(best, [F.desc("score"), "entity_key", "season_key", "competition_key"])
    return document(filters=said(f), rows=rows, returnedRows=lambda parts: F.size(parts["rows"]))


def players(tables: Tables, given: Mapping[str, str], allowed: dict[str, set]) -> DataFrame:
    """Entities whose name holds the query; without one, those with the best latest season."""
    query = (given.get("query") or "").strip()
    if query:
        found = listed(dashboard.search(tables("entities"), tables("kpi"), query), ["entity_name", "entity_key"])
    else:
        best = dashboard.latest_best(tables("scores"), tables("entities"), "entity_key", "entity_name", "season_key", F.round("score", DECIMALS).alias("score"))
        found = listed(best, [F.desc("score"), "entity_name", "entity_key"])
    return document(query=F.lit(query), rows=found)


def seasons_of(tables: Tables, key: int) -> DataFrame:
    """An entity's seasons with the names of their clubs and, where they are scored, the scores."""
    of = F.col("entity_key") == key
    scored = tables("scores").where(of).select("competition_key", "season_key", F.round("score", DECIMALS).alias("score"), "efficiency_rank", "peers")
    club = tables("clubs").select(F.col("club_key").alias("primary_club_key"), F.col("club_name").alias("primary_club_name"))
    own = tables("kpi").where(of).join(scored, ["competition_key", "season_key"], "left")
    return own.join(club, "primary_club_key", "left").select(*SEASON)


def player(tables: Tables, given: Mapping[str, str], allowed: dict[str, set]) -> DataFrame:
    """An entity's description, seasons, values and moves."""
    key = whole(given.get("player_key", ""), "player_key")
    who = tables("entities").where(F.col("entity_key") == key).select("entity_key", "entity_name", "position_group", "country", "date_of_birth")
    if who.isEmpty():
        raise LookupError("player was not found")
    return document(
        profile=single(who),
        seasons=listed(seasons_of(tables, key), ["season_key", "competition_key"]),
        valuations=listed(dashboard.valuations_of(tables("valuations"), tables("entities"), key), ["valuation_date"]),
        transfers=listed(dashboard.transfers_of(tables("transfers"), key), ["transfer_date", "transfer_key"]),
    )


def team_options(tables: Tables, given: Mapping[str, str], allowed: dict[str, set]) -> DataFrame:
    """The clubs of a season that have a team to look at."""
    f = with_season(given, allowed)
    rows = dashboard.team_options(tables("stints"), tables("clubs"), {n: v for n, v in f.items() if n != "position"})
    rows = rows.select("club_key", "club_name", "competition_key", "contributors")
    return document(filters=said(f), rows=listed(rows, ["competition_key", "club_name", "club_key"]))


def health(tables: Tables, given: Mapping[str, str], allowed: dict[str, set]) -> DataFrame:
    """Whether the engine answers, and on how many rows of scores."""
    scores = tables("scores")
    state = scores.agg(F.count("*").alias("scored_rows"))
    return document(status=F.lit("ok"), engine=F.lit(f"Spark {scores.sparkSession.version}"), model=single(state))


ROUTES: dict[str, Callable[[Tables, Mapping[str, str], dict[str, set]], DataFrame]] = {
    "health": health,
    "meta": lambda t, g, a: payloads.meta(t("scores"), t("snapshot"), g.get("version", "")),
    "overview": lambda t, g, a: payloads.overview(t("scores"), filters_of(g, a), a),
    "efficiency": efficiency,
    "players": players,
    "player": player,
    "transfers": lambda t, g, a: payloads.transfers(t("outcomes"), t("entities"), g.get("horizon", 12), g.get("fee_status")),
    "clubs": lambda t, g, a: payloads.clubs(t("development"), t("clubs"), filters_of(g, a), a),
    "team-options": team_options,
    "team": lambda t, g, a: payloads.team(t("stints"), with_season(g, a), a, g.get("club_key", "")),
    "quality": lambda t, g, a: payloads.quality(t("ledger"), t("parameters")),
}


def answer(tables: Tables, route: str, given: Mapping[str, str], allowed: dict[str, set]) -> DataFrame:
    """One row, payload: the document of a route."""
    if route not in ROUTES:
        raise LookupError(f"no route is named {route}")
    return ROUTES[route](tables, given, allowed)
