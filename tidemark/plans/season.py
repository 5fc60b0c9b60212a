"""From observations to stints, seasons and their indicators.

Column roles: entity_key, club_key, competition_key, season_key name whatever
plays those parts; observations carry minutes_played, goals, assists,
yellow_cards, red_cards, is_starter (may be null), is_valid (may be null) and
appearance_date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import age, age_band, lag_status, ratio
from ..operators.asof import asof_backward, latest_and_peak, top_one
from .params import Params

RATES = {
    "goals_per_90": ("goals * 90", "minutes_played", 4),
    "assists_per_90": ("assists * 90", "minutes_played", 4),
    "goal_contributions_per_90": ("(goals + assists) * 90", "minutes_played", 4),
    "minutes_per_goal_contribution": ("minutes_played", "goals + assists", 2),
    "cards_per_90": ("(yellow_cards + red_cards) * 90", "minutes_played", 4),
}


def rates(df: DataFrame) -> DataFrame:
    return df.withColumns({name: ratio(*r) for name, r in RATES.items()})


def stint_sums(observations: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per entity, club, competition and season: sums, first and last day, and the marks of latest and primary club.

    Rows whose validity is unknown count as neither valid nor rejected. All that
    follows reads these rows and not the observations.

    A stint has few observations, so adding up before the shuffle saves nothing and holds
    every stint in memory twice: with ``tasks`` the rows are dealt by entity and season to as
    many tasks, once, for the sums and the marks.
    """
    keys = ["entity_key", "club_key", "competition_key", "season_key"]
    ok = F.col("is_valid")
    sums = {c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("bigint") for c in ("minutes_played", "goals", "assists", "yellow_cards", "red_cards")}
    d = observations.dropna(subset=keys)
    d = (d if tasks is None else d.repartition(tasks, "entity_key", "season_key")).groupBy(*keys).agg(
        F.count("*").alias("appearance_rows"), F.count_if(ok).alias("valid_appearances"), F.count_if(~ok).alias("rejected_rows"),
        F.count_if(ok & F.col("is_starter")).alias("starts"), F.count_if(ok & F.col("is_starter").isNull()).alias("without_lineup"),
        *[s.alias(n) for n, s in sums.items()], F.min("appearance_date").alias("first_date"), F.max("appearance_date").alias("last_date"),
    )
    season = Window.partitionBy("entity_key", "competition_key", "season_key")
    latest = season.orderBy(F.desc("last_date"), F.desc_nulls_last("minutes_played"), "club_key")
    primary = season.orderBy(F.desc_nulls_last("minutes_played"), F.desc("last_date"), "club_key")
    return d.withColumns({"club_count": F.count("*").over(season), "is_latest_stint": F.row_number().over(latest) == 1, "is_primary_club": F.row_number().over(primary) == 1})


def stints(sums: DataFrame, valuations: DataFrame, entities: DataFrame, like: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """The rows of ``stint_sums`` with rates, the value known at the last day and the age then.

    ``like`` (an entity and a date) is read to find entities with very many rows. ``tasks`` is for the pass over stints and values.
    """
    d = asof_backward(rates(sums), valuations, "entity_key", "last_date", "valuation_date", {"stint_value_date": "valuation_date", "stint_value": "market_value"}, like=like, tasks=tasks)
    lag = F.datediff("last_date", "stint_value_date")
    d = d.withColumn("stint_value_lag_days", lag).withColumn("stint_value_status", lag_status(lag))
    who = entities.select("entity_key", "date_of_birth", "is_outfield", "position_group")
    return d.join(who, "entity_key").withColumn("age_at_stint_end", age(F.col("last_date"), F.col("date_of_birth"))).drop("date_of_birth")


def season_ends(sums: DataFrame) -> DataFrame:
    return sums.groupBy("competition_key", "season_key").agg(F.max("last_date").alias("season_end_date"))


def seasons(sums: DataFrame, valuations: DataFrame, entities: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per entity, competition and season of ``stint_sums``, with the value known at the season's end and the highest up to then.

    Primary and latest club are marked in the stints, so all is one hash aggregation. ``tasks`` is for the pass over the entities' seasons and values.
    """
    keys = ["entity_key", "competition_key", "season_key"]
    added = ("appearance_rows", "valid_appearances", "starts", "minutes_played", "goals", "assists", "yellow_cards", "red_cards")
    chosen = {"primary_club_key": "is_primary_club", "season_end_club_key": "is_latest_stint"}
    clubs = [F.max(F.when(F.col(mark), F.col("club_key"))).alias(n) for n, mark in chosen.items()]
    d = sums.groupBy(*keys).agg(F.count("*").alias("club_count"), *clubs, *[F.sum(c).alias(c) for c in added])
    d = rates(d).withColumn("start_rate", ratio("starts", "valid_appearances", 6)).join(season_ends(sums), ["competition_key", "season_key"])
    value, peak = {"value_date": "valuation_date", "value": "market_value"}, {"peak_value": "market_value", "peak_value_date": "valuation_date"}
    # An entity has a row for each of its seasons and a valuation a day at most: no key can be hot.
    d = latest_and_peak(d, valuations, "entity_key", "season_end_date", "valuation_date", "market_value", value, peak, tasks=tasks)
    lag = F.datediff("season_end_date", "value_date")
    who = entities.select("entity_key", "date_of_birth", "is_outfield", "position_group")
    d = d.withColumn("value_lag_days", lag).withColumn("value_status", lag_status(lag)).join(who, "entity_key")
    return d.withColumn("age_at_season_end", age(F.col("season_end_date"), F.col("date_of_birth"))).drop("date_of_birth")


def indicators(season: DataFrame, p: Params) -> DataFrame:
    """Seasons with age band, eligibility for scoring and the reason if not eligible."""
    d = season
    rated = F.col("goals_per_90").isNotNull() & F.col("assists_per_90").isNotNull() & F.col("cards_per_90").isNotNull()
    fine = (
        F.col("is_outfield") & (F.col("minutes_played") >= p.minimum_minutes) & (F.col("value") > 0)
        & F.col("value_lag_days").between(0, p.maximum_valuation_lag_days) & (F.col("valid_appearances") > 0) & rated
    )
    # The labels are fixed values of the method.
    status = (
        F.when(~F.col("is_outfield"), "goalkeeper_excluded").when(F.col("minutes_played") < p.minimum_minutes, "below_minimum_minutes")
        .when(F.col("value").isNull(), "missing_market_value").when(F.col("value") <= 0, "nonpositive_market_value")
        .when(F.col("value_lag_days").isNull(), "missing_valuation_date").when(F.col("value_lag_days") > p.maximum_valuation_lag_days, "stale_valuation")
        .when(F.col("valid_appearances") <= 0, "no_valid_appearances").when(~rated, "missing_score_metric").otherwise("eligible")
    )
    peers = F.concat_ws("|", F.col("season_key").cast("string"), "competition_key", "position_group")
    return d.withColumns({"age_band": age_band(F.col("age_at_season_end")), "peer_group_key": peers, "is_eligible": fine, "eligibility_status": status})


def development(kpi: DataFrame) -> DataFrame:
    """Each entity's seasons, one row each, against its season before: change only between neighbouring, eligible seasons."""
    one = top_one(kpi, ["entity_key", "season_key"], [F.desc("minutes_played"), F.col("competition_key")])
    w = Window.partitionBy("entity_key").orderBy("season_key")
    before = {"previous_season_key": "season_key", "previous_competition_key": "competition_key", "previous_value": "value", "previous_value_date": "value_date", "previous_eligible": "is_eligible"}
    d = one.withColumns({n: F.lag(c).over(w) for n, c in before.items()})
    comparable = (F.col("previous_season_key") == F.col("season_key") - 1) & F.col("is_eligible") & F.col("previous_eligible") & (F.col("previous_value") > 0)
    change = F.when(comparable, F.col("value") - F.col("previous_value"))
    d = d.withColumns({"season_gap": F.col("season_key") - F.col("previous_season_key"), "has_comparison": comparable, "value_change": change})
    return d.withColumn("value_growth_pct", ratio("value_change * 100", "CASE WHEN value_change IS NOT NULL THEN previous_value END", 4))


def value_by_age(kpi: DataFrame) -> DataFrame:
    """Distribution of value by competition, season, group and age band, over eligible rows."""
    return kpi.where("is_eligible").groupBy("competition_key", "season_key", "position_group", "age_band").agg(
        F.count("*").alias("entities"), F.sum("value").alias("total_value"), F.percentile("value", F.lit(0.25)).alias("p25_value"),
        F.percentile("value", F.lit(0.5)).alias("median_value"), F.percentile("value", F.lit(0.75)).alias("p75_value"),
    )
