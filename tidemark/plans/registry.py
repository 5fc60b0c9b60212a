"""Every query of the engine, bound to the tables of the test data, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import outcomes, scoring, season
from .bindings import PARAMS, Model, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, make: Callable[[Model], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Model(spark, sf_dir))
    if oracle:
        ORACLE_SQL[name] = oracle


def six(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles that sums or interpolation made, to six decimals."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


STINT = "entity_key club_key competition_key season_key appearance_rows valid_appearances rejected_rows starts without_lineup minutes_played goals assists yellow_cards red_cards first_date last_date club_count is_latest_stint goals_per_90 assists_per_90 goal_contributions_per_90 minutes_per_goal_contribution cards_per_90 stint_value_date stint_value stint_value_lag_days stint_value_status age_at_stint_end".split()
SEASON = "entity_key competition_key season_key primary_club_key season_end_club_key club_count valid_appearances starts start_rate minutes_played goals assists goals_per_90 cards_per_90 season_end_date value_date value value_lag_days value_status age_at_season_end".split()
KPI = "entity_key competition_key season_key age_band peak_value peak_value_date peer_group_key is_eligible eligibility_status".split()
DEV = "entity_key season_key competition_key previous_season_key previous_competition_key previous_value previous_value_date season_gap has_comparison value_change value_growth_pct".split()
EFF = "entity_key competition_key season_key position_group peers efficiency_rank efficiency_band score".split()
EFF_Z = "goals_per_90_z assists_per_90_z minutes_played_z start_rate_z cards_per_90_z raw_score performance_z log_value_z efficiency_pct".split()
TR = "transfer_key entity_key transfer_date fee fee_status matched_date value_at_transfer lag_days match_status fee_vs_value fee_premium_pct is_historical".split()
OUT = "transfer_key horizon_months target_date post_date post_value post_lag_days is_matured has_baseline has_post_value is_change_eligible value_change value_growth_pct post_status age_at_transfer age_band_at_transfer".split()


def listed(columns: list[str]) -> str:
    return ", ".join(columns)


def efficiency(m: Model) -> DataFrame:
    d = m.scores()
    return d.select(*EFF[:-1], F.round("score", 6).alias("score"), *[F.round(c, 6).alias(c) for c in EFF_Z])


EFF_SQL = sql("eff", f"SELECT {listed(EFF[:-1])}, round(score, 6) AS score, {', '.join(f'round({c}, 6) AS {c}' for c in EFF_Z)} FROM eff")
register("club_stints", lambda m: m.stints().select(STINT), sql("stint", f"SELECT {listed(STINT)} FROM stint"))
register("entity_seasons", lambda m: m.seasons().select(SEASON), sql("season", f"SELECT {listed(SEASON)} FROM season"))
register("season_indicators", lambda m: m.kpi().select(KPI), sql("kpi", f"SELECT {listed(KPI)} FROM kpi"))
register("value_development", lambda m: m.development().select(DEV), sql("dev", f"SELECT {listed(DEV)} FROM dev"))
register("value_by_age", lambda m: six(season.value_by_age(m.kpi()), "p25_value", "median_value", "p75_value"), sql("kpi", "SELECT competition_key, season_key, position_group, age_band, count(*) AS entities, sum(value)::BIGINT AS total_value, round(quantile_cont(value, 0.25), 6) AS p25_value, round(quantile_cont(value, 0.5), 6) AS median_value, round(quantile_cont(value, 0.75), 6) AS p75_value FROM kpi WHERE is_eligible GROUP BY ALL"))
register("value_efficiency", efficiency, EFF_SQL)
register("peer_benchmark", lambda m: scoring.peer_benchmark(m.scores()).drop("top_10_value").select("*"), sql("eff", """SELECT competition_key, season_key, position_group, count(*) AS entities, sum(value)::BIGINT AS total_value,
    quantile_cont(value, 0.25) AS p25_value, quantile_cont(value, 0.5) AS p50_value, quantile_cont(value, 0.75) AS p75_value, ((2 * sum(round(goals_per_90 * 10000)::BIGINT) * 100 + count(*)) // (2 * count(*)))::DOUBLE / 1000000 AS average_goals_per_90, quantile_cont(goal_contributions_per_90, 0.5) AS median_contributions_per_90,
    CASE WHEN min(p) < max(p) AND min(v) < max(v) THEN round((count(*) * sum(p * v) - sum(p) * sum(v)) / sqrt((count(*) * sum(p * p) - sum(p) * sum(p)) * (count(*) * sum(v * v) - sum(v) * sum(v))), 6) END AS spearman,
    min(value_date) AS earliest_value_date, max(value_date) AS latest_value_date, ((2 * sum(value) FILTER (t <= 10) * 1000000 + sum(value)) // (2 * sum(value)))::DOUBLE / 10000 AS top_10_pct
    FROM (SELECT *, row_number() OVER (g ORDER BY value DESC, entity_key) AS t, (rank() OVER (g ORDER BY round(performance_z, 6)))::DOUBLE AS p, (rank() OVER (g ORDER BY value))::DOUBLE AS v FROM eff WINDOW g AS (PARTITION BY competition_key, season_key, position_group)) GROUP BY ALL"""))
register("transfers", lambda m: m.transfers().select(TR), sql("tr", f"SELECT {listed(TR)} FROM tr"))
register("transfer_outcomes", lambda m: m.outcomes().select(OUT), sql("out", f"SELECT {listed(OUT)} FROM out"))
register("outcome_summary", lambda m: six(outcomes.outcome_summary(m.outcomes()), "median_change", "median_growth_pct"), sql("out", """SELECT horizon_months, fee_status, count(*) AS transfers, count(*) FILTER (is_matured) AS matured, count(*) FILTER (has_baseline) AS with_baseline,
    count(*) FILTER (has_post_value) AS with_post_value, count(*) FILTER (is_change_eligible) AS change_eligible, round(quantile_cont(value_change, 0.5) FILTER (is_change_eligible), 6) AS median_change, round(quantile_cont(value_growth_pct, 0.5) FILTER (is_change_eligible), 6) AS median_growth_pct,
    min(post_date) FILTER (is_change_eligible) AS earliest_post_date, max(post_date) FILTER (is_change_eligible) AS latest_post_date, ((2 * count(*) FILTER (is_change_eligible) * 1000000 + count(*)) // (2 * count(*)))::DOUBLE / 10000 AS coverage_pct,
    CASE WHEN count(*) FILTER (is_change_eligible) > 0 THEN sign(sum(value_change)) * ((2 * abs(sum(value_change)) * 100 + count(*) FILTER (is_change_eligible)) // (2 * count(*) FILTER (is_change_eligible)))::DOUBLE / 100 END AS average_change FROM out GROUP BY ALL"""))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value efficiency; the smallest tables have peer groups of a few."""
    return efficiency(Model(spark, sf_dir, replace(PARAMS, minimum_peers=2)))
