"""What a dashboard asks: read-only summaries over the model, with checked filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import age, age_band, age_band_order, like_text
from ..operators.asof import top_one
from ..operators.quality import union_all
from ..operators.ranks import percentiles, ranked
from ..sources.files import stored
from .params import METRICS, Params

FILTERS = {"competition": "competition_key", "season": "season_key", "position": "position_group"}


def checked(given: dict, allowed: dict[str, set]) -> dict:
    """The filters that are set; an error for a name or a value that isn't allowed."""
    out = {k: v for k, v in given.items() if v not in (None, "")}
    for k, v in out.items():
        if k not in FILTERS or v not in allowed.get(k, {v}):
            raise ValueError(f"unsupported {k} filter")
    return out


def condition(filters: dict) -> Column:
    """All filters at once; true if there is none."""
    out = F.lit(True)
    for k, v in filters.items():
        out &= F.col(FILTERS[k]) == v
    return out


def page_size(asked: int | None) -> int:
    """Rows of a page: 600 unless asked otherwise, 10 at least, 2000 at most."""
    return min(max(600 if asked is None else asked, 10), 2000)


def median_of(d: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """The exact median of each group, from counts in ranges of the values: no task sees all values of a large group."""
    return percentiles(ranked(d, [by], value), [by], value, {name: 0.5})


def overview(scores: DataFrame, filters: dict) -> DataFrame:
    d = stored(scores.where(condition(filters)).select(F.lit(0).alias("_all"), "entity_key", "value", "value_date"))
    facts = d.agg(
        F.count("*").alias("entity_seasons"), F.countDistinct("entity_key").alias("entities"), F.sum("value").alias("total_value"),
        F.min("value_date").alias("earliest_value_date"), F.max("value_date").alias("latest_value_date"),
    )
    facts = facts.join(F.broadcast(median_of(d, "_all", "value", "median_value")), F.lit(True), "left")  # one row
    return facts.select("entity_seasons", "entities", "total_value", "median_value", "earliest_value_date", "latest_value_date")


def overview_by(scores: DataFrame, filters: dict, by: str) -> DataFrame:
    d = stored(scores.where(condition(filters)).select(by, "value"))
    facts = d.groupBy(by).agg(F.count("*").alias("entity_seasons"), F.sum("value").alias("total_value"))
    medians = median_of(d, by, "value", "median_value").withColumnRenamed(by, "_by")
    return facts.join(medians, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def efficiency(scores: DataFrame, entities: DataFrame, clubs: DataFrame, filters: dict, asked: int | None = None) -> DataFrame:
    """The highest scores with names, best first."""
    best = scores.where(condition(filters)).orderBy(F.desc("score"), "entity_key", "season_key", "competition_key").limit(page_size(asked))
    names = entities.select("entity_key", "entity_name", "country")
    club = clubs.select(F.col("club_key").alias("primary_club_key"), F.col("club_name").alias("primary_club_name"))
    return best.join(names, "entity_key").join(club, "primary_club_key", "left")


def search(entities: DataFrame, kpi: DataFrame, query: str) -> DataFrame:
    """Thirty entities with a season whose name holds the query."""
    found = entities.where(like_text(F.col("entity_name"), query)).join(kpi.select("entity_key").distinct(), "entity_key", "left_semi")
    return found.select("entity_key", "entity_name", "position_group", "country").orderBy("entity_name", "entity_key").limit(30)


def latest_best(scores: DataFrame, entities: DataFrame, *columns: str | Column) -> DataFrame:
    """Thirty entities by the score of their latest season, in these columns or key, name and season."""
    one = top_one(scores, ["entity_key"], [F.desc("season_key"), F.desc("score"), F.col("competition_key")])
    return one.join(entities.select("entity_key", "entity_name"), "entity_key").orderBy(F.desc("score"), "entity_name", "entity_key").limit(30).select(*(columns or ("entity_key", "entity_name", "season_key")))


def history(development: DataFrame, entity_key: int) -> DataFrame:
    return development.where(F.col("entity_key") == entity_key).select("season_key", "competition_key", "minutes_played", "value", "value_change", "value_growth_pct")


def top_outcomes(outcomes: DataFrame, entities: DataFrame, horizon: int, fee_status: str | None = None) -> DataFrame:
    """The forty largest gains at a horizon."""
    d = outcomes.where((F.col("horizon_months") == horizon) & F.col("is_change_eligible"))
    d = d if fee_status is None else d.where(F.col("fee_status") == fee_status)
    best = d.orderBy(F.desc_nulls_last("value_change"), "transfer_key").limit(40)
    return best.join(entities.select("entity_key", "entity_name"), "entity_key", "left").select("transfer_key", "entity_name", "transfer_date", "fee_status", "value_at_transfer", "post_value", "value_change", "post_date")


def clubs_by_change(development: DataFrame, clubs: DataFrame, filters: dict, least: int = 10) -> DataFrame:
    """Change of value by season-end club, with at least ``least`` comparisons."""
    d = development.where(F.col("has_comparison") & F.col("season_end_club_key").isNotNull() & condition(filters))
    d = d.groupBy(F.col("season_end_club_key").alias("club_key")).agg(
        F.count("*").alias("comparisons"), F.sum("value_change").alias("total_change"), F.percentile("value_change", F.lit(0.5)).alias("median_change"), F.count_if(F.col("value_change") > 0).alias("gains")
    ).where(F.col("comparisons") >= least)
    return d.join(clubs, "club_key").orderBy(F.desc("median_change"), F.desc("comparisons"), "club_key").limit(60)


def team_options(stints: DataFrame, clubs: DataFrame, filters: dict) -> DataFrame:
    d = stints.where((F.col("valid_appearances") > 0) & condition(filters))
    return d.groupBy("club_key", "competition_key").agg(F.count("*").alias("contributors")).join(clubs, "club_key")


ALIGNED = "stint_value > 0 AND stint_value_lag_days BETWEEN 0 AND 365"


def team(stints: DataFrame, filters: dict, club_key: int) -> DataFrame:
    return stints.where((F.col("valid_appearances") > 0) & condition(filters) & (F.col("club_key") == club_key))


def team_summary(stints: DataFrame, filters: dict, club_key: int) -> DataFrame:
    fine = F.expr(ALIGNED)
    return team(stints, filters, club_key).agg(
        F.count("*").alias("contributors"), F.sum("minutes_played").alias("total_minutes"), F.sum("goals").alias("total_goals"), F.sum(F.when(fine, F.col("stint_value"))).alias("squad_value"),
        F.percentile(F.when(fine, F.col("stint_value")), F.lit(0.5)).alias("median_value"), F.percentile("age_at_stint_end", F.lit(0.5)).alias("median_age"), F.count_if(fine).alias("with_value"),
    ).withColumn("coverage_pct", F.expr("CASE WHEN contributors > 0 THEN CAST((2 * with_value * 1000 + contributors) div (2 * contributors) AS DOUBLE) / 10 END"))


def team_by_position(stints: DataFrame, filters: dict, club_key: int) -> DataFrame:
    return team(stints, filters, club_key).groupBy("position_group").agg(F.count("*").alias("contributors"), F.sum("minutes_played").alias("minutes_played"), F.sum(F.when(F.expr(ALIGNED), F.col("stint_value"))).alias("squad_value"))


def team_by_age(stints: DataFrame, filters: dict, club_key: int) -> DataFrame:
    d = team(stints, filters, club_key).withColumn("age_band", age_band(F.col("age_at_stint_end")))
    return d.groupBy("age_band", age_band_order(F.col("age_band")).alias("age_band_order")).agg(F.count("*").alias("contributors"), F.sum("minutes_played").alias("minutes_played"))


def team_benchmark(stints: DataFrame, filters: dict) -> DataFrame:
    """Every club's figures beside the medians of all clubs' figures (medians of medians among them)."""
    fine = F.expr(ALIGNED)
    per = stints.where((F.col("valid_appearances") > 0) & condition(filters)).groupBy("club_key").agg(
        F.count("*").alias("contributors"), F.sum("minutes_played").alias("total_minutes"), F.sum(F.col("goals") + F.col("assists")).alias("contributions"),
        F.sum(F.when(fine, F.col("stint_value"))).alias("squad_value"), F.percentile(F.when(fine, F.col("stint_value")), F.lit(0.5)).alias("median_value"),
    )
    names = ("contributors", "total_minutes", "contributions", "squad_value", "median_value")
    per = stored(per)  # read twice: each club, and all of them
    all_clubs = per.agg(F.count("*").alias("clubs"), *[F.percentile(c, F.lit(0.5)).alias(f"all_{c}") for c in names])
    return per.join(F.broadcast(all_clubs))  # one row


def profile(players: DataFrame, player_key: int) -> DataFrame:
    """One player's description; no row is the caller's "not found"."""
    names = ("player_key", "player_name", "date_of_birth", "position_group", "height_cm", "height_quality_status")
    return players.where(F.col("player_key") == player_key).select(*names)


def valuations_of(valuations: DataFrame, entities: DataFrame, entity_key: int) -> DataFrame:
    born = entities.where(F.col("entity_key") == entity_key).select("entity_key", "date_of_birth")
    d = valuations.where(F.col("entity_key") == entity_key).join(born, "entity_key")
    return d.select("valuation_date", "market_value", age(F.col("valuation_date"), F.col("date_of_birth")).alias("age_at_valuation")).orderBy("valuation_date")


def transfers_of(transfers: DataFrame, entity_key: int) -> DataFrame:
    d = transfers.where((F.col("entity_key") == entity_key) & F.col("is_historical"))
    return d.select("transfer_key", "transfer_date", "fee_status", "fee", "value_at_transfer", "matched_date").orderBy("transfer_date", "transfer_key")


def validation_summary(ledgers: dict[str, DataFrame]) -> DataFrame:
    """How many checks of each phase's ledger passed and failed."""
    rows = [
        d.agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed")).withColumn("phase", F.lit(n))
        for n, d in ledgers.items()
    ]
    return union_all(rows).select("phase", "checks", "passed", "failed").orderBy("phase")


def parameters(spark: SparkSession, p: Params) -> DataFrame:
    """The method's parameters, one row."""
    row = (p.version, p.minimum_minutes, p.maximum_valuation_lag_days, p.minimum_peers, p.low, p.high, p.maximum_target_lag_days, list(p.horizons))
    return spark.createDataFrame([row], "version string, minimum_minutes int, maximum_valuation_lag_days int, minimum_peers int, low double, high double, maximum_target_lag_days int, horizons array<int>")


def metric_weights(spark: SparkSession, p: Params) -> DataFrame:
    """A row for each group and metric of the score."""
    rows = [(g, m, w, "negative" if m == "cards_per_90" else "positive") for g, ws in p.weights.items() for m, w in zip(METRICS, ws, strict=True)]
    return spark.createDataFrame(rows, "position_group string, metric_name string, metric_weight double, direction string").orderBy("position_group", "metric_name")


def meta(scores: DataFrame) -> DataFrame:
    """What can be chosen: the competitions, seasons and groups with scores, each as a sorted array."""
    return scores.agg(*[F.array_sort(F.collect_set(c)).alias(n) for n, c in (("competitions", "competition_key"), ("seasons", "season_key"), ("positions", "position_group"))])


def health(spark: SparkSession) -> dict[str, str]:
    return {"status": "ok" if spark.range(1).count() == 1 else "failing", "engine": f"Spark {spark.version}"}
