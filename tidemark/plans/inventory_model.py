"""Queries of the typed layer, its checks and extracts, the materialised model and the quality payloads.

The raw text tables are made from the test tables by expressions that Spark and
DuckDB read alike, so both start from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from ..sources.files import manifest_check, scratch, stored
from . import build, dashboard, outcomes, typed
from .bindings import PARAMS, Model, age_sql, sql
from .registry import register

#: name: (table, expressions)
RAW = {
    "raw_competition": ("region", ["r_name AS competition_id", "concat('The ', r_name) AS name", "CASE r_regionkey % 3 WHEN 0 THEN 'league' WHEN 1 THEN NULL ELSE 'cup' END AS type",
        "r_name AS country_name", "CASE WHEN r_regionkey % 2 = 0 THEN '20' ELSE 'n/a' END AS total_clubs"]),
    "raw_club": ("nation", ["CASE WHEN n_nationkey % 8 = 7 THEN concat('c', CAST(n_nationkey AS STRING)) ELSE CAST(n_nationkey AS STRING) END AS club_id", "n_name AS name",
        "CASE n_regionkey WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'OTHER' END AS domestic_competition_id",
        "CASE WHEN n_nationkey % 3 = 0 THEN '25+' ELSE CAST(20 + n_nationkey AS STRING) END AS squad_size", "CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE concat(CAST(20 + n_nationkey AS STRING), '.5') END AS average_age"]),
    "raw_player": ("customer", ["CASE WHEN c_custkey % 11 = 10 THEN '' ELSE CAST(c_custkey AS STRING) END AS player_id", "c_name AS name",
        "CASE WHEN c_custkey % 6 = 0 THEN '31.12.1999' WHEN c_custkey % 6 = 1 THEN '1990-05-17 00:00:00' ELSE '1988-02-29' END AS date_of_birth",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS position", "CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'left' END AS sub_position",
        "CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'tall' WHEN 2 THEN '99' WHEN 3 THEN '230.4' WHEN 4 THEN '-5' WHEN 5 THEN '180.5' ELSE CAST(150 + c_custkey % 60 AS STRING) END AS height_in_cm",
        "CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS STRING) END AS current_club_id"]),
    "raw_lineup": ("lineitem", ["CAST(l_orderkey AS STRING) AS game_id", "CAST(l_suppkey % 7 AS STRING) AS player_id", "CASE WHEN l_linestatus = 'O' THEN 'starting_lineup' ELSE 'substitutes' END AS type"]),
    "raw_appearance": ("lineitem", ["concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS appearance_id", "CAST(l_orderkey AS STRING) AS game_id", "CAST(l_partkey % 9 AS STRING) AS player_id",
        "CASE WHEN l_partkey % 13 = 0 THEN 'x' ELSE CAST(l_partkey % 28 AS STRING) END AS player_club_id",
        "CASE WHEN l_partkey % 17 = 0 THEN 'HT' WHEN l_partkey % 19 = 0 THEN '131' WHEN l_partkey % 7 = 0 THEN '45.5' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS minutes_played",
        "CASE WHEN l_partkey % 23 = 0 THEN '-1' ELSE '1' END AS goals", "'0' AS assists", "CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS yellow_cards", "'0' AS red_cards"]),
    "raw_game": ("orders", ["o_orderkey AS game_key", "o_orderpriority AS competition_key", "CAST(year(o_orderdate) AS INT) AS season_key", "CAST(o_orderdate AS DATE) AS game_date"]),
}
OVERRIDES = "('EUROPE', 'Europe', 'cup', 'International', 'Continental', 'known'), ('FRIENDLY', 'Friendlies', NULL, 'International', 'Other', 'seen in games'), ('TOUR', 'Tour', '', 'International', NULL, 'seen in games')"
GROUPS = "('league', 'League'), ('', 'Unsorted')"
POSITIONS = "('AUTOMOBILE', '', 'Defender'), ('AUTOMOBILE', 'left', 'Midfielder'), ('BUILDING', NULL, 'Forward'), ('MACHINERY', 'left', 'Goalkeeper')"
SCOPE = ["AFRICA", "TOUR"]


def raw(m: Model, name: str) -> DataFrame:
    table, columns = RAW[name]
    return m.t(table).selectExpr(*columns)


def rows_of(m: Model, values: str, columns: str) -> DataFrame:
    return m.t("region").sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def competition(m: Model) -> DataFrame:
    overrides = rows_of(m, OVERRIDES, "competition_id, name, type, country_name, competition_group, evidence")
    return typed.competitions(raw(m, "raw_competition"), overrides, rows_of(m, GROUPS, "type, competition_group"), SCOPE)


def club(m: Model) -> DataFrame:
    return typed.clubs(raw(m, "raw_club"), competition(m))


def player(m: Model) -> DataFrame:
    return typed.players(raw(m, "raw_player"), club(m), rows_of(m, POSITIONS, "position, sub_position, position_group"))


def appearance(m: Model) -> DataFrame:
    return typed.appearances(raw(m, "raw_appearance"), raw(m, "raw_game"), player(m), club(m), typed.lineups(raw(m, "raw_lineup")))


DIGITS, NUMBER = "'[0-9]+'", "'[0-9]+([.][0-9]+)?'"
TYPED = {name: f"SELECT {', '.join(columns)} FROM {table}" for name, (table, columns) in RAW.items()} | {
    "override": f"SELECT * FROM (VALUES {OVERRIDES}) t(competition_id, name, type, country_name, competition_group, evidence)",
    "competition": f"""SELECT c.*, coalesce(o.competition_group, g.competition_group, 'Unknown') AS competition_group, competition_key IN ('AFRICA', 'TOUR') AS in_scope FROM (
        SELECT competition_id AS competition_key, name, type, country_name, try_cast(total_clubs AS BIGINT) AS total_clubs, false AS is_override, NULL::VARCHAR AS evidence FROM raw_competition
        UNION ALL SELECT competition_id, name, type, country_name, NULL, true, evidence FROM override WHERE competition_id NOT IN (SELECT competition_id FROM raw_competition)) c
        LEFT JOIN override o ON o.competition_id = competition_key LEFT JOIN (VALUES {GROUPS}) g(type, competition_group) ON coalesce(c.type, '') = coalesce(g.type, '')""",
    "club": f"""SELECT club_id::BIGINT AS club_key, r.name AS club_name, competition_key, CASE WHEN regexp_full_match(squad_size, {DIGITS}) THEN squad_size::BIGINT END AS squad_size,
        CASE WHEN regexp_full_match(average_age, {NUMBER}) THEN round(average_age::DECIMAL(38,10), 2)::DOUBLE END AS average_age, competition_key IS NOT NULL AS has_competition
        FROM raw_club r LEFT JOIN competition ON domestic_competition_id = competition_key WHERE regexp_full_match(club_id, {DIGITS})""",
    "player": f"""SELECT player_id::BIGINT AS player_key, name AS player_name, CASE WHEN regexp_full_match(left(date_of_birth, 10), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN left(date_of_birth, 10)::DATE END AS date_of_birth,
        coalesce(g.position_group, 'Unknown') AS position_group, CASE WHEN regexp_full_match(height_in_cm, {NUMBER}) AND height_in_cm::DOUBLE BETWEEN 100 AND 230 THEN round(height_in_cm::DECIMAL(38,10))::BIGINT END AS height_cm,
        CASE WHEN height_in_cm IS NULL THEN 'missing' WHEN NOT regexp_full_match(height_in_cm, {NUMBER}) THEN 'invalid_format' WHEN height_in_cm::DOUBLE NOT BETWEEN 100 AND 230 THEN 'out_of_range' ELSE 'valid' END AS height_quality_status,
        club_key AS current_club_key, coalesce(g.position_group, 'Unknown') <> 'Goalkeeper' AS is_outfield, g.position_group IS NOT NULL AS has_position_mapping, club_key IS NOT NULL AS has_current_club
        FROM raw_player p LEFT JOIN (VALUES {POSITIONS}) g(position, sub_position, position_group) ON p.position = g.position AND coalesce(p.sub_position, '') = coalesce(g.sub_position, '')
        LEFT JOIN club ON try_cast(current_club_id AS BIGINT) = club_key WHERE regexp_full_match(player_id, {DIGITS})""",
    "appearance": f"""SELECT appearance_id AS appearance_key, player_key, a.game_id::BIGINT AS game_key, club_key, competition_key, season_key, game_date AS appearance_date,
        CASE WHEN ok AND m BETWEEN 0 AND 130 THEN round(m)::BIGINT END AS minutes_played, CASE WHEN regexp_full_match(goals, {DIGITS}) THEN goals::BIGINT END AS goals, assists::BIGINT AS assists, yellow_cards::BIGINT AS yellow_cards, red_cards::BIGINT AS red_cards,
        CASE WHEN n IS NOT NULL THEN started END AS is_starter, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'matched_unique' WHEN started AND bench THEN 'duplicate_conflict' ELSE 'matched_duplicate' END AS lineup_match_status, coalesce(n, 0)::BIGINT AS lineup_rows,
        player_key IS NOT NULL AND club_key IS NOT NULL AND ok AND m BETWEEN 0 AND 130 AND regexp_full_match(goals, {DIGITS}) AS is_valid,
        CASE WHEN player_key IS NULL THEN 'missing_player_dimension' WHEN club_key IS NULL THEN 'missing_club_dimension' WHEN NOT ok THEN 'invalid_minutes_format' WHEN m NOT BETWEEN 0 AND 130 THEN 'minutes_out_of_range' WHEN NOT regexp_full_match(goals, {DIGITS}) THEN 'invalid_metric_format' ELSE 'valid' END AS data_quality_status
        FROM (SELECT *, regexp_full_match(minutes_played, {NUMBER}) AS ok, try_cast(minutes_played AS DECIMAL(38,10)) AS m FROM raw_appearance) a JOIN raw_game ON a.game_id::BIGINT = game_key
        LEFT JOIN (SELECT player_key FROM player) p ON try_cast(player_id AS BIGINT) = player_key LEFT JOIN (SELECT club_key FROM club) c ON try_cast(player_club_id AS BIGINT) = club_key
        LEFT JOIN (SELECT game_id, player_id, count(*) AS n, bool_or(type = 'starting_lineup') AS started, bool_or(type = 'substitutes') AS bench FROM raw_lineup GROUP BY 1, 2) l ON l.game_id = a.game_id AND l.player_id = a.player_id""",
}


def typed_sql(select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in TYPED.items()) + "\n" + select


register("typed_competitions", competition, typed_sql("SELECT * FROM competition"))
register("typed_clubs", club, typed_sql("SELECT * FROM club"))
register("typed_players", player, typed_sql("SELECT * FROM player"))
register("typed_appearances", appearance, typed_sql("SELECT * FROM appearance"))
register("height_outliers", lambda m: quality.outliers(raw(m, "raw_player"), "height_in_cm", 100, 230, ["player_id", "name"]),
    typed_sql("SELECT player_id, name, height_in_cm FROM raw_player WHERE regexp_full_match(height_in_cm, '-?[0-9]+([.][0-9]+)?') AND height_in_cm::DOUBLE NOT BETWEEN 100 AND 230"))
register("minutes_outliers", lambda m: quality.outliers(raw(m, "raw_appearance"), "minutes_played", None, 130, ["appearance_id", "player_id"]),
    typed_sql("SELECT appearance_id, player_id, minutes_played FROM raw_appearance WHERE regexp_full_match(minutes_played, '-?[0-9]+([.][0-9]+)?') AND minutes_played::DOUBLE > 130"))
register("future_transfers", lambda m: m.raw_transfers().where(F.col("transfer_date") > m.cutoff()).groupBy("transfer_date").agg(F.count("*").alias("transfer_rows"), F.count("fee_text").alias("rows_with_fee")),
    sql("rawtr", "SELECT transfer_date, count(*) AS transfer_rows, count(fee_text) AS rows_with_fee FROM rawtr WHERE transfer_date > DATE '2001-06-30' GROUP BY 1"))
register("orphan_games", lambda m: quality.orphan_groups(raw(m, "raw_game"), competition(m), "competition_key", "competition_key", "game_date"),
    typed_sql("SELECT competition_key, count(*) AS row_count, min(game_date) AS min_date, max(game_date) AS max_date FROM raw_game WHERE competition_key NOT IN (SELECT competition_key FROM competition) GROUP BY 1"))
register("orphan_game_samples", lambda m: quality.orphan_samples(raw(m, "raw_game"), competition(m), "competition_key", "competition_key", [F.desc("game_date"), F.col("game_key")], ["game_key", "game_date"]),
    typed_sql("SELECT competition_key, row_number() OVER (PARTITION BY competition_key ORDER BY game_date DESC, game_key) AS nth, game_key, game_date FROM raw_game WHERE competition_key NOT IN (SELECT competition_key FROM competition) QUALIFY nth <= 3"))


def orphan_context(m: Model) -> DataFrame:
    """Of each reference, the orphan rows by competition."""
    game, a = raw(m, "raw_game").select(F.col("game_key").cast("string").alias("game_id"), "competition_key"), raw(m, "raw_appearance")
    known = {"player_id": raw(m, "raw_player").select(F.col("player_id").alias("_p")), "player_club_id": raw(m, "raw_club").select(F.col("club_id").alias("_p"))}
    found = [
        a.where(F.col(c).isNotNull()).join(parents, F.col(c) == F.col("_p"), "left_anti").join(game, "game_id").groupBy("competition_key").agg(F.count("*").alias("orphan_rows")).withColumn("relationship", F.lit(c))
        for c, parents in known.items()
    ]
    return quality.union_all(found)


register("orphan_context", orphan_context, typed_sql(" UNION ALL ".join(f"SELECT competition_key, count(*) AS orphan_rows, '{c}' AS relationship FROM raw_appearance a JOIN raw_game g ON a.game_id = g.game_key::VARCHAR WHERE {c} NOT IN (SELECT {p} FROM {t}) GROUP BY 1" for c, p, t in (("player_id", "player_id", "raw_player"), ("player_club_id", "club_id", "raw_club")))))


# Coverage of periods and the scope that follows -----------------------------------------------------------------------
def coverage(m: Model) -> DataFrame:
    covered = m.t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("seen", F.lit(True))
    d = m.t("orders").join(covered, "o_orderkey", "left").groupBy(F.col("o_orderpriority").alias("competition_key"), F.expr("year(o_orderdate) * 100 + month(o_orderdate)").alias("period"))
    return quality.period_coverage(d.agg(F.count("*").alias("games"), F.count("seen").alias("covered")), "competition_key", "period", "games", "covered")


COVERAGE = """SELECT *, CASE WHEN local_median > 0 AND games >= 0.85 * local_median AND covered > 0 THEN 'ADEQUATE' ELSE 'REVIEW' END AS coverage_status FROM (
    SELECT *, quantile_cont(games, 0.5) OVER (PARTITION BY competition_key ORDER BY period ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS local_median FROM (
    SELECT o_orderpriority AS competition_key, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS period, count(*) AS games, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) AS covered FROM orders GROUP BY 1, 2))"""
MEMBERS = ["1-URGENT", "2-HIGH", "5-LOW"]
register("period_coverage", coverage, COVERAGE)
register("recommended_scope", lambda m: quality.common_periods(coverage(m), "competition_key", "period", MEMBERS), f"SELECT period FROM ({COVERAGE}) WHERE coverage_status = 'ADEQUATE' AND competition_key IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1 HAVING count(DISTINCT competition_key) = 3 ORDER BY 1 DESC LIMIT 3")

# Transfers ------------------------------------------------------------------------------------------------------------
AFTER, TO = "CASE WHEN day(post_date) % 5 > 0 THEN (entity_key + month(post_date)) % 3 END", "nullif(transfer_key % 4, 3)"
register("post_club_match", lambda m: m.outcomes().select("transfer_key", "horizon_months", outcomes.club_match(F.expr(AFTER), F.expr(TO)).alias("post_club_match_status")),
    sql("out", f"SELECT transfer_key, horizon_months, CASE WHEN a IS NULL OR b IS NULL THEN 'club_comparison_unavailable' WHEN a = b THEN 'matches_destination_club' ELSE 'different_club_at_post_valuation' END AS post_club_match_status FROM (SELECT *, {AFTER} AS a, {TO} AS b FROM out)"))
register("fee_eligibility", lambda m: m.transfers().groupBy("fee_status", "is_fee_analysis_eligible").agg(F.count("*").alias("n")),
    sql("tr", "SELECT fee_status, coalesce(regexp_full_match(fee_text, '[0-9]+([.][0-9]+)?') AND try_cast(fee_text AS DOUBLE) > 0, false) AS is_fee_analysis_eligible, count(*) AS n FROM tr GROUP BY 1, 2"))

# The model written once -----------------------------------------------------------------------------------------------
CTES = {"entities": "ent", "clubs": "club", "valuations": "val", "stints": "stint", "seasons": "season", "kpi": "kpi", "development": "dev", "scores": "eff", "transfers": "tr", "outcomes": "out"}
register("model_manifest", lambda m: build.manifest(build.build(m)), sql(" ".join(CTES.values()), " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {c}" for n, c in CTES.items())))


def by_view(m: Model) -> DataFrame:
    """SQL over the model's views."""
    build.views({"seasons": m.seasons(), "entities": m.entities()})
    return m.t("region").sparkSession.sql("SELECT country, count(*) AS seasons, sum(goals) AS goals FROM tidemark_seasons JOIN tidemark_entities USING (entity_key) GROUP BY country")


register("model_views", by_view, sql("season ent", "SELECT country, count(*) AS seasons, sum(goals)::BIGINT AS goals FROM season JOIN (SELECT entity_key, country FROM ent) USING (entity_key) GROUP BY 1"))

# Quality payloads -----------------------------------------------------------------------------------------------------
register("catalog_columns", lambda m: quality.catalog({n: m.t(n) for n in ("region", "nation", "part")}), "SELECT table_name, column_name, ordinal_position::INT AS ordinal_position FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'part')")


def ledgers(m: Model) -> DataFrame:
    a, s = stored(appearance(m)), stored(m.seasons())
    typed_layer = quality.contracts([("appearance_key", a.groupBy("appearance_key").count().where("count > 1")), ("all_valid", a.where("NOT is_valid"))])
    return dashboard.validation_summary({"analysis": quality.contracts([("value_date", s.where("value_date > season_end_date"))]), "typed": typed_layer})


register("api_quality_validation", ledgers, typed_sql("""SELECT 'analysis' AS phase, 1::BIGINT AS checks, 1::BIGINT AS passed, 0::BIGINT AS failed UNION ALL
    SELECT 'typed', 2, (r = 0)::BIGINT + (i = 0)::BIGINT, (r > 0)::BIGINT + (i > 0)::BIGINT FROM (SELECT count(*) - count(DISTINCT appearance_key) AS r, count(*) FILTER (NOT is_valid) AS i FROM appearance)"""))
register("api_quality_parameters", lambda m: dashboard.parameters(m.t("region").sparkSession, PARAMS).join(F.broadcast(m.kpi().agg(F.count("*").alias("seasons"), F.count_if("is_eligible").alias("eligible")))), sql("kpi", "SELECT 'v1.0' AS version, 60::INT AS minimum_minutes, 365::INT AS maximum_valuation_lag_days, 8::INT AS minimum_peers, 0.05::DOUBLE AS low, 0.95::DOUBLE AS high, 90::INT AS maximum_target_lag_days, [6, 12, 24]::INT[] AS horizons, count(*) AS seasons, count(*) FILTER (is_eligible) AS eligible FROM kpi"))
WEIGHT_ROWS = ", ".join(f"('{g}', '{n}', {w}::DOUBLE, '{'negative' if n == 'cards_per_90' else 'positive'}')" for g, ws in PARAMS.weights.items() for n, w in zip(dashboard.METRICS, ws, strict=True))
register("api_quality_weights", lambda m: dashboard.metric_weights(m.t("region").sparkSession, PARAMS).join(m.kpi().groupBy("position_group").agg(F.count_if("is_eligible").alias("eligible")), "position_group", "left"),
    sql("kpi", f"SELECT t.*, eligible FROM (VALUES {WEIGHT_ROWS}) t(position_group, metric_name, metric_weight, direction) LEFT JOIN (SELECT position_group, count(*) FILTER (is_eligible) AS eligible FROM kpi GROUP BY 1) USING (position_group)"))
register("api_meta", lambda m: dashboard.meta(m.scores()), sql("eff", "SELECT list_sort(list(DISTINCT competition_key)) AS competitions, list_sort(list(DISTINCT season_key)) AS seasons, list_sort(list(DISTINCT position_group)) AS positions FROM eff"))
register("api_player_profile", lambda m: dashboard.profile(player(m), 7), typed_sql("SELECT player_key, player_name, date_of_birth, position_group, height_cm, height_quality_status FROM player WHERE player_key = 7"))
register("api_player_valuations", lambda m: dashboard.valuations_of(m.valuations(), m.entities(), 7), sql("val ent", f"SELECT valuation_date, market_value, {age_sql('valuation_date', 'date_of_birth')} AS age_at_valuation FROM val JOIN (SELECT entity_key, date_of_birth FROM ent) USING (entity_key) WHERE entity_key = 7"))
register("api_player_transfers", lambda m: dashboard.transfers_of(m.transfers(), 7), sql("tr", "SELECT transfer_key, transfer_date, fee_status, fee, value_at_transfer, matched_date FROM tr WHERE entity_key = 7 AND is_historical"))


def files_as_listed(m: Model) -> DataFrame:
    """A folder of CSV files against a manifest with one right, one wrong and one missing file."""
    spark = m.t("region").sparkSession
    folder = scratch(spark)
    m.t("region").orderBy("r_regionkey").coalesce(1).write.option("header", True).csv(folder)
    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    own = own.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    listed = own.unionByName(own.select(F.lit("absent.csv").alias("file_name"), F.lit(1).cast("bigint").alias("bytes"), F.lit("0").alias("sha256")))
    return manifest_check(spark, folder, listed, "*.csv").groupBy("status").agg(F.count("*").alias("files"))


register("file_manifest", files_as_listed, "SELECT * FROM (VALUES ('MATCH', 1::BIGINT), ('MISSING', 1::BIGINT)) t(status, files)")
