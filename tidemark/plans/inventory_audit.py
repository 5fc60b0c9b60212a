"""Queries of the audit, the reconciliation of layers, funnels, the committed model, its views and its payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import Dated, Known, Missing, Unique, Within, audit, audit_sql
from ..operators.checksum import reconcile
from ..operators.funnel import funnel
from ..operators.quality import union_all
from ..sources.files import scratch, write_indexed
from . import dashboard, payloads, views
from .bindings import PARAMS, Model, sql
from .registry import register
from .store import SPECS, Store

# The audit ------------------------------------------------------------------------------------------------------------
LAST = "1998-01-01"
RULES = {
    "region": [Unique(("r_regionkey",)), Missing("r_name")],
    "nation": [Unique(("n_nationkey",)), Missing("n_name"), Known("n_regionkey", "region", "r_regionkey")],
    "customer": [Unique(("c_custkey",)), Known("c_nationkey", "nation", "n_nationkey"), Within("c_acctbal", 0), Unique(("c_mktsegment", "c_nationkey"))],
    "supplier": [Unique(("s_suppkey",)), Known("s_nationkey", "nation", "n_nationkey"), Within("s_acctbal", None, 5000)],
    "part": [Unique(("p_partkey",)), Missing("p_name"), Within("p_size", 5, 45), Within("p_retailprice", 900)],
    "orders": [Unique(("o_orderkey",)), Known("o_custkey", "customer", "c_custkey"), Known("o_orderkey", "lineitem", "l_orderkey"), Dated("o_orderdate", LAST), Within("o_totalprice", 1000, 300000)],
    "lineitem": [Unique(("l_orderkey", "l_linenumber")), Unique(("l_orderkey", "l_partkey")), Known("l_orderkey", "orders", "o_orderkey"), Known("l_suppkey", "supplier", "s_suppkey"), Within("l_quantity", 2, 49), Dated("l_shipdate", LAST)],
    "events": [Unique(("event_id",)), Missing("event_type"), Known("user_id", "customer", "c_custkey"), Dated("ts", LAST)],
}
register("table_audit", lambda m: audit({t: m.t(t) for t in RULES}, RULES), audit_sql(RULES))


# Layers against each other ------------------------------------------------------------------------------------------------
SUMS = ("appearance_rows", "minutes_played", "goals", "assists")
AMOUNTS = {"minutes": "minutes_played", "goals": "goals", "assists": "assists"}


def layers(m: Model) -> DataFrame:
    """Six pairs of layers by season: what the later should hold of the earlier, and what it holds."""
    season = ["entity_key", "competition_key", "season_key"]
    valid = F.coalesce(F.col("is_valid"), F.lit(False))
    sums = [F.count("*").alias("appearance_rows"), *[F.coalesce(F.sum(F.when(valid, F.col(c))), F.lit(0)).alias(c) for c in SUMS[1:]]]
    added = [F.sum(c).alias(c) for c in SUMS]
    seen, stints, seasons, kpi = m.observations(), m.stints(), m.seasons(), m.kpi()
    stint = ["entity_key", "club_key", "competition_key", "season_key"]
    by, facts = F.col("season_key"), lambda d, keys: d.select(*keys, *SUMS)
    scored = m.scores().withColumn("minutes_played", F.col("minutes_played").cast("bigint"))
    pairs = [
        ("observations_to_stints", seen.groupBy(*stint).agg(*sums), facts(stints, stint), stint),
        ("observations_to_seasons", seen.groupBy(*season).agg(*sums), facts(seasons, season), season),
        ("stints_to_seasons", stints.groupBy(*season).agg(*added), facts(seasons, season), season),
        ("seasons_to_indicators", facts(seasons, season), facts(kpi, season), season),
        ("indicators_to_scores", facts(kpi.where("is_eligible"), season), facts(scored, season), season),
        ("seasons_to_development", facts(seasons, season), facts(m.development(), season), season),
    ]
    return union_all([reconcile(n, a, b, [*k, *SUMS], by, amounts=AMOUNTS) for n, a, b, k in pairs])


def layers_sql() -> str:
    season, stint = "entity_key, competition_key, season_key", "entity_key, club_key, competition_key, season_key"
    total = "count(*) AS appearance_rows, " + ", ".join(f"coalesce(sum({c}) FILTER (coalesce(is_valid, false)), 0) AS {c}" for c in SUMS[1:])
    added, facts = ", ".join(f"sum({c}) AS {c}" for c in SUMS), ", ".join(SUMS)
    pairs = [
        ("observations_to_stints", f"SELECT {stint}, {total} FROM obs GROUP BY ALL", f"SELECT {stint}, {facts} FROM stint"),
        ("observations_to_seasons", f"SELECT {season}, {total} FROM obs GROUP BY ALL", f"SELECT {season}, {facts} FROM season"),
        ("stints_to_seasons", f"SELECT {season}, {added} FROM stint GROUP BY ALL", f"SELECT {season}, {facts} FROM season"),
        ("seasons_to_indicators", f"SELECT {season}, {facts} FROM season", f"SELECT {season}, {facts} FROM kpi"),
        ("indicators_to_scores", f"SELECT {season}, {facts} FROM kpi WHERE is_eligible", f"SELECT {season}, {facts} FROM eff"),
        ("seasons_to_development", f"SELECT {season}, {facts} FROM season", f"SELECT {season}, {facts} FROM dev"),
    ]
    sides = ", ".join(f"sum({c}) AS {n}" for n, c in AMOUNTS.items())
    one = lambda q: f"(SELECT season_key::VARCHAR AS key_range, count(*) AS n, {sides}, list_sort(list(x::VARCHAR)) AS held FROM ({q}) x GROUP BY season_key)"
    out = []
    for n, a, b in pairs:
        amounts = ", ".join(f"coalesce({s}.{c}, 0)::BIGINT AS {p}_{c}" for c in AMOUNTS for s, p in (("a", "source"), ("b", "target")))
        status = "CASE WHEN coalesce(b.n, 0) < coalesce(a.n, 0) THEN 'SHORT' WHEN coalesce(b.n, 0) > coalesce(a.n, 0) THEN 'EXCESS' WHEN a.held = b.held THEN 'MATCH' ELSE 'DIFFERENT' END AS status"
        out.append(f"SELECT '{n}' AS reconciliation, coalesce(a.key_range, b.key_range) AS key_range, coalesce(a.n, 0) AS source_row_count, coalesce(b.n, 0) AS target_row_count, {amounts}, {status} FROM {one(a)} a FULL JOIN {one(b)} b ON a.key_range = b.key_range")
    return sql("obs stint season kpi eff dev", " UNION ALL ".join(out))


register("layer_reconciliation", layers, layers_sql())


# Funnels and profiles ------------------------------------------------------------------------------------------------------
STAGES = {"outfield": "is_outfield", "minimum_minutes": "minutes_played >= 60", "positive_value": "value > 0", "fresh_value": "value_lag_days BETWEEN 0 AND 365", "rated": "goals_per_90 IS NOT NULL AND cards_per_90 IS NOT NULL"}
HISTORY = {"historical": "is_historical", "priced": "fee_status = 'numeric_fee'", "valued": "value_at_transfer > 0", "fresh": "lag_days <= 365"}
HORIZON = {"baseline": "has_baseline", "matured": "is_matured", "later_value": "post_date IS NOT NULL", "usable": "is_change_eligible"}


def funnel_sql(table: str, stages: dict[str, str], by: str = "") -> str:
    first = f"{by}, " if by else ""
    passed, parts = "true", []
    for k, (name, stage) in enumerate({"all": "true", **stages}.items()):
        before, passed = passed, f"{passed} AND coalesce({stage}, false)"
        count = f"count(*) FILTER ({passed})"
        parts.append(f"SELECT {first}{k}::INT AS place, '{name}' AS stage, {count} AS passed, count(*) FILTER ({before}) - {count} AS dropped, CASE WHEN count(*) > 0 THEN ((2 * {count} * 1000000 + count(*)) // (2 * count(*)))::DOUBLE / 10000 END AS share_pct FROM {table}" + (f" GROUP BY {by}" if by else ""))
    return " UNION ALL ".join(parts)


def as_columns(stages: dict[str, str]) -> dict:
    return {n: F.expr(s) for n, s in stages.items()}


register("season_funnel", lambda m: funnel(m.kpi(), as_columns(STAGES), ["position_group"]), sql("kpi", funnel_sql("kpi", STAGES, "position_group")))
register("transfer_funnel", lambda m: funnel(m.transfers(), as_columns(HISTORY)), sql("tr", funnel_sql("tr", HISTORY)))
register("horizon_funnel", lambda m: funnel(m.outcomes(), as_columns(HORIZON), ["horizon_months"]), sql("out", funnel_sql("out", HORIZON, "horizon_months")))
register(
    "peer_profile",
    lambda m: m.kpi().where("is_eligible").groupBy("competition_key", "season_key", "position_group").agg(
        F.count("*").alias("entities"), F.min("minutes_played").alias("minimum_minutes"), F.max("minutes_played").alias("maximum_minutes"), F.count_if(F.col("value_lag_days") > 90).alias("older_values")
    ),
    sql("kpi", "SELECT competition_key, season_key, position_group, count(*) AS entities, min(minutes_played) AS minimum_minutes, max(minutes_played) AS maximum_minutes, count(*) FILTER (value_lag_days > 90) AS older_values FROM kpi WHERE is_eligible GROUP BY ALL"),
)
RATES = ("goals_per_90", "assists_per_90", "cards_per_90")
register(
    "metric_profile",
    lambda m: m.kpi().where("is_eligible").groupBy("position_group").agg(
        F.count("*").alias("entities"), *[F.expr(f"CAST((2 * sum(CAST(round({c} * 10000) AS BIGINT)) + count({c})) div (2 * count({c})) AS DOUBLE) / 10000").alias(f"average_{c}") for c in RATES]
    ),
    sql("kpi", "SELECT position_group, count(*) AS entities, " + ", ".join(f"((2 * sum(round({c} * 10000)::BIGINT) + count({c})) // (2 * count({c})))::DOUBLE / 10000 AS average_{c}" for c in RATES) + " FROM kpi WHERE is_eligible GROUP BY 1"),
)

# The committed model and what reads it ----------------------------------------------------------------------------------------
_stores: dict[tuple[int, str], Store] = {}


def built(m: Model, *need: str) -> Store:
    """The session's store of this folder, with these tables up to date; what is committed and unchanged isn't built again."""
    key = id(m.spark), m.sf_dir
    if key not in _stores:
        _stores[key] = Store(m.spark, scratch(m.spark))
    _stores[key].build(m, need)
    return _stores[key]


CTES = {"entities": "ent", "clubs": "club", "valuations": "val", "stints": "stint", "seasons": "season", "kpi": "kpi", "transfers": "tr"}


def ledger_sql() -> str:
    out = []
    for spec in (s for s in SPECS if s.name in CTES):
        cte, keys = CTES[spec.name], ", ".join(spec.key)
        said = {"key_is_unique": f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {cte} GROUP BY {keys})", "key_has_no_null": f"SELECT count(*) FROM {cte} WHERE " + " OR ".join(f"{k} IS NULL" for k in spec.key)}
        said |= {f"{c}_is_in_{t}": f"SELECT count(*) FROM {cte} WHERE {c} NOT IN (SELECT {k} FROM {CTES[t]})" for c, (t, k) in spec.refers.items()}
        said |= {n: f"SELECT count(*) FROM {cte} WHERE NOT ({h})" for n, h in spec.holds.items()}
        out += [f"SELECT '{n}' AS check_name, '{spec.name}' AS table_name, 0::BIGINT AS expected, a AS actual, CASE WHEN a = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT ({q})::BIGINT AS a)" for n, q in said.items()]
    return sql(" ".join(CTES.values()), " UNION ALL ".join(out))


register("published_audit", lambda m: built(m, *CTES).ledger().where(F.col("table_name").isin(list(CTES))), ledger_sql())

SCOPE = "competition_key IN ('AMERICA', 'ASIA', 'EUROPE') AND season_key BETWEEN 1994 AND 1997"
FROM, TO = "entity_key % 30", "nullif(transfer_key % 29, 3)"
VIEW_SEASON = "entity_key season_key competition_key minutes_played value entity_name date_of_birth country primary_club_name season_end_club_name".split()
VIEW_STINT = "entity_key club_key season_key minutes_played stint_value entity_name club_name".split()
VIEW_TRANSFER = "transfer_key entity_key transfer_date fee entity_name from_club_name to_club_name".split()
VIEW_RANK = "entity_key competition_key season_key efficiency_rank efficiency_band entity_name country primary_club_name season_end_club_name".split()
VIEW_DEV = "entity_key season_key value_change entity_name season_end_club_name".split()
VIEW_OUT = "transfer_key horizon_months value_change entity_name from_club_name to_club_name".split()
SOURCES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def with_clubs(d: DataFrame) -> DataFrame:
    return d.withColumns({"from_club_key": F.expr(FROM), "to_club_key": F.expr(TO)})


def view_sql(ctes: str, table: str, columns: list[str], clubs: dict[str, str], where: str = "true", who: str = "entity_name, date_of_birth, country", join: str = "JOIN") -> str:
    joins = " ".join(f"LEFT JOIN (SELECT club_key AS k{i}, club_name AS {n} FROM club) ON k{i} = {k}" for i, (k, n) in enumerate(clubs.items()))
    return sql(f"{ctes} ent club", f"SELECT {', '.join(columns)} FROM {table} {join} (SELECT entity_key, {who} FROM ent) USING (entity_key) {joins} WHERE {where}")


PRIMARY = {"primary_club_key": "primary_club_name", "season_end_club_key": "season_end_club_name"}
MOVE = {FROM: "from_club_name", TO: "to_club_name"}
register("view_entity_season", lambda m: views.entity_season(m.seasons(), m.entities(), m.clubs(), F.expr(SCOPE)).select(VIEW_SEASON), view_sql("season", "season", VIEW_SEASON, PRIMARY, SCOPE))
register("view_club_season", lambda m: views.club_season(m.stints(), m.entities(), m.clubs(), F.expr(SCOPE)).select(VIEW_STINT), view_sql("stint", "stint", VIEW_STINT, {"stint.club_key": "club_name"}, f"{SCOPE} AND club_name IS NOT NULL", "entity_name"))
register("view_historical_transfers", lambda m: views.historical_transfers(with_clubs(m.transfers()), m.entities(), m.clubs()).select(VIEW_TRANSFER), view_sql("tr", "tr", VIEW_TRANSFER, MOVE, "is_historical", "entity_name"))
register("view_efficiency_ranking", lambda m: views.efficiency_ranking(m.scores(), m.entities(), m.clubs()).select(VIEW_RANK), view_sql("eff", "eff", VIEW_RANK, PRIMARY))
register("view_value_development", lambda m: views.value_development(m.development(), m.entities(), m.clubs()).select(VIEW_DEV), view_sql("dev", "dev", VIEW_DEV, {"season_end_club_key": "season_end_club_name"}, "true", "entity_name"))
register("view_transfer_outcomes", lambda m: views.transfer_outcomes(with_clubs(m.outcomes()), m.entities(), m.clubs()).select(VIEW_OUT), view_sql("out", "out", VIEW_OUT, MOVE, "true", "entity_name", "LEFT JOIN"))
FRESH = " UNION ALL ".join(f"SELECT '{t}' AS source_table, min({c}::DATE) AS min_business_date, max({c}::DATE) AS max_business_date, count(*) AS row_count FROM {t}" for t, c in SOURCES.items())
register("view_data_freshness", lambda m: views.freshness({t: (m.t(t), c) for t, c in SOURCES.items()}), FRESH)

def indexed_join(m: Model) -> DataFrame:
    """Orders and lines as tables bucketed by the order, joined without a shuffle of either."""
    at, tag = scratch(m.spark), uuid.uuid4().hex[:12]
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        write_indexed(m.t(table), f"{table}_{tag}", f"{at}/{table}", [key], int(m.spark.conf.get("spark.sql.shuffle.partitions")))
    both = m.spark.table(f"orders_{tag}").join(m.spark.table(f"lineitem_{tag}"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


register("indexed_join", indexed_join, "SELECT o_orderpriority, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")

# Payloads: they read the committed tables -----------------------------------------------------------------------------------------
ALLOWED = {"season": set(range(1992, 1999)), "competition": {"AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"}, "position": set(PARAMS.weights)}
F97 = {"season": 1997}


def snapshot(m: Model) -> DataFrame:
    return views.freshness({t: (m.t(t), c) for t, c in SOURCES.items()})


def array_sql(query: str, order: str) -> str:
    return f"(SELECT coalesce(list(x ORDER BY {order}), []) FROM ({query}) x)"


SAID = "{'competition': NULL::VARCHAR, 'season': 1997::INT, 'position': NULL::VARCHAR}"
BY = lambda c: f"SELECT {c}, count(*) AS entity_seasons, sum(value)::BIGINT AS total_value, quantile_cont(value, 0.5) AS median_value FROM eff WHERE season_key = 1997 GROUP BY 1"
WHOLE = "SELECT count(*) AS entity_seasons, count(DISTINCT entity_key) AS entities, sum(value)::BIGINT AS total_value, quantile_cont(value, 0.5) AS median_value, min(value_date)::VARCHAR AS earliest_value_date, max(value_date)::VARCHAR AS latest_value_date FROM eff WHERE season_key = 1997"
register("api_route_overview", lambda m: payloads.overview(built(m, "scores").table("scores"), F97, ALLOWED), sql("eff", f"""SELECT to_json({{'filters': {SAID}, 'summary': (SELECT x FROM ({WHOLE}) x),
    'byPosition': {array_sql(BY('position_group'), 'position_group')}, 'byCompetition': {array_sql(BY('competition_key'), 'competition_key')}, 'byAge': {array_sql(BY('age_band'), 'age_band')}}})::VARCHAR AS payload"""))
TOP_SQL = """SELECT transfer_key, entity_name, transfer_date::VARCHAR AS transfer_date, fee_status, value_at_transfer, post_value, value_change, post_date::VARCHAR AS post_date FROM
    (SELECT * FROM out WHERE horizon_months = 12 AND is_change_eligible ORDER BY value_change DESC NULLS LAST, transfer_key LIMIT 40) LEFT JOIN (SELECT entity_key, entity_name FROM ent) USING (entity_key)"""
FEE_SQL = "SELECT fee_status, count(*) AS transfers, count(*) FILTER (is_change_eligible) AS change_eligible FROM out WHERE horizon_months = 12 GROUP BY 1"
register("api_route_transfers", lambda m: (lambda s: payloads.transfers(s.table("outcomes"), s.table("entities"), 12))(built(m, "outcomes")),
    sql("out ent", f"SELECT to_json({{'horizon': 12, 'byFeeStatus': {array_sql(FEE_SQL, 'fee_status')}, 'top': {array_sql(TOP_SQL, 'value_change DESC NULLS LAST, transfer_key')}}})::VARCHAR AS payload"))
META_SQL = "SELECT list_sort(list(DISTINCT competition_key)) AS competitions, list_sort(list(DISTINCT season_key)) AS seasons, list_sort(list(DISTINCT position_group)) AS positions FROM eff"
FRESH_TEXT = f"SELECT source_table, min_business_date::VARCHAR AS min_business_date, max_business_date::VARCHAR AS max_business_date, row_count FROM ({FRESH})"
register("api_route_meta", lambda m: payloads.meta(built(m, "scores").table("scores"), snapshot(m), PARAMS.version),
    sql("eff", f"SELECT to_json({{'version': 'v1.0', 'options': (SELECT x FROM ({META_SQL}) x), 'sources': {array_sql(FRESH_TEXT, 'source_table')}}})::VARCHAR AS payload"))
TEAM = f"valid_appearances > 0 AND season_key = 1997 AND club_key = 3"
TEAM_SUM = f"SELECT position_group, count(*) AS contributors, sum(minutes_played)::BIGINT AS minutes_played, sum(stint_value) FILTER ({dashboard.ALIGNED})::BIGINT AS squad_value FROM stint WHERE {TEAM} GROUP BY 1"
AGES = "['Under 20', '20-22', '23-25', '26-28', '29-31', '32+', 'Unknown']"
TEAM_AGE = f"SELECT b AS age_band, list_position({AGES}, b)::INT AS age_band_order, count(*) AS contributors, sum(minutes_played)::BIGINT AS minutes_played FROM (SELECT *, CASE WHEN age_at_stint_end IS NULL THEN 'Unknown' WHEN age_at_stint_end < 20 THEN 'Under 20' WHEN age_at_stint_end <= 22 THEN '20-22' WHEN age_at_stint_end <= 25 THEN '23-25' WHEN age_at_stint_end <= 28 THEN '26-28' WHEN age_at_stint_end <= 31 THEN '29-31' ELSE '32+' END AS b FROM stint WHERE {TEAM}) GROUP BY 1, 2"
TEAM_ALL = f"SELECT count(*) AS contributors, sum(minutes_played)::BIGINT AS total_minutes, sum(goals)::BIGINT AS total_goals, sum(stint_value) FILTER ({dashboard.ALIGNED})::BIGINT AS squad_value, quantile_cont(stint_value, 0.5) FILTER ({dashboard.ALIGNED}) AS median_value, quantile_cont(age_at_stint_end, 0.5) AS median_age, count(*) FILTER ({dashboard.ALIGNED}) AS with_value, ((2 * count(*) FILTER ({dashboard.ALIGNED}) * 1000 + count(*)) // (2 * count(*)))::DOUBLE / 10 AS coverage_pct FROM stint WHERE {TEAM}"
register("api_route_team", lambda m: payloads.team(built(m, "stints").table("stints", [1997]), F97, ALLOWED, 3), sql("stint", f"""SELECT to_json({{'filters': {SAID}, 'summary': (SELECT x FROM ({TEAM_ALL}) x),
    'byPosition': {array_sql(TEAM_SUM, 'position_group')}, 'byAge': {array_sql(TEAM_AGE, 'age_band_order')}}})::VARCHAR AS payload"""))
