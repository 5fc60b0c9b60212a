"""The roles of the method on the test tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import stored, table, tasks_of
from . import outcomes, scoring, season
from .params import Params

#: Four of the five segments take the method's parts; MACHINERY plays the excluded keeper, HOUSEHOLD has no weights.
WEIGHTS = {"AUTOMOBILE": (0.10, 0.10, 0.30, 0.30, 0.20), "BUILDING": (0.25, 0.30, 0.15, 0.15, 0.15), "FURNITURE": (0.45, 0.25, 0.10, 0.10, 0.10)}
PARAMS = Params(minimum_minutes=60, minimum_peers=8, weights=WEIGHTS)


class Model:
    """Lazily built frames over the tables in one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = PARAMS):
        self.spark, self.sf_dir = spark, sf_dir
        self.t, self.p, self._made = partial(table, spark, sf_dir), params, {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def copy(self) -> Model:
        """The same frames; what is replaced in the copy stays in this one."""
        out = Model(self.spark, self.sf_dir, self.p)
        out.t, out._made = self.t, dict(self._made)
        return out

    def of_seasons(self, seasons: list[int], read: Callable[[str], DataFrame]) -> Model:
        """The model of these seasons alone; ``read`` gives their rows of a table that is written already."""
        out = self.copy()
        out._made["stint_sums"] = self.stint_sums().where(F.col("season_key").isin(seasons))
        written = [n for n in ("stints", "seasons", "kpi", "scores") if n in out._made]
        out._made |= {n: read(n) for n in written}
        return out

    def entities(self) -> DataFrame:
        def make():
            nation, region = self.t("nation"), self.t("region")
            d = self.t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            born = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("CAST(c_custkey * 37 % 9000 AS INT)"))
            return d.select(
                F.col("c_custkey").alias("entity_key"), F.col("c_name").alias("entity_name"), F.col("c_mktsegment").alias("position_group"), F.col("n_name").alias("country"),
                F.col("r_name").alias("competition_key"), born.alias("date_of_birth"), (F.col("c_mktsegment") != "MACHINERY").alias("is_outfield"),
            )

        return self._once("entities", make)

    def clubs(self) -> DataFrame:
        return self._once("clubs", lambda: self.t("nation").select(F.col("n_nationkey").alias("club_key"), F.col("n_name").alias("club_name")))

    def tasks(self) -> int:
        """Tasks for the lines; their number grows with the lines, so a task's memory doesn't."""
        return self._once("tasks", lambda: tasks_of(self.t("lineitem")))

    def observations(self) -> DataFrame:
        def make():
            # The lines are shuffled once, to orders that know their entity, in tasks of a bounded number of lines.
            o = self.t("orders").join(self.entities().select("entity_key", "competition_key"), F.col("o_custkey") == F.col("entity_key"))
            o = o.select("o_orderkey", "o_orderdate", "entity_key", "competition_key").repartition(self.tasks(), "o_orderkey")
            l = self.t("lineitem").repartition(self.tasks(), "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            flag, line = F.col("l_returnflag"), F.col("l_linestatus")
            return l.join(self.t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
                "entity_key", F.col("s_nationkey").alias("club_key"), "competition_key", F.year("o_orderdate").alias("season_key"), F.col("o_orderdate").cast("date").alias("appearance_date"),
                F.col("l_quantity").cast("bigint").alias("minutes_played"), F.round(F.col("l_discount") * 100).cast("bigint").alias("goals"), F.round(F.col("l_tax") * 100).cast("bigint").alias("assists"),
                (flag == "R").cast("bigint").alias("yellow_cards"), ((flag == "A") & (line == "O")).cast("bigint").alias("red_cards"),
                F.when((flag != "N") | (line != "F"), line == "O").alias("is_starter"), (F.col("l_quantity") > 2).alias("is_valid"),
            )

        return self._once("observations", make)

    def valuations(self) -> DataFrame:
        def make():
            # A day has few orders of an entity, so adding up before the shuffle saves nothing; tasks hold a bounded number of orders.
            o = self.t("orders").where("o_orderpriority <> '1-URGENT'")
            o = o.select(F.col("o_custkey").alias("entity_key"), F.col("o_orderdate").cast("date").alias("valuation_date"), F.floor("o_totalprice").alias("market_value"))
            return o.repartition(tasks_of(self.t("orders")), "entity_key", "valuation_date").groupBy("entity_key", "valuation_date").agg(F.max("market_value").alias("market_value"))

        return self._once("valuations", make)

    def stint_sums(self) -> DataFrame:
        """Written once: stints, season ends and seasons read these rows, and the observations are read for nothing else."""
        return self._once("stint_sums", lambda: stored(season.stint_sums(self.observations(), self.tasks())))

    def stints(self) -> DataFrame:
        like = self.t("orders").select("o_custkey", F.col("o_orderdate").cast("date"))
        return self._once("stints", lambda: season.stints(self.stint_sums(), self.valuations(), self.entities(), like, self.tasks()))

    def seasons(self) -> DataFrame:
        # Seasons and valuations are a third of the lines at most.
        return self._once("seasons", lambda: season.seasons(self.stint_sums(), self.valuations(), self.entities(), max(self.spark.sparkContext.defaultParallelism, self.tasks() // 3)))

    def kpi(self) -> DataFrame:
        return self._once("kpi", lambda: season.indicators(self.seasons(), self.p))

    def development(self) -> DataFrame:
        return self._once("development", lambda: season.development(self.kpi()))

    def scores(self) -> DataFrame:
        return self._once("scores", lambda: scoring.value_efficiency(self.kpi(), self.p))

    def raw_transfers(self) -> DataFrame:
        def make():
            o = self.t("orders").where("o_orderpriority = '1-URGENT'")
            fee = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'free' WHEN o_orderkey % 11 = 0 THEN '0' WHEN o_orderkey % 13 = 0 THEN '-1' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END")
            return o.select(F.col("o_orderkey").alias("transfer_key"), F.col("o_custkey").alias("entity_key"), F.col("o_orderdate").cast("date").alias("transfer_date"), fee.alias("fee_text"))

        return self._once("raw_transfers", make)

    def cutoff(self):
        return F.lit("2001-06-30").cast("date")

    def snapshot(self):
        return F.lit("2001-08-01").cast("date")

    def transfers(self) -> DataFrame:
        return self._once("transfers", lambda: outcomes.transfers(self.raw_transfers(), self.valuations(), self.cutoff()))

    def outcomes(self) -> DataFrame:
        return self._once("outcomes", lambda: outcomes.outcomes(self.transfers(), self.valuations(), self.entities(), self.snapshot(), self.p, self.raw_transfers().select("entity_key", "transfer_date")))


def ratio_sql(num: str, den: str, digits: int) -> str:
    s = 10**digits
    return f"CASE WHEN ({den}) > 0 THEN sign({num}) * ((2 * abs({num}) * {s} + ({den})) // (2 * ({den})))::DOUBLE / {s} END"


def age_sql(at: str, born: str) -> str:
    return f"CASE WHEN {at} >= {born} THEN year({at}) - year({born}) - (strftime({at}, '%m%d') < strftime({born}, '%m%d'))::INT END"


def band_sql(a: str) -> str:
    return f"CASE WHEN {a} IS NULL THEN 'Unknown' WHEN {a} < 20 THEN 'Under 20' WHEN {a} <= 22 THEN '20-22' WHEN {a} <= 25 THEN '23-25' WHEN {a} <= 28 THEN '26-28' WHEN {a} <= 31 THEN '29-31' ELSE '32+' END"


def lag_sql(d: str, same: bool = False) -> str:
    return f"CASE WHEN {d} IS NULL THEN 'no_prior_valuation' {f'WHEN {d} = 0 THEN ' + chr(39) + 'same_day' + chr(39) if same else ''} WHEN {d} <= 30 THEN 'within_30_days' WHEN {d} <= 90 THEN 'within_90_days' WHEN {d} <= 365 THEN 'within_365_days' ELSE 'stale_over_365_days' END"


RATES_SQL = ", ".join(f"{ratio_sql(*r)} AS {n}" for n, r in season.RATES.items())
METRIC_SQL = ("goals_per_90", "assists_per_90", "minutes_played", "start_rate", "cards_per_90", "log_value")

CTE = {
    "ent": ("", """SELECT c_custkey AS entity_key, c_name AS entity_name, c_mktsegment AS position_group, n_name AS country, r_name AS competition_key,
        (DATE '1970-01-01' + (c_custkey * 37 % 9000)::INT)::DATE AS date_of_birth, c_mktsegment <> 'MACHINERY' AS is_outfield
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "club": ("", "SELECT n_nationkey AS club_key, n_name AS club_name FROM nation"),
    "obs": ("ent", """SELECT entity_key, s_nationkey AS club_key, competition_key, year(o_orderdate)::INT AS season_key, o_orderdate::DATE AS appearance_date,
        l_quantity::BIGINT AS minutes_played, round(l_discount * 100)::BIGINT AS goals, round(l_tax * 100)::BIGINT AS assists, (l_returnflag = 'R')::BIGINT AS yellow_cards,
        (l_returnflag = 'A' AND l_linestatus = 'O')::BIGINT AS red_cards, CASE WHEN l_returnflag <> 'N' OR l_linestatus <> 'F' THEN l_linestatus = 'O' END AS is_starter, l_quantity > 2 AS is_valid
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN ent ON o_custkey = entity_key"""),
    "val": ("", "SELECT o_custkey AS entity_key, o_orderdate::DATE AS valuation_date, max(floor(o_totalprice)::BIGINT) AS market_value FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2"),
    "stint0": ("obs", """SELECT entity_key, club_key, competition_key, season_key, count(*) AS appearance_rows, count(*) FILTER (is_valid) AS valid_appearances, count(*) FILTER (NOT is_valid) AS rejected_rows,
        count(*) FILTER (is_valid AND is_starter) AS starts, count(*) FILTER (is_valid AND is_starter IS NULL) AS without_lineup,
        """ + ", ".join(f"coalesce(sum({c}) FILTER (is_valid), 0)::BIGINT AS {c}" for c in ("minutes_played", "goals", "assists", "yellow_cards", "red_cards")) + """,
        min(appearance_date) AS first_date, max(appearance_date) AS last_date FROM obs GROUP BY ALL"""),
    "stint": ("stint0 val ent", f"""SELECT s.*, {RATES_SQL}, count(*) OVER (PARTITION BY s.entity_key, competition_key, season_key) AS club_count,
        row_number() OVER (PARTITION BY s.entity_key, competition_key, season_key ORDER BY last_date DESC, minutes_played DESC NULLS LAST, club_key) = 1 AS is_latest_stint,
        v.valuation_date AS stint_value_date, v.market_value AS stint_value, (last_date - v.valuation_date)::INT AS stint_value_lag_days, {lag_sql('(last_date - v.valuation_date)')} AS stint_value_status,
        e.is_outfield, e.position_group, {age_sql('last_date', 'e.date_of_birth')} AS age_at_stint_end
        FROM stint0 s ASOF LEFT JOIN val v ON s.entity_key = v.entity_key AND s.last_date >= v.valuation_date JOIN (SELECT entity_key, is_outfield, position_group, date_of_birth FROM ent) e ON e.entity_key = s.entity_key"""),
    "ends": ("obs", "SELECT competition_key, season_key, max(appearance_date) AS season_end_date FROM obs GROUP BY ALL"),
    "season0": ("stint", """SELECT entity_key, competition_key, season_key, count(*) AS club_count, (array_agg(club_key ORDER BY minutes_played DESC, last_date DESC, club_key))[1] AS primary_club_key,
        (array_agg(club_key ORDER BY last_date DESC, minutes_played DESC, club_key))[1] AS season_end_club_key,
        """ + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("appearance_rows", "valid_appearances", "starts", "minutes_played", "goals", "assists", "yellow_cards", "red_cards")) + " FROM stint GROUP BY ALL"),
    "season": ("season0 ends val ent", f"""SELECT s.*, season_end_date, {RATES_SQL}, {ratio_sql('starts', 'valid_appearances', 6)} AS start_rate, v.valuation_date AS value_date, v.market_value AS value,
        (season_end_date - v.valuation_date)::INT AS value_lag_days, {lag_sql('(season_end_date - v.valuation_date)')} AS value_status, e.is_outfield, e.position_group, {age_sql('season_end_date', 'e.date_of_birth')} AS age_at_season_end
        FROM (SELECT * FROM season0 JOIN ends USING (competition_key, season_key)) s ASOF LEFT JOIN val v ON s.entity_key = v.entity_key AND s.season_end_date >= v.valuation_date
        JOIN (SELECT entity_key, is_outfield, position_group, date_of_birth FROM ent) e ON e.entity_key = s.entity_key"""),
    "kpi": ("season val", f"""SELECT s.*, p.peak_value, p.peak_value_date, {band_sql('age_at_season_end')} AS age_band, concat_ws('|', season_key::VARCHAR, competition_key, position_group) AS peer_group_key,
        is_outfield AND minutes_played >= 60 AND value > 0 AND value_lag_days BETWEEN 0 AND 365 AND valid_appearances > 0 AND goals_per_90 IS NOT NULL AND assists_per_90 IS NOT NULL AND cards_per_90 IS NOT NULL AS is_eligible,
        CASE WHEN NOT is_outfield THEN 'goalkeeper_excluded' WHEN minutes_played < 60 THEN 'below_minimum_minutes' WHEN value IS NULL THEN 'missing_market_value' WHEN value <= 0 THEN 'nonpositive_market_value'
          WHEN value_lag_days IS NULL THEN 'missing_valuation_date' WHEN value_lag_days > 365 THEN 'stale_valuation' WHEN valid_appearances <= 0 THEN 'no_valid_appearances'
          WHEN goals_per_90 IS NULL OR assists_per_90 IS NULL OR cards_per_90 IS NULL THEN 'missing_score_metric' ELSE 'eligible' END AS eligibility_status
        FROM season s LEFT JOIN (SELECT s.entity_key AS ek, s.competition_key AS ck, s.season_key AS sk, max(v.market_value) AS peak_value, (array_agg(v.valuation_date ORDER BY v.market_value DESC, v.valuation_date))[1] AS peak_value_date
          FROM season s JOIN val v ON v.entity_key = s.entity_key AND v.valuation_date <= s.season_end_date GROUP BY ALL) p ON ek = entity_key AND ck = competition_key AND sk = season_key"""),
    "dev": ("kpi", f"""SELECT *, {ratio_sql('value_change * 100', 'CASE WHEN value_change IS NOT NULL THEN previous_value END', 4)} AS value_growth_pct FROM (
        SELECT *, season_key - previous_season_key AS season_gap, previous_season_key = season_key - 1 AND is_eligible AND previous_eligible AND previous_value > 0 AS has_comparison,
          CASE WHEN previous_season_key = season_key - 1 AND is_eligible AND previous_eligible AND previous_value > 0 THEN value - previous_value END AS value_change FROM (
        SELECT *, lag(season_key) OVER w AS previous_season_key, lag(competition_key) OVER w AS previous_competition_key, lag(value) OVER w AS previous_value, lag(value_date) OVER w AS previous_value_date, lag(is_eligible) OVER w AS previous_eligible
        FROM (SELECT * FROM kpi QUALIFY row_number() OVER (PARTITION BY entity_key, season_key ORDER BY minutes_played DESC, competition_key) = 1) WINDOW w AS (PARTITION BY entity_key ORDER BY season_key)))"""),
    "eff": ("kpi", "SELECT * FROM (" + """
        WITH q AS (SELECT * REPLACE (minutes_played::DOUBLE AS minutes_played), ln(1 + value::DOUBLE) AS log_value FROM (SELECT *, count(*) OVER (PARTITION BY competition_key, season_key, position_group) AS peers FROM kpi WHERE is_eligible) WHERE peers >= 8),
        b AS (SELECT competition_key, season_key, position_group, """ + ", ".join(f"quantile_cont({c}, 0.05) AS {c}_lo, quantile_cont({c}, 0.95) AS {c}_hi" for c in METRIC_SQL) + """ FROM q GROUP BY ALL),
        w AS (SELECT q.*, """ + ", ".join(f"greatest({c}_lo, least({c}_hi, {c})) AS w_{c}" for c in METRIC_SQL) + """ FROM q JOIN b USING (competition_key, season_key, position_group)),
        s AS (SELECT competition_key, season_key, position_group, """ + ", ".join(f"avg(w_{c}) AS {c}_mean, stddev_samp(w_{c}) AS {c}_sd" for c in METRIC_SQL) + """ FROM w GROUP BY ALL),
        z AS (SELECT w.*, """ + ", ".join(f"coalesce((w_{c} - {c}_mean) / nullif({c}_sd, 0), 0) AS {c}_z" for c in METRIC_SQL) + """ FROM w JOIN s USING (competition_key, season_key, position_group)),
        m(position_group, wg, wa, wm, ws, wc) AS (VALUES """ + ", ".join(f"('{g}', " + ", ".join(f"{x}::DOUBLE" for x in w) + ")" for g, w in WEIGHTS.items()) + """),
        c AS (SELECT z.*, goals_per_90_z * wg + assists_per_90_z * wa + minutes_played_z * wm + start_rate_z * ws - cards_per_90_z * wc AS raw_score FROM z JOIN m USING (position_group)),
        p AS (SELECT *, coalesce((raw_score - avg(raw_score) OVER g) / nullif(stddev_samp(raw_score) OVER g, 0), 0) AS performance_z FROM c WINDOW g AS (PARTITION BY competition_key, season_key, position_group)),
        r AS (SELECT *, round(performance_z - log_value_z, 9) AS score FROM p),
        k AS (SELECT *, rank() OVER (PARTITION BY competition_key, season_key, position_group ORDER BY score DESC) AS efficiency_rank, cume_dist() OVER (PARTITION BY competition_key, season_key, position_group ORDER BY score) * 100 AS efficiency_pct FROM r)
        SELECT *, CASE WHEN efficiency_pct >= 90 THEN 'high_relative_efficiency' WHEN efficiency_pct >= 75 THEN 'above_peer_range' WHEN efficiency_pct >= 25 THEN 'within_peer_range' ELSE 'low_relative_efficiency' END AS efficiency_band FROM k)"""),
    "rawtr": ("", """SELECT o_orderkey AS transfer_key, o_custkey AS entity_key, o_orderdate::DATE AS transfer_date, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'free' WHEN o_orderkey % 11 = 0 THEN '0' WHEN o_orderkey % 13 = 0 THEN '-1'
        ELSE floor(o_totalprice)::BIGINT::VARCHAR END AS fee_text FROM orders WHERE o_orderpriority = '1-URGENT'"""),
    "tr": ("rawtr val", f"""SELECT *, {ratio_sql('fee_vs_value * 100', 'CASE WHEN fee_vs_value IS NOT NULL THEN value_at_transfer END', 4)} AS fee_premium_pct FROM (
        SELECT t.*, CASE WHEN regexp_full_match(fee_text, '-?[0-9]+([.][0-9]+)?') THEN fee_text::BIGINT END AS fee,
        CASE WHEN fee_text IS NULL THEN 'unknown_or_undisclosed' WHEN NOT regexp_full_match(fee_text, '-?[0-9]+([.][0-9]+)?') THEN 'invalid_format' WHEN try_cast(fee_text AS BIGINT) < 0 THEN 'invalid_negative' WHEN try_cast(fee_text AS BIGINT) = 0 THEN 'recorded_zero_ambiguous' ELSE 'numeric_fee' END AS fee_status,
        v.valuation_date AS matched_date, v.market_value AS value_at_transfer, (transfer_date - v.valuation_date)::INT AS lag_days, {lag_sql('(transfer_date - v.valuation_date)', True)} AS match_status,
        CASE WHEN try_cast(fee_text AS BIGINT) > 0 AND v.market_value > 0 THEN try_cast(fee_text AS BIGINT) - v.market_value END AS fee_vs_value, transfer_date <= DATE '2001-06-30' AS is_historical
        FROM rawtr t ASOF LEFT JOIN val v ON t.entity_key = v.entity_key AND t.transfer_date >= v.valuation_date)"""),
    "out": ("tr val ent", f"""SELECT *, {ratio_sql('value_change * 100', 'CASE WHEN value_change IS NOT NULL THEN value_at_transfer END', 4)} AS value_growth_pct, {band_sql('age_at_transfer')} AS age_band_at_transfer FROM (SELECT *, CASE WHEN is_change_eligible THEN post_value - value_at_transfer END AS value_change FROM (SELECT *, is_matured AND has_baseline AND has_post_value AS is_change_eligible FROM (
        SELECT x.*, CASE WHEN v.valuation_date > transfer_date THEN v.valuation_date END AS post_date, CASE WHEN v.valuation_date > transfer_date THEN v.market_value END AS post_value,
        CASE WHEN v.valuation_date > transfer_date THEN (target_date - v.valuation_date)::INT END AS post_lag_days, target_date <= DATE '2001-08-01' AS is_matured, value_at_transfer > 0 AND lag_days BETWEEN 0 AND 365 AS has_baseline,
        CASE WHEN v.valuation_date > transfer_date THEN v.market_value > 0 AND (target_date - v.valuation_date) BETWEEN 0 AND 90 END AS has_post_value,
        CASE WHEN v.valuation_date IS NULL OR v.valuation_date <= transfer_date THEN 'no_post_valuation' WHEN target_date > DATE '2001-08-01' THEN 'horizon_not_matured' WHEN target_date - v.valuation_date > 90 THEN 'post_valuation_too_old' WHEN v.market_value <= 0 THEN 'post_value_nonpositive' ELSE 'post_valuation_eligible' END AS post_status,
        {age_sql('transfer_date', 'e.date_of_birth')} AS age_at_transfer
        FROM (SELECT tr.*, h AS horizon_months, (transfer_date + to_months(h))::DATE AS target_date FROM tr, (SELECT unnest([6, 12, 24])::INT AS h) WHERE is_historical) x ASOF LEFT JOIN val v ON x.entity_key = v.entity_key AND x.target_date >= v.valuation_date
        LEFT JOIN (SELECT entity_key, date_of_birth FROM ent) e ON e.entity_key = x.entity_key)))"""),
}


def sql(names: str, select: str) -> str:
    """A query over the named expressions and all that they need."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in CTE[n][0].split():
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + select
