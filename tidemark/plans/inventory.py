"""The primitive operators, one query each, on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import age, fee_status, joined, like_text, repaired, sounds_like, to_amount, to_date, to_long
from ..operators import quality
from ..operators.asof import asof_backward, peak_to_date, top_one
from ..sources.files import read_csv, scratch, stored, write_csv
from .bindings import Model, age_sql, sql
from . import dashboard as D
from .registry import ORACLE_SQL, QUERIES, register, six

DAY = "o_orderdate::DATE"

# Scalars ------------------------------------------------------------------------------------------------------------
TEXTS = "CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' 12 ' WHEN 3 THEN '+5' WHEN 4 THEN 'abc' WHEN 5 THEN '12.7' WHEN 6 THEN '-3' ELSE CAST(p_size AS STRING) END"
register(
    "guarded_casts",
    lambda m: m.t("part").select("p_partkey", F.expr(TEXTS).alias("x")).select("p_partkey", to_long(F.col("x")).alias("whole"), to_amount(F.col("x")).alias("amount"), fee_status(F.col("x")).alias("fee_status")),
    f"""SELECT p_partkey, CASE WHEN regexp_full_match(x, '[0-9]+') THEN x::BIGINT END AS whole, CASE WHEN regexp_full_match(x, '[0-9]+([.][0-9]+)?') THEN round(x::DECIMAL(38,10))::BIGINT END AS amount,
    CASE WHEN x IS NULL THEN 'unknown_or_undisclosed' WHEN NOT regexp_full_match(x, '-?[0-9]+([.][0-9]+)?') THEN 'invalid_format' WHEN x::DOUBLE < 0 THEN 'invalid_negative' WHEN x::DOUBLE = 0 THEN 'recorded_zero_ambiguous' ELSE 'numeric_fee' END AS fee_status
    FROM (SELECT p_partkey, {TEXTS} AS x FROM part)""",
)
register(
    "guarded_dates",
    lambda m: m.t("orders").select("o_orderkey", to_date(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 10:00:00') WHEN o_orderkey % 3 = 1 THEN '2023-02-30' ELSE 'n/a' END")).alias("d")),
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN {DAY} END AS d FROM orders",
)
register(
    "calendar",
    lambda m: m.t("orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d")).select(
        "d", F.date_format("d", "yyyyMMdd").cast("int").alias("date_key"), F.year("d").alias("y"), F.quarter("d").alias("q"), F.month("d").alias("m"), F.date_format("d", "MMM").alias("month_name"), F.date_format("d", "E").alias("day_name"),
        F.expr("extract(DAYOFWEEK_ISO FROM d)").alias("iso_day"), F.weekofyear("d").alias("iso_week"), F.trunc("d", "month").alias("month_start"),
    ),
    f"""SELECT d, strftime(d, '%Y%m%d')::INT AS date_key, year(d)::INT AS y, quarter(d)::INT AS q, month(d)::INT AS m, strftime(d, '%b') AS month_name, strftime(d, '%a') AS day_name, isodow(d)::INT AS iso_day, weekofyear(d)::INT AS iso_week, date_trunc('month', d)::DATE AS month_start
    FROM (SELECT unnest(generate_series(min({DAY}), max({DAY}), INTERVAL 1 DAY))::DATE AS d FROM orders)""",
)
register(
    "ages",
    lambda m: m.entities().select("entity_key", age(F.lit("2000-02-28").cast("date"), F.col("date_of_birth")).alias("a"), age(F.lit("1980-02-29").cast("date"), F.col("date_of_birth")).alias("b")),
    sql("ent", f"SELECT entity_key, {age_sql('DATE ' + chr(39) + '2000-02-28' + chr(39), 'date_of_birth')} AS a, {age_sql('DATE ' + chr(39) + '1980-02-29' + chr(39), 'date_of_birth')} AS b FROM ent"),
)
register(
    "text_functions",
    lambda m: m.t("part").select("p_partkey", F.left("p_name", F.lit(5)).alias("l"), F.right("p_name", F.lit(2)).alias("r"), joined(F.col("p_brand"), F.expr("CASE WHEN p_size > 20 THEN p_type END")).alias("c"), F.concat_ws("|", "p_brand", "p_type").alias("w"), F.nullif(F.trim(F.expr("CASE WHEN p_size > 25 THEN '  ' ELSE p_name END")), F.lit("")).alias("n")),
    "SELECT p_partkey, left(p_name, 5) AS l, right(p_name, 2) AS r, concat(p_brand, CASE WHEN p_size > 20 THEN p_type END) AS c, concat_ws('|', p_brand, p_type) AS w, nullif(trim(CASE WHEN p_size > 25 THEN '  ' ELSE p_name END), '') AS n FROM part",
)
register("text_repair", lambda m: m.t("nation").select("n_nationkey", repaired(F.when(F.col("n_nationkey") % 3 == 0, F.lit("FuÃŸballclub")).when(F.col("n_nationkey") % 3 == 1, F.lit("Âx")).otherwise(F.col("n_name"))).alias("name")),
    "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Fußballclub' WHEN 1 THEN 'Âx' ELSE n_name END AS name FROM nation")
register("accent_search", lambda m: m.t("documents").where(sounds_like(F.col("text"), "eau")).select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE contains(strip_accents(lower(text)), 'eau')")
register("composite_keys", lambda m: m.valuations().select("entity_key", "valuation_date", (F.col("entity_key") * 100000000 + F.date_format("valuation_date", "yyyyMMdd").cast("bigint")).alias("valuation_key"), F.greatest(F.col("market_value"), F.lit(100000)).alias("g"), F.least(F.col("market_value"), F.lit(100000)).alias("l")), sql("val", "SELECT entity_key, valuation_date, entity_key * 100000000 + strftime(valuation_date, '%Y%m%d')::BIGINT AS valuation_key, greatest(market_value, 100000) AS g, least(market_value, 100000) AS l FROM val"))
register("add_months", lambda m: m.t("orders").select("o_orderkey", *[F.add_months(F.col("o_orderdate").cast("date"), k).alias(f"m{k}") for k in (1, 6, 12, 24)]), f"SELECT o_orderkey, {', '.join(f'({DAY} + INTERVAL {k} MONTH)::DATE AS m{k}' for k in (1, 6, 12, 24))} FROM orders")
register("json_rows", lambda m: m.t("region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("j")), "SELECT r_regionkey, to_json({'r_regionkey': r_regionkey, 'r_name': r_name})::VARCHAR AS j FROM region")

# Filters ------------------------------------------------------------------------------------------------------------
register("ranges_and_members", lambda m: m.t("part").where(F.col("p_size").between(5, 15) & F.col("p_type").isin("ECONOMY", "STANDARD") & F.array_contains(F.lit([5, 6, 7, 8, 9, 10]), F.col("p_size"))).select("p_partkey", "p_size", "p_type"), "SELECT p_partkey, p_size, p_type FROM part WHERE p_size BETWEEN 5 AND 15 AND p_type IN ('ECONOMY', 'STANDARD') AND list_contains([5, 6, 7, 8, 9, 10], p_size)")
register("pattern_search", lambda m: m.t("part").where(like_text(F.col("p_name"), "RED%w")).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%w%'")
register("three_valued_flags", lambda m: m.observations().groupBy((F.col("is_starter") & (F.col("goals") > 3)).alias("flag")).agg(F.count("*").alias("n")), sql("obs", "SELECT is_starter AND goals > 3 AS flag, count(*) AS n FROM obs GROUP BY 1"))
register("dynamic_filters", lambda m: m.kpi().where(D.condition(D.checked({"season": 1997, "position": "BUILDING", "competition": ""}, {"season": {1996, 1997}, "position": {"BUILDING", "FURNITURE"}}))).select("entity_key", "competition_key", "season_key"), sql("kpi", "SELECT entity_key, competition_key, season_key FROM kpi WHERE season_key = 1997 AND position_group = 'BUILDING'"))

# Joins --------------------------------------------------------------------------------------------------------------
register("role_playing_joins", lambda m: m.t("lineitem").join(m.t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(m.t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(m.t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    .join(m.t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer")), "c_nationkey", "left").join(m.t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller")), "s_nationkey", "left").groupBy("buyer", "seller").agg(F.count("*").alias("n")),
    "SELECT b.n_name AS buyer, s.n_name AS seller, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation b ON b.n_nationkey = c_nationkey LEFT JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY 1, 2")
register("guarded_join", lambda m: m.t("orders").select("o_orderkey", to_long(F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE CAST(o_custkey AS STRING) END")).alias("k")).join(m.t("customer").select("c_custkey", "c_name"), F.col("k") == F.col("c_custkey"), "left").select("o_orderkey", "c_name"), "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_orderkey % 4 <> 0 AND o_custkey = c_custkey")
register("anti_join", lambda m: m.t("orders").join(m.t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
register("null_as_empty_join", lambda m: quality.mapping_coverage(m.t("part").select(F.expr("CASE WHEN p_size > 40 THEN NULL ELSE p_type END").alias("kind")), m.t("part").where("p_size < 3").select(F.expr("CASE WHEN p_type = 'ECONOMY' THEN '' ELSE p_type END").alias("kind")), ["kind"]),
    """SELECT kind, n AS row_count, ((2 * n * 1000000 + sum(n) OVER ()) // (2 * sum(n) OVER ()))::DOUBLE / 10000 AS share_pct, EXISTS (SELECT 1 FROM part WHERE p_size < 3 AND coalesce(CASE WHEN p_type = 'ECONOMY' THEN '' ELSE p_type END, '') = coalesce(kind, '')) AS is_mapped
    FROM (SELECT CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS kind, count(*)::BIGINT AS n FROM part GROUP BY 1)""")  # fmt: skip
register("parameter_join", lambda m: m.t("orders").join(F.broadcast(m.t("orders").agg(F.max("o_orderdate").alias("last")))).groupBy(F.datediff("last", "o_orderdate").alias("age_days")).agg(F.count("*").alias("n")), "SELECT date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders))::INT AS age_days, count(*) AS n FROM orders GROUP BY 1")
EV = lambda m, kind: m.t("events").where(F.col("event_type") == kind)
register("asof_events", lambda m: asof_backward(EV(m, "purchase").select("event_id", "user_id", "ts"), EV(m, "view").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("v")), "user_id", "ts", "seen", {"view_ts": "seen", "view_value": "v"}).select("event_id", "view_ts", "view_value"),
    "SELECT p.event_id, v.ts AS view_ts, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
register("asof_events_in_spans", lambda m: asof_backward(EV(m, "purchase").select("event_id", "user_id", "ts"), EV(m, "view").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("v")), "user_id", "ts", "seen", {"view_ts": "seen", "view_value": "v"}, span_days=3).select("event_id", "view_ts", "view_value"), ORACLE_SQL["asof_events"])
PEAK = sql("val", "SELECT o_orderkey, max(market_value) AS peak, (array_agg(valuation_date ORDER BY market_value DESC, valuation_date))[1] AS peak_date FROM orders LEFT JOIN val ON entity_key = o_custkey AND valuation_date <= o_orderdate::DATE GROUP BY o_orderkey")
for n, span in (("peak_to_date", None), ("peak_to_date_in_spans", 200)):
    register(n, lambda m, span=span: peak_to_date(m.t("orders").select("o_orderkey", F.col("o_custkey").alias("entity_key"), F.col("o_orderdate").cast("date").alias("d")), m.valuations(), "entity_key", "d", "valuation_date", "market_value", {"peak": "market_value", "peak_date": "valuation_date"}, span_days=span).select("o_orderkey", "peak", "peak_date"), PEAK)
register("reconciliation", lambda m: m.stints().groupBy("entity_key", "competition_key", "season_key").agg(F.sum("minutes_played").alias("s")).join(m.seasons(), ["entity_key", "competition_key", "season_key"]).agg(F.count("*").alias("rows_compared"), F.count_if(F.col("s") != F.col("minutes_played")).alias("mismatches")), sql("season", "SELECT count(*) AS rows_compared, 0::BIGINT AS mismatches FROM season"))

# Aggregates ---------------------------------------------------------------------------------------------------------
register("grouped_aggregates", lambda m: m.t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.round(F.avg("l_quantity"), 6).alias("a"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.bool_or(F.col("l_tax") > 0.07).alias("b")),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS sd, bool_or(l_tax > 0.07) AS b FROM lineitem GROUP BY 1, 2")
register("conditional_aggregates", lambda m: m.t("lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).alias("n"), F.countDistinct(F.when(F.col("l_tax") > 0.04, F.col("l_suppkey"))).alias("suppliers"), F.countDistinct(F.struct("l_suppkey", F.expr("nullif(l_linenumber, 1)"))).alias("pairs"), F.percentile(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")), F.lit(0.5)).alias("med")).withColumn("med", F.round("med", 4)),
    "SELECT l_linestatus, count(*) FILTER (l_discount > 0.05) AS n, count(DISTINCT l_suppkey) FILTER (l_tax > 0.04) AS suppliers, count(DISTINCT (l_suppkey, nullif(l_linenumber, 1))) AS pairs, round(quantile_cont(l_extendedprice, 0.5) FILTER (l_discount > 0.05), 4) AS med FROM lineitem GROUP BY 1")
Q5 = (0.05, 0.25, 0.5, 0.75, 0.95)
register("exact_percentiles", lambda m: m.t("orders").groupBy("o_orderstatus").agg(*[F.round(F.percentile("o_totalprice", F.lit(q)), 4).alias(f"p{int(q * 100)}") for q in Q5], F.round(F.percentile(F.log1p("o_totalprice"), F.lit(0.5)), 6).alias("log_median")), "SELECT o_orderstatus, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS p{int(q * 100)}" for q in Q5) + ", round(quantile_cont(ln(1 + o_totalprice), 0.5), 6) AS log_median FROM orders GROUP BY 1")
register("percentile_of_percentiles", lambda m: m.t("orders").groupBy("o_custkey", "o_orderstatus").agg(F.percentile("o_totalprice", F.lit(0.5)).alias("p")).groupBy("o_orderstatus").agg(F.round(F.percentile("p", F.lit(0.5)), 4).alias("median_of_medians")), "SELECT o_orderstatus, round(quantile_cont(p, 0.5), 4) AS median_of_medians FROM (SELECT o_custkey, o_orderstatus, quantile_cont(o_totalprice, 0.5) AS p FROM orders GROUP BY 1, 2) GROUP BY 1")
register("pivot", lambda m: m.t("lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_extendedprice")).withColumnsRenamed({"A": "flag_a", "N": "flag_n", "R": "flag_r"}), "SELECT l_linestatus, " + ", ".join(f"max(l_extendedprice) FILTER (l_returnflag = '{f}') AS flag_{f.lower()}" for f in "ANR") + " FROM lineitem GROUP BY 1")
register("having", lambda m: m.t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
register("category_counts", lambda m: m.t("events").groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
register("distinct_rows", lambda m: m.t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
register("distinct_on", lambda m: top_one(m.t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey"), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_totalprice DESC, o_orderkey")

# Windows ------------------------------------------------------------------------------------------------------------
def by_date():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


register("window_functions", lambda m: m.t("orders").select("o_orderkey", F.row_number().over(by_date()).alias("rn"), F.count("*").over(Window.partitionBy("o_custkey")).alias("size"), F.lag("o_orderkey").over(by_date()).alias("before"), F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderstatus"))).alias("rk"), F.round(F.cume_dist().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")) * 100, 6).alias("cd")),
    "SELECT o_orderkey, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey) AS size, lag(o_orderkey) OVER w AS before, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC) AS rk, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) * 100, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
register("local_median", lambda m: m.t("orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")).withColumn("med", F.expr("percentile(n, 0.5) OVER (PARTITION BY o_custkey ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")), "SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY o_custkey ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med FROM (SELECT o_custkey, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1, 2)")
register("top_ten_per_group", lambda m: m.t("part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("k <= 10").select("p_brand", "p_partkey", "k"), "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part QUALIFY k <= 10")

# Sorting, limits, sets ----------------------------------------------------------------------------------------------
register("top_k", lambda m: m.t("customer").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(30).select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 30")
register("custom_order", lambda m: m.t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '5-LOW' THEN 1 ELSE 3 END"), "o_orderpriority"))), "SELECT *, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '5-LOW' THEN 1 ELSE 3 END, o_orderpriority) AS place FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
register("union_all", lambda m: m.t("customer").select(F.col("c_nationkey").alias("k")).unionAll(m.t("supplier").select("s_nationkey")), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
register("union_distinct", lambda m: m.t("customer").select(F.col("c_nationkey").alias("k")).union(m.t("supplier").select("s_nationkey")).distinct(), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
register("set_difference", lambda m: m.t("customer").select(F.col("c_custkey").alias("k")).subtract(m.t("supplier").select("s_suppkey")), "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier")
register("recommended_seasons", lambda m: m.kpi().groupBy("season_key", "competition_key").agg(F.count("*").alias("n")).where("n >= 20").groupBy("season_key").agg(F.countDistinct("competition_key").alias("c")).where("c = 5").orderBy(F.desc("season_key")).limit(3).select("season_key"), sql("kpi", "SELECT season_key FROM (SELECT season_key, competition_key FROM kpi GROUP BY ALL HAVING count(*) >= 20) GROUP BY 1 HAVING count(DISTINCT competition_key) = 5 ORDER BY 1 DESC LIMIT 3"))
HORIZON_ROWS = "(6, 'half'), (12, 'one'), (24, 'two')"


def inline_rows(m: Model) -> DataFrame:
    """Orders by inline horizons of twice their month."""
    named = m.t("region").sparkSession.sql(f"SELECT * FROM VALUES {HORIZON_ROWS} AS t(months, name)")
    return m.t("orders").select((F.month("o_orderdate") * 2).alias("months")).join(F.broadcast(named), "months").groupBy("months", "name").agg(F.count("*").alias("orders"))


register("inline_rows", inline_rows, f"SELECT months, name, count(*) AS orders FROM orders JOIN (VALUES {HORIZON_ROWS}) t(months, name) ON months = 2 * month(o_orderdate) GROUP BY 1, 2")

# Quality ------------------------------------------------------------------------------------------------------------
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6}
register("table_profile", lambda m: quality.table_profile({n: m.t(n) for n in TABLES}), " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, {WIDTHS[n]}::BIGINT AS column_count FROM {n}" for n in TABLES))
GAPS = "CASE WHEN c_custkey % 10 = 0 THEN '  ' WHEN c_custkey % 10 = 1 THEN NULL ELSE c_name END"
register("missingness", lambda m: quality.missingness(m.t("customer").select("c_custkey", F.expr(GAPS).alias("name")), "customer"), f"SELECT 'customer' AS table_name, x.column_name, row_count, x.missing_count FROM (SELECT count(*) AS row_count, unnest([{{'column_name': 'c_custkey', 'missing_count': 0::BIGINT}}, {{'column_name': 'name', 'missing_count': count(*) FILTER (coalesce(trim({GAPS}), '') = '')}}]) AS x FROM customer)")
register("key_check", lambda m: quality.key_check(m.t("lineitem").withColumn("l_linenumber", F.expr("nullif(l_linenumber, 7)")), "lineitem", ["l_orderkey", "l_linenumber"]), "SELECT 'lineitem' AS table_name, 'l_orderkey+l_linenumber' AS key_columns, coalesce(sum(n) FILTER (e), 0)::BIGINT AS null_key_rows, count(*) FILTER (NOT e AND n > 1) AS duplicate_groups, coalesce(sum(n - 1) FILTER (NOT e AND n > 1), 0)::BIGINT AS excess_rows FROM (SELECT l_orderkey, nullif(l_linenumber, 7) AS k, nullif(l_linenumber, 7) IS NULL AS e, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)")
register("reference_check", lambda m: quality.union_all([quality.reference_check(m.t("orders"), m.t("lineitem"), "o_orderkey", "l_orderkey", "orders_to_lineitem"), quality.reference_check(m.t("lineitem"), m.t("orders"), "l_orderkey", "o_orderkey", "lineitem_to_orders")]),
    " UNION ALL ".join(f"SELECT '{n}' AS relationship, count(*) AS checked_rows, count(*) FILTER ({c} NOT IN (SELECT {p} FROM {pt})) AS orphan_rows, count(DISTINCT {c}) FILTER ({c} NOT IN (SELECT {p} FROM {pt})) AS orphan_keys, CASE WHEN count(*) FILTER ({c} NOT IN (SELECT {p} FROM {pt})) = 0 THEN 'PASS' ELSE 'REVIEW' END AS status FROM {ct}" for n, ct, c, pt, p in (("orders_to_lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("lineitem_to_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"))))
DTEXT = "CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN '31.12.1999' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"
register("date_check", lambda m: quality.date_check(m.t("orders").select(F.expr(DTEXT).alias("d")), "d", "orders.date", "2001-01-01"), f"SELECT 'orders.date' AS check_name, count(*) FILTER (d = '') AS missing_rows, count(*) FILTER (d <> '' AND NOT regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS invalid_rows, min(try_cast(d AS DATE)) AS minimum_date, max(try_cast(d AS DATE)) AS maximum_date, count(*) FILTER (try_cast(d AS DATE) > DATE '2001-01-01') AS future_rows FROM (SELECT {DTEXT} AS d FROM orders)")
register("number_check", lambda m: quality.number_check(m.t("part").select(F.expr(TEXTS).alias("x")), "x", "part.x", 0, 40), f"SELECT 'part.x' AS check_name, count(*) FILTER (coalesce(trim(x), '') = '') AS missing_rows, count(*) FILTER (coalesce(trim(x), '') <> '' AND NOT regexp_full_match(trim(x), '-?[0-9]+([.][0-9]+)?')) AS invalid_rows, count(*) FILTER (CASE WHEN regexp_full_match(trim(x), '-?[0-9]+([.][0-9]+)?') THEN trim(x)::DOUBLE < 0 END) AS below_rows, count(*) FILTER (CASE WHEN regexp_full_match(trim(x), '-?[0-9]+([.][0-9]+)?') THEN trim(x)::DOUBLE > 40 END) AS above_rows FROM (SELECT {TEXTS} AS x FROM part)")
BAD_VALUES = "value_date > season_end_date"


def ledger(m: Model) -> DataFrame:
    s, k = stored(m.seasons()), ["entity_key", "competition_key", "season_key"]
    shipped = m.t("lineitem").join(m.t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.contracts([
        ("season_grain", s.groupBy(*k).count().where("count > 1")),
        ("value_not_after_season_end", s.where(BAD_VALUES)),
        ("season_entity_known", s.join(m.entities(), "entity_key", "left_anti")),
        ("ship_not_before_order", shipped.where("l_shipdate < o_orderdate")),
        ("shipped_within_30_days", shipped.where("datediff(l_shipdate, o_orderdate) > 30")),
        ("one_club_a_season", s.where("club_count > 1")),
        ("value_in_range", s.where("value NOT BETWEEN 1000 AND 300000")),
    ], [("seasons_without_value", s.where("value IS NULL"))])


LEDGER = {
    "season_grain": "(SELECT count(*) FROM (SELECT 1 FROM season GROUP BY entity_key, competition_key, season_key HAVING count(*) > 1))",
    "value_not_after_season_end": f"(SELECT count(*) FROM season WHERE {BAD_VALUES})",
    "season_entity_known": "(SELECT count(*) FROM season WHERE entity_key NOT IN (SELECT entity_key FROM ent))",
    "ship_not_before_order": "(SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate)",
    "shipped_within_30_days": "(SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate::DATE - o_orderdate::DATE > 30)",
    "one_club_a_season": "(SELECT count(*) FROM season WHERE club_count > 1)",
    "value_in_range": "(SELECT count(*) FROM season WHERE value NOT BETWEEN 1000 AND 300000)",
}
register("contract_ledger", ledger, sql("season ent", "SELECT n AS check_name, 0::BIGINT AS expected, a AS actual, CASE WHEN a = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS n, {q}::BIGINT AS a" for n, q in LEDGER.items()) + ") UNION ALL SELECT 'seasons_without_value', NULL, count(*), 'INFO' FROM season WHERE value IS NULL"))
register("coverage", lambda m: m.t("orders").withColumn("y", F.year("o_orderdate")).join(m.t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("seen", F.lit(True)), "o_orderkey", "left").groupBy("y").agg(F.count("*").alias("games"), F.count("seen").alias("covered")).withColumn("pct", F.expr("CAST((2 * covered * 10000 + games) div (2 * games) AS DOUBLE) / 100")).withColumn("status", F.expr("CASE WHEN games = covered THEN 'FULL' WHEN pct >= 99 THEN 'HIGH' ELSE 'REVIEW' END")),
    "SELECT *, CASE WHEN games = covered THEN 'FULL' WHEN pct >= 99 THEN 'HIGH' ELSE 'REVIEW' END AS status FROM (SELECT *, ((2 * covered * 10000 + games) // (2 * games))::DOUBLE / 100 AS pct FROM (SELECT year(o_orderdate)::INT AS y, count(*) AS games, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS covered FROM orders GROUP BY 1))")
register("eligibility_funnel", lambda m: m.kpi().groupBy("eligibility_status").agg(F.count("*").alias("n")), sql("kpi", "SELECT eligibility_status, count(*) AS n FROM kpi GROUP BY 1"))
register("standardization_check", lambda m: m.scores().groupBy("competition_key", "season_key", "position_group").agg(F.avg("performance_z").alias("a"), F.stddev_samp("performance_z").alias("s")).agg(F.count("*").alias("peer_groups"), F.count_if((F.abs("a") > 1e-5) | (F.abs(F.col("s") - 1) > 1e-5)).alias("off")), sql("eff", "SELECT count(*) AS peer_groups, count(*) FILTER (abs(a) > 1e-5 OR abs(s - 1) > 1e-5) AS off FROM (SELECT avg(performance_z) AS a, stddev_samp(performance_z) AS s FROM eff GROUP BY competition_key, season_key, position_group)"))
register("source_snapshot", lambda m: quality.union_all([m.t(t).agg(F.min(F.col(c).cast("date")).alias("min_date"), F.max(F.col(c).cast("date")).alias("max_date"), F.count("*").alias("row_count")).withColumn("source_table", F.lit(t)) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]), " UNION ALL ".join(f"SELECT min({c}::DATE) AS min_date, max({c}::DATE) AS max_date, count(*) AS row_count, '{t}' AS source_table FROM {t}" for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))))

# Dashboard ----------------------------------------------------------------------------------------------------------
F97 = {"season": 1997}
register("api_overview", lambda m: six(D.overview(m.scores(), {}), "median_value"), sql("eff", "SELECT count(*) AS entity_seasons, count(DISTINCT entity_key) AS entities, sum(value)::BIGINT AS total_value, round(quantile_cont(value, 0.5), 6) AS median_value, min(value_date) AS earliest_value_date, max(value_date) AS latest_value_date FROM eff"))
for n, by in (("api_overview_by_position", "position_group"), ("api_overview_by_competition", "competition_key"), ("api_overview_by_band", "efficiency_band")):
    register(n, lambda m, by=by: six(D.overview_by(m.scores(), F97, by), "median_value"), sql("eff", f"SELECT {by}, count(*) AS entity_seasons, sum(value)::BIGINT AS total_value, round(quantile_cont(value, 0.5), 6) AS median_value FROM eff WHERE season_key = 1997 GROUP BY 1"))
register("api_efficiency", lambda m: D.efficiency(m.scores(), m.entities(), m.clubs(), F97, 50).select("entity_key", "entity_name", "competition_key", "primary_club_name", F.round("score", 6).alias("score")), sql("eff ent club", "SELECT e.entity_key, entity_name, e.competition_key, club_name AS primary_club_name, round(score, 6) AS score FROM (SELECT * FROM eff WHERE season_key = 1997 ORDER BY score DESC, entity_key, competition_key LIMIT 50) e JOIN ent USING (entity_key) LEFT JOIN club ON club_key = primary_club_key"))
register("api_search", lambda m: D.search(m.entities(), m.kpi(), "00001"), sql("ent kpi", "SELECT entity_key, entity_name, position_group, country FROM ent WHERE entity_name ILIKE '%00001%' AND entity_key IN (SELECT entity_key FROM kpi) ORDER BY entity_name, entity_key LIMIT 30"))
register("api_latest_best", lambda m: D.latest_best(m.scores(), m.entities()), sql("eff ent", "SELECT entity_key, entity_name, season_key FROM (SELECT DISTINCT ON (entity_key) * FROM eff ORDER BY entity_key, season_key DESC, score DESC, competition_key) JOIN (SELECT entity_key, entity_name FROM ent) USING (entity_key) ORDER BY score DESC, entity_name LIMIT 30"))
register("api_player", lambda m: D.history(m.development(), 7), sql("dev", "SELECT season_key, competition_key, minutes_played, value, value_change, value_growth_pct FROM dev WHERE entity_key = 7"))
register("api_transfers", lambda m: D.top_outcomes(m.outcomes(), m.entities(), 12), sql("out ent", "SELECT transfer_key, entity_name, transfer_date, fee_status, value_at_transfer, post_value, value_change, post_date FROM (SELECT * FROM out WHERE horizon_months = 12 AND is_change_eligible ORDER BY value_change DESC NULLS LAST, transfer_key LIMIT 40) o LEFT JOIN (SELECT entity_key, entity_name FROM ent) USING (entity_key)"))
register("api_clubs", lambda m: six(D.clubs_by_change(m.development(), m.clubs(), {}), "median_change"), sql("dev club", "SELECT season_end_club_key AS club_key, count(*) AS comparisons, sum(value_change)::BIGINT AS total_change, round(quantile_cont(value_change, 0.5), 6) AS median_change, count(*) FILTER (value_change > 0) AS gains, club_name FROM dev JOIN club ON club_key = season_end_club_key WHERE has_comparison GROUP BY season_end_club_key, club_name HAVING count(*) >= 10 ORDER BY median_change DESC, comparisons DESC, 1 LIMIT 60"))
register("api_team_options", lambda m: D.team_options(m.stints(), m.clubs(), F97), sql("stint club", "SELECT club_key, competition_key, count(*) AS contributors, club_name FROM stint JOIN club USING (club_key) WHERE season_key = 1997 AND valid_appearances > 0 GROUP BY ALL"))
TEAM = "valid_appearances > 0 AND season_key = 1997 AND club_key = 3"
register("api_team_roster", lambda m: D.team(m.stints(), F97, 3).join(m.entities().select("entity_key", "entity_name"), "entity_key").select("entity_key", "entity_name", "competition_key", "minutes_played", "stint_value"), sql("stint ent", f"SELECT entity_key, entity_name, stint.competition_key, minutes_played, stint_value FROM stint JOIN (SELECT entity_key, entity_name FROM ent) USING (entity_key) WHERE {TEAM}"))
register("api_team_summary", lambda m: six(D.team_summary(m.stints(), F97, 3), "median_value", "median_age"), sql("stint", f"SELECT count(*) AS contributors, sum(minutes_played)::BIGINT AS total_minutes, sum(goals)::BIGINT AS total_goals, sum(stint_value) FILTER ({D.ALIGNED})::BIGINT AS squad_value, round(quantile_cont(stint_value, 0.5) FILTER ({D.ALIGNED}), 6) AS median_value, round(quantile_cont(age_at_stint_end, 0.5), 6) AS median_age, count(*) FILTER ({D.ALIGNED}) AS with_value, ((2 * count(*) FILTER ({D.ALIGNED}) * 1000 + count(*)) // (2 * count(*)))::DOUBLE / 10 AS coverage_pct FROM stint WHERE {TEAM}"))
register("api_team_by_position", lambda m: D.team_by_position(m.stints(), F97, 3), sql("stint", f"SELECT position_group, count(*) AS contributors, sum(minutes_played)::BIGINT AS minutes_played, sum(stint_value) FILTER ({D.ALIGNED})::BIGINT AS squad_value FROM stint WHERE {TEAM} GROUP BY 1"))
register("api_team_by_age", lambda m: D.team_by_age(m.stints(), F97, 3), sql("stint", f"SELECT b AS age_band, list_position(['Under 20', '20-22', '23-25', '26-28', '29-31', '32+', 'Unknown'], b)::INT AS age_band_order, count(*) AS contributors, sum(minutes_played)::BIGINT AS minutes_played FROM (SELECT *, CASE WHEN age_at_stint_end IS NULL THEN 'Unknown' WHEN age_at_stint_end < 20 THEN 'Under 20' WHEN age_at_stint_end <= 22 THEN '20-22' WHEN age_at_stint_end <= 25 THEN '23-25' WHEN age_at_stint_end <= 28 THEN '26-28' WHEN age_at_stint_end <= 31 THEN '29-31' ELSE '32+' END AS b FROM stint WHERE {TEAM}) GROUP BY 1, 2"))
NAMES = ("contributors", "total_minutes", "contributions", "squad_value", "median_value")
register("api_team_benchmark", lambda m: six(D.team_benchmark(m.stints(), F97), "median_value", *[f"all_{c}" for c in NAMES]), sql("stint", f"""SELECT club_key, contributors, total_minutes, contributions, squad_value, round(median_value, 6) AS median_value, count(*) OVER () AS clubs, {', '.join(f'round(quantile_cont({c}, 0.5) OVER (), 6) AS all_{c}' for c in NAMES)} FROM (
    SELECT club_key, count(*) AS contributors, sum(minutes_played)::BIGINT AS total_minutes, sum(goals + assists)::BIGINT AS contributions, sum(stint_value) FILTER ({D.ALIGNED})::BIGINT AS squad_value, quantile_cont(stint_value, 0.5) FILTER ({D.ALIGNED}) AS median_value FROM stint WHERE valid_appearances > 0 AND season_key = 1997 GROUP BY 1)"""))
register("upper_median", lambda m: m.t("orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))).withColumn("n", F.count("*").over(Window.partitionBy("o_custkey"))).where("rn = n div 2 + 1").select("o_custkey", "o_totalprice"), "SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = count(*) OVER (PARTITION BY o_custkey) // 2 + 1")


# Files --------------------------------------------------------------------------------------------------------------
def csv_round_trip(m: Model) -> DataFrame:
    """A table written as gzip CSV and read again as text with row numbers."""
    spark: SparkSession = m.t("nation").sparkSession
    path = f"{scratch(spark)}/nation.csv"
    write_csv(m.t("nation").orderBy("n_nationkey"), path, gzip=True)
    return read_csv(spark, path).select("n_nationkey", "n_name", "n_regionkey", "_source_row_number")


register("csv_round_trip", csv_round_trip, "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, row_number() OVER (ORDER BY nation.n_nationkey) AS _source_row_number FROM nation")

from . import inventory_audit, inventory_model, inventory_routes  # noqa: E402, F401  register their queries

__all__ = ["ORACLE_SQL", "QUERIES"]
