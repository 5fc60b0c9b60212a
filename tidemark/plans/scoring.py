"""Performance against value within peer groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, z_score
from ..operators.ranks import percentiles, ranked, top_sum, with_ranks
from ..sources.files import stored
from .params import METRICS, Params

GROUP = ["competition_key", "season_key", "position_group"]
INPUTS = (*METRICS, "log_value")
#: Fixed values of the method: the lowest share of each band, from the highest, and the label below all.
BANDS = ((90, "high_relative_efficiency"), (75, "above_peer_range"), (25, "within_peer_range"))
BELOW_BANDS = "low_relative_efficiency"


def band(share: Column) -> Column:
    out = F
    for least, label in BANDS:
        out = out.when(share >= least, label)
    return out.otherwise(BELOW_BANDS)


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and standard deviation of the columns of each group, aggregated before the shuffle."""
    return df.groupBy(*GROUP).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def limits(df: DataFrame, low: float, high: float) -> DataFrame:
    """{input}_lo and {input}_hi of each group: the exact percentiles of the six inputs, all in one pass over (group, input, value)."""
    long = df.select(*GROUP, F.explode(F.array(*[F.struct(F.lit(k).alias("input"), F.col(c).cast("double").alias("value")) for k, c in enumerate(INPUTS)])).alias("x"))
    values = ranked(long.select(*GROUP, "x.input", "x.value"), [*GROUP, "input"], "value")
    found = percentiles(values, [*GROUP, "input"], "value", {"lo": low, "hi": high})
    return found.groupBy(*GROUP).agg(*[F.max(F.when(F.col("input") == k, F.col(n))).alias(f"{c}_{n}") for k, c in enumerate(INPUTS) for n in ("lo", "hi")])


#: A peer group is large if it has more than this share of all rows, and more rows than FLOOR.
LARGE, FLOOR = 1 / 256, 50_000


def apart(df: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(the rows of groups that a task can hold, those of large groups) of a written table; None where there are none."""
    sizes = df.groupBy(*GROUP).agg(F.count("*").alias("_n"))
    total, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    least = max(total * LARGE, FLOOR)
    if most <= least:
        return df, None
    large = F.broadcast(sizes.where(F.col("_n") > least).select(*GROUP))  # fewer than 1 / LARGE
    return df.join(large, GROUP, "left_anti"), df.join(large, GROUP, "left_semi")


def both(df: DataFrame, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``small`` makes of the rows of usual groups and ``large`` of those of large ones."""
    usual, rest = apart(df)
    return small(usual) if rest is None else small(usual).unionByName(large(rest))


def value_efficiency(kpi: DataFrame, p: Params) -> DataFrame:
    """Scores of the eligible rows in groups of at least ``minimum_peers``.

    Six inputs are winsorised at two percentiles and standardised within the
    group; the weighted sum of five, cards negative, is standardised again, and
    less the standardised log value it is the score. Groups without weights are
    left out. Rank and share use the score to nine decimals, so that equal scores
    tie on every engine.

    Groups that a task can hold are one shuffle and windows. Of large ones no task sees all
    rows: sums are aggregated before the shuffle, percentiles and ranks
    follow from counts in ranges of the values.
    """
    eligible = kpi.where("is_eligible").withColumn("log_value", F.log1p(F.col("value").cast("double"))).withColumn("minutes_played", F.col("minutes_played").cast("double"))
    d = both(stored(eligible), lambda d: _scores_in_windows(d, p), lambda d: _scores_in_ranges(d, p))
    return d.withColumn("efficiency_band", band(F.col("efficiency_pct"))).withColumn("version", F.lit(p.version))


def _weighted(d: DataFrame, p: Params) -> DataFrame:
    rows = [(g, *w) for g, w in p.weights.items()]
    weights = d.sparkSession.createDataFrame(rows, "position_group string, " + ", ".join(f"{c}_weight double" for c in METRICS))
    d = d.join(F.broadcast(weights), "position_group")  # a row for each group of the method
    return d.withColumn("raw_score", sum(F.col(f"{c}_z") * F.col(f"{c}_weight") * (-1 if c == "cards_per_90" else 1) for c in METRICS))


def _scores_in_windows(d: DataFrame, p: Params) -> DataFrame:
    peers = Window.partitionBy(*GROUP)
    d = d.withColumn("peers", F.count("*").over(peers)).where(F.col("peers") >= p.minimum_peers)
    # One partitioning by group for all: the rows are shuffled once, and never joined with their own summary.
    d = d.withColumns({f"{c}_q": F.percentile(c, F.lit([p.low, p.high])).over(peers) for c in INPUTS})
    d = d.withColumns({f"w_{c}": clamp(F.col(c), F.col(f"{c}_q")[0], F.col(f"{c}_q")[1]) for c in INPUTS}).drop(*[f"{c}_q" for c in INPUTS])
    d = d.withColumns({f"{c}_z": z_score(F.col(f"w_{c}"), F.avg(f"w_{c}").over(peers), F.stddev_samp(f"w_{c}").over(peers)) for c in INPUTS})
    d = _weighted(d, p)
    d = d.withColumn("performance_z", z_score(F.col("raw_score"), F.avg("raw_score").over(peers), F.stddev_samp("raw_score").over(peers)))
    d = d.withColumn("score", F.round(F.col("performance_z") - F.col("log_value_z"), 9))
    return d.withColumn("efficiency_rank", F.rank().over(peers.orderBy(F.desc("score"))).cast("bigint")).withColumn("efficiency_pct", F.cume_dist().over(peers.orderBy("score")) * 100)


def _scores_in_ranges(d: DataFrame, p: Params) -> DataFrame:
    # A group's facts are one row, which Spark broadcasts if all are small; else it splits skewed groups.
    sizes = d.groupBy(*GROUP).agg(F.count("*").alias("peers")).where(F.col("peers") >= p.minimum_peers)
    d = d.join(sizes, GROUP)
    d = stored(d.join(limits(d, p.low, p.high), GROUP).withColumns({f"w_{c}": clamp(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi")) for c in INPUTS}))
    d = d.join(moments(d, [f"w_{c}" for c in INPUTS]), GROUP)
    d = d.withColumns({f"{c}_z": z_score(F.col(f"w_{c}"), F.col(f"w_{c}_mean"), F.col(f"w_{c}_sd")) for c in INPUTS})
    d = d.drop(*[f"w_{c}_{n}" for c in INPUTS for n in ("mean", "sd")], *[f"{c}_{n}" for c in INPUTS for n in ("lo", "hi")])
    d = stored(_weighted(d, p))
    d = d.join(moments(d, ["raw_score"]), GROUP)
    d = d.withColumn("performance_z", z_score(F.col("raw_score"), F.col("raw_score_mean"), F.col("raw_score_sd"))).drop("raw_score_mean", "raw_score_sd")
    d = stored(d.withColumn("score", F.round(F.col("performance_z") - F.col("log_value_z"), 9)))
    return with_ranks(d, GROUP, "score", from_top="efficiency_rank", share="efficiency_pct").withColumn("efficiency_pct", F.col("efficiency_pct") * 100)


def peer_benchmark(scores: DataFrame) -> DataFrame:
    """Each group's values, concentration in its ten highest, and Spearman's correlation of performance and value.

    Ties take their lowest rank in the correlation; a group in which either is
    constant has none.
    """
    return both(stored(scores.withColumn("_score", F.round("performance_z", 6))), _benchmark_in_windows, _benchmark_in_ranges)


SHARES = {"p25_value": 0.25, "p50_value": 0.5, "p75_value": 0.75}
TOP = 10
TOP_SHARE = "CASE WHEN total_value > 0 THEN CAST((2 * top_10_value * 1000000 + total_value) div (2 * total_value) AS DOUBLE) / 10000 END"


def _benchmark_in_windows(scores: DataFrame) -> DataFrame:
    peers = Window.partitionBy(*GROUP)
    d = scores.withColumn("_top", F.row_number().over(peers.orderBy(F.desc("value"))))
    d = d.withColumn("_p", F.rank().over(peers.orderBy("_score")).cast("double")).withColumn("_v", F.rank().over(peers.orderBy("value")).cast("double"))
    values = F.percentile("value", F.lit(list(SHARES.values())))
    out = _correlated(d, values.alias("_q"), F.sum(F.when(F.col("_top") <= TOP, F.col("value"))).alias("top_10_value"), F.percentile("goal_contributions_per_90", F.lit(0.5)).alias("median_contributions_per_90"))
    return out.withColumns({n: F.col("_q")[k] for k, n in enumerate(SHARES)} | {"top_10_pct": F.expr(TOP_SHARE)}).drop("_q")


def _benchmark_in_ranges(scores: DataFrame) -> DataFrame:
    d = with_ranks(with_ranks(scores, GROUP, "_score", rank="_p"), GROUP, "value", rank="_v").withColumns({"_p": F.col("_p").cast("double"), "_v": F.col("_v").cast("double")})
    values = ranked(scores, GROUP, "value")
    contributions = percentiles(ranked(scores, GROUP, "goal_contributions_per_90"), GROUP, "goal_contributions_per_90", {"median_contributions_per_90": 0.5})
    facts = percentiles(values, GROUP, "value", SHARES).join(top_sum(values, GROUP, "value", TOP).withColumnRenamed("top", "top_10_value"), GROUP).join(contributions, GROUP, "left")
    return _correlated(d).join(facts, GROUP).withColumn("top_10_pct", F.expr(TOP_SHARE))


def _correlated(d: DataFrame, *more: Column) -> DataFrame:
    """Each group's sums and the correlation of the ranks _p and _v."""
    varied = (F.min("_p") < F.max("_p")) & (F.min("_v") < F.max("_v"))
    # Pearson's on the ranks by sums, so that a constant side divides nothing.
    n, sp, sv = F.count("*"), F.sum("_p"), F.sum("_v")
    top = n * F.sum(F.col("_p") * F.col("_v")) - sp * sv
    under = F.sqrt((n * F.sum(F.col("_p") * F.col("_p")) - sp * sp) * (n * F.sum(F.col("_v") * F.col("_v")) - sv * sv))
    # In ten-thousandths, which the rates are: the same on every engine.
    average = F.expr("CAST((2 * sum(CAST(round(goals_per_90 * 10000) AS BIGINT)) * 100 + count(goals_per_90)) div (2 * count(goals_per_90)) AS DOUBLE) / 1000000")
    return d.groupBy(*GROUP).agg(
        *more, n.alias("entities"), F.sum("value").alias("total_value"), average.alias("average_goals_per_90"),
        F.round(F.when(varied, top / F.nullif(under, F.lit(0.0))), 6).alias("spearman"), F.min("value_date").alias("earliest_value_date"), F.max("value_date").alias("latest_value_date"),
    )
