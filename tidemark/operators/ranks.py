"""Order statistics of groups of any size: ranks, shares and exact percentiles with no task that sees a whole large group.

Equal values of a group are counted first, map-side. Groups with very many values are
cut into ranges at sketched quantiles of their own; a running sum within each
range, raised by what lies in the ranges before it, says of every value how many rows
of its group are less and how many are not greater. Rank, cumulative share and the
interpolated percentiles follow from these two numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored

#: A group is large if it has more than this share of all distinct values, and more of them than FLOOR.
LARGE, FLOOR = 1 / 256, 10_000
#: Ranges that a large group is cut into.
RANGES = 128


def ranked(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The distinct values of each group: group, value, rows, less, upto, of.

    ``rows`` have the value, ``less`` have less, ``upto`` have at most it, ``of`` are all of the group.
    Null values are left out; groups can be null. Fewer than 1 / LARGE groups are large, so their cuts
    and the sums of their ranges are bounded and broadcast.
    """
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("rows")))
    sizes = counts.groupBy(*group).agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    least = max(total * LARGE, FLOOR)
    own = Window.partitionBy(*group)
    if most <= least:
        upto = F.sum("rows").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumns({"upto": upto, "of": F.sum("rows").over(own)}).withColumn("less", F.col("upto") - F.col("rows"))
    key = F.xxhash64(*group)
    shares = [k / RANGES for k in range(1, RANGES)]
    large = sizes.where(F.col("n") > least).select(key.alias("_tm_k"))
    cuts = counts.join(F.broadcast(large), key == F.col("_tm_k")).groupBy("_tm_k").agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), F.lit(shares), F.lit(20 * RANGES))).alias("_tm_cuts"))
    ranges = counts.join(F.broadcast(stored(cuts)), key == F.col("_tm_k"), "left")
    ranges = ranges.withColumn("_tm_range", F.when(F.col("_tm_k").isNotNull(), F.size(F.filter("_tm_cuts", lambda c: c < F.col(value).cast("double")))).otherwise(-1)).drop("_tm_cuts")
    along = Window.partitionBy("_tm_k").orderBy("_tm_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranges.where("_tm_range >= 0").groupBy("_tm_k", "_tm_range").agg(F.sum("rows").alias("_tm_n"))
    sums = sums.select(F.col("_tm_k").alias("_tm_l"), F.col("_tm_range").alias("_tm_r"), (F.sum("_tm_n").over(along) - F.col("_tm_n")).alias("_tm_before"), F.sum("_tm_n").over(Window.partitionBy("_tm_k")).alias("_tm_all"))
    inside = Window.partitionBy(*group, "_tm_range")
    out = ranges.withColumns({"upto": F.sum("rows").over(inside.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "of": F.sum("rows").over(inside)})
    out = out.join(F.broadcast(stored(sums)), (F.col("_tm_k") == F.col("_tm_l")) & (F.col("_tm_range") == F.col("_tm_r")), "left")
    upto = F.col("upto") + F.coalesce("_tm_before", F.lit(0))
    return out.select(*group, value, "rows", upto.alias("upto"), F.coalesce("_tm_all", "of").alias("of"), (upto - F.col("rows")).alias("less"))


def percentiles(values: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A row for each group of ``ranked``: the exact percentiles, interpolated between neighbours, under the names in ``shares``."""

    def at(share: float) -> Column:
        place = F.lit(share) * (F.col("of") - 1)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda k: F.max(F.when((F.col("less") <= k) & (k < F.col("upto")), F.col(value).cast("double")))
        weight = F.max(place - low)
        return F.when(weight == 0, holds(low)).otherwise((1 - weight) * holds(low) + weight * holds(high))

    return values.groupBy(*group).agg(*[at(q).alias(n) for n, q in shares.items()])


def with_ranks(df: DataFrame, group: list[str], value: str, rank: str | None = None, from_top: str | None = None, share: str | None = None) -> DataFrame:
    """``df`` with the least rank of its value from below, from above, and its cumulative share, under the names given; rows without a value go."""
    facts = ranked(df, group, value)
    made = {rank: F.col("less") + 1, from_top: F.col("of") - F.col("upto") + 1, share: F.col("upto") / F.col("of")}
    facts = facts.select(*group, value, *[c.cast("double" if n == share else "bigint").alias(n) for n, c in made.items() if n])
    # Spark broadcasts the facts if they are small and splits skewed partitions of the rows otherwise.
    return df.join(facts, [*group, value])


def top_sum(values: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """group, top: the sum of the ``k`` highest values of each group of ``ranked``; equal values at the limit count as far as it goes."""
    above = F.col("of") - F.col("upto")
    taken = F.greatest(F.lit(0), F.least(F.col("rows"), F.lit(k) - above))
    return values.groupBy(*group).agg(F.sum(taken * F.col(value)).alias("top"))
