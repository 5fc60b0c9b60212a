"""Funnels: how many rows pass each of a list of stages and all before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth(stages: list[Column]) -> Column:
    """How many of the first stages a row passes in a row; a stage that is null is not passed."""
    out = F.lit(len(stages))
    for k, stage in reversed(list(enumerate(stages))):
        out = F.when(F.coalesce(stage, F.lit(False)), out).otherwise(k)
    return out


def funnel(df: DataFrame, stages: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """by, place (from 0: all rows), stage, passed, dropped (of those that passed the stage before), share_pct.

    A row is counted once, under the deepest stage that it reaches; the rest is sums
    over those few counts. So a funnel of any depth is one aggregation of the
    rows, whatever its stages.
    """
    by, names = by or [], ["all", *stages]
    per = df.withColumn("_tm_depth", depth(list(stages.values()))).groupBy(*by, "_tm_depth").agg(F.count("*").alias("n"))
    reached = [F.coalesce(F.sum(F.when(F.col("_tm_depth") >= k, F.col("n"))), F.lit(0)).alias(f"_{k}") for k in range(len(names))]
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("stage"), F.col(f"_{k}").alias("passed"), (F.col(f"_{max(k - 1, 0)}") - F.col(f"_{k}")).alias("dropped"), F.col("_0").alias("of")) for k, n in enumerate(names)])
    out = per.groupBy(*by).agg(*reached).select(*by, F.explode(rows).alias("x")).select(*by, "x.*")
    return out.withColumn("share_pct", F.expr("CASE WHEN of > 0 THEN CAST((2 * passed * 1000000 + of) div (2 * of) AS DOUBLE) / 10000 END")).drop("of")
