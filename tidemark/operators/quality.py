"""Data-quality operators: profiles, keys, references, ranges, contracts. Each gives a small table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ISO_DATE, SIGNED


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def blank(c: str) -> Column:
    text = F.col(c).cast("string")
    return text.isNull() | (F.trim(text) == "")


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count, column_count."""
    return union_all([df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count")) for n, df in tables.items()])


def missingness(df: DataFrame, name: str) -> DataFrame:
    """table_name, column_name, row_count, missing_count: blank after trimming counts as missing. One scan of the table."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(blank(c)).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_count")) for c in df.columns])
    return counts.select(F.lit(name).alias("table_name"), F.col("n").alias("row_count"), F.explode(pairs).alias("x")).select("table_name", "x.column_name", "row_count", "x.missing_count")


def key_check(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows with a blank key part, groups of repeated keys, and rows beyond the first of each."""
    empty = reduce(Column.__or__, [blank(k) for k in keys])
    groups = df.groupBy(*keys, empty.alias("_e")).agg(F.count("*").alias("n"))
    full = ~F.col("_e") & (F.col("n") > 1)
    sums = [F.sum(F.when(F.col("_e"), F.col("n")).otherwise(0)), F.count_if(full), F.sum(F.when(full, F.col("n") - 1).otherwise(0))]
    return groups.agg(*[F.coalesce(s, F.lit(0)).cast("bigint").alias(n) for s, n in zip(sums, ("null_key_rows", "duplicate_groups", "excess_rows"), strict=True)]).select(
        F.lit(name).alias("table_name"), F.lit("+".join(keys)).alias("key_columns"), "null_key_rows", "duplicate_groups", "excess_rows"
    )


def reference_check(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """Rows and distinct keys of the child without a parent; PASS if there is none, REVIEW otherwise. Null keys aren't checked."""
    parents = parent.select(F.col(parent_key).alias("_p")).where("_p is not null").distinct()
    rows = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_c")).agg(F.count("*").alias("n"))
    out = rows.join(parents, F.col("_c") == F.col("_p"), "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked_rows"),
        F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"),
        F.countDistinct(F.when(F.col("_p").isNull(), F.col("_c"))).alias("orphan_keys"),
    )
    return out.select(F.lit(name).alias("relationship"), "checked_rows", "orphan_rows", "orphan_keys", F.when(F.col("orphan_rows") == 0, "PASS").otherwise("REVIEW").alias("status"))


def date_check(df: DataFrame, column: str, name: str, today: str) -> DataFrame:
    """Missing, ill-formed, earliest, latest and future dates of a text column; ``today`` is given so that reruns agree."""
    text = F.trim(F.col(column).cast("string"))
    good = F.when(text.rlike(ISO_DATE), F.try_to_date(text, "yyyy-MM-dd"))
    return df.select(blank(column).alias("m"), good.alias("d")).agg(
        F.count_if("m").alias("missing_rows"), F.count_if(~F.col("m") & F.col("d").isNull()).alias("invalid_rows"),
        F.min("d").alias("minimum_date"), F.max("d").alias("maximum_date"), F.count_if(F.col("d") > F.lit(today).cast("date")).alias("future_rows"),
    ).select(F.lit(name).alias("check_name"), "*")


def number_check(df: DataFrame, column: str, name: str, low: float | None, high: float | None) -> DataFrame:
    """Missing, ill-formed, too low and too high numbers of a text column."""
    text = F.trim(F.col(column).cast("string"))
    value = F.when(text.rlike(SIGNED), text.try_cast("double"))
    none = F.lit(False)
    return df.select(blank(column).alias("m"), value.alias("v")).agg(
        F.count_if("m").alias("missing_rows"), F.count_if(~F.col("m") & F.col("v").isNull()).alias("invalid_rows"),
        F.count_if(none if low is None else F.col("v") < low).alias("below_rows"), F.count_if(none if high is None else F.col("v") > high).alias("above_rows"),
    ).select(F.lit(name).alias("check_name"), "*")


def contracts(checks: list[tuple[str, DataFrame]], notes: list[tuple[str, DataFrame]] = ()) -> DataFrame:
    """The ledger: a row for each (name, violating rows); PASS if there is none. ``notes`` are counted without judgement, as INFO."""
    rows = [bad.agg(F.count("*").alias("actual")).select(F.lit(n).alias("check_name"), "actual", F.lit(0).cast("bigint").alias("expected")) for n, bad in checks]
    rows += [d.agg(F.count("*").alias("actual")).select(F.lit(n).alias("check_name"), "actual", F.lit(None).cast("bigint").alias("expected")) for n, d in notes]
    status = F.when(F.col("expected").isNull(), "INFO").when(F.col("actual") == F.col("expected"), "PASS").otherwise("FAIL")
    return union_all(rows).select("check_name", "expected", "actual", status.alias("status"))


def exit_status(ledger: DataFrame) -> int:
    """What a validation run ends with: 1 if any check failed."""
    return 0 if ledger.where(F.col("status") == "FAIL").isEmpty() else 1


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, ordinal_position of every column. Schemas are metadata: no table is scanned."""
    rows = [(n, c, k) for n, df in tables.items() for k, c in enumerate(df.columns, 1)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int")


def period_coverage(periods: DataFrame, group: str, period: str, count: str, covered: str, ratio: float = 0.85) -> DataFrame:
    """``periods`` (a row for each group and period) with the median of ``count`` over the five periods around it and a status.

    ADEQUATE: at least ``ratio`` of that median, and something covered.
    """
    around = Window.partitionBy(group).orderBy(period).rowsBetween(-2, 2)
    d = periods.withColumn("local_median", F.percentile(count, F.lit(0.5)).over(around))
    fine = (F.col("local_median") > 0) & (F.col(count) >= ratio * F.col("local_median")) & (F.col(covered) > 0)
    return d.withColumn("coverage_status", F.when(fine, "ADEQUATE").otherwise("REVIEW"))


def common_periods(coverage: DataFrame, group: str, period: str, members: list[str], last: int = 3) -> DataFrame:
    """The latest periods that are adequate in every one of these groups."""
    d = coverage.where((F.col("coverage_status") == "ADEQUATE") & F.col(group).isin(members))
    d = d.groupBy(period).agg(F.countDistinct(group).alias("n")).where(F.col("n") == len(members))
    return d.orderBy(F.desc(period)).limit(last).select(period)


def outliers(df: DataFrame, column: str, low: float | None, high: float | None, keep: list[str]) -> DataFrame:
    """The rows whose text is a number outside [low, high]."""
    value = F.when(F.col(column).rlike(SIGNED), F.col(column).try_cast("double"))
    bad = F.lit(False)
    for limit in (None if low is None else value < low, None if high is None else value > high):
        bad = bad if limit is None else bad | limit
    return df.where(bad).select(*keep, column)


def orphan_groups(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, date: str) -> DataFrame:
    """The child's keys without a parent: rows, first and last date."""
    lost = child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")
    return lost.groupBy(child_key).agg(F.count("*").alias("row_count"), F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def orphan_samples(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, order: list[Column], keep: list[str], each: int = 3) -> DataFrame:
    """Of each key without a parent, the first rows in this order."""
    lost = child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")
    nth = F.row_number().over(Window.partitionBy(child_key).orderBy(*order))
    return lost.withColumn("nth", nth).where(F.col("nth") <= each).select(child_key, "nth", *keep)


def mapping_coverage(df: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each combination of the columns, their share of all, and whether the mapping has it; null and empty are alike."""
    on = [F.coalesce(F.col(c), F.lit("")) == F.coalesce(F.col(f"_m_{c}"), F.lit("")) for c in columns]
    known = mapping.select(*[F.col(c).alias(f"_m_{c}") for c in columns], F.lit(True).alias("_known")).distinct()
    groups = df.groupBy(*columns).agg(F.count("*").alias("row_count")).join(known, reduce(Column.__and__, on), "left")
    total = df.agg(F.count("*").alias("total"))
    return groups.join(F.broadcast(total)).select(*columns, "row_count", F.expr("CAST((2 * row_count * 1000000 + total) div (2 * total) AS DOUBLE) / 10000").alias("share_pct"), F.coalesce("_known", F.lit(False)).alias("is_mapped"))
