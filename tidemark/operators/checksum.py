"""Order-free checksums of tables, by range of a key: what is equal has equal sums, what differs names its range.

A checksum is a row count and two sums over the hashes of the rows, so it is
aggregated before the shuffle and two tables are compared by a handful of rows,
never by a join of their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a key is cut into where the caller names none.
RANGES = 64


def row_hash(columns: list[str]) -> Column:
    """A hash of these columns that tells null from every value."""
    told = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*told)


def sums(hashed: str) -> list[Column]:
    """row_count, xor and total of the hashes: xor sees what is there an odd number of times, the total also what is there twice."""
    return [F.count("*").alias("row_count"), F.coalesce(F.bit_xor(hashed), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.col(hashed).cast("decimal(20,0)")), F.lit(0)).alias("total")]


def checksums(df: DataFrame, columns: list[str], by: Column | None = None) -> DataFrame:
    """row_count, xor and total of ``df`` over ``columns``, for each value of ``by`` (as text in key_range) if it is given. An empty table without ``by`` has zeros."""
    columns = sorted(columns)
    if by is None:
        return df.select(row_hash(columns).alias("h")).agg(*sums("h"))
    return df.select(by.cast("string").alias("key_range"), row_hash(columns).alias("h")).groupBy("key_range").agg(*sums("h"))


def ranges_of(key: str, ranges: int = RANGES) -> Column:
    """A key's range: equal keys are in one range whatever the table."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(ranges))


def reconcile(name: str, source: DataFrame, target: DataFrame, columns: list[str], by: Column | None = None, key: str | None = None, amounts: dict[str, str] | None = None) -> DataFrame:
    """A row for each key range: what ``source`` and ``target`` count and sum, and whether they hold the same rows.

    Both have ``columns``. ``by`` names the ranges (a period, say); without it they
    are RANGES runs of the hash of ``key``. ``amounts`` maps names to SQL expressions
    over ``columns`` that are summed on both sides. status: MATCH, DIFFERENT (as many rows
    but not the same), SHORT (the target has fewer) or EXCESS.
    """
    by = ranges_of(key) if by is None else by
    amounts = amounts or {}

    def side(df: DataFrame, p: str) -> DataFrame:
        d = df.select(by.cast("string").alias("key_range"), row_hash(sorted(columns)).alias("h"), *[F.expr(e).alias(n) for n, e in amounts.items()])
        rows, xor, total = sums("h")
        out = d.groupBy("key_range").agg(rows, xor, total, *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in amounts])
        return out.select(F.col("key_range").alias(f"_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in ("row_count", "xor", "total", *amounts)])

    d = side(source, "source").join(side(target, "target"), F.col("_source").eqNullSafe(F.col("_target")), "full")
    zero = [c for c in d.columns if not c.startswith("_")]
    d = d.select(F.coalesce("_source", "_target").alias("key_range"), *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])
    same = (F.col("source_xor") == F.col("target_xor")) & (F.col("source_total") == F.col("target_total"))
    fewer, more = F.col("target_row_count") < F.col("source_row_count"), F.col("target_row_count") > F.col("source_row_count")
    status = F.when(fewer, "SHORT").when(more, "EXCESS").when(same, "MATCH").otherwise("DIFFERENT")
    kept = [f"{p}_{c}" for c in ("row_count", *amounts) for p in ("source", "target")]
    return d.select(F.lit(name).alias("reconciliation"), "key_range", *kept, status.alias("status"))
