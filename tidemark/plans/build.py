"""The model written once, in order, with a manifest of its row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import union_all
from ..sources.files import scratch, write_table
from .bindings import Model

#: Each table reads only those before it.
ORDER = ("entities", "clubs", "valuations", "stints", "seasons", "kpi", "development", "scores", "transfers", "outcomes")


def build(m: Model, folder: str | None = None, replace: bool = False) -> dict[str, DataFrame]:
    """Writes every table of the model under ``folder``, a fresh one if none is given, and lets ``m`` read them from there.

    A table that exists is an error unless ``replace``.
    """
    spark = m.t("region").sparkSession
    folder = folder or scratch(spark)
    for name in ORDER:
        df = getattr(m, name)()
        write_table(df, f"{folder}/{name}", replace)
        m._made[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    return {name: m._made[name] for name in ORDER}


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count of each table."""
    return union_all([d.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, d in tables.items()])


def views(tables: dict[str, DataFrame], prefix: str = "tidemark_") -> list[str]:
    """Offers the tables by name to SQL in this session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in tables]
