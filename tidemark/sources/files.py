"""Sources and sinks: text tables from CSV, replaceable tables, small reports."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task of a wide step takes, about.
TASK_ROWS = 250_000


def tasks_of(df: DataFrame) -> int:
    """Tasks of about TASK_ROWS rows each, for a table whose rows are counted from its files' footers; no fewer than the session runs at once."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def header_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """The names in a CSV file's first line, without a byte order mark; an error if one is empty or repeated."""
    first = spark.read.option("encoding", encoding).option("multiLine", True).option("header", False).csv(path).limit(1).first()
    names = [(n or "").removeprefix("﻿").strip() for n in (first or [])]
    if not names or not all(names):
        raise ValueError(f"empty column name in {path}")
    if len(set(names)) < len(names):
        raise ValueError(f"repeated column name in {path}")
    return names


#: What the reader puts where a quoted field is empty: characters of the private use area, so that no text is taken for it.
QUOTED_EMPTY = "\ue000\uf8ff\ue000"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, gzip or not, as text columns with _source_row_number from 1 and _loaded_at_utc.

    Quotes double inside quotes and may hold line ends. An empty field is null, a
    quoted empty one (``,"",``) an empty text.
    A gzip file is one partition, so its numbers are dense and in its order; of a
    folder of files the numbers are unique and rise within a file.
    """
    names = header_of(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).option("emptyValue", QUOTED_EMPTY).csv(path)
    rows = rows.select(*[F.when(F.col(f"`{n}`") != QUOTED_EMPTY, F.col(f"`{n}`")).when(F.col(f"`{n}`") == QUOTED_EMPTY, "").alias(n) for n in names])
    return rows.withColumn("_source_row_number", F.monotonically_increasing_id() + 1).withColumn("_loaded_at_utc", F.current_timestamp())


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """true and false in lower case, null empty, a header, one file: for reports and small tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("compression", "gzip" if gzip else "none").csv(path)


def write_table(df: DataFrame, path: str, replace: bool = False, sort: list[str] | None = None) -> None:
    """Parquet at ``path``; an existing table is an error unless ``replace``. ``sort`` orders rows within files, so their statistics prune like an index."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite" if replace else "errorifexists").parquet(path)


def write_indexed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int, replace: bool = False) -> None:
    """A catalog table at ``path`` whose rows lie in ``buckets`` by the hash of ``keys``, sorted within, with Bloom filters of the keys.

    A lookup by the keys reads one bucket, and of it the row groups that can have the
    key; a join on them with a table bucketed alike shuffles neither. Statistics of
    all columns are kept for the cost-based optimiser. One file for each bucket.
    """
    blooms = {f"parquet.bloom.filter.enabled#{k}": "true" for k in keys}
    out = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).options(**blooms)
    out.mode("overwrite" if replace else "errorifexists").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def statistics(spark: SparkSession, name: str) -> DataFrame:
    """column_name, distinct_count, null_count, min, max: what ANALYZE recorded of a catalog table."""
    columns = [c.name for c in spark.catalog.listColumns(name)]
    rows = []
    for c in columns:
        said = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {name} `{c}`").collect()}
        rows.append((c, *(None if said.get(k) in (None, "NULL") else said[k] for k in ("distinct_count", "num_nulls", "min", "max"))))
    return spark.createDataFrame(rows, "column_name string, distinct_count string, null_count string, min string, max string")


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown; an error if it has more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a report")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    said = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else str(v).replace("|", "\\|")
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line([said(v) for v in r]) for r in rows)])


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: in spark.checkpoint.dir, in local mode a temporary one if that is unset. Deleted when the driver ends."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        path = f"{own.rstrip('/')}/tidemark-{uuid.uuid4().hex[:12]}"
        _stored.append((spark, path))
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    _stored.append((spark, folder))
    return f"{folder}/work"


_stored: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: what several readers share is computed once. Deleted when the driver ends."""
    path = scratch(df.sparkSession)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _stored:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before
            continue


def manifest_check(spark: SparkSession, folder: str, manifest: DataFrame, pattern: str = "*") -> DataFrame:
    """file_name, expected_bytes, expected_sha256, actual_bytes, actual_sha256, status of each file of ``manifest`` or of the folder.

    ``manifest`` has file_name, bytes and sha256. MATCH, MISMATCH, MISSING (not in
    the folder) or UNLISTED. Files are hashed where they are read, not on the driver.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("f"), F.col("length").alias("actual_bytes"), F.sha2("content", 256).alias("actual_sha256"))
    said = manifest.select("file_name", F.col("bytes").cast("bigint").alias("expected_bytes"), F.lower("sha256").alias("expected_sha256"))
    d = said.join(found, F.col("file_name") == F.col("f"), "full")
    same = (F.col("expected_bytes") == F.col("actual_bytes")) & (F.col("expected_sha256") == F.col("actual_sha256"))
    status = F.when(F.col("f").isNull(), "MISSING").when(F.col("file_name").isNull(), "UNLISTED").when(same, "MATCH").otherwise("MISMATCH")
    return d.select(F.coalesce("file_name", "f").alias("file_name"), "expected_bytes", "expected_sha256", "actual_bytes", "actual_sha256", status.alias("status"))
