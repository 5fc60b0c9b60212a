"""What the operators of this subpackage share: reading, cutting lineage, global ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. Java and RE2 syntax alike.
WORD = r"[^\x20\x09-\x0D]+"

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, on whatever store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where that is unset, a temporary one.

    A cluster without the setting is an error: a machine-local folder would be
    invisible to the other executors.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="tidemark-")
    return _local["dir"]


_local: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Cut:
    """Writes intermediate tables to the shared folder and reads them again.

    A written table survives the loss of executors and ends the lineage, so a
    lost task never recomputes what lies before it. ``drop`` deletes the tables
    that no later step reads; the others go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        _written[path] = self.spark
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_cut_path", None)
        if path and _written.pop(path, None):
            _delete(self.spark, path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            continue


_forget: dict[str, Callable[[], object]] = {}


def remembers(operator: str, forget: Callable[[], object]) -> None:
    """Says that this operator now remembers things in this Python worker: what others remember there is forgotten.

    A worker serves one stage after another; so its memory is that of the largest
    operator, not of all.
    """
    if operator not in _forget:
        for other in _forget.values():
            other()
        _forget.clear()
        _forget[operator] = forget


def runs_of(batches, keys: tuple[str, ...]):
    """Tables of the rows that follow one another with equal whole-number ``keys``, from batches in the order of the keys."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        values = np.stack([t[c].to_numpy() for c in keys])
        starts = np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1])
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            yield t.slice(s, e - s)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what a symmetric matrix of neighbours joins: each index with the least that it reaches."""
    own = np.arange(len(near))
    label, before = own, None
    while before is None or (label != before).any():
        before = label
        label = np.minimum(label, np.where(near, label, len(near)).min(1))
        label = label[label]
    to = np.flatnonzero(label != own)
    return label[to], to


#: A key is hot if it has more than this share of all rows; so fewer than 1 / HOT keys are.
HOT = 1 / 1024


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], member: str, counts: DataFrame) -> DataFrame:
    """The inner join of ``rows`` with ``facts``, one row for each key, where a few keys may have most of the rows.

    ``counts`` has the keys and c, their number of rows. The keys above HOT of all
    rows are fewer than 1 / HOT, so they are broadcast; their rows are salted by a
    hash of ``member`` and their facts repeated for each salt.
    """
    salts = parts(rows.sparkSession)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("c") > max(total * HOT, 1000)).select(*keys, F.lit(True).alias("_tm_hot")))
    salt = F.when(F.col("_tm_hot"), F.pmod(F.xxhash64(member), F.lit(salts))).otherwise(0).cast("int")
    every = F.when(F.col("_tm_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").withColumn("_tm_salt", salt).drop("_tm_hot")
    right = facts.join(hot, keys, "left").withColumn("_tm_salt", F.explode(every)).drop("_tm_hot")
    return left.join(right.hint("merge"), [*keys, "_tm_salt"]).drop("_tm_salt")


def in_blocks(rows: DataFrame, keys: list[str], member: str, size: int, cut: Cut | None = None) -> DataFrame:
    """Deals the rows of each key into blocks of about ``size`` and repeats them for each pair of blocks.

    Adds block, i and j (int): the rows with one (keys, i, j) are two blocks, i <= j,
    or one if i = j, so a task compares a bounded number whatever the size of the
    group. Rows that are alone with their key go.
    """
    sizes = (cut or Cut(rows.sparkSession, "blocks"))(rows.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1"))
    out = join_hot(rows, sizes.select(*keys, F.ceil(F.col("c") / size).cast("int").alias("_tm_b")), keys, member, sizes).withColumn("block", F.pmod(F.xxhash64(member), F.col("_tm_b")).cast("int"))
    out = out.withColumn("_tm_o", F.explode(F.sequence(F.lit(0), F.col("_tm_b") - 1)))
    return out.withColumn("i", F.least("block", "_tm_o")).withColumn("j", F.greatest("block", "_tm_o")).drop("_tm_b", "_tm_o")


def together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` of in_blocks so that those of one (keys, i, j) follow one another in a task."""
    return rows.repartition(4 * parts(rows.sparkSession), *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def blocks(rows: DataFrame, keys: list[str], member: str, size: int, cut: Cut | None = None) -> DataFrame:
    """in_blocks, each pair of blocks together."""
    return together(in_blocks(rows, keys, member, size, cut), keys)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def splits(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 distinct values of the long ``column`` that cut its rows into near equal runs.

    A mergeable quantile sketch: its size depends on n alone, not on the rows.
    """
    if n < 2:
        return []
    at = [k / n for k in range(1, n)]
    found = df.agg(F.percentile_approx(column, F.lit(at), F.lit(10 * n)).alias("q")).first()["q"]
    return sorted({int(x) for x in found or []})


def bucket_of(column: str | Column, cuts: list[int], below: bool = False) -> Column:
    """How many of the ascending ``cuts`` lie at or below the value, with ``below`` below it: 0 to len(cuts), 0 for null.

    A binary search over a literal array; nothing is joined.
    """
    col = F.col(column) if isinstance(column, str) else column
    if not cuts:
        return F.lit(0)
    at = F.lit(cuts).cast("array<bigint>")

    def step(a: Column, _: Column) -> Column:
        mid = ((a.lo + a.hi) / 2).cast("int")
        past = col > F.get(at, mid) if below else col >= F.get(at, mid)
        right, left = (a.lo < a.hi) & past, (a.lo < a.hi) & ~past
        return F.struct(F.when(right, mid + 1).otherwise(a.lo).alias("lo"), F.when(left, mid).otherwise(a.hi).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step, lambda a: a.lo)
    return F.when(col.isNull(), 0).otherwise(found)


#: Rows that one task ranks, about.
RUN = 1_000_000


def with_rank(df: DataFrame, key: str, ties: list[str], out: str) -> DataFrame:
    """Adds the 0-based global rank by (key, *ties), without a task that sees all rows.

    ``key`` is a non-null long. Rows are cut into runs by sketched quantiles of
    the key, ranked within their run, and raised by the sizes of the runs
    before it; there are as many runs as keep them at about RUN rows. Rows alike in key
    and ties get any of their ranks.
    """
    n = max(2, parts(df.sparkSession) * 4, -(-df.count() // RUN))
    cuts = splits(df, key, n)
    df = df.withColumn("_tm_run", bucket_of(key, cuts))
    counts = {r["_tm_run"]: r["n"] for r in df.groupBy("_tm_run").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for run in range(len(cuts) + 1):
        starts.append(before)
        before += counts.get(run, 0)
    inside = F.row_number().over(Window.partitionBy("_tm_run").orderBy(key, *ties))
    start = F.element_at(F.lit(starts).cast("array<bigint>"), F.col("_tm_run") + 1)
    return df.withColumn(out, start + inside - 1).drop("_tm_run")
