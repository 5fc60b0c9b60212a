"""Sharding: rows in the order of a Hilbert curve over metadata, cut into runs.

Each of several metadata columns is quantised to cells that hold near equal
numbers of rows, the cells' coordinates are turned into their place on a Hilbert
curve, and the rows in that order are cut into shards. Rows near on the curve are
near in every column, so the minimum and maximum of any of the columns prune
shards of the written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, bucket_of, splits, table, with_rank

SHARDS = 40
#: Bits of each coordinate.
BITS = 5


def hilbert_tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """For each of the 2^dims sub-cubes along the curve: its place by Gray code, the entry corner, the direction.

    The state machine of a compact Hilbert index: sub-cube w is gray(w) in the
    rotated, reflected cube; inside it the curve enters at entry(w) and runs along
    the axis direction(w).
    """
    n = 1 << dims
    gray = [i ^ (i >> 1) for i in range(n)]
    place = [0] * n
    for i, g in enumerate(gray):
        place[g] = i
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(n)]

    def ones(i: int) -> int:
        k = 0
        while i & 1:
            i, k = i >> 1, k + 1
        return k

    along = [0 if i == 0 else ones(i - 1) % dims if i % 2 == 0 else ones(i) % dims for i in range(n)]
    return place, entry, along


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of the cell with these coordinates, each in [0, 2^bits)."""
    dims = len(cells)
    if dims == 1:
        return cells[0].cast("bigint")
    mask = (1 << dims) - 1
    place, entry, along = (F.lit(t) for t in hilbert_tables(dims))

    def shift(value: Column, by: Column, left: bool) -> Column:
        up = F.call_function("shiftleft", value, by)
        down = F.call_function("shiftright", value, by)
        return up if left else down

    def turned(value: Column, by: Column, left: bool) -> Column:
        other = F.lit(dims) - by
        return shift(value, by, left).bitwiseOR(shift(value, other, not left)).bitwiseAND(F.lit(mask))

    def level(a: Column, i: Column) -> Column:
        corner = F.lit(0)
        for k, c in enumerate(cells):
            bit = shift(c.cast("int"), i, False).bitwiseAND(F.lit(1))
            corner = corner.bitwiseOR(F.shiftleft(bit, k))
        by = (a.d + 1) % dims
        w = F.get(place, turned(corner.bitwiseXOR(a.e), by, False))
        # a struct of one field, so that w is computed once
        step = F.transform(
            F.array(w),
            lambda x: F.struct(
                F.shiftleft(a.h, dims).bitwiseOR(x.cast("bigint")).alias("h"),
                a.e.bitwiseXOR(turned(F.get(entry, x), by, True)).alias("e"),
                ((a.d + F.get(along, x) + 1) % dims).alias("d"),
            ),
        )
        return F.get(step, F.lit(0))

    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, level, lambda a: a.h)


def _ordinal(df: DataFrame, column: str) -> Column:
    """An order-preserving long of a string column: what follows the prefix that all rows share, 7 bytes of it."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = (ends["lo"] or "").encode(), (ends["hi"] or "").encode()
    shared = 0
    while shared < min(len(lo), len(hi)) and lo[shared] == hi[shared]:
        shared += 1
    seven = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), shared + 1, 7)), 14, "0")
    return F.when(F.col(column).isNotNull(), F.conv(seven, 16, 10).cast("bigint"))


def cell(df: DataFrame, column: str, bits: int) -> Column:
    """The cell, 0 to 2^bits - 1, of a numeric or string column: near equal numbers of rows in each; null lies in 0.

    A column of few values has a cell for each; of others, the cuts are quantiles. A cut belongs to the cell below it, and none lies at the highest value, so no
    cell is empty. A value lies in one cell, so a value of many rows makes its
    cell large and leaves fewer cells than there are coordinates: the cells are
    spread over all of them, for the curve turns by the highest bits first.
    """
    kind = df.schema[column].dataType.simpleString()
    value = _ordinal(df, column) if kind == "string" else F.col(column).cast("bigint")
    values = df.select(value.alias("v"))
    about, highest = values.agg(F.approx_count_distinct("v"), F.max("v")).first()
    if about <= 2 << bits:  # few values: a bounded list; each has its own cell if there are cells enough
        cuts = sorted(r["v"] for r in values.where("v is not null").distinct().collect())[:-1]
    if about > 2 << bits or len(cuts) >= 1 << bits:
        cuts = [c for c in splits(values, "v", 1 << bits) if c < highest]
    return F.floor(bucket_of(value, cuts, below=True) * (1 << bits) / (len(cuts) + 1)).cast("int")


def shard_by_curve(df: DataFrame, by: list[str], ties: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Adds curve (long), shard (int) and slot (long): runs of the Hilbert order of the columns ``by``.

    Shards differ by one row at most, whatever the skew: rows of one cell follow
    the columns ``ties`` and are cut like any others. slot counts from 0 in each
    shard. Null lies in the lowest cell of its column. An empty table gives none.
    """
    cells = [cell(df, c, bits) for c in by]
    df = df.withColumns({f"_tm_cell{k}": c for k, c in enumerate(cells)})
    curve = hilbert_index([F.col(f"_tm_cell{k}") for k in range(len(by))], bits)
    df = df.withColumn("curve", curve).drop(*[f"_tm_cell{k}" for k in range(len(by))])
    # The low bits spread the rows of one cell, so that no run of the rank is one cell.
    spread = F.xxhash64(*ties).bitwiseAND(F.lit((1 << 24) - 1))
    df = df.withColumn("_tm_key", F.shiftleft("curve", 24).bitwiseOR(spread))
    n = df.count()
    df = with_rank(df, "_tm_key", ties, "_tm_rank")
    least, more = divmod(n, shards)
    wide = more * (least + 1)  # rows of the shards that hold one more
    rank = F.col("_tm_rank")
    shard = F.when(rank < wide, F.floor(rank / (least + 1))).otherwise(more + F.floor((rank - wide) / max(least, 1)))
    start = F.when(F.col("shard") < more, F.col("shard") * (least + 1)).otherwise(wide + (F.col("shard") - more) * least)
    return df.withColumn("shard", shard.cast("int")).withColumn("slot", (rank - start).cast("bigint")).drop("_tm_key", "_tm_rank")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 along a Hilbert curve over source, lang and size; law ``rows``.

    A null text has 16 bytes and the checksum of no bytes, 0. Repeated rows take
    neighbouring places.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    docs = Cut(spark, "op8")(docs)  # the quantiles and counts below read this narrow table, not the texts
    out = shard_by_curve(docs, ["source", "lang", "size"], ["text_crc32", "doc_id", "source", "lang", "size"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
