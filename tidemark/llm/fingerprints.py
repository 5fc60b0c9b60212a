"""Document fingerprints by winnowing.

Every k-gram of a text's code points is hashed by a rolling polynomial; of each
window of w consecutive hashes the least is selected, the rightmost on ties. Two
texts that share a run of w + k - 1 code points share a selected hash, at known
positions in both. Fingerprints are compared by the Jaccard likeness of their
sets of hashes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, parts, splits, table

#: Code points in a gram and grams in a window, both powers of two: shared runs of 23 code points are found for certain.
K = 8
W = 16
#: Rows of a range that one task walks through, about, at most.
ROWS = 1_000_000
BASE = 0x9E3779B97F4A7C15


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def gram_hashes(code: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of the k-grams; a text shorter than k is one gram, an empty one has none.

    sum c[i+j] B^(k-1-j) mod 2^64, by doubling: the hash of 2m symbols follows from those of m.
    """
    if not len(code):
        return np.empty(0, np.uint64)
    h, m, power = code + np.uint64(1), 1, BASE
    while m < k and len(h) > m:
        h = h[:-m] * np.uint64(power) + h[m:]
        m, power = 2 * m, power * power % (1 << 64)
    if m < k:  # shorter than a gram
        h = h[:1] * np.uint64(BASE) + np.uint64(len(code)) + code.sum()
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def winnow(hashes: np.ndarray, w: int = 64) -> np.ndarray:
    """Ascending positions of the selected hashes; with fewer than w hashes there is one window. Fingerprints say their own w."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    # The least of (hash, distance from the end) is the least hash, the rightmost on ties.
    key = (hashes << np.uint64(32)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    if n <= w:
        least = key.min(keepdims=True)
    else:
        least, m = key, 1
        while m < w:
            least, m = np.minimum(least[:-m], least[m:]), 2 * m
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (n - 1) - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) selected from the text, in its order; both empty for an empty text."""
    hashes = gram_hashes(points(text), k)
    at = winnow(hashes, w)
    return hashes[at].astype(np.uint32), at


def packed(hashes: np.ndarray, at: np.ndarray) -> str:
    """Base64 of the hashes, 4 bytes each, then of the steps between positions, a byte each; no step passes the window."""
    steps = np.diff(at, prepend=0).astype(np.uint8)
    return base64.b64encode(hashes.astype("<u4").tobytes() + steps.tobytes()).decode()


def unpacked(said: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(said)
    n = len(raw) // 5
    return np.frombuffer(raw[: 4 * n], "<u4"), np.cumsum(np.frombuffer(raw[4 * n :], np.uint8), dtype=np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two arrays of distinct hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, hashes (array of long), positions (array of int) of every row of ``docs`` (doc_id, text). Null text: empty arrays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py() or "", k, w) for t in b.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "hashes": pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), "positions": pa.array([p.astype(np.int32) for _, p in found], pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id bigint, hashes array<bigint>, positions array<int>")


SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "n_chars")]
    + [T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]
)


def edit(text: str, after: str) -> str:
    """The text with its last third replaced by the first as many code points of ``after``, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def against_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, in the columns of SCHEMA.

    ``docs`` has doc_id and text. The next document is that of the next lower
    doc_id, of the highest after the lowest; rows with one doc_id follow the hash
    of their text and then the text; a null doc_id comes last; a null text is
    empty. The last row of an only document follows itself. Texts are read whole, however
    long, one at a time; an empty table gives no rows.

    The rows are cut into ranges of doc_id and go once through a shuffle. Each
    range gets one more row, the first of the range after it, so no task needs
    another's rows. A range's rows pass through one task in order, one at a time.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = max(parts(spark), -(-docs.count() // ROWS))
    own = docs.select(F.col("doc_id").alias("id"))
    cuts = splits(own, "id", n)
    last = len(cuts)
    # Ranges in the order of the rows: the highest doc_ids are in range 0, null is in the last.
    which = lambda c: F.lit(last) - bucket_of(c, cuts)
    heads = own.groupBy(which("id").alias("at")).agg(F.max("id").alias("id")).collect()  # a row for each range
    first = {r["at"]: r["id"] for r in heads}
    filled = sorted(first)
    # The ranges before which a range's first rows are read again: that of every id that starts one.
    readers: dict[int | None, int] = {first[at]: filled[i - 1] for i, at in enumerate(filled)}
    told = spark.createDataFrame(list(readers.items()), "_tm_id bigint, at int")  # a row for each range
    # Of the rows that share a starting doc_id, only the first is a guest.
    key = F.struct(F.xxhash64("text").alias("h"), "text")
    guests = docs.join(F.broadcast(told), F.col("doc_id").eqNullSafe(F.col("_tm_id")))
    guests = guests.groupBy("doc_id", "at").agg(F.min(key).alias("x")).select("doc_id", "x.text", "at")
    rows = docs.withColumn("at", which("doc_id")).withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    rows = rows.repartitionById(last + 1, F.col("at")).sortWithinPartitions("at", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        held, out, size = None, [], 0

        def packet() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            for doc_id, text, guest in zip(*(b.column(c) for c in ("doc_id", "text", "guest")), strict=True):
                text = text.as_py()
                hashes, at = fingerprint(text, k, w)
                now = doc_id.as_py(), text, packed(hashes, at), np.unique(hashes)
                if held:
                    before, was, print_of, mine = held
                    edited = edit(was, text)
                    hashes, at = (hashes, at) if edited == text else fingerprint(edited, k, w)
                    out.append((before, len(was), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_of, packed(hashes, at), likeness(mine, np.unique(hashes)), likeness(mine, now[3])))
                    size += len(was)
                held = None if guest.as_py() else now
                if size > 4_000_000:
                    yield packet()
                    out, size = [], 0
        yield packet()

    return rows.select("doc_id", "text", "guest").mapInArrow(walk, SCHEMA)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return against_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
