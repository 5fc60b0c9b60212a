"""Near-duplicate embeddings by spherical-cap filters.

A filter is a cap of the unit sphere around a direction; two vectors are compared
if they share one. The directions are a product code: after a random rotation a
vector is cut into two blocks, each with its own random unit codewords, and every
pair of codewords is a direction. So M * M caps are decoded from 2 * M dot
products. There are several such codes, each with its own rotation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, forest, in_blocks, join_hot, runs_of, table, together
from .components import components

COSINE = 0.93
#: Codes, each with its own rotation.
CODES = 6
#: Vectors of one bucket that a task compares at once; larger buckets are compared block by block.
BLOCK = 1024


def words_for(rows: int) -> int:
    """Codewords in a block: their pairs grow in proportion to the rows, so that a bucket stays about as large."""
    return 1 << max(8, math.ceil(math.log2(max(rows, 1) ** 0.5 / 4)))


def caps_for(words: int) -> int:
    """Caps that hold a vector in each code, at least: more where they are smaller, so that as many near pairs meet."""
    return 4 + 2 * round(math.log2(max(words / 256, 1)))


@lru_cache(8)
def codebook(dims: int, words: int, code: int) -> tuple[np.ndarray, np.ndarray]:
    """The code's two matrices, from a vector to its dot products with either block's codewords.

    The rotation is a random orthogonal matrix. Everything follows from the
    numbers given, so each worker makes its own.
    """
    rng = np.random.default_rng([dims, words, code])
    rotation, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
    half = (dims + 1) // 2
    out = []
    for block in (rotation[:, :half], rotation[:, half:]):
        c = rng.normal(size=(block.shape[1], words))
        out.append(block @ (c / np.maximum(np.linalg.norm(c, axis=0), 1e-12)))
    return out[0], out[1]


def decode(x: np.ndarray, words: int, caps: int, code: int) -> list[np.ndarray]:
    """For each row of ``x``, a unit vector, all directions of the code that exceed its height.

    The height is the greatest that at least ``caps`` directions exceed. Only
    codewords that can take part in such a pair are paired: those above the height
    less the other block's best.
    """
    first, second = codebook(x.shape[1], words, code)
    a, b = x @ first, x @ second
    out = []
    k = min(words, caps)
    for p, q in zip(a, b, strict=True):
        # The best ``caps`` pairs lie among the best ``caps`` codewords of either block.
        i, j = np.argpartition(-p, k - 1)[:k], np.argpartition(-q, k - 1)[:k]
        height = np.partition((p[i][:, None] + q[j]).ravel(), -min(caps, k * k))[-min(caps, k * k)]
        i, j = np.flatnonzero(p >= height - q.max() - 1e-9), np.flatnonzero(q >= height - p.max() - 1e-9)  # a margin for rounding
        u, v = np.nonzero(p[i][:, None] + q[j] >= height)
        out.append(np.sort((code * words + i[u]) * words + j[v]))
    return out


def clean(vector) -> np.ndarray | None:
    """The vector as doubles, None if it is null, empty, zero or holds a null or non-finite component."""
    if vector is None or not len(vector) or any(v is None for v in vector):
        return None
    x = np.array(vector, float)
    return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max()
    return scaled / np.linalg.norm(scaled)


def filtered(rows: DataFrame, words: int, caps: int, kind: str) -> DataFrame:
    """vec_id, label, vector (its components as numpy's ``kind``, binary), caps (array of long) of the rows that can link at all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, raw, kept = [], [], [], []
            for i, label, vector in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True):
                if (x := clean(vector)) is not None:
                    ids.append(i)
                    labels.append(label)
                    raw.append(x.astype(kind).tobytes())
                    kept.append(unit(x))
            found = [[] for _ in kept]
            for dims in {len(x) for x in kept}:
                mine = [k for k, x in enumerate(kept) if len(x) == dims]
                for code in range(CODES):
                    for k, caps_of in zip(mine, decode(np.array([kept[k] for k in mine]), words, caps, code), strict=True):
                        found[k].append(caps_of)
            yield pa.RecordBatch.from_pydict({
                "vec_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int64()), "vector": pa.array(raw, pa.binary()),
                "caps": pa.array([np.concatenate(f) for f in found], pa.list_(pa.int64())),
            })

    return rows.mapInArrow(each, "vec_id bigint, label bigint, vector binary, caps array<bigint>")


def links_of(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, side: np.ndarray, keys: list[np.ndarray], key: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of a bucket whose vectors reach the cosine and share no lower bucket; if there are two sides, across them."""
    near = (x @ x.T >= cosine) & (labels[:, None] == labels) & (ids[:, None] != ids)
    if side.any() and not side.all():
        near &= side[:, None] != side
    a, b = np.nonzero(np.triu(near, 1))
    if len(a):
        lower = np.unique(np.concatenate([c[c < key] for c in keys]))
        if len(lower):
            held = np.zeros((len(ids), len(lower)), bool)
            for k, c in enumerate(keys):
                held[k, np.searchsorted(lower, c[c < key])] = True
            new = np.concatenate([~(held[a[k : k + 65536]] & held[b[k : k + 65536]]).any(1) for k in range(0, len(a), 65536)])
            a, b = a[new], b[new]
    return a, b


def compare(batches: Iterator[pa.RecordBatch], cosine: float, kind: str, as_pairs: bool) -> Iterator[pa.RecordBatch]:
    """Goes through rows in the order of (key, i, j) and compares each bucket's. Puts out (a, b, n):

    (a, b, null) for a pair, with ``as_pairs`` every one, otherwise those of a
    repeated vec_id; for the other pairs, (vec_id, null, n) with its number of
    them, and the edges (a, b, 0) of a forest that joins them.
    """
    for t in runs_of(batches, ("key", "i", "j")):
        x = np.array([unit(np.frombuffer(v, kind).astype(float)) for v in t["vector"].to_pylist()])
        side = t["block"].to_numpy() != t["i"].to_numpy()
        ids, labels, repeated = (t[c].to_numpy() for c in ("vec_id", "label", "repeated"))
        a, b = links_of(ids, labels, x, side, [np.array(c) for c in t["keys"].to_pylist()], t["key"][0].as_py(), cosine)
        plain = np.zeros(len(a), bool) if as_pairs else ~(repeated[a] | repeated[b])
        pairs = np.sort(np.stack([ids[a], ids[b]], 1), 1)[~plain]
        near = np.zeros((len(ids), len(ids)), bool)
        near[a[plain], b[plain]] = near[b[plain], a[plain]] = True
        degree, (lo, hi) = near.sum(1), forest(near)
        some = np.flatnonzero(degree)
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(np.concatenate([pairs[:, 0], ids[some], ids[lo]]), pa.int64()),
            "b": pa.array([*pairs[:, 1].tolist(), *[None] * len(some), *ids[hi].tolist()], pa.int64()),
            "n": pa.array([*[None] * len(pairs), *degree[some].tolist(), *[0] * len(lo)], pa.int64()),
        })


def met(rows: DataFrame, cut: Cut, cosine: float, words: int | None, caps: int | None, as_pairs: bool) -> DataFrame:
    """What ``compare`` puts out for ``rows`` (vec_id, label, embedding) with equal labels.

    A bucket is the vectors of a label in a cap. Only the buckets' and rows' numbers
    are shuffled until it is known which buckets have more than one vector; of
    buckets with the very same vectors one stays. Then each vector is fetched for
    the buckets that are left, with their list, by which a pair counts in its
    lowest one alone. A bucket with more than BLOCK vectors is dealt into blocks,
    and each pair of blocks is a task's work of bounded size.
    """
    kind = "<f4" if "array<float>" in rows.schema["embedding"].dataType.simpleString() else "<f8"
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").dropDuplicates()
    words = words or words_for(rows.count())
    known = cut(filtered(rows, words, caps or caps_for(words), kind))
    several = cut(known.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id", F.lit(True).alias("repeated")))
    known = known.join(several, "vec_id", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    known = known.withColumn("node", F.when(F.col("repeated"), F.xxhash64("vec_id", "label", "vector")).otherwise(F.col("vec_id")))
    slim = known.select(F.octet_length("vector").alias("dims"), "label", F.explode("caps").alias("cap"), "node").select(F.xxhash64("label", "dims", "cap").alias("key"), "node")
    told = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]
    kept = slim.groupBy("key").agg(F.count("*").alias("c"), *told).where("c > 1").groupBy("c", "x0", "x1").agg(F.min("key").alias("key"))
    kept = cut(kept.select("key", "c"))
    slim = cut(join_hot(slim, kept.select("key"), ["key"], "node", kept))
    lists = slim.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most as many as caps hold a vector
    vectors = lists.join(known.select("node", "vec_id", "label", "repeated", "vector"), "node")
    dealt = together(in_blocks(slim, ["key"], "node", BLOCK, cut).join(vectors, "node"), ["key"])
    dealt = dealt.select("key", "i", "j", "block", "vec_id", "label", "repeated", "vector", "keys")
    return dealt.mapInArrow(lambda batches: compare(batches, cosine, kind, as_pairs), "a bigint, b bigint, n bigint")


def links(rows: DataFrame, cut: Cut, cosine: float = COSINE, words: int | None = None, caps: int | None = None) -> DataFrame:
    """The distinct links (a < b) found among ``rows`` (vec_id, label, embedding) with equal labels."""
    return met(rows, cut, cosine, words, caps, True).select("a", "b").distinct()


def near_duplicates(rows: DataFrame, cut: Cut, cosine: float = COSINE, words: int | None = None, caps: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, label, embedding).

    A null label, a null, empty or zero vector, one with null or non-finite
    components, and a null vec_id link with nothing; vectors of different lengths
    don't link. Rows that share a vec_id share its links, and don't link with each
    other. Links are counted where they are found and never written as pairs, but
    for those of a vec_id whose rows differ. An empty table gives no rows.
    """
    found = cut(met(rows, cut, cosine, words, caps, False))
    pairs = found.where("b is not null and n is null").select("a", "b").distinct()
    ends = [pairs.select(F.col(c).alias("node"), F.lit(1).cast("bigint").alias("n")) for c in "ab"]
    degrees = found.where("b is null").select(F.col("a").alias("node"), "n").unionByName(ends[0]).unionByName(ends[1]).groupBy("node").agg(F.sum("n").alias("n_links"))
    facts = degrees.join(components(found.where("b is not null").select("a", "b"), cut), "node", "left").withColumnRenamed("node", "_tm_node")
    out = rows.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(facts, F.col("vec_id") == F.col("_tm_node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between all embeddings of equal label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return near_duplicates(rows, Cut(spark, "op9"))


ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = e.vec_id
"""
