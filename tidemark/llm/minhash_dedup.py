"""Near-duplicate documents by MinHash with tensored banding.

A document's set is that of its distinct 5-word shingles. Two collections of m
half keys, each of four minhashes, give m * m table keys, one for each pair of a
left and a right half key: as selective as 8 minhashes each, from 8m minhashes
instead of 8m^2. Only the left half keys are shuffled; a task completes them. Two documents with similarity s meet in some table with
probability (1 - (1 - s^4)^m)^2, 0.9998 for s = 0.75 and m = 25.

Documents with equal sets form a class; the work is between classes. Each class is
compared on full sets with one leader of its buckets, and, where that leaves a
bucket in several components, with another. So a group of near copies is joined by
about as many comparisons as it has classes. What stays apart in a bucket resembles
if its signatures, a byte of each minhash, agree enough; only the classes that
resemble one of another component are compared on full sets again, block by block,
and only a forest comes out of a block, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cut, blocks, forest, in_blocks, join_hot, parts, remembers, runs_of, table, together
from .components import components

WORDS = 5
#: Links have 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 75
#: Half keys on either side.
HALVES = 25
#: Minhashes in a half key.
IN_HALF = 4
#: The share of bytes that two resembling signatures have in common, at least: linked classes have less with a chance of 1e-7.
AGREE = 0.59
#: Classes that a task compares at once; larger groups are compared block by block.
BLOCK = 512
#: Leaders that a class is compared with before what stays apart is compared in blocks.
TURNS = 2
REMEMBERED = 400_000

_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    try:
        return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    except KeyError:
        new = set(words).difference(_hashes)
        if len(_hashes) + len(new) > REMEMBERED:
            _hashes.clear()
            new = set(words)
        _hashes.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The ascending distinct 64-bit hashes of the text's k-word shingles.

    A-Z are lower-cased, words lie between ASCII white space. Fewer than k words
    are one shingle, none is none.
    """
    remembers("minhash_dedup", _hashes.clear)
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes() + b"short")], np.uint64)
    n, out = len(h) - k + 1, np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(mixed(out))


class Sketcher:
    """Minhashes of many sets at once."""

    def __init__(self, halves: int, in_half: int):
        self.halves, self.in_half = halves, in_half
        self.seeds = np.random.default_rng(20_26).integers(1, 1 << 63, 2 * halves * in_half, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, signature): the half keys, a byte of each minhash; none of the sets is empty."""
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        h = np.concatenate(sets)
        least = np.stack([np.minimum.reduceat(mixed(h ^ s), starts) for s in self.seeds], 1)
        parts = least.reshape(len(sets), 2, self.halves, self.in_half)
        keys = np.zeros(parts.shape[:3], np.uint64)
        for j in range(self.in_half):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[..., j])
        # the number of the half key belongs to it
        keys = mixed(keys + np.arange(2 * self.halves, dtype=np.uint64).reshape(1, 2, self.halves))
        keys = keys.view(np.int64)
        return keys[:, 0], keys[:, 1], (least & np.uint64(0xFF)).astype(np.uint8)


def sketches(docs: DataFrame, halves: int = HALVES, in_half: int = IN_HALF) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, and of non-empty sets a 128-bit digest (s1, s2), left, right (arrays of half keys), signature."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(halves, in_half)
        ids, marks, sets, size = [], [], [], 0

        def packet() -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            left, right, sig = sketch(full) if full else ([], [], [])
            told = iter(zip(left, right, sig, strict=True))
            rows = []
            for s in sets:
                if not len(s):
                    rows.append((0, None, None, None, None, None))
                    continue
                lo, r, g = next(told)
                d = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((len(s), *np.frombuffer(d, np.int64).tolist(), lo, r, g.tobytes()))
            c = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "h": pa.array(marks, pa.int64()), "n_shingles": pa.array(c[0], pa.int64()), "s1": pa.array(c[1], pa.int64()), "s2": pa.array(c[2], pa.int64()),
                "left": pa.array(c[3], pa.list_(pa.int64())), "right": pa.array(c[4], pa.list_(pa.int64())), "signature": pa.array(c[5], pa.binary()),
            })

        for b in batches:
            for doc_id, text, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids.append(doc_id)
                marks.append(h)
                sets.append(shingles(text.as_py()))
                size += len(sets[-1]) + 10
                if size > 500_000:
                    yield packet()
                    ids, marks, sets, size = [], [], [], 0
        if ids:
            yield packet()

    schema = "doc_id bigint, h bigint, n_shingles bigint, s1 bigint, s2 bigint, left array<bigint>, right array<bigint>, signature binary"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), "h").mapInArrow(each, schema)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """rep, shingles (array of long) of ``texts`` (rep, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                sets = [shingles(t.as_py()).view(np.int64) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])

    return texts.select("rep", "text").mapInArrow(each, "rep bigint, shingles array<bigint>")


def agreeing(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows of ``sig`` have enough bytes in common."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 50_000):
        i, j = a[k : k + 50_000], b[k : k + 50_000]
        out[k : k + 50_000] = (sig[i] == sig[j]).sum(1) >= AGREE * sig.shape[1]
    return out


def bytes_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    said = column.to_pylist()
    return np.frombuffer(b"".join(said), np.uint8).reshape(len(said), -1)


def across(t: pa.Table) -> np.ndarray | bool:
    """Which pairs of a table's rows are to be compared: those across two blocks, all if there is one."""
    side = t["block"].to_numpy() != t["i"].to_numpy()
    return side[:, None] != side if side.any() and not side.all() else True


def edges_of(rep: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    a, b = forest(near)
    return pa.RecordBatch.from_pydict({"a": pa.array(rep[a], pa.int64()), "b": pa.array(rep[b], pa.int64())})


def confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The links of each leader's rows with it: rows (lead, member, rep, shingles), the leader's own first, member false."""
    for batch in batches:
        pairs = []
        for lead, member, rep, said in zip(*(batch.column(c).to_pylist() for c in ("lead", "member", "rep")), batch.column("shingles"), strict=True):
            own = np.array(said.values.to_numpy()) if said.is_valid else np.empty(0, np.int64)
            if not member:
                leader = own
            else:
                both = len(np.intersect1d(own, leader, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(leader) - both):
                    pairs.append((min(lead, rep), max(lead, rep)))
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def resembling(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(key, rep) of the rows (rep, n, at, right, signature) of each left half key that resemble one that differs in ``at``.

    Two rows are compared if they have a table key in common: with the left half key any right one.
    """
    for t in runs_of(batches, ("key", "i", "j")):
        rep, n, at, sig = *(t[c].to_numpy() for c in ("rep", "n", "at")), bytes_of(t["signature"])
        right = np.array(t["right"].to_pylist(), np.int64)
        fit = (at[:, None] != at) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)) & across(t)
        a, b = np.nonzero(np.triu(fit, 1))
        met = np.zeros(len(a), bool)
        for k in range(0, len(a), 50_000):
            met[k : k + 50_000] = (right[a[k : k + 50_000]] == right[b[k : k + 50_000]]).any(1)
        a, b = a[met], b[met]
        good = agreeing(sig, a, b)
        some = np.unique(np.concatenate([a[good], b[good]]))
        yield pa.RecordBatch.from_pydict({"key": pa.array(t["key"].to_numpy()[some], pa.int64()), "rep": pa.array(rep[some], pa.int64())})


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections."""
    g = len(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    owner, token = owner[shared], token[shared]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out, wide = np.zeros((g, g), np.int64), max(64, 4_000_000 // g)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1]) if len(token) else np.empty(0, int)
    rank = np.cumsum(np.concatenate([[0], np.diff(token) > 0])) if len(token) else np.empty(0, int)
    for k in range(0, len(starts), wide):  # some tokens at a time
        lo, hi = starts[k], starts[k + wide] if k + wide < len(starts) else len(token)
        has = np.zeros((g, min(wide, len(starts) - k)), np.float32)
        has[owner[lo:hi], rank[lo:hi] - k] = 1
        out += (has @ has.T).astype(np.int64)  # exact: fewer tokens at a time than float32 counts
    return out


def linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A forest of the links among the rows (rep, at, shingles) of each half key that differ in ``at``."""
    for t in runs_of(batches, ("key", "i", "j")):
        sets = [np.array(s, np.int64) for s in t["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets])
        inter = intersections(sets)
        at = t["at"].to_numpy()
        near = (100 * inter >= percent * (size[:, None] + size - inter)) & (at[:, None] != at) & across(t)
        yield edges_of(t["rep"].to_numpy(), near)


class Nearest:
    """The stages of the search; every table it makes is written to the shared folder."""

    def __init__(self, docs: DataFrame, cut: Cut, percent: int, halves: int):
        self.cut, self.percent = cut, percent
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
        self.sketch = cut(sketches(self.docs, halves))

    def classes(self) -> DataFrame:
        """rep, n, left, right, signature of each class of equal, non-empty sets.

        A class stands by the text h of its smallest doc_id. rep is that doc_id; where
        rows of one doc_id but of several texts stand for several classes, one has it
        and the others a hash of both.
        """
        self.whole = self.sketch.where("n_shingles > 0 and doc_id is not null")
        rep = self.whole.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h")).alias("x")).select("s1", "s2", F.col("x.doc_id").alias("id"), F.col("x.h").alias("h"))
        first = F.row_number().over(Window.partitionBy("id").orderBy("h")) == 1
        self.rep = self.cut(rep.withColumn("rep", F.when(first, F.col("id")).otherwise(F.xxhash64("id", "h"))))
        mine = self.whole.drop("s1", "s2").join(self.rep.select("rep", F.col("id").alias("doc_id"), "h"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
        return self.cut(mine.select("rep", F.col("n_shingles").alias("n"), "left", "right", "signature"))

    def shared(self) -> DataFrame:
        """doc_id, rep of the classes of every doc_id whose rows are not all of one class; empty sets have no class."""
        of = self.sketch.where("doc_id is not null").groupBy("doc_id").agg(
            *[f(c).alias(f"{c}_{f.__name__}") for c in ("s1", "s2") for f in (F.min, F.max)], F.count("s1").alias("some"), F.count("*").alias("all")
        )
        several = of.where("some > 0 AND (some < all OR s1_min < s1_max OR s2_min < s2_max)").select("doc_id")
        rows = self.whole.select("doc_id", "s1", "s2").join(several, "doc_id")
        return self.cut(rows.join(self.rep.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", "rep").distinct())

    def buckets(self, classes: DataFrame) -> DataFrame:
        """key, rep, n, score: the left half keys that more than one class has, one for each set of classes.

        A table key is a left half key with a right one. Rows are dealt by the left
        one alone, m for a class and not m * m; the right ones complete the table
        keys within a task. score: how many classes share the class's keys; high for
        those that much resembles.
        """
        keys = classes.select("rep", "n", F.explode("left").alias("key"))
        told = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"x{k}") for k in range(2)]
        often = keys.groupBy("key").agg(F.count("*").alias("c"), *told).where("c > 1")
        often = self.cut(often)
        rows = self.cut(join_hot(keys, often, ["key"], "rep", often.select("key", "c")))
        # Many half keys are had by the very same classes: one stands for each set of them.
        once = self.cut(rows.groupBy("c", "x0", "x1").agg(F.min("key").alias("key")).select("key", "c"))
        score = rows.groupBy("rep").agg(F.sum("c").alias("score"))
        rows = join_hot(rows.select("key", "rep", "n"), once.select("key"), ["key"], "rep", once).join(score.hint("merge"), "rep")
        return self.cut(rows.select("key", "rep", "n", "score"))

    def sets(self, rows: DataFrame) -> DataFrame:
        """rep, shingles of every class in a bucket. Their texts go through a shuffle once."""
        named = rows.select("rep").distinct().join(self.rep.select("rep", F.col("id").alias("doc_id"), "h"), "rep")
        return self.cut(shingle_sets(self.docs.join(named.hint("merge"), ["doc_id", "h"]).dropDuplicates(["rep"])))

    def with_component(self, rows: DataFrame, found: DataFrame | None) -> DataFrame:
        """``rows`` with at: the component of the class, itself if it is in none yet."""
        rows = rows.select("key", "rep", "n", "score")
        if found is None:
            return rows.withColumn("at", F.col("rep"))
        to = found.select(F.col("node").alias("rep"), F.col("component_id").alias("c")).hint("merge")
        return self.cut(rows.join(to, "rep", "left").select("key", "rep", "n", "score", F.coalesce("c", "rep").alias("at")))

    def led(self, rows: DataFrame, turn: int) -> DataFrame:
        """(rep, lead): for each class one leader of its buckets, of another component and of a size that can link.

        A bucket's leader is at first the class with the highest score, in later
        turns one by a hash; a class follows the leader that comes first in this order.
        """
        order = F.struct(F.col("score").alias("s") if not turn else F.xxhash64("rep", F.lit(turn)).alias("s"), (-F.col("rep")).alias("r"))
        lead = rows.groupBy("key").agg(F.max(F.struct(order.alias("o"), "rep", "n", "at")).alias("x"), F.count("*").alias("c"), F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo < hi")
        lead = self.cut(lead)
        facts = lead.select("key", F.col("x.o").alias("o"), F.col("x.rep").alias("lead"), F.col("x.n").alias("m"), F.col("x.at").alias("of"))
        pairs = join_hot(rows, facts, ["key"], "rep", lead.select("key", "c")).where(f"at <> of AND 100 * least(n, m) >= {self.percent} * greatest(n, m)")
        return self.cut(pairs.groupBy("rep").agg(F.max(F.struct("o", "lead")).alias("x")).select("rep", "x.lead"))

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The links (a, b) among the pairs (rep, lead), on full sets.

        The followers of a leader are dealt into groups of about BLOCK; each group
        gets the leader's set once and passes by it one row at a time.
        """
        counts = self.cut(pairs.groupBy("lead").agg(F.count("*").alias("c")))
        salted = join_hot(pairs, counts, ["lead"], "rep", counts).select("lead", F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / BLOCK)).alias("salt"), "rep")
        salted = self.cut(salted)
        heads = salted.select("lead", "salt").distinct().withColumn("rep", F.col("lead")).withColumn("member", F.lit(False))
        dealt = salted.withColumn("member", F.lit(True)).unionByName(heads).join(sets.hint("merge"), "rep")
        dealt = dealt.repartition(parts(sets.sparkSession), "lead", "salt").sortWithinPartitions("lead", "salt", "member").select("lead", "member", "rep", "shingles")
        percent = self.percent
        return self.cut(dealt.mapInArrow(lambda batches: confirmed(batches, percent), "a bigint, b bigint"))

    def apart(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """(key, rep) of the classes that resemble one of another component in a bucket."""
        several = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo < hi").select("key", "c")
        several = self.cut(several)
        rows = join_hot(rows, several.select("key"), ["key"], "rep", several).join(classes.select("rep", "right", "signature").hint("merge"), "rep")
        dealt = blocks(self.cut(rows), ["key"], "rep", BLOCK, self.cut).select("key", "i", "j", "block", "rep", "n", "at", "right", "signature")
        percent = self.percent
        return self.cut(dealt.mapInArrow(lambda batches: resembling(batches, percent), "key bigint, rep bigint").distinct())

    def links(self, rows: DataFrame, active: DataFrame, sets: DataFrame) -> DataFrame:
        """A forest of the links of different components among the classes (key, rep) of ``active``, on full sets."""
        mine = self.cut(rows.select("key", "rep", "at").join(active, ["key", "rep"]))
        dealt = in_blocks(mine, ["key"], "rep", BLOCK, self.cut).join(sets.hint("merge"), "rep")
        dealt = together(dealt, ["key"]).select("key", "i", "j", "block", "rep", "at", "shingles")
        percent = self.percent
        return self.cut(dealt.mapInArrow(lambda batches: linked(batches, percent), "a bigint, b bigint").distinct())

    def run(self) -> DataFrame:
        """rep, component_id of every class that a link or a doc_id joins to another; also sets ``several``, what shared() finds."""
        classes = self.classes()
        rows = self.buckets(classes)
        sets = self.sets(rows)
        found, edges, self.followers = None, None, []
        for turn in range(TURNS):
            self.followers.append(self.led(self.with_component(rows, found), turn))
            if self.followers[-1].isEmpty():
                break
            new = self.confirm(self.followers[-1], sets)
            edges = new if edges is None else edges.unionByName(new)
            found = components(edges, self.cut)
        rows = self.with_component(rows, found)
        self.active = self.apart(rows, classes)
        self.several = self.shared()
        low = self.several.groupBy("doc_id").agg(F.min("rep").alias("a"))
        same = self.several.join(low, "doc_id").select("a", F.col("rep").alias("b"))
        for more in (edges, None if self.active.isEmpty() else self.links(rows, self.active, sets)):
            same = same if more is None else same.unionByName(more)
        found = components(same, self.cut).select(F.col("node").alias("rep"), F.col("component_id").alias("at"))
        if self.several.isEmpty():  # then every rep is a doc_id
            return found.withColumnRenamed("at", "component_id")
        least = found.join(self.rep.select("rep", "id"), "rep").groupBy("at").agg(F.min("id").alias("component_id"))
        return self.cut(found.join(least, "at").select("rep", "component_id"))


def near_duplicates(docs: DataFrame, cut: Cut, percent: int = PERCENT, halves: int = HALVES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    A null or empty text, and one of white space, has no set and links with
    nothing; a row without doc_id is not linked either. Rows that share a doc_id
    are joined by what any of them links with. Texts are read whole, however long; an
    empty table gives no rows.
    """
    search = Nearest(docs, cut, percent, halves)
    found = search.run()
    rep = search.rep.join(found, "rep", "left").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "rep", F.coalesce("component_id", "id").alias("c"))
    rows = search.sketch.select("doc_id", "n_shingles", "s1", "s2")
    out = rows.join(rep, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & F.col("doc_id").isNotNull(), "left")
    if not search.several.isEmpty():  # a row without a set goes with its doc_id
        of = search.several.join(rep.select("rep", F.col("c").alias("of")), "rep").groupBy("doc_id").agg(F.min("of").alias("of"))
        out = out.join(of, "doc_id", "left").withColumn("c", F.coalesce("c", "of"))
    out = out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Cut(spark, "op3"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
