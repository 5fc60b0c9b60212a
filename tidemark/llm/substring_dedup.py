"""Substring dedup: later copies of long word sequences are removed wherever they stand in a line.

Fixed-block anchors: every document's words are cut into non-overlapping blocks of
BLOCK words, the reference, and every rolling position of every document is a probe.
Both are keyed by the KEY words from there on. A sequence of ``least`` words holds
several blocks whole, whatever its offset, so of the positions that are BLOCK apart
only the least of any CHAIN that follow one another is sent (rightmost on ties):
a repeated sequence has the same CHAIN keys at both places, hence the same least one.
Anchors meet by key. Around those that met, the windows of ``least`` words are
compared by the hash of all their words, and windows that repeat an earlier
document make up the maximal exact repeats, which are removed.

No pairs of documents are made: of a key or a window, the smallest doc_id of its
reference rows is all that a later document needs to know, however many share it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT, Cut, join_hot, table

#: Words of a repeat, at least.
LEAST = 50
#: Words from one reference block to the next.
BLOCK = 4
#: Words that a key covers: those of the block and of what follows.
KEY = 12
#: Words that are hashed together, about; a longer document is hashed whole.
WORDS = 1 << 19
#: Words that a task remembers the hashes of.
MEMO = 1 << 17

_M = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hashes(dict):
    """The hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: what ASCII white space leaves between."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n elements, the same wherever the run stands."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes), _M)]))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(hashes) - n, _INV)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1])])
    x = (sums[n:] - sums[:-n]) * back
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def chain(least: int, block: int = BLOCK, key: int = KEY) -> int:
    """How many keys, a block apart, lie in a run of ``least`` words at any offset."""
    n = (least - key + 1) // block
    if n < 1:
        raise ValueError("a key and a block must fit in the shortest repeat")
    return n


class Chunk:
    """The words of several documents in one array, with the key that each chain selects."""

    def __init__(self, words: list[np.ndarray], least: int):
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(words)), self.sizes)
        self.least = least
        self.keys = rolling(self.hashes, KEY)
        n = chain(least)
        count = max(0, len(self.keys) - (n - 1) * BLOCK)
        best, at = self.keys[:count].copy(), np.zeros(count, np.int64)
        for k in range(1, n):
            own = self.keys[k * BLOCK : k * BLOCK + count]
            less = own <= best
            best[less], at[less] = own[less], k
        ends = np.arange(count) + (n - 1) * BLOCK + KEY - 1
        #: Where chains start that lie in one document, and what each selects.
        self.first = np.flatnonzero(self.doc[:count] == self.doc[ends]) if count else np.zeros(0, np.int64)
        self.chosen = self.first + at[self.first] * BLOCK

    def aligned(self, at: np.ndarray) -> np.ndarray:
        """Which of these places are the start of a reference block of their document."""
        return (at - self.starts[self.doc[at]]) % BLOCK == 0

    def anchors(self) -> list[np.ndarray]:
        """The distinct selected keys of each document, as signed numbers whose last bit says that it is a reference block."""
        at = np.unique(self.chosen)
        key = (self.keys[at] & ~np.uint64(1)) | self.aligned(at).astype(np.uint64)
        cuts = np.searchsorted(self.doc[at], np.arange(1, len(self.sizes)))
        return [np.unique(k.view(np.int64)) for k in np.split(key, cuts)]

    def windows(self, met: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hash, is reference, is probe) of the windows of each document around the anchors in ``met``, what anchors() says of them in two more bits.

        ``met`` has for each document (n, 2) of key and bits: 1 as a reference, 2 as a probe.
        """
        marks = np.zeros((2, len(self.hashes) + 1), bool)
        for d, found in enumerate(met):
            lo, hi = np.searchsorted(self.first, self.starts[d : d + 2])
            first, chosen = self.first[lo:hi], self.chosen[lo:hi]
            key = ((self.keys[chosen] & ~np.uint64(1)) | self.aligned(chosen).astype(np.uint64)).view(np.int64)
            for bit in (0, 1):
                own = first[np.isin(key, found[found[:, 1] >> bit & 1 == 1, 0])]
                for o in range(BLOCK):
                    marks[bit, np.maximum(own - o, self.starts[d])] = True
        hashes, out = rolling(self.hashes, self.least), []
        for s, e in zip(self.starts[:-1], self.starts[1:], strict=True):
            last = max(s, e - self.least + 1)
            at = s + np.flatnonzero(marks[:, s:last].any(0))
            out.append((hashes[at].view(np.int64), marks[0, at], marks[1, at]))
        return out


def chunks(texts: Iterable[str | None], least: int, memo: _Hashes) -> Iterator[tuple[int, Chunk, list[list[bytes]]]]:
    """(number of the first text, its chunk, the words of each text)."""
    words: list[list[bytes]] = []
    n = begin = 0
    make = lambda: Chunk([np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)) for w in words], least)
    for t in texts:
        words.append(words_of(t))
        n += len(words[-1])
        if n >= WORDS:
            yield begin, make(), words
            begin, words, n = begin + len(words), [], 0
    if words:
        yield begin, make(), words


def spans_of(covered: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The maximal runs of words, first and one past the last, that windows at these ascending starts cover."""
    if not len(covered):
        return []
    breaks = np.flatnonzero(np.diff(covered) > least)
    return list(zip(covered[np.concatenate([[0], breaks + 1])].tolist(), (covered[np.concatenate([breaks, [len(covered) - 1]])] + least).tolist(), strict=True))


def met(rows: DataFrame) -> DataFrame:
    """``rows`` (key, ref, _i, _r, ...) with first, the smallest _i of the key's reference rows, and last, its greatest _i of all.

    ``key`` is a mixed hash. Rows meet in one shuffle, in a window that spills. Keys
    with more than HOT of all rows, of which there are fewer than 1 / HOT, are
    aggregated before that: their rows know what they need from a broadcast and are
    dealt over the window's tasks. They are looked for where the 65,536 runs of
    hashes have as many rows.
    """
    run, many = F.shiftrightunsigned("key", 48).cast("int"), F.lit(max(rows.count() * HOT, 1000))
    runs = [r["b"] for r in rows.groupBy(run.alias("b")).count().where(F.col("count") > many).collect()]  # fewer than 1 / HOT
    first, last = F.min(F.when(F.col("ref"), F.col("_i"))), F.max("_i")
    if not runs:
        along = Window.partitionBy("key")
        return rows.withColumns({"first": first.over(along), "last": last.over(along)})
    hot = rows.where(run.isin(runs)).groupBy("key").agg(first.alias("_first"), last.alias("_last"), F.count("*").alias("c")).where(F.col("c") > many)
    rows = rows.join(F.broadcast(hot.drop("c")), "key", "left")
    along = Window.partitionBy("key", F.when(F.col("_last").isNotNull(), F.xxhash64("_i", "_r")))
    known = F.col("_last").isNotNull()
    facts = {"first": F.when(known, F.col("_first")).otherwise(first.over(along)), "last": F.coalesce("_last", last.over(along))}
    return rows.withColumns(facts).drop("_first", "_last")


SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
SPANS_SQL = "array<struct<from:bigint,to:bigint>>"


def repeats(docs: DataFrame, cut: Cut, least: int = LEAST) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_words, words_sha256, repeats (array of (from, to) in words), kept.

    ``repeats`` are the maximal runs of words covered by windows of ``least``
    words that also start in a document with a smaller doc_id; ``kept`` are the words
    outside them, joined by one space, null where there are no repeats;
    words_sha256 is the digest of all words joined so. Windows are judged on the
    input. A null doc_id is greater than all others; documents of one doc_id never
    remove each other's words, repeated rows included. Null, empty and blank texts
    have no words; texts shorter than ``least`` words lose nothing. Texts are read
    whole, however long. Of documents with equal words all but those of the
    smallest doc_id go whole, without being compared. An empty table gives none.
    """
    last = F.lit((1 << 63) - 1).cast("bigint")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), last).alias("_i"), F.xxhash64("text").alias("_r"), F.col("text").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        memo = _Hashes()
        for b in batches:
            texts = b.column(2)
            for begin, chunk, words in chunks((t.as_py() for t in texts), least, memo):
                n = len(words)
                own = [b.column(k).slice(begin, n) for k in (0, 1)]
                shas = [sha256(b" ".join(w)).hexdigest() for w in words]
                yield pa.RecordBatch.from_arrays([*own, pa.array(chunk.sizes), pa.array(shas), pa.array(chunk.anchors(), pa.list_(pa.int64()))], names=["_i", "_r", "n_words", "sha", "keys"])

    known = cut(rows.select("_i", "_r", "text").mapInArrow(read, "_i bigint, _r bigint, n_words bigint, sha string, keys array<bigint>"))
    place = ["_i", "_r"]
    # Documents whose words are all those of an earlier one go whole.
    same = cut(known.where(F.col("n_words") >= least).groupBy("sha").agg(F.min("_i").alias("q"), F.count("*").alias("c")).where("c > 1"))
    copies = cut(join_hot(known.select(*place, "sha"), same.select("sha", "q"), ["sha"], "_i", same).where("q < _i").select(*place).distinct())

    # An anchor counts if it is a reference block that a later document meets, or meets one of an earlier.
    anchors = known.select(*place, F.explode("keys").alias("key")).select(*place, F.shiftright("key", 1).alias("key"), (F.col("key").bitwiseAND(F.lit(1)) == 1).alias("ref"))
    as_ref, as_probe = F.col("ref") & (F.col("last") > F.col("_i")), F.coalesce(F.col("first") < F.col("_i"), F.lit(False))
    bits = as_ref.cast("bigint") + as_probe.cast("bigint") * 2
    found = met(anchors).withColumn("bits", bits).where("bits > 0").select(*place, F.array(F.shiftleft("key", 1) + F.col("ref").cast("bigint"), F.col("bits")).alias("m"))
    found = found.groupBy(*place).agg(F.collect_set("m").alias("met")).join(copies, place, "left_anti")
    near = cut(rows.select(*place, "text").join(found.hint("merge"), place))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for b in batches:
            marks = [np.array(m, np.int64).reshape(-1, 2) for m in b.column(3).to_pylist()]
            for begin, chunk, words in chunks((t.as_py() for t in b.column(2)), least, memo):
                found = chunk.windows(marks[begin : begin + len(words)])
                own = [np.repeat(b.column(c).slice(begin, len(words)).to_numpy(), [len(h) for h, _, _ in found]) for c in (0, 1)]
                columns = [*own, *(np.concatenate(x) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["_i", "_r", "key", "ref", "probe"])

    windows = cut(near.select(*place, "text", "met").mapInArrow(around, "_i bigint, _r bigint, key bigint, ref boolean, probe boolean"))
    covered = met(windows).where("probe and first < _i").groupBy(*place).agg(F.collect_set("key").alias("covered"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for b in batches:
            gone = [np.array(c, np.int64) for c in b.column(3).to_pylist()]
            for begin, chunk, words in chunks((t.as_py() for t in b.column(2)), least, memo):
                hashes = rolling(chunk.hashes, least).view(np.int64)
                spans, kept = [], []
                for k, w in enumerate(words):
                    s = int(chunk.starts[k])
                    runs = spans_of(np.flatnonzero(np.isin(hashes[s : max(s, s + len(w) - least + 1)], gone[begin + k])), least)
                    edges = [0, *(x for run in runs for x in run), len(w)]
                    spans.append([{"from": i, "to": j} for i, j in runs])
                    kept.append(b" ".join(x for i, j in zip(edges[::2], edges[1::2], strict=True) for x in w[i:j]).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(words)), b.column(1).slice(begin, len(words)), pa.array(spans, SPANS), pa.array(kept)], names=["_i", "_r", "repeats", "kept"])

    some = near.select(*place, "text").join(covered.hint("merge"), place).mapInArrow(remove, f"_i bigint, _r bigint, repeats {SPANS_SQL}, kept string")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("from"), F.col("n_words").alias("to")))
    lost = cut(some.dropDuplicates(place).unionByName(copies.select(*place, F.lit(None).cast(SPANS_SQL).alias("repeats"), F.lit("").alias("kept"))))
    out = known.select(*place, "n_words", "sha").join(lost, place, "left")
    found = F.when(F.col("kept").isNull(), F.array().cast(SPANS_SQL)).otherwise(F.coalesce("repeats", whole))
    doc_id = F.when(F.col("_i") < last, F.col("_i")).cast(docs.schema["doc_id"].dataType)
    return out.select(doc_id.alias("doc_id"), "n_words", F.col("sha").alias("words_sha256"), found.alias("repeats"), "kept")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document repeat an earlier one's run of 50, and the digest of the others."""
    out = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Cut(spark, "op13"))
    removed = F.aggregate("repeats", F.lit(0).cast("bigint"), lambda a, r: a + r["to"] - r["from"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce(F.sha2("kept", 256), "words_sha256").alias("kept_sha256"))
