"""Line dedup: later copies of runs of lines that many documents share are deleted.

Winnowing over line hashes finds the runs. From each line on, the shortest run of
at least MIN_WORDS words is a window; it selects its least line hash, the rightmost
on ties. Windows that follow one another mostly select the same place, so there are
far fewer fingerprints than lines. A run of that many words that occurs twice holds
the window at its first line, so both occurrences have that fingerprint, at the
same place in the run. Fingerprints are joined by line hash; of those that occur
more than once, each is joined with the first occurrence of each of its windows,
the match is extended line by line both ways, and the later run is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, join_hot, table

MIN_WORDS = 50


def lines_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """(hash, words, number) of each line with a word; white space at its ends doesn't count."""
    hashes, words, at = [], [], []
    for k, line in enumerate(text.split("\n")):
        n = len(line.split())
        if n:
            hashes.append(xxhash.xxh3_64_intdigest(line.strip().encode("utf-8", "surrogatepass")) - (1 << 63))
            words.append(n)
            at.append(k)
    return hashes, words, at


def windows(hashes: np.ndarray, words: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(hash of the window, position of its fingerprint) for each line at which a window starts."""
    out = []
    for i, e in enumerate(ends_of(words, least).tolist()):
        if e > len(hashes):
            break
        own = hashes[i:e]
        at = e - 1 - int(np.argmin(own[::-1])) if e > i + 1 else i
        out.append((xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), at))
    return out


def extended(p: np.ndarray, q: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """The run of p, first line and one past the last, that equals q's around the match of p[i] and q[j]."""
    n = min(i, j)
    before = p[i - n : i][::-1] == q[j - n : j][::-1]
    start = i - (n if before.all() else int(np.argmin(before)))
    n = min(len(p) - i, len(q) - j)
    after = p[i : i + n] == q[j : j + n]
    return start, i + (n if after.all() else int(np.argmin(after)))


def fingerprints(hashes: np.ndarray, words: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int, list[int]]]:
    """(line hash, position, hashes of the windows that select it) for each position that winnowing selects."""
    out: list[tuple[int, int, list[int]]] = []
    for window, at in windows(hashes, words, least):
        if not out or out[-1][1] != at:
            out.append((int(hashes[at]), at, []))
        out[-1][2].append(window)
    return out


def ends_of(words: np.ndarray, least: int) -> np.ndarray:
    """For each line, one past the last line of the window that it starts; more than all lines if there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    return np.searchsorted(total, total[:-1] + least)


def runs_against(p: np.ndarray, q: np.ndarray, matches: list[tuple[int, int]], own: bool, words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The runs of p, first line and one past the last, that repeat q around these matches of their lines.

    Within one document (``own``) a run can overlap what it repeats, as in a line
    said ten times over. It then starts only where every window ends that starts
    before it, so that what it repeats stays whole.
    """
    ends, seen, out = ends_of(words, least) if own else None, {}, []
    for i, j in sorted(matches):
        if i < seen.get(i - j, 0):
            continue
        start, end = extended(p, q, i, j)
        seen[i - j] = end
        if own and end - (i - j) > start:
            start = max(start, int(ends[start - 1]))
        if start < end:
            out.append((start, end))
    return out


def union_of(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending runs that cover the same lines."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


RANGES = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def repeated_runs(docs: DataFrame, cut: Cut, least: int = MIN_WORDS) -> DataFrame:
    """_i, _r, keep (array of (from, to) over all lines of the text), words_gone, repeats_of (array of doc_id) of the documents that lose lines.

    ``docs`` has _i (long), _r (a hash) and text. Documents stand in the order of
    (_i, _r); rows alike in both are one document. A run that two lines of one
    document start is deleted at the later one.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lines_of(t.as_py() or "") for t in b.column(2)]
            ends = [t.as_py().count("\n") + 1 if t.is_valid else 0 for t in b.column(2)]
            yield pa.RecordBatch.from_pydict({
                "_i": b.column(0), "_r": b.column(1), "lines": pa.array([h for h, _, _ in found], pa.list_(pa.int64())),
                "words": pa.array([w for _, w, _ in found], pa.list_(pa.int32())), "places": pa.array([[*at, end] for (_, _, at), end in zip(found, ends, strict=True)], pa.list_(pa.int32())),
            })

    known = docs.select("_i", "_r", "text").mapInArrow(read, "_i bigint, _r bigint, lines array<bigint>, words array<int>, places array<int>")
    known = cut(known.where(F.aggregate("words", F.lit(0), lambda a, w: a + w) >= least).dropDuplicates(["_i", "_r"]))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, i, r, at, w) for i, r, lines, words in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True) for f, at, w in fingerprints(np.array(lines, np.int64), np.array(words), least)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["line", "_i", "_r", "at", "windows"])

    prints = cut(known.select("_i", "_r", "lines", "words").mapInArrow(select, "line bigint, _i bigint, _r bigint, at int, windows array<bigint>"))
    # A line that was selected in one place only repeats nothing. Of the others, the windows tell which places of a common line go together.
    often = cut(prints.groupBy("line").agg(F.count("*").alias("c")).where("c > 1"))
    shared = cut(join_hot(prints, often.select("line"), ["line"], "_i", often).withColumn("window", F.explode("windows")).drop("windows"))
    place = F.struct("_i", "_r", "at")
    first = cut(shared.groupBy("line", "window").agg(F.min(place).alias("q"), F.count("*").alias("c")).where("c > 1"))
    pairs = join_hot(shared, first.drop("c"), ["line", "window"], "_i", first).where(place != F.col("q"))
    pairs = pairs.select("_i", "_r", F.col("q._i").alias("qi"), F.col("q._r").alias("qr"), F.struct("at", F.col("q.at").alias("to")).alias("m"))
    pairs = cut(pairs.groupBy("_i", "_r", "qi", "qr").agg(F.collect_set("m").alias("m")))
    others = known.select(F.col("_i").alias("qi"), F.col("_r").alias("qr"), F.col("lines").alias("other"))
    both = join_hot(pairs.join(known, ["_i", "_r"]), others, ["qi", "qr"], "_i", pairs.groupBy("qi", "qr").agg(F.count("*").alias("c")))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = []
            ids = zip(*(b.column(c).to_pylist() for c in ("_i", "_r", "qi", "qr")), strict=True)
            for (i, r, qi, qr), m, lines, words, other in zip(ids, *(b.column(c) for c in ("m", "lines", "words", "other")), strict=True):
                p, q = np.array(lines.as_py(), np.int64), np.array(other.as_py(), np.int64)
                found = runs_against(p, q, [(x["at"], x["to"]) for x in m.as_py()], (i, r) == (qi, qr), np.array(words.as_py()), least)
                runs.append([{"from": s, "to": e} for s, e in found])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_i", "_r", "qi", "words", "places")), pa.array(runs, RANGES)], names=["_i", "_r", "qi", "words", "places", "runs"])

    schema = "_i bigint, _r bigint, qi bigint, words array<int>, places array<int>, runs array<struct<from:int,to:int>>"
    runs = both.select("_i", "_r", "qi", "qr", "m", "lines", "words", "places", "other").mapInArrow(extend, schema).where("size(runs) > 0")
    per = runs.groupBy("_i", "_r").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.any_value("words").alias("words"), F.any_value("places").alias("places"), F.sort_array(F.collect_set("qi")).alias("repeats_of"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, lost = [], []
            for runs, words, places in zip(*(b.column(c).to_pylist() for c in ("runs", "words", "places")), strict=True):
                gone = union_of([(x["from"], x["to"]) for x in runs])
                lost.append(sum(sum(words[s:e]) for s, e in gone))
                edges = [0, *(places[x] for run in gone for x in run), places[-1]]
                keep.append([{"from": s, "to": e} for s, e in zip(edges[::2], edges[1::2], strict=True) if s < e])
            yield pa.RecordBatch.from_arrays([b.column("_i"), b.column("_r"), pa.array(keep, RANGES), pa.array(lost, pa.int64()), b.column("repeats_of")], names=["_i", "_r", "keep", "words_gone", "repeats_of"])

    return per.mapInArrow(merge, "_i bigint, _r bigint, keep array<struct<from:int,to:int>>, words_gone bigint, repeats_of array<bigint>")


def without(text: str, gone: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(the text without these runs, its lines before, lines deleted): in plain form what ``deduplicated`` does; tests hold it against this."""
    bad = {k for s, e in gone for k in range(s, e)}
    kept, n, dead = [], -1, False
    lines = text.split("\n")
    for line in lines:
        if line.split():
            n += 1
            dead = n in bad
        if not dead:
            kept.append(line)
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def deduplicated(docs: DataFrame, cut: Cut, least: int = MIN_WORDS) -> DataFrame:
    """doc (the row of ``docs`` as a struct, without text), text (what is left), n_lines, lines_deleted, words_deleted (long), repeats_of.

    ``docs`` has doc_id and text among its columns; earlier documents are those
    with a lower doc_id, null last, ties in the order of a hash of the text. Runs
    of at least ``least`` words are found for certain; shorter ones never. Null
    and empty texts stay as they are. Rows alike in doc_id and text are one
    document: neither repeats the other. Blank lines go with the line before them.
    Texts are read whole, however long; an empty table gives no rows.
    """
    last = F.lit((1 << 63) - 1).cast("bigint")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col("doc_id").cast("bigint"), last).alias("_i"), F.xxhash64("text").alias("_r"))
    runs = repeated_runs(rows.select("_i", "_r", F.col("doc.text").cast("string").alias("text")), cut, least)
    out = rows.join(runs, ["_i", "_r"], "left").withColumn("_text", F.col("doc.text").cast("string"))
    lines = F.split("_text", "\n", -1)
    left = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(lines, r["from"] + 1, r["to"] - r["from"]))), "\n")
    n_lines = F.coalesce(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    stay = F.aggregate("keep", F.lit(0), lambda a, r: a + r["to"] - r["from"])
    return out.select(
        F.struct(*[F.col(f"doc.`{c}`") for c in docs.columns if c != "text"]).alias("doc"), F.coalesce("words_gone", F.lit(0)).cast("bigint").alias("words_deleted"),
        F.coalesce("repeats_of", F.array().cast("array<bigint>")).alias("repeats_of"), F.when(F.col("keep").isNotNull(), left).otherwise(F.col("_text")).alias("text"),
        n_lines.alias("n_lines"), F.when(F.col("keep").isNotNull(), n_lines - stay).otherwise(0).cast("bigint").alias("lines_deleted"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document, and the earlier documents that hold what it deletes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs, Cut(spark, "op1")).select(F.col("doc.doc_id").alias("doc_id"), "text", "n_lines", "lines_deleted", "words_deleted", "repeats_of")
