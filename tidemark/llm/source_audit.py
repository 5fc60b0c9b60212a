"""Source divergence audit: how the words of each source differ from those of its language.

Terms are counted once for each (lang, source) and put into postings: for a term of
a language, the sources that have it and how often. Two reports come from them.

``pair``: the distance of two sources is a sum over all terms of the language. Only
terms in the postings of a block of sources are read; what the others add is the
distance of the two sources' shares of an absent term, times their number.

``term``: the terms of a source that stand out most. Its terms lie in buckets by
count; of each bucket the greatest count and the least share in the language bound
what any of its terms can reach. Buckets are evaluated from the highest bound on,
until all unseen bounds are strictly below the k-th best value found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cut, join_hot, parts, runs_of, table

#: A language keeps the terms in so many of its documents.
DOCUMENTS = 30
#: Shares are whole numbers of so many parts, smoothed by so many occurrences.
PARTS, SMOOTH = 1_000_000_000, 5
#: Terms reported for a source.
TOP = 50
#: Distinct terms that a task counts before it passes them on.
HELD = 1 << 17
#: Sources that are compared at once.
BLOCK = 256

#: Bytes to bytes: A-Z lower-cased, all that is no letter and below 0x80 to a space.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and of all beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), d (documents): ``docs`` (lang, source, text, none null) counted; term is null in one row of each group, with c = 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(*g, None, 0, 0) for g in held] + [(*g, t.decode("utf-8", "surrogatepass"), n, ds[t]) for g, (cs, ds) in held.items() for t, n in cs.items()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "term", "c", "d"])

        for b in batches:
            for lang, source, text in zip(*(b.column(k) for k in range(3)), strict=True):
                cs, ds = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                terms = terms_of(text.as_py())
                size -= len(cs)
                cs.update(terms)
                ds.update(set(terms))
                size += len(cs)
                if size > HELD:
                    yield out()
                    held, size = {}, 0
        yield out()

    found = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, c bigint, d bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def share(count: Column) -> Column:
    """1 + floor(PARTS * (count + SMOOTH) / (n + SMOOTH * v)), exact, of a row with n and v; null where v is 0."""
    whole = lambda c: c.cast("decimal(19,0)")
    down = whole(F.col("n")) + whole(F.lit(SMOOTH)) * whole(F.col("v"))
    return F.when(F.col("v") > 0, F.call_function("div", whole(F.lit(PARTS)) * whole(count + SMOOTH), down) + 1).cast("bigint")


class Postings:
    """The kept terms of each language with the sources that have them.

    groups: lang, source, n (occurrences of kept terms), v (kept terms of the language), none (share of an absent term).
    rows: lang, source, term, c, p (share in the source), q (in the language), none; c > 0.
    Both are written.
    """

    def __init__(self, docs: DataFrame, cut: Cut, documents: int = DOCUMENTS):
        text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
        counts = cut(counted(docs.select(*text)))
        known = counts.where("term is not null")
        kept = cut(known.groupBy("lang", "term").agg(F.sum("c").alias("all"), F.sum("d").alias("d")).where(F.col("d") >= documents).select("lang", "term", "all"))
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n"))
        rows = cut(known.select("lang", "source", "term", "c").join(kept, ["lang", "term"]))
        sizes = rows.groupBy("lang", "source").agg(F.sum("c").alias("n"))
        groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs.select("lang", "v", F.col("n").alias("of_lang")), "lang", "left")
        groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("v", F.lit(0)).cast("bigint").alias("v"), F.col("of_lang").cast("bigint").alias("of_lang"))
        self.groups = cut(groups.withColumn("none", F.coalesce(share(F.lit(0)), F.lit(0))))
        # A source can hold a third of all rows; the facts of the groups are one row each.
        facts = self.groups.where("n > 0").select("lang", "source", "n", "v", "none", "of_lang")
        rows = join_hot(rows, facts, ["lang", "source"], "term", rows.groupBy("lang", "source").agg(F.count("*").alias("c")))
        rows = rows.withColumn("p", share(F.col("c"))).withColumn("n", F.col("of_lang")).withColumn("q", share(F.col("all")))
        self.rows = cut(rows.select("lang", "source", "term", "c", "p", "q", "none"))
        cut.drop(counts)


def pairs(postings: Postings, cut: Cut, block: int = BLOCK) -> DataFrame:
    """lang, source, item, value: the distance of each two sources of a language, both ways.

    Sources are dealt into blocks; a task has the postings of two blocks for a part of the
    terms and adds up, for each pair, how much the terms differ beyond what absent
    ones do. So no row stands for a pair and a term. As many rows come out as
    there are pairs, which is the report.
    """
    n = parts(postings.groups.sparkSession)
    sizes = postings.groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = cut(sizes.withColumn("chunks", F.greatest(F.ceil(F.lit(2.0 * n) / (F.col("blocks") * (F.col("blocks") + 1))), F.lit(1)).cast("int")))  # a row for each language
    dealt = lambda d: join_hot(d, sizes, ["lang"], "source", d.groupBy("lang").agg(F.count("*").alias("c"))).withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    meet = F.sequence(F.lit(0), F.col("blocks") - 1)
    groups = dealt(postings.groups.select("lang", "source", "none", "v")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = groups.select("lang", "chunk", "own", "blocks", F.lit(None).cast("bigint").alias("term"), "source", "none", F.col("v").alias("p"))
    rows = dealt(postings.rows.select("lang", "source", "term", "none", "p")).withColumn("h", F.xxhash64("term"))
    rows = rows.select("lang", F.pmod("h", "chunks").cast("int").alias("chunk"), "own", "blocks", F.col("h").alias("term"), "source", "none", "p")
    both = groups.unionByName(rows).withColumn("other", F.explode(meet)).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    both = both.select(F.xxhash64("lang").alias("l"), "chunk", "i", "j", "term", "lang", "own", "source", "none", "p")
    both = both.repartition(2 * n, "l", "chunk", "i", "j").sortWithinPartitions("l", "chunk", "i", "j", F.col("term").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ("l", "chunk", "i", "j")):
            head = t.filter(pa.compute.is_null(t["term"]))
            rest = t.filter(pa.compute.is_valid(t["term"]))
            names, own, base, kept = head["source"].to_pylist(), head["own"].to_numpy(), head["none"].to_numpy(), head["p"][0].as_py()
            at = {s: k for k, s in enumerate(names)}
            place = np.fromiter((at[s] for s in rest["source"].to_pylist()), np.int64, rest.num_rows)
            _, term = np.unique(rest["term"].to_numpy(), return_inverse=True)
            share = rest["p"].to_numpy()
            sums = np.zeros((len(names), len(names)), np.int64)
            order = np.argsort(term, kind="stable")
            terms = int(term.max()) + 1 if len(term) else 0
            for lo in range(0, terms, 256):
                some = order[np.searchsorted(term[order], lo) : np.searchsorted(term[order], lo + 256)]
                m = np.repeat(base[None, :], min(256, terms - lo), 0)
                m[term[some] - lo, place[some]] = share[some]
                for k in range(len(names)):
                    sums[k] += np.abs(m - m[:, k : k + 1]).sum(0)
            sums -= terms * np.abs(base[:, None] - base[None, :])
            # Within one block each pair is met once; of two blocks, the pairs across.
            one = t["i"][0].as_py() == t["j"][0].as_py()
            x, y = np.nonzero(np.triu(np.ones_like(sums, bool), 1) if one else (own[:, None] != own[None, :]) & np.triu(np.ones_like(sums, bool), 1))
            named = [pa.array([names[k] for k in at], pa.string()) for at in (x, y)]
            yield pa.RecordBatch.from_arrays([pa.repeat(t["lang"][0], len(x)), *named, pa.array(kept * np.abs(base[x] - base[y])), pa.array(sums[x, y])], names=["lang", "a", "b", "absent", "value"])

    found = both.mapInArrow(compare, "lang string, a string, b string, absent bigint, value bigint")
    # The order of the two in a task is that of its rows; the smaller name goes first.
    found = found.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "absent", "value")
    found = found.groupBy("lang", "a", "b").agg((F.max("absent") + F.sum("value")).alias("value"))
    ways = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])
    return found.select("lang", F.explode(ways).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def bucket(c: Column) -> Column:
    """The bucket of a count: four for each doubling."""
    return F.floor(F.log2(c) * 4).cast("int")


def bounds(postings: Postings) -> DataFrame:
    """lang, source, bucket, c (terms), top: no term of the bucket stands out by more than top."""
    rows = postings.rows.withColumn("bucket", bucket(F.col("c")))
    per = rows.groupBy("lang", "source", "bucket").agg(F.count("*").alias("c"), F.max("p").alias("p"), F.min("q").alias("q"))
    return per.select("lang", "source", "bucket", "c", (F.col("p") - F.col("q")).alias("top"))


def outstanding(postings: Postings, cut: Cut, top: int = TOP) -> DataFrame:
    """lang, source, item, value: of each source the ``top`` terms whose share exceeds that in the language by most, ties by item."""
    rows = postings.rows.withColumn("bucket", bucket(F.col("c"))).select("lang", "source", "bucket", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    unseen, best, keys, want = cut(bounds(postings).where("top > 0")), None, ["lang", "source", "bucket"], top
    along = Window.partitionBy("lang", "source").orderBy(F.col("top").desc(), "bucket")
    inside = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    while not unseen.isEmpty():
        # The next buckets by bound, as many as hold ``want`` terms; the rest waits.
        before = F.sum("c").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        ordered = cut(unseen.withColumn("now", before < want))
        now = ordered.where("now").select(*keys, "c")
        found = join_hot(rows, now.select(*keys), keys, "item", now).where("value > 0").select("lang", "source", "item", "value")
        found = found if best is None else found.unionByName(best)
        best = cut(found.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= top).drop("rank"))
        # Unseen bounds strictly below the top-th best value are done with.
        kth = best.groupBy("lang", "source").agg(F.when(F.count("*") >= top, F.min("value")).alias("kth"))
        unseen = cut(ordered.where("not now").join(kth, ["lang", "source"], "left").where("kth is null or top >= kth").select("lang", "source", "bucket", "c", "top"))
        want *= 4
    return best if best is not None else rows.select("lang", "source", "item", "value").limit(0)


def audit(docs: DataFrame, cut: Cut, documents: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value (long), rank (int): both reports of ``docs`` (text, lang, source; nulls read as empty).

    Terms in fewer than ``documents`` documents of the language, repeated rows
    counted each, are left out. A source without kept terms is compared like any
    other; in a language without any, all distances are 0. A source alone in its
    language has no pairs. Ranks run by value, highest first, ties by item in the
    order of UTF-8. Texts are read whole, however long; an empty table gives no rows.
    """
    postings = Postings(docs, cut, documents)
    both = pairs(postings, cut).withColumn("part", F.lit("pair")).unionByName(outstanding(postings, cut, top).withColumn("part", F.lit("term")))
    along = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return both.select("lang", "source", "part", "item", "value", F.row_number().over(along).cast("int").alias("rank"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances of the sources of each language, and the terms in which each differs most from the language."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"), Cut(spark, "op11"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS a FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT l.lang, count(term) AS v, coalesce(sum(a), 0) AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept USING (lang) GROUP BY l.lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * langs.v) AS p,
    1 + (1000000000::HUGEINT * (kept.a + 5)) // (langs.n + 5 * langs.v) AS q
    FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) x ON x.lang = a.lang AND s1 = a.source AND s2 = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
