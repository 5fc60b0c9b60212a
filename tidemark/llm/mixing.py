"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots. Slot k holds the point frac(k * golden ratio) of
the unit interval, on which each source owns a stretch as long as its share of
the words; so every run of slots holds each source in nearly its share. All
blocks have the same number of words. A source's words, in a shuffled order of its
documents and repeated as often as its target asks, are cut into such blocks, and
its r-th slot takes the r-th of them, the last as far as the target goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Cut, parts, table

WEIGHTS = (5, 2, 1)
#: Most times that a source's words are taken.
PASSES = 3
#: Words in a block, whatever the size of the corpus.
BLOCK = 1024
GOLDEN = 0.6180339887498949
#: Documents in a run of the shuffled order that one task sums up, about.
RUN = 20_000
#: Slots that one task ranks.
CHUNK = 4096


def words(text: str = "text") -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.call_function("regexp_count", F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def in_ranges(sources: DataFrame, cut: Cut) -> DataFrame:
    """``sources`` written in ranges of source by code point, null last, each with its number in _tm_part."""
    ranges = sources.repartitionByRange(parts(sources.sparkSession), F.col("source").isNull(), "source")
    return cut(ranges.withColumn("_tm_part", F.spark_partition_id()))


def running(ranges: DataFrame, value: Column) -> Column:
    """The sum of the whole number ``value`` over the sources up to this one: within a range, raised by the ranges before it."""
    per = {r["_tm_part"]: r["v"] or 0 for r in ranges.groupBy("_tm_part").agg(F.sum(value).alias("v")).collect()}  # a row for each range
    before = [sum(v for p, v in per.items() if p < k) for k in range(max(per, default=0) + 1)]
    inside = Window.partitionBy("_tm_part").orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(inside) + F.get(F.lit(before).cast("array<bigint>"), F.col("_tm_part"))


def targets(sizes: DataFrame, cut: Cut, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """source, source_size, target (double), goal (long): the words that each source gives; in ranges of source.

    ``sizes`` has source and source_size, a row for each source. The weights go
    round the sources by code point, null last. The targets share all words by
    weight; a source above ``passes`` times its size is held there and the excess
    is shared again by weight, round after round, until none is above. No task
    sees all sources, so they can be as many as hosts.
    """
    d = in_ranges(sizes, cut)
    d = d.withColumn("w", F.get(F.lit(list(weights)), ((running(d, F.lit(1)) - 1) % len(weights)).cast("int")).cast("bigint"))
    limit = F.col("source_size") * passes
    full, held = F.lit(False), -1
    while True:
        sums = [F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("source_size"), F.when(full, limit), F.when(~full, F.col("w")))]
        n, total, given, shared = d.agg(F.count_if(full), *sums).first()
        if n == held or not shared:
            break
        held, left = n, total - given
        exact = lambda c: c.cast("decimal(19,0)")
        full = exact(F.lit(left)) * exact(F.col("w")) > exact(limit) * exact(F.lit(shared))
    share = F.lit(float(total - given)) / float(max(shared or 0, 1))
    d = d.withColumn("target", F.when(full, limit.cast("double")).otherwise(share * F.col("w")))
    return cut(d.withColumn("goal", F.least(F.floor(F.col("target") + 0.5), limit)).select("source", "source_size", "target", "goal", "_tm_part"))


def schedule(goals: DataFrame, block: int = BLOCK, cut: Cut | None = None) -> tuple[DataFrame, DataFrame]:
    """(slots: source, r, k; counts: source, slots): the slot k that each block r of ``block`` words of a source takes.

    A point finds its stretch by an equality join: the unit interval is cut into
    cells, a stretch lies in the cells that it meets. There are as many points as
    blocks, so a source meets as many as it has blocks, but for a few; it leaves
    slots beyond its blocks empty. The k-th point is slot 2k. A block that no
    point met, as of a source smaller than a block, takes the odd slot at its own
    place, where the middle of the block lies among the source's words.
    """
    spark = goals.sparkSession
    goals = goals.where("goal > 0")
    if "_tm_part" not in goals.columns:
        goals = in_ranges(goals, cut or Cut(spark, "schedule"))
    total, n = goals.agg(F.coalesce(F.sum("goal"), F.lit(0)), F.count("*")).first()
    length = -(-total // block)
    cells = max(256, 4 * n)
    own = goals.withColumn("end", running(goals, F.col("goal"))).select("source", ((F.col("end") - F.col("goal")) / max(total, 1)).alias("lo"), (F.col("end") / max(total, 1)).alias("hi"))
    own = own.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    slots = spark.range(length).select(F.col("id").alias("k"), ((F.col("id") * GOLDEN) % 1.0).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells)).join(own, "cell").where("lo <= u and u < hi").select("source", "k")
    slots = slots.withColumn("chunk", F.floor(F.col("k") / CHUNK))
    per = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    per = per.select(F.col("source").alias("s"), F.col("chunk").alias("c"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("k")) - 1
    slots = slots.withColumn("inside", inside).join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    slots = slots.select("source", (F.col("before") + F.col("inside")).alias("r"), "k")
    needed = goals.select(F.col("source").alias("s"), F.ceil(F.col("goal") / block).alias("need"))
    slots = slots.join(needed, F.col("source").eqNullSafe(F.col("s"))).where("r < need").select("source", "r", (2 * F.col("k")).alias("k"))
    met = slots.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("slots"))
    counts = goals.join(met, F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("slots", F.lit(0)).alias("slots"), F.ceil(F.col("goal") / block).alias("need"))
    late = counts.where("slots < need").select("source", "need", F.explode(F.sequence("slots", F.col("need") - 1)).alias("r"))
    at = F.floor((2 * F.col("r") + 1) * F.lit(length) / (2 * F.col("need")))
    late = late.select("source", "r", (2 * at + 1).alias("k"))
    return slots.unionByName(late), counts.select("source", F.col("need").alias("slots"))


def streamed(docs: DataFrame, cut: Cut, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with source_size, target, passes and _tm_from; the slots).

    ``docs`` has doc_id, source, size and other columns with no leading _tm_.
    passes: the words taken in each pass over the source; _tm_from: how many words
    of the source lie before the document in its shuffled order.
    """
    docs = docs.withColumn("_tm_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    runs = max(64, -(-docs.count() // RUN))
    docs = docs.withColumn("_tm_run", F.floor(F.conv(F.substring("_tm_h", 1, 8), 16, 10).cast("bigint") * runs / (1 << 32)))
    per = docs.groupBy(F.col("source").alias("_tm_s"), F.col("_tm_run").alias("_tm_r")).agg(F.sum("size").alias("_tm_n"))
    along = Window.partitionBy("_tm_s").orderBy("_tm_r").rowsBetween(Window.unboundedPreceding, 0)
    per = cut(per.withColumn("_tm_before", F.sum("_tm_n").over(along) - F.col("_tm_n")))
    sizes = per.groupBy(F.col("_tm_s").alias("source")).agg(F.sum("_tm_n").alias("source_size"))
    goals = targets(sizes, cut, weights, passes)
    slots = cut(schedule(goals, block)[0])
    per = per.join(goals.withColumnRenamed("source", "_tm_p").drop("_tm_part"), F.col("_tm_s").eqNullSafe(F.col("_tm_p"))).drop("_tm_n", "_tm_p")

    in_run = Window.partitionBy("source", "_tm_run").orderBy("_tm_h", "doc_id", "size")
    docs = docs.withColumn("_tm_to", F.sum("size").over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    docs = docs.join(per, F.col("source").eqNullSafe(F.col("_tm_s")) & (F.col("_tm_run") == F.col("_tm_r")))
    docs = docs.withColumn("_tm_from", F.col("_tm_before") + F.col("_tm_to") - F.col("size"))
    lo = lambda p: F.col("source_size") * p + F.col("_tm_from")
    taken = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: F.greatest(F.least(lo(p) + F.col("size"), F.col("goal")) - lo(p), F.lit(0).cast("bigint")))
    docs = docs.withColumn("passes", taken)
    return docs.drop("goal", *[c for c in docs.columns if c.startswith("_tm_") and c != "_tm_from"]), slots


def in_slots(rows: DataFrame, slots: DataFrame, block: int, start: Column, slot: str, place: str) -> DataFrame:
    """``rows`` (source, ...) with the slot whose block holds the word ``start`` of the source, and that word's place in the block."""
    at = slots.select(F.col("source").alias("_tm_s"), F.col("r").alias("_tm_r"), F.col("k").alias(slot))
    rows = rows.withColumn("_tm_at", start).withColumn("_tm_b", F.floor(F.col("_tm_at") / block))
    out = rows.join(at, F.col("source").eqNullSafe(F.col("_tm_s")) & (F.col("_tm_b") == F.col("_tm_r")), "left")
    return out.withColumn(place, F.when(F.col(slot).isNotNull(), F.col("_tm_at") - F.col("_tm_b") * block)).drop("_tm_s", "_tm_r", "_tm_at", "_tm_b")


def mix(docs: DataFrame, cut: Cut, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, source, size, other columns with no leading _tm_): what the mix takes of it.

    Adds source_size, target, passes (array of the words taken in each pass over
    the source), taken (their sum), first_slot (the slot of the schedule that
    takes its first word; null if none does) and place (that word's number in the
    slot's block). The mix is the blocks in the order of their slots. Words are
    taken from the start of a document; at most one document of a source is taken
    in part in a pass. The order inside a source follows the MD5 of doc_id, then
    size; rows alike in both are interchangeable. Nulls: a null source is a source;
    a null doc_id sorts first. A document of size 0 is never taken. An empty table gives no rows.
    """
    out, slots = streamed(docs, cut, weights, passes, block)
    out = out.withColumn("taken", F.aggregate("passes", F.lit(0).cast("bigint"), lambda a, x: a + x))
    return in_slots(out, slots, block, F.when(F.col("taken") > 0, F.col("_tm_from")), "first_slot", "place").drop("_tm_from")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by the weights 5, 2, 1: what it takes of each, and where."""
    cut = Cut(spark, "op2")
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("size")))
    return mix(docs, cut).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "place")


def mixed_documents(docs: DataFrame, cut: Cut, block: int = BLOCK, **how) -> DataFrame:
    """The mix in its order, in the columns of ``docs``: a row each time that a document is taken.

    Rows lie in the order of the slot and the place of their first word; a
    partition holds a run of slots, so about as many words as any other. A
    document taken in part in a pass is cut after its last taken word. Rows
    that are alike in every column are numbered, and each counts. Rows that the mix doesn't take go.
    """
    # Both non-null, so that the numbering and the join share one shuffle of the texts.
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_tm_id"), F.xxhash64(*docs.columns).alias("_tm_key")]
    number = F.row_number().over(Window.partitionBy("_tm_id", "_tm_key").orderBy("_tm_key"))
    whole = docs.select(F.struct(*docs.columns).alias("_tm_doc"), *key).withColumn("_tm_no", number)
    facts = docs.select("doc_id", "source", words().alias("size"), *key).withColumn("_tm_no", number)
    facts = cut(facts.select("doc_id", "source", "size", F.col("_tm_id").alias("id"), F.col("_tm_key").alias("key"), F.col("_tm_no").alias("no")))
    rows, slots = streamed(facts, cut, block=block, **how)
    rows = rows.select("id", "key", "no", "source", "size", "source_size", "_tm_from", F.posexplode("passes").alias("p", "n")).where("n > 0")
    rows = cut(in_slots(rows, slots, block, F.col("_tm_from") + F.col("p") * F.col("source_size"), "slot", "place"))
    last = rows.agg(F.coalesce(F.max("slot"), F.lit(0))).first()[0] + 1
    each = rows.groupBy("id", "key", "no").agg(F.collect_list(F.struct("slot", "place", "n", "size")).alias("x"))  # one for each pass
    taken = each.groupBy(F.col("id").alias("_tm_id"), F.col("key").alias("_tm_key")).agg(F.map_from_entries(F.collect_list(F.struct("no", "x"))).alias("_tm_taken"))
    out = whole.join(taken.hint("merge"), ["_tm_id", "_tm_key"]).withColumn("_tm_x", F.explode(F.element_at("_tm_taken", F.col("_tm_no"))))
    out = out.select("_tm_doc", "_tm_id", "_tm_x.*")
    # Each piece is a word with the white space before it, so the pieces put together are the text up to there.
    pieces = F.regexp_extract_all("_tm_doc.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(F.col("n") < F.col("size"), F.array_join(F.slice(pieces, 1, F.col("n").cast("int")), "")).otherwise(F.col("_tm_doc.text"))
    n = parts(docs.sparkSession)
    out = out.repartitionById(n, F.floor(F.col("slot") * n / last).cast("int")).sortWithinPartitions("slot", "place", "_tm_id").withColumn("_tm_text", text)
    changed = {"text": F.col("_tm_text"), "n_chars": F.length("_tm_text").cast("bigint")}
    return out.select(*[changed.get(c, F.col(f"_tm_doc.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
c AS (SELECT *, 3 * source_size AS lim, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
f AS (SELECT *, (total - given) * w > lim * open AS full_up FROM c),
t AS (SELECT source, source_size, CASE WHEN full_up THEN lim::DOUBLE ELSE
    (total - coalesce(sum(CASE WHEN full_up THEN lim END) OVER (), 0))::DOUBLE / sum(CASE WHEN NOT full_up THEN w END) OVER () * w END AS target, lim FROM f),
g AS (SELECT *, least(floor(target + 0.5)::BIGINT, lim)::BIGINT AS goal FROM t),
n AS (SELECT coalesce(sum(goal), 0)::BIGINT AS total, 1024 AS block, (coalesce(sum(goal), 0)::BIGINT + 1023) // 1024 AS length FROM g WHERE goal > 0),
own AS (SELECT source, (goal + block - 1) // block AS need, (ends - goal) / total AS lo, ends / total AS hi FROM
    (SELECT *, sum(goal) OVER (ORDER BY source IS NULL, source)::BIGINT AS ends FROM g WHERE goal > 0) CROSS JOIN n),
met AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS r, need FROM
    (SELECT k, (k * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM (SELECT unnest(range(length)) AS k FROM n)) JOIN own ON lo <= u AND u < hi QUALIFY r < need),
late AS (SELECT own.source, need, unnest(range(coalesce(x.c, 0), need)) AS r FROM own LEFT JOIN (SELECT source, count(*) AS c FROM met GROUP BY source) x ON own.source IS NOT DISTINCT FROM x.source),
slots AS (SELECT source, r, 2 * k AS k FROM met UNION ALL SELECT source, r, 2 * floor((2 * r + 1) * length / (2 * need))::BIGINT + 1 FROM late CROSS JOIN n),
o AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.goal,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS a
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, (greatest(0, least(a + size, goal) - a) + greatest(0, least(source_size + a + size, goal) - source_size - a)
     + greatest(0, least(2 * source_size + a + size, goal) - 2 * source_size - a))::BIGINT AS taken FROM o),
q AS (SELECT p.*, CASE WHEN taken > 0 THEN a // block END AS b, CASE WHEN taken > 0 THEN a % block END AS place FROM p LEFT JOIN n ON true)
SELECT doc_id, size, source_size, target, taken, k AS first_slot, place FROM q LEFT JOIN slots ON q.source IS NOT DISTINCT FROM slots.source AND b = r
"""
