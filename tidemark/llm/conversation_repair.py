"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

Everything is Spark SQL. Windows over a conversation derive the fault of each turn;
its turns are collected in order, and a fold over them carries, for each of the four
states of the grammar ``(s?(ua)+)?`` (nothing yet, after system, after user, after
assistant), the cheapest edits so far as a struct (cost, audit). ``least`` on those
structs takes the cheapest and, of equals, the audit that is least by code point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: What an edit costs. TRUNCATED is added to a kept or changed role of a truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The faults that damage() plants, by the remainder of the row's checksum.
DROP, EMPTY, CUT, REPEAT, USER, KINDS = 0, 1, 2, 3, 4, 20


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone: ``rows`` with faults planted by crc32 of ``conv_id:turn``, nulls read as one space.

    conv_id and turn stay null where they were; a dropped row stays with ``gone``
    true, so that its conversation stays known.
    """
    space = F.lit(" ")
    said = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % KINDS
    text = F.when(kind == EMPTY, "").when(kind == CUT, F.regexp_replace(said("text"), r"[.!?]", "")).otherwise(said("text"))
    out = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(kind == USER, "user").otherwise(said("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    twice = F.when(F.col("kind") == REPEAT, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.withColumn("copy", F.explode(twice)).select("conv_id", "turn", "role", "text", (F.col("kind") == DROP).alias("gone"))


def _plus(state: Column, cost: Column | int, letter: Column | str) -> Column:
    """The state after one more edit; null stays null."""
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return F.when(state.isNotNull(), F.struct((state["c"] + cost).cast("bigint").alias("c"), F.concat(state["t"], letter).alias("t")))


def _inserted(a: Column) -> Column:
    """The four states, with what up to two insertions reach."""
    user = F.least(a["u"], *[_plus(a[k], INSERT, "I") for k in "nsa"])
    return F.transform(F.array(F.struct(a["n"].alias("n"), a["s"].alias("s"), user.alias("u"), a["a"].alias("a"))), lambda x: x.withField("a", F.least(x["a"], _plus(x["u"], INSERT, "I"))))[0]


def _step(a: Column, turn: Column) -> Column:
    """The four states after one more turn: deleted, kept, or given another role."""
    more = turn["truncated"].cast("bigint") * TRUNCATED
    stays = ~turn["must_go"]
    gone = lambda k: _plus(a[k], DELETE, "D")

    def stay(before: Column, role: str) -> Column:
        same = turn["initial"] == role
        return F.when(stays, _plus(before, more + F.when(same, 0).otherwise(REROLE), F.when(same, "K").otherwise("R")))

    system = F.when(stays & (turn["initial"] == "s"), _plus(a["n"], more, "K"))
    return F.struct(
        gone("n").alias("n"), F.least(gone("s"), system).alias("s"),
        F.least(gone("u"), stay(F.least(a["n"], a["s"], a["a"]), "u")).alias("u"), F.least(gone("a"), stay(a["u"], "a")).alias("a"),
    )


STATE = "struct<c:bigint,t:string>"


def cheapest(turns: Column) -> Column:
    """(c, t): the cost and the audit of the cheapest edits of these turns (array of structs with initial, must_go, truncated)."""
    none = F.lit(None).cast(STATE)
    start = F.struct(F.struct(F.lit(0).cast("bigint").alias("c"), F.lit("").alias("t")).cast(STATE).alias("n"), none.alias("s"), none.alias("u"), none.alias("a"))
    step = lambda a, x: F.transform(F.array(_inserted(a)), lambda b: _step(b, x))[0]
    return F.aggregate(turns, start, step, lambda a: F.transform(F.array(_inserted(a)), lambda b: F.least(b["n"], b["a"]))[0])


def edited(turns: Column, audit: Column) -> Column:
    """The repaired turns, as ``role:text``.

    Legal orders of one length have one sequence of initials (an odd length starts with a
    system turn), so the audit says which role an insertion or a change gives.
    """
    edits = F.regexp_extract_all(audit, F.lit("I*[DKR]"), F.lit(0))  # one for each turn
    new = F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))
    inserted = lambda e: F.array_repeat(new, F.length(e) - F.length(F.replace(e, F.lit("I"), F.lit(""))))

    def one(e: Column, k: Column) -> Column:
        turn, letter = turns[k], F.right(e, F.lit(1))
        role = F.when(letter == "K", turn["role"])
        own = F.when(letter == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), turn["text"].alias("text"))))
        return F.concat(inserted(e), own)

    rows = F.concat(F.flatten(F.transform(edits, one)), inserted(F.regexp_extract(audit, "I*$", 0)))
    odd = lambda r: F.size(r) % 2
    said = lambda r: F.transform(r, lambda x, k: F.concat(F.coalesce(x["role"], F.when((k + odd(r)) % 2 == 0, "user").otherwise("assistant")), F.lit(":"), x["text"]))
    return F.transform(F.array(rows), said)[0]


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of ``rows`` (conv_id, turn, role, text, and gone for rows that are not there): its faults and its cheapest repair.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), audit
    and repaired (array of ``role:text``). Turns stand in the order of turn, null
    first, ties by role and text. A turn's first fault counts: blank (nothing but
    white space), duplicate (its role and text stand earlier), truncated (its last
    character that is no white space is none of ``.!?``). A null conv_id is one
    conversation. Roles go by their first character; one that is none of s, u and a
    can't be kept. Null roles and texts are read as empty. A conversation with no
    turns has zeros, an empty audit and no repaired turns. Other columns are
    ignored; an empty table gives no rows.

    The turns of one conversation are one row of the result, so they meet in one
    task; that is as much as one string can hold.
    """
    rows = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("gone") if "gone" in rows.columns else F.lit(False).alias("gone"),
    )
    # One shuffle by conversation serves both windows and the collection.
    rows = rows.repartition("conv_id")
    along = Window.partitionBy("conv_id", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "seen")
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("seen", seen).withColumns({"place": F.row_number().over(along), "before": F.lag(initial).over(along), "initial": initial})
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    duplicate = ~blank & F.col("seen")
    truncated = ~blank & ~F.col("seen") & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    rows = rows.withColumns({"blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal})
    stays = ~F.col("gone")
    count = lambda c: F.count_if(stays & F.col(c)).alias(c)
    turn = F.when(stays, F.col("turn"))
    known = F.struct("place", "role", "text", "initial", (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated")
    per = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"),
        count("blank"), count("duplicate"), count("truncated"), count("illegal"), F.array_sort(F.collect_list(F.when(stays, known))).alias("turns"),
    )
    per = per.withColumn("best", cheapest(F.col("turns")))
    return per.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.c").alias("cost"), F.col("best.t").alias("audit"), edited(F.col("turns"), F.col("best.t")).alias("repaired"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults and the cheapest repair of every conversation, after damage."""
    out = repair(damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))


#: DuckDB has no crc32; its table follows from the polynomial.
ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t FROM range(256) r(n)),
k AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS b FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) % 20 AS d FROM k, tab),
r AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS x FROM h),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM r),
f AS (SELECT conv_id, turn, role, text, left(role, 1) AS i, row_number() OVER w AS n, lag(left(role, 1)) OVER w AS p, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    seen, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
g AS (SELECT conv_id, turn, role, text, i, n, blank, NOT blank AND seen AS dup, NOT blank AND NOT seen AND cut AS trunc, coalesce((p || i) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM f),
steps AS (SELECT conv_id, n, blank OR dup AS must, CASE WHEN trunc THEN 5 ELSE 0 END AS more, i FROM g),
-- The edits of one more turn, all at once: st is the state before (0 nothing, 1 system, 2 user, 3 assistant), at most two insertions, then the turn.
ins(st, pre, c, x) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
best AS (SELECT DISTINCT conv_id, 0 AS n, 0 AS st, 0::BIGINT AS c, '' AS x FROM conversations
    UNION ALL (
    WITH moves AS (
        SELECT b.conv_id, s.n, e.st, b.c + ins.c + e.c AS c, b.x || ins.x || e.x AS x FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.n = b.n + 1 JOIN ins ON ins.st = b.st,
        LATERAL (SELECT unnest([{st: ins.pre, c: 2, x: 'D', ok: true},
            {st: 1, c: s.more, x: 'K', ok: NOT s.must AND s.i = 's' AND ins.pre = 0}, {st: 2, c: s.more, x: 'K', ok: NOT s.must AND s.i = 'u' AND ins.pre <> 2},
            {st: 3, c: s.more, x: 'K', ok: NOT s.must AND s.i = 'a' AND ins.pre = 2}, {st: 2, c: s.more + 1, x: 'R', ok: NOT s.must AND ins.pre <> 2}, {st: 3, c: s.more + 1, x: 'R', ok: NOT s.must AND ins.pre = 2}]) AS m) l(m),
        LATERAL (SELECT m.st AS st, m.c AS c, m.x AS x, m.ok AS ok) e WHERE e.ok)
    SELECT conv_id, n, st, c, x FROM moves QUALIFY row_number() OVER (PARTITION BY conv_id, n, st ORDER BY c, x) = 1)),
last AS (SELECT b.conv_id, b.c + ins.c AS cost, b.x || ins.x AS audit FROM best b JOIN ins ON ins.st = b.st AND ins.pre IN (0, 3)
    LEFT JOIN (SELECT conv_id, max(n) AS m FROM g GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.n = coalesce(z.m, 0)
    QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.c + ins.c, b.x || ins.x) = 1),
e AS (SELECT conv_id, a, k, count(*) FILTER (a <> 'I') OVER w AS n, count(*) FILTER (a <> 'D') OVER w AS o, count(*) FILTER (a <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd
    FROM (SELECT conv_id, unnest(string_split(audit, '')) AS a, unnest(range(length(audit))) AS k FROM last WHERE audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (SELECT e.conv_id, sha256(string_agg(CASE a WHEN 'K' THEN g.role ELSE CASE WHEN (o - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE a WHEN 'I' THEN '' ELSE g.text END, chr(10) ORDER BY o)) AS h
    FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.n = e.n WHERE a <> 'D' GROUP BY e.conv_id),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (illegal) AS illegal FROM g GROUP BY conv_id)
SELECT last.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM last LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM last.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM last.conv_id
"""
