"""Operators 11 to 13: their queries against SQL on odd tables, and against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair, registry, source_audit, substring_dedup
from tidemark.llm.common import Cut


@pytest.mark.parametrize(("name", "table"), [("op11_source_audit", "documents"), ("op12_conversation_repair", "conversations")])
def test_odd_tables_are_those_of_sql(spark, odd, name, table):
    df = registry.QUERIES[name](spark, odd["full"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd['full']}/{table}.parquet/*.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = [tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()]
    got = [tuple(r) for r in df.collect()]
    assert len(got) > 50 and sorted(got, key=repr) == sorted(want, key=repr)


# Operator 11 ---------------------------------------------------------------------------------------------------------
def plain_audit(rows, documents, top):
    docs = [((lang or ""), (source or ""), Counter(re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    groups = sorted({(lang, source) for lang, source, _ in docs})
    out = []
    for lang in {g[0] for g in groups}:
        seen = Counter(t for x, _, c in docs if x == lang for t in c)
        kept = sorted(t for t in seen if seen[t] >= documents)
        total = lambda pick: Counter({t: sum(c[t] for x, s, c in docs if x == lang and pick(s)) for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        counts = {s: total(lambda x, s=s: x == s) for x, s in groups if x == lang}
        p, q = {s: share(c) for s, c in counts.items()}, share(total(lambda x: True))
        for s in counts:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("documents", "top", "block"), [(1, 3, 2), (4, 50, 256), (1000, 5, 256)])
def test_audit_is_that_of_brute_force(spark, documents, top, block):
    rnd = random.Random(documents)
    vocabulary = ["Und", "über", "the", "THE", "a", "1b2c", "é\U0001f600", "x" * 40, *(f"{a}{b}" for a in "abcde" for b in "klmno")]
    rows = [(" ".join(rnd.choice(vocabulary[: 5 + len(vocabulary) * k // 90]) for _ in range(rnd.randrange(60))), rnd.choice(["de", "en", None]), rnd.choice(["s0", "s0", "s0", "s1", "s2", "s3", "s4", None])) for k in range(90)]
    rows += [(None, "fr", "only"), ("", "it", "a"), ("...", "it", None), ("word", "it", ""), rows[0], rows[0]]
    d = spark.createDataFrame(rows, "text string, lang string, source string")
    cut = Cut(spark, "t")
    postings = source_audit.Postings(d, cut, documents)
    pair = {(r.lang, r.source, r.item): r.value for r in source_audit.pairs(postings, cut, block).collect()}
    want = plain_audit(rows, documents, top)
    assert pair == {x[:2] + (x[3],): x[4] for x in want if x[2] == "pair"}
    assert sorted(tuple(r) for r in source_audit.audit(d, cut, documents, top).collect()) == want


def test_bounds_hold_for_every_term(spark):
    rnd = random.Random(3)
    rows = [(" ".join(f"w{'abcdefghij'[min(9, int(rnd.expovariate(0.4)))]}" for _ in range(80)), "en", f"s{k % 5}") for k in range(60)]
    postings = source_audit.Postings(spark.createDataFrame(rows, "text string, lang string, source string"), Cut(spark, "t"), 1)
    terms = postings.rows.withColumn("bucket", source_audit.bucket(F.col("c"))).join(source_audit.bounds(postings), ["lang", "source", "bucket"])
    assert terms.count() == postings.rows.count() and terms.where("p - q > top").count() == 0


# Operator 12 ---------------------------------------------------------------------------------------------------------
def plain_repair(turns):
    """(cost, audit, repaired) of (role, text, must go, truncated) by trying every sequence of edits with up to two insertions between turns."""
    best = None
    options = []
    for role, text, must, cut in turns:
        more = 5 if cut else 0
        options.append([(2, "D", [])] + ([] if must else [(more, "K", [(role, text)]), (1 + more, "R", [("user", text)]), (1 + more, "R", [("assistant", text)])]))
    new = [[], [("user", "")], [("assistant", "")], [("user", ""), ("assistant", "")], [("assistant", ""), ("user", "")]]
    for edits in itertools.product(*options):
        for gaps in itertools.product(new, repeat=len(turns) + 1):
            said = list(gaps[0])
            audit, cost = "I" * len(gaps[0]), 5 * len(gaps[0])
            for (c, letter, out), gap in zip(edits, gaps[1:], strict=True):
                said += out + gap
                audit += letter + "I" * len(gap)
                cost += c + 5 * len(gap)
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, [f"{r}:{t}" for r, t in said]
    return best


def test_repair_is_the_cheapest_of_all_edits(spark):
    rnd = random.Random(12)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", "tool"]), rnd.choice(["a.", "b!", "c", "d?", " "])) for c in range(60) for t in range(c % 4)]
    d = spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string")
    got = {r.conv_id: r for r in conversation_repair.repair(d).collect()}
    for c in range(60):
        seen, turns, faults = set(), [], Counter()
        for _, _, role, text in (r for r in rows if r[0] == c):
            kind = "blank" if not text.strip() else "duplicate" if (role, text) in seen else "truncated" if text[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[kind] += 1
            turns.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
        if not turns:
            assert c not in got
            continue
        cost, audit, said = plain_repair(turns)
        r = got[c]
        assert (r.cost, r.audit, list(r.repaired)) == (cost, audit, said)
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults[k] for k in ("blank", "duplicate", "truncated"))


def test_a_long_conversation_of_legal_turns_stays(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000)]
    r = conversation_repair.repair(spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string")).first()
    assert (r.cost, r.audit, r.gaps, r.illegal) == (0, "K" * 3000, 0, 0) and list(r.repaired) == [f"{x[2]}:{x[3]}" for x in rows]


# Operator 13 ---------------------------------------------------------------------------------------------------------
def plain_substrings(docs, least=50):
    """doc_id -> list of (n_words, n_removed, digest) of its rows."""
    seen, out = defaultdict(lambda: float("inf")), defaultdict(list)
    order = lambda i: float("inf") if i is None else i
    texts = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in texts:
        for k in range(len(w) - least + 1):
            key = tuple(w[k : k + least])
            seen[key] = min(seen[key], order(i))
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - least + 1):
            if seen[tuple(w[k : k + least])] < order(i):
                gone[k : k + least] = [True] * least
        out[i].append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return {i: sorted(x) for i, x in out.items()}


def found_by(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    return {i: sorted(x) for i, x in out.items()}


def test_substrings_of_odd_documents(spark, odd):
    assert found_by(registry.QUERIES["op13_substring_dedup"](spark, odd["full"]).collect()) == plain_substrings([d[:2] for d in odd["docs"]])


def planted(rnd):
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyzé") + str(rnd.randrange(9))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 73, 74, 120, 200)]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rnd.randrange(120))]
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            s = rnd.randrange(0, 30)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p[s : s + rnd.randrange(30, 200)]
        docs.append((rnd.randrange(1000) if i % 9 else None, rnd.choice([" ", "\n", "\t "]).join(w)))
    same = " ".join(["ha"] * 130)
    return docs + [(5, same), (2000, same), (2001, "x " + same + " ha ha"), (2002, None), (2003, ""), (2004, " \n"), docs[3], docs[3], (3000, docs[7][1]), (3001, docs[7][1].replace(" ", "  "))]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_are_those_of_brute_force(spark, seed):
    docs = planted(random.Random(seed))
    out = substring_dedup.repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), Cut(spark, "t")).collect()
    got = defaultdict(list)
    for r in out:
        digest = r.words_sha256 if r.kept is None else hashlib.sha256(r.kept.encode()).hexdigest()
        got[r.doc_id].append((r.n_words, sum(x["to"] - x["from"] for x in r.repeats), digest))
        spans = [(x["from"], x["to"]) for x in r.repeats]
        assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and all(t - s >= 50 for s, t in spans)
    assert {i: sorted(x) for i, x in got.items()} == plain_substrings(docs)


def test_a_repeated_run_shares_a_selected_block():
    """At each offset in both documents a shared run has an anchor that is a block of the one and selected in the other."""
    rnd = random.Random(4)
    word = lambda: rnd.getrandbits(60)
    run = [word() for _ in range(50)]
    for a, b in itertools.product(range(9), range(9)):
        texts = [np.array([word() for _ in range(n)] + run + [word() for _ in range(7)], np.uint64) for n in (a, b)]
        one, two = (set(x.tolist()) for x in substring_dedup.Chunk(texts, 50).anchors())
        assert {k >> 1 for k in one if k & 1} & {k >> 1 for k in two}


def test_documents_do_not_share_a_chunk():
    """What a document's anchors and windows are doesn't depend on what lies beside it."""
    rnd = random.Random(6)
    texts = [np.array([rnd.getrandbits(3) for _ in range(n)], np.uint64) for n in (0, 49, 50, 400, 3, 120)]
    whole = substring_dedup.Chunk(texts, 50)
    alone = [substring_dedup.Chunk([t], 50) for t in texts]
    met = []
    for together, c in zip(whole.anchors(), alone, strict=True):
        assert together.tolist() == c.anchors()[0].tolist()
        met.append(np.stack([together, np.full(len(together), 3)], 1))
    for w, c, m, t in zip(whole.windows(met), alone, met, texts, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(w, c.windows([m])[0], strict=True))
        assert w[2].sum() == max(0, len(t) - 49)  # every window selects an anchor


def test_hot_keys_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, i % 2 == 0, i // 2) for i in range(3000)] + [(7, True, 4000)], "k int, ref boolean, _i bigint")
    rows = docs.select(F.when(F.col("k") % 3 == 0, F.xxhash64(F.lit(1))).otherwise(F.xxhash64(F.col("k") % 500)).alias("key"), "ref", F.col("_i"), F.col("_i").alias("_r"))
    plain = sorted(map(tuple, substring_dedup.met(rows).collect()))
    monkeypatch.setattr(substring_dedup, "HOT", 1 / 64)
    monkeypatch.setattr(substring_dedup, "max", lambda a, b: a, raising=False)
    assert sorted(map(tuple, substring_dedup.met(rows).collect())) == plain
