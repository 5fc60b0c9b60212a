"""The parts of the operators against brute force."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, embedding_dedup, fingerprints, language_id, line_dedup, minhash_dedup, mixing, packing, sharding, toxicity, url_filter
from tidemark.llm.common import Cut, blocks, bucket_of, with_rank


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours_touch(spark, dims, bits):
    n = 1 << bits
    cells = [(F.floor(F.col("id") / n**k) % n).cast("int").alias(f"c{k}") for k in range(dims)]
    d = spark.range(n**dims).select(*cells)
    rows = sorted(tuple(r) for r in d.select(sharding.hilbert_index([F.col(f"c{k}") for k in range(dims)], bits), *d.columns).collect())
    assert [r[0] for r in rows] == list(range(n**dims))
    assert all(sum(abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_curve_prunes_shards_in_every_dimension(spark):
    d = spark.range(6400).select("id", (F.col("id") % 8).alias("a"), (F.floor(F.col("id") / 8) % 8).alias("b"))
    out = sharding.shard_by_curve(d, ["a", "b"], ["id"], shards=16, bits=3).groupBy("shard").agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b")).collect()
    assert len(out) == 16 and max(r.a for r in out) <= 3 and max(r.b for r in out) <= 3


def test_bucket_of(spark):
    cuts = [1, 3, 7, 7 + 2**40]
    values = [None, -5, 1, 2, 3, 6, 7, 2**50]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v bigint").select(bucket_of("v", cuts).alias("b")).collect()]
    assert got == [sum(c <= v for c in cuts) if v is not None else 0 for v in values]


def test_cells_of_discrete_values(spark):
    """Against brute force: no cell is empty between others, values keep their order, the cells span all coordinates."""
    for values, bits in (([k % 8 for k in range(6400)], 3), ([k % 3 for k in range(90)], 5), ([7] * 50 + list(range(50)), 3), ([None, 4, 4, None], 2), ([5], 4)):
        d = spark.createDataFrame([(v,) for v in values], "v int")
        got = {r.v: r.c for r in d.select("v", sharding.cell(d, "v", bits).alias("c")).distinct().collect()}
        known = sorted(v for v in got if v is not None)
        cells = [got[v] for v in known]
        assert cells == sorted(cells) and got.get(None, 0) == 0 == cells[0]
        if len(known) <= 1 << bits and len(values) == len(known) * values.count(known[0]):
            assert cells == [k * (1 << bits) // len(known) for k in range(len(known))]
        assert max(cells) >= (1 << bits) * (len(set(cells)) - 1) // len(set(cells))
        full = [sum(1 for x in values if x is not None and got[x] == c) for c in set(cells)]
        assert max(full) <= 2 * max([values.count(v) for v in known] + [-(-len(values) // (1 << bits))])


def test_rank_with_ties(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = {(r.k, r.id): r.r for r in with_rank(d, "k", ["id"], "r").collect()}
    assert [got[x] for x in sorted(got)] == list(range(500))


def test_blocks_meet_in_pairs(spark):
    d = spark.range(100).select((F.col("id") % 2).alias("key"), "id").unionAll(spark.createDataFrame([(9, 9)], "key bigint, id bigint"))
    rows = blocks(d, ["key"], "id", 8).collect()
    met = {(r.key, x.id, r.id) for r in rows for x in rows if (r.key, r.i, r.j) == (x.key, x.i, x.j) and x.id < r.id}
    assert met == {(k, a, b) for k in (0, 1) for b in range(k, 100, 2) for a in range(k, b, 2)}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)] * 3 + [(2000, x) for x in range(2001, 2200)]
    at = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                at[a] = at[b] = min(at[a], at[b])
    got = {r.node: r.component_id for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), Cut(spark, "t")).collect()}
    assert got == at
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), Cut(spark, "t")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 65, 300])
def test_winnow_takes_the_rightmost_least(n):
    h = np.random.default_rng(n).integers(0, 9, n).astype(np.uint64)
    want = []
    for i in range(max(1, n - 63) if n else 0):
        w = h[i : i + 64]
        j = i + max(k for k, v in enumerate(w) if v == w.min())
        if want[-1:] != [j]:
            want.append(j)
    assert fingerprints.winnow(h).tolist() == want


def test_shared_run_is_found_in_both_texts():
    rng = np.random.default_rng(1)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    run = text(fingerprints.K + fingerprints.W - 1)
    a, b = text(200) + run + text(90), text(77) + run + text(300)
    (ha, pa), (hb, pb) = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
    places = {(int(x) - 200) for x, h in zip(pa, ha, strict=True) if h in set(hb.tolist())} & {int(x) - 77 for x, h in zip(pb, hb, strict=True) if h in set(ha.tolist())}
    assert places
    h, p = fingerprints.unpacked(fingerprints.packed(ha, pa))
    assert (h == ha).all() and (p == pa).all()


def test_edited_copy_of_a_short_text_is_seen():
    rng = np.random.default_rng(12)
    text = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    prints = lambda t: np.unique(fingerprints.fingerprint(t)[0])
    for n in range(36, 200):  # two thirds are a run of 23 at least
        a, other = text(n), text(n)
        assert fingerprints.likeness(prints(a), prints(fingerprints.edit(a, other))) > 0 == fingerprints.likeness(prints(a), prints(other))


def test_rolling_hash_depends_on_the_gram_alone():
    code = fingerprints.points("abcdefgh" * 20)
    h = fingerprints.gram_hashes(code)
    assert (h[:50] == h[8:58]).all() and len(set(h[:8].tolist())) == 8


def test_language_model_is_a_distribution():
    model = language_id.fit(Counter({"banana": 3, "bandana": 2, "nab": 5, "cab": 1}))
    letters = "abcdn"
    for head in ("", "b", "ban", "cabna"):
        total = 0.0
        for last in [*letters, "\x00"]:
            s, _ = language_id.symbols([head + (last if last != "\x00" else "")])
            at = len(head) + 1
            total += 2 ** model.log2(language_id.gram_hashes(s, language_id.ORDER), np.arange(len(s)))[at]
        assert total == pytest.approx(1 - 0 * model.floor, abs=0.06)


def plain_kneser_ney(words, order):
    """log2 of each symbol of a word by interpolated Kneser-Ney over tuples in dictionaries."""
    edged = {w: ("<", *w, "<") for w in words}
    grams = [Counter() for _ in range(order + 1)]
    for w, n in words.items():
        s = edged[w]
        for i in range(1, len(s)):
            for k in range(1, order + 1):
                if i >= k - 1:
                    grams[k][s[i - k + 1 : i + 1]] += n
    counts = [None]
    for k in range(1, order + 1):
        if k < order:
            longer = Counter(g[1:] for g in grams[k + 1])
            counts.append({g: longer.get(g, 1) for g in grams[k]})
        else:
            counts.append(dict(grams[k]))
    discount, total, kinds = [0.0], [None], [None]
    for k in range(1, order + 1):
        ones, twos = (sum(c == x for c in counts[k].values()) for x in (1, 2))
        discount.append(min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95))
        total.append(Counter())
        kinds.append(Counter())
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1

    def score(word):
        s, out = ("<", *word, "<"), []
        for i in range(1, len(s)):
            p = 1 / (len(counts[1]) + 1)
            for k in range(1, order + 1):
                context = s[i - k + 1 : i]
                if i >= k - 1 and total[k][context]:
                    p = max(counts[k].get((*context, s[i]), 0) - discount[k], 0) / total[k][context] + discount[k] * kinds[k][context] / total[k][context] * p
            out.append(np.log2(p))
        return out

    return score


def test_language_model_is_that_of_plain_kneser_ney():
    rng = np.random.default_rng(31)
    words = Counter({"".join(rng.choice(list("abcde"), rng.integers(1, 9))): int(rng.integers(1, 6)) for _ in range(300)})
    model, score = language_id.fit(words), plain_kneser_ney(words, language_id.ORDER)
    for w in [*list(words)[:60], "abcdeabcde", "zz", "azb", "e"]:
        s, _ = language_id.symbols([w])
        got = model.log2(language_id.gram_hashes(s, language_id.ORDER), np.arange(len(s)))[1:]
        assert got == pytest.approx(score(w), abs=1e-9)


def test_unknown_languages_and_scripts_are_rejected(spark):
    rng = np.random.default_rng(33)
    parts = {"aa": ["ba", "to", "ri", "nel", "sa", "mo"], "bb": ["kek", "zu", "pli", "gro", "wax", "ny"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(n))
    model = language_id.train(spark.createDataFrame([(lang, text(lang, 60)) for lang in parts for _ in range(200)], "lang string, text string"))
    known = [text(lang, n) for lang in parts for n in (2, 3, 8, 40, 400)]
    strange = ["私は今日学校に行きます", "日本", "Καλημέρα κόσμε", "Быстрая лиса", "Быстрая коричневая лиса прыгает " * 30, "שלום עולם", "uhq jfvd cyqh uvjj " * 4, "il cheudu voff hiddj " * 100]
    got = language_id.identify(spark.createDataFrame([(k, t) for k, t in enumerate(known + strange)], "k int, text string"), model).collect()
    assert {r.k for r in got if r.accepted} == set(range(len(known)))
    assert all(r.lang_pred == ("aa" if r.k < 5 else "bb") for r in got if r.k < len(known))


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    """A language of few texts with many copies is learned whole; a text with many of the rows is one of the sample."""
    texts = lambda lang, n: [(lang, f"{lang} some words and " + "".join(chr(97 + int(d)) for d in f"{k:03}") + f"q{lang}") for k in range(n)]
    rows = texts("aa", 10) * 200 + texts("bb", 400) + texts("bb", 20) * 100
    given = {}
    monkeypatch.setattr(language_id, "fit", lambda words, order: words)
    monkeypatch.setattr(language_id, "calibrate", lambda langs, models, order, apart: given.update(langs=langs, models=models, apart=apart))
    language_id.train(spark.createDataFrame(rows, "lang string, text string"), sample=100)
    assert given["langs"] == ["aa", "bb"] and len(given["apart"]) == len(set(given["apart"]))
    drawn = {lang: m["words"] + sum(x == lang for x, _ in given["apart"]) for lang, m in zip(given["langs"], given["models"], strict=True)}
    assert drawn["aa"] == 10 and 60 <= drawn["bb"] <= 140


def test_scorer_does_not_depend_on_the_order_of_words():
    model = language_id.fit(Counter({"banana": 3, "bandana": 2, "nab": 5}))
    a, b = language_id.Scorer([model], language_id.ORDER), language_id.Scorer([model], language_id.ORDER)
    assert a.texts(["nab banana x", None, "é banana"])[0] == pytest.approx(b.texts(["q", "banana x nab"])[1])
    assert a.texts([None, "", "12 !"]).tolist() == [[0, 0]] * 3


def test_first_fit():
    rng = np.random.default_rng(2)
    for lengths in ([], [4096], sorted(rng.integers(1, 4097, 500).tolist(), reverse=True)):
        bins, offsets = packing.first_fit(lengths, 4096)
        room: list[int] = []
        for n, b, o in zip(lengths, bins, offsets, strict=True):
            k = next((k for k, r in enumerate(room) if r >= n), len(room))
            if k == len(room):
                room.append(4096)
            assert (b, o) == (k, 4096 - room[k])
            room[k] -= n


def test_word_ids_are_those_of_the_whole_text():
    w = packing.WordIds(packing.tokenizer_path(), remembered=40)
    for t in ("", "  ", "a\x1cb c d", "I'll they've It's.", "ΣΑΣ ΟΔΟΣ x", "é ́x  ̸", "<|endoftext|>a b", "\x85x\x0by", "İstanbul ẞ, ÉCOLE.", "日本 語　x", "a\r\n\tb", "Ab. Ab, Ab; ab! AB? x|"):
        assert np.frombuffer(w.encode(t), "<u4").tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids


def test_a_cased_tokenizer_reads_whole_texts(tmp_path):
    with open(packing.tokenizer_path()) as f:
        said = json.load(f)
    said["normalizer"]["normalizers"] = said["normalizer"]["normalizers"][:2]  # no lower case
    (tmp_path / "cased.json").write_text(json.dumps(said))
    w, small = packing.WordIds(str(tmp_path / "cased.json")), packing.WordIds(packing.tokenizer_path())
    assert w.whole and not small.whole
    for t in ("", "Ab cd. EF", "It's A\nb"):
        assert np.frombuffer(w.encode(t), "<u4").tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids
    assert w.encode("Ab") != small.encode("Ab")


def test_full_pieces_pass_by_the_packing(spark):
    docs = spark.createDataFrame([(1, "a " * 1000), (2, "b " * 39), (2, "b " * 39), (None, None)], "doc_id bigint, text string")
    out = packing.pack_documents(docs, capacity=64, group=3, with_ids=True).collect()
    assert sum(r.length == 64 for r in out) == 15 and len(out) == 19 and all(len(r.ids) == 4 * r.length for r in out)
    full = [r for r in out if r.length == 64]
    assert len({r.sequence_id for r in full}) == 15 and all(r.sequence_id >= packing.FULL and r.offset == 0 for r in full)
    used: dict[int, list] = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64


def test_ranges_of_fingerprints_do_not_change_them(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"text number {i} " * (i % 7)) for i in range(200)] + [(None, "x" * 50), (None, None), (7, None)], "doc_id bigint, text string")
    order = ["doc_id", "n_chars", "edited_sha256"]
    want = sorted(map(str, fingerprints.against_next(docs).select(*order, "near_edited", "near_next").collect()))
    monkeypatch.setattr(fingerprints, "ROWS", 3)
    assert sorted(map(str, fingerprints.against_next(docs).select(*order, "near_edited", "near_next").collect())) == want and len(want) == 203


def test_grammar():
    def weight(text):
        lexicon = toxicity.Lexicon(toxicity.seeds())
        return toxicity.Grammar(lexicon).features(text)[1]

    plain, aimed = weight("an idiot"), weight("you idiot")
    assert plain == 2.0 and aimed == pytest.approx(plain * toxicity.TARGETED)
    assert weight("you are not an idiot") == pytest.approx(aimed * toxicity.DENIED)
    assert weight("he said an idiot") == pytest.approx(aimed * toxicity.REPORTED)
    assert weight("not here. an idiot") == plain  # a clause ends what a negation denies
    assert weight("kill time") == 0 and weight("kill you") == toxicity.THREAT_WEIGHT
    assert weight("a nice day for you") == weight("") == 0


def test_grammar_of_speech_and_later_negation():
    def weight(text, without=""):
        return toxicity.Grammar(toxicity.Lexicon(toxicity.seeds()), without).features(text)[1]

    aimed, plain = 2.0 * toxicity.TARGETED, 2.0
    assert weight('"you idiot", he said') == weight('"You idiot!" he said.') == weight('she wrote: "you idiot!"') == pytest.approx(aimed * toxicity.REPORTED)
    assert weight('he said "hello" to you idiot') == pytest.approx(aimed)  # after what he said
    assert weight('an "idiot"') == plain  # quoted, but nobody says it
    assert weight("ein trottel bist du nicht") == pytest.approx(plain * toxicity.DENIED)
    assert weight("the idiot did not come") == plain  # this negation doesn't end the clause
    assert weight("he kills you") == weight("I am killing them") == weight("mataré a ellos") == toxicity.THREAT_WEIGHT
    assert weight("I will not kill you") == pytest.approx(toxicity.THREAT_WEIGHT * toxicity.DENIED)
    assert weight('"I will kill you", she said') == pytest.approx(toxicity.THREAT_WEIGHT * toxicity.REPORTED)
    assert weight('"unclosed you idiot\nstill an idiot') == pytest.approx(aimed + plain)


def test_each_part_of_the_grammar_adds_something():
    """Right decisions on clauses apart from those that it was written by, with a part left out and with none."""
    toxic = ["you moron", "du arschloch", "he is pathetic and you are scum", "she said hello. you bastard", "we will strangle him", "I destroy you", "tu es un connard", "je vais te tuer toi", "vosotros y tú gilipollas"]
    clean = [
        "you are not a loser", "he never was stupid", "du bist kein vollidiot", "ein idiot ist er nicht", 'he called: "you are a bastard"', '"du trottel", sagte sie', "she wrote that he is a moron",
        "the word idiot is greek", "they destroy old houses", "kill the process", "a stab in the dark, no more", "not one stupid question from you",
    ]

    def right(without):
        g = toxicity.Grammar(toxicity.Lexicon(toxicity.seeds()), without)
        return sum(g.features(t)[0] >= 2.5 for t in toxic) + sum(g.features(t)[0] < 2.5 for t in clean)

    full = right("")
    assert full == len(toxic) + len(clean)
    assert all(right(part) < full for part in ("negation", "reported", "target"))


def test_machines_are_those_of_their_parts_one_after_another():
    """The composed machine against reading the same symbols by its parts in turn, over all clauses of five symbols."""
    from itertools import product

    def read(t, symbols):
        state, out, weights = t.start, [], []
        for x in symbols:
            state, y, w = t.arcs[state, x]
            out.append(y)
            weights.append(w)
        return out, np.array(weights)

    _, whole = toxicity.machine()
    parts = [toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.insult(), toxicity.threat()]
    for clause in product("oTRQNIH", repeat=5):
        symbols, weights = list(clause), np.ones(5)
        for t in parts:
            symbols, w = read(t, symbols)
            weights = weights * w
        got, w = read(whole, clause)
        assert got == symbols and np.allclose(w, weights)


def test_the_product_of_primes_is_the_path():
    """Every clause of six symbols: the weight is the word's times the arcs that the primes name, as often as they name them."""
    from itertools import product

    lexicon = toxicity.Lexicon({}, toxicity.Arcs(0.3, 0.7, 1.9, 2.5))
    weigh, name = toxicity.Grammar(lexicon), toxicity.Grammar(toxicity.Lexicon({}, toxicity.PATHS))
    taken = set()
    for symbols in product("oTRQNIH", repeat=6):
        clause = [(x, 2.0) for x in symbols]
        paths = [(w, toxicity.arcs_taken(path)) for w, path in name.matches(clause)]
        taken |= {tuple(t) for _, t in paths}
        assert weigh.weight(clause) == pytest.approx(sum(w * np.prod(np.array(lexicon.arcs) ** t) for w, t in paths))
    assert all(any(t[k] for t in taken) for k in range(4))


def test_arcs_are_learned(spark):
    """Where labels say that denied insults are harmless and aimed ones are not, the arcs follow; without evidence they stay."""
    docs = [(f"you are an idiot, number {k}", 1) for k in range(200)] + [(f"this is not an idiot, number {k}", 0) for k in range(200)]
    sample = spark.createDataFrame(docs + [(f"a quiet day number {k}", 0) for k in range(200)], "text string, toxic int")
    lexicon = toxicity.Lexicon(toxicity.seeds())
    got = toxicity.learn_arcs(sample, lexicon)
    assert got.denied < toxicity.DENIED / 2 and got.targeted > toxicity.TARGETED
    assert got.reported == pytest.approx(toxicity.REPORTED) and got.threat == pytest.approx(toxicity.THREAT_WEIGHT)
    contrary = [(f"this is not an idiot, number {k}", 1) for k in range(200)] + [(f"a quiet day number {k}", 0) for k in range(200)]
    assert toxicity.learn_arcs(spark.createDataFrame(contrary, "text string, toxic int"), lexicon).denied > toxicity.DENIED
    assert toxicity.learn_arcs(sample.where("text like 'a quiet%'"), lexicon) == toxicity.learn_arcs(sample.limit(0), lexicon) == toxicity.Arcs()


def test_stems_are_learned(spark):
    rows = [(f"some vorble{x} talk number {k}", 1) for k, x in enumerate(["a", "en", "ing", "ed"] * 20)] + [(f"some plain talk number {k} vore", 0) for k in range(300)]
    found = toxicity.learn_stems(spark.createDataFrame(rows, "text string, toxic int"))
    assert any("vorblex".startswith(p.rstrip("*")) for p in found) and not any("vore".startswith(p.rstrip("*")) and p != "vore" for p in found)


def test_decode_lists_all_directions_above_the_height():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    first, second = embedding_dedup.codebook(24, 64, 1)
    for v, got in zip(x, embedding_dedup.decode(x, 64, 4, 1), strict=True):
        scores = ((v @ first)[:, None] + v @ second).ravel()
        assert len(got) >= 4 and set(got - 64 * 64) == set(np.flatnonzero(scores >= np.sort(scores)[-4] - 1e-12))


def test_embedding_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 48))
    near = base + rng.normal(size=base.shape) * np.linalg.norm(base, axis=1)[:, None] / 48**0.5 * 0.38
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True)}
    got = {(r.a, r.b) for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), Cut(spark, "t")).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("words", [64, 256, 1024, 4096])
def test_caps_of_near_vectors_meet(words):
    """The recall of the filters at the limit itself, whatever number of codewords the rows ask for."""
    rng = np.random.default_rng(words)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    y = 0.931 * x + (1 - 0.931**2) ** 0.5 * z / np.linalg.norm(z, axis=1)[:, None]
    found = np.zeros(len(x), bool)
    for code in range(embedding_dedup.CODES):
        a, b = (embedding_dedup.decode(v, words, embedding_dedup.caps_for(words), code) for v in (x, y))
        found |= [len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]
    assert found.mean() >= 0.99


def test_degrees_and_components_are_those_of_the_pairs(spark):
    """With vec_ids that stand for several vectors, and rows repeated."""
    rng = np.random.default_rng(23)
    base = rng.normal(size=(30, 24))
    rows = [(int(rng.integers(0, 150)), (base[k % 30] + rng.normal(size=24) * 0.1).tolist(), k % 2) for k in range(240)]
    d = spark.createDataFrame(rows + rows[:5], "vec_id bigint, embedding array<double>, label int")
    pairs = {(r.a, r.b) for r in embedding_dedup.links(d, Cut(spark, "t")).collect()}
    unit = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows]
    assert pairs == {(min(i, j), max(i, j)) for i, v, a in unit for j, w, b in unit if i != j and a == b and v @ w >= 0.93}
    at = {i: i for i, _, _ in rows}
    for _ in range(60):
        for a, b in pairs:
            at[a] = at[b] = min(at[a], at[b])
    degree = Counter(x for p in pairs for x in p)
    for r in embedding_dedup.near_duplicates(d, Cut(spark, "t")).collect():
        assert (r.n_links, r.component_id) == (degree[r.vec_id], at[r.vec_id])


def test_large_bucket_is_compared_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=16)
    rows = [(i, (v + rng.normal(size=16) * 0.02).tolist(), 0) for i in range(90)]
    old, embedding_dedup.BLOCK = embedding_dedup.BLOCK, 16
    try:
        got = embedding_dedup.links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), Cut(spark, "t")).count()
    finally:
        embedding_dedup.BLOCK = old
    assert got == 90 * 89 // 2


def test_intersections_and_forest():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(30)]
    assert (minhash_dedup.intersections(sets) * (1 - np.eye(30)) == [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()
    near = rng.random((40, 40)) < 0.02
    near |= near.T
    a, b = minhash_dedup.forest(near)
    at = np.arange(40)
    for _ in range(40):
        at = np.minimum(at, np.where(near, at, 99).min(1))
    own = np.arange(40)
    own[b] = a
    assert (own == at).all()


def test_tensored_keys_find_near_pairs():
    rng, sketch = np.random.default_rng(8), minhash_dedup.Sketcher(minhash_dedup.HALVES, minhash_dedup.IN_HALF)
    sets = []
    for _ in range(300):
        s = rng.integers(0, 1 << 62, 230).astype(np.uint64)
        sets += [s[:200], s[28:228]]  # 172 of 228: 0.754
    left, right, sig = sketch(sets)
    met = [(left[k] == left[k + 1]).any() and (right[k] == right[k + 1]).any() and (sig[k] == sig[k + 1]).mean() >= minhash_dedup.AGREE for k in range(0, 600, 2)]
    assert np.mean(met) >= 0.99


def test_work_on_a_group_of_near_copies_grows_with_its_size(spark):
    """Of n classes that all link, each is compared with few others on full sets."""
    rng = np.random.default_rng(17)
    base = [f"w{x}" for x in rng.integers(0, 9999, 120)]
    for n in (200, 1600):
        rows = [(k, " ".join([*base[: k % 120], f"edit{k}", *base[k % 120 + 1 :]])) for k in range(n)]
        search = minhash_dedup.Nearest(spark.createDataFrame(rows, "doc_id bigint, text string"), Cut(spark, "t"), 75, minhash_dedup.HALVES)
        assert {r.component_id for r in search.run().collect()} == {0}
        compared = sum(f.count() for f in search.followers) + search.active.count()
        assert n - 1 <= compared <= 2 * n


def test_links_at_the_limit_are_those_of_brute_force(spark):
    """Chains of texts whose neighbours are near the limit on either side, so that no leader links with all."""
    rng = np.random.default_rng(19)
    rows, k = [], 0
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 9999, 70)]
        for _ in range(25):
            rows.append((k, " ".join(words)))
            words, k = [*words[int(rng.integers(5, 12)) :], *(f"w{x}" for x in rng.integers(0, 9999, 8))], k + 1
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    at = list(range(k))
    for _ in range(30):
        for a in range(k):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    at[a] = at[b] = min(at[a], at[b])
        if all(at[x] == at[at[x]] for x in range(k)):
            break
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), Cut(spark, "t")).collect()}
    assert 12 < len(set(at)) < k and got == dict(enumerate(at))


def test_rows_of_one_doc_id_are_joined(spark):
    """By what each of their texts links with, where that id is the smallest of several classes, and where it is not."""
    rng = np.random.default_rng(13)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 9999, 60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(1, a), (1, b), (7, a + " more"), (8, b + " more"), (2, c), (9, c), (9, d), (3, d + " more"), (4, None), (4, e), (5, e), (6, f), (10, f), (10, "")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), Cut(spark, "t")).collect()}
    want = {1: 1, 7: 1, 8: 1, 2: 2, 9: 2, 3: 2, 4: 4, 5: 4, 6: 6, 10: 6}
    assert {i: c for (i, _), (c, _) in got.items()} == want and all(c == want[i] and kept == (c == i) for (i, _), (c, kept) in got.items())


def test_line_windows():
    hashes, n = np.array([5, 3, 9, 3, 7]), np.array([20, 20, 20, 60, 4])
    got = line_dedup.windows(hashes, n, 50)
    assert [at for _, at in got] == [1, 3, 3, 3]
    assert line_dedup.extended(np.array([1, 2, 3, 4]), np.array([9, 2, 3, 4, 5]), 2, 2) == (1, 4)
    assert line_dedup.without("a\n\nb\nc", [(1, 2)])[0] == "a\n\nc"


def plain_line_dedup(docs, least=50):
    """{doc_id: (text, words deleted, repeats of)} of {doc_id: text} without hashes, fingerprints or joins."""
    lines = {i: [x.strip() for x in (t or "").split("\n") if x.split()] for i, t in docs.items()}
    first, out = {}, {}
    window = lambda p, i: next((e for e in range(i + 1, len(p) + 1) if sum(len(x.split()) for x in p[i:e]) >= least), None)
    for d in sorted(docs):
        for i in range(len(lines[d])):
            if e := window(lines[d], i):
                first.setdefault(tuple(lines[d][i:e]), (d, i))
    for d in sorted(docs):
        p, gone, of = lines[d], set(), set()
        for i in range(len(p)):
            e = window(p, i)
            if not e or first[tuple(p[i:e])] == (d, i):
                continue
            o, j = first[tuple(p[i:e])]
            q, s, t = lines[o], i, i
            while s > 0 and s - i + j > 0 and p[s - 1] == q[s - 1 - i + j]:
                s -= 1
            while t < len(p) and t - i + j < len(q) and p[t] == q[t - i + j]:
                t += 1
            if o == d and t - i + j > s:
                s = max(s, window(p, s - 1) or len(p) + 1)
            if s < t:
                gone |= set(range(s, t))
                of.add(o)
        text = docs[d]
        if gone:
            text, _, _ = line_dedup.without(text, [(k, k + 1) for k in gone])
        out[d] = text, sum(len(p[k].split()) for k in gone), sorted(of)
    return out


def lined(spark, docs):
    found = line_dedup.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), Cut(spark, "t")).collect()
    assert all(r.n_lines - r.lines_deleted == (0 if r.text is None else r.text.count("\n") + 1 if r.text or not r.lines_deleted else 0) for r in found)
    return {r.doc.doc_id: (r.text, r.words_deleted, sorted(r.repeats_of)) for r in found}


def test_line_dedup_is_that_of_brute_force(spark):
    rng = np.random.default_rng(21)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 900, rng.integers(1, 30))) for _ in range(60)]
    docs = {0: None, 1: "", 2: "\n \n"}
    for d in range(3, 150):
        own = [f"own {d} {k} " + "x " * int(rng.integers(0, 25)) for k in range(rng.integers(0, 6))]
        start = int(rng.integers(0, 55))
        run = pool[start : start + int(rng.integers(1, 9))] * int(rng.integers(1, 3))
        at = int(rng.integers(0, len(own) + 1))
        docs[d] = "\n".join(own[:at] + run + [""] * int(rng.integers(0, 2)) + own[at:])
    want = plain_line_dedup(docs)
    assert lined(spark, docs) == want and sum(w > 0 for _, w, _ in want.values()) > 30


def test_a_run_does_not_eat_what_it_repeats(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    docs = {1: "\n".join([a] * 10), 2: "\n".join([a] * 3), 3: "\n".join([a, b] * 5), 4: "\n".join([b, a, b])}
    got = lined(spark, docs)
    assert got == plain_line_dedup(docs)
    assert got[1] == ("\n".join([a] * 3), 140, [1]) and got[2] == ("", 60, [1])
    assert got[3] == ("\n".join([a, b, a, b]), 120, [3]) and got[4][1] == 60


def test_fingerprints_are_far_fewer_than_lines():
    rng = np.random.default_rng(5)
    hashes, words = rng.integers(-(1 << 62), 1 << 62, 4000), rng.integers(3, 12, 4000)
    found = line_dedup.fingerprints(hashes, words)
    starts = sum(len(w) for _, _, w in found)
    assert starts > 3900 and len(found) < 0.4 * starts
    assert [at for _, at, _ in found] == sorted({at for _, at, _ in found}) and all(h == hashes[at] for h, at, _ in found)


def test_slots_keep_shares_everywhere(spark):
    goals = spark.createDataFrame([("a", 50_000), ("b", 30_000), ("c", 20_000), (None, 3)], "source string, goal bigint")
    slots, counts = mixing.schedule(goals, 100)
    rows = sorted((r.k, r.source, r.r) for r in slots.collect())
    for end in (100, 500, 1000):
        seen = Counter(s for _, s, _ in rows[:end])
        assert abs(seen["a"] / end - 0.5) < 0.03 and abs(seen["b"] / end - 0.3) < 0.03
    for s in ("a", "b", "c", None):
        assert [r for _, x, r in rows if x == s] == list(range(sum(x == s for _, x, _ in rows)))
    assert {r.source: r.slots for r in counts.collect()}[None] == 1


def farthest(rows, share):
    """By how many words source x strays from its share in any beginning of the rows (source, words)."""
    seen, x, most = 0, 0, 0.0
    for source, n in rows:
        seen, x = seen + n, x + n * (source == "x")
        most = max(most, abs(x - share * seen))
    return most


def test_the_mix_follows_its_schedule(spark, monkeypatch):
    """Every beginning of the mix has the sources in their shares to a few blocks, by the golden ratio and not by another step."""
    docs = spark.createDataFrame([(k, f"w{k} and four more words", "x" if k % 2 else "y", 7) for k in range(3000)], "doc_id bigint, text string, source string, n_chars bigint")
    facts = docs.select("doc_id", "source", F.lit(5).cast("bigint").alias("size"))

    def found():
        return sorted(mixing.mix(facts, Cut(spark, "t"), block=50).where("taken > 0").collect(), key=lambda r: (r.first_slot, r.place))

    def in_order():
        return [(r.source, 5) for r in mixing.mixed_documents(docs, Cut(spark, "t"), block=50).collect()]

    rows, block = found(), 50
    assert {(r.source, round(r.target, 6)) for r in rows} == {("x", round(15000 * 5 / 7, 6)), ("y", round(15000 * 2 / 7, 6))}
    assert len({(r.first_slot, r.place) for r in rows}) == len(rows)  # no two documents start at the same word
    assert farthest(in_order(), 5 / 7) <= 3 * block
    monkeypatch.setattr(mixing, "GOLDEN", 0.0001234)
    assert [(r.doc_id, r.first_slot) for r in found()] != [(r.doc_id, r.first_slot) for r in rows]
    assert farthest(in_order(), 5 / 7) > 10 * block  # blocks that no point meets lie at their own place


def test_mix_counts_repeated_rows(spark):
    rows = [(1, "a b c d", "x", 7)] * 3 + [(2, "e f", "x", 3), (None, "g h", "x", 3), (None, "g h", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    got = Counter(tuple(r) for r in mixing.mixed_documents(docs, Cut(spark, "t")).collect())
    assert got == Counter(rows)  # one source gives all its words once


def test_link_graph(spark):
    pages = spark.createDataFrame([
        (1, "http://bad.net/x", '<a href="http://bad.net/y">'), (2, "http://farm.com/x", '<a href="http://bad.net/y">'), (3, "http://good.org/fr/x", '<A HREF="https://friend.com/">'),
        (4, "http://friend.com/a", ""), (5, "http://alone.com/", None),
    ], "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, Cut(spark, "t")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_hosts_that_link_to_blocked_ones_alone_are_blocked(spark):
    """However many others link there too."""
    bad = lambda k, n: "".join(f'<a href="http://bad{n}x{x}.net/">' for x in range(k))
    pages = [(f"http://farm{k}of{n}x{x}.com/", bad(k, n)) for n in (1, 2, 10, 200) for k in (1, 3) for x in range(n)]
    pages += [(f"http://bad{n}x{x}.net/", "") for n in (1, 2, 10, 200) for x in range(3)]
    links = "".join(f'<a href="http://plain{x}.io/">' for x in range(9))
    pages += [("http://wide.com/", bad(1, 200) + links), ("http://www.sub.com/", bad(1, 200)), ("http://good.org/fr/", links + '<a href="http://known.com/">'), ("http://known.com/", links)]
    rows = [(i, *p) for i, p in enumerate(pages)]
    got = {r.host: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), Cut(spark, "t")).collect()}
    assert {h for h, v in got.items() if v == "allow"} == {"wide.com", "good.org", "known.com"}


def test_tenants_of_a_shared_domain_are_apart(spark):
    """Distrust passes from a host to its siblings through their own domain, not through one that anyone can have a host under."""
    rules = (("block", "bad.mine.com", "/"), ("block", "bad.github.io", "/"))
    urls = [f"http://{name}.{domain}/" for domain in ("mine.com", "github.io") for name in ("bad", "other")]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id bigint, url string, html string")
    edges = {(r.src, r.dst) for r in url_filter.host_edges(pages.select(F.regexp_extract("url", "//([^/]+)", 1).alias("host"), "html")).collect()}
    assert edges == {(a, b) for x in ("bad.mine.com", "other.mine.com") for a, b in ((x, "mine.com"), ("mine.com", x))}
    got = {r.host: r for r in url_filter.judge(pages, Cut(spark, "t"), rules).collect()}
    assert got["other.mine.com"].distrust > 0 == got["other.github.io"].distrust and got["other.github.io"].verdict == "allow"


def test_propagation_is_pagerank(spark):
    rng = np.random.default_rng(11)
    w = (rng.random((6, 6)) < 0.5) * rng.integers(1, 5, (6, 6))
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(str(a), str(b), float(w[a, b]), 1.0) for a, b in zip(*np.nonzero(w), strict=True)], "src string, dst string, weight double, link double")
    t, d = rng.random(6), rng.random(6)
    seeds = spark.createDataFrame([(str(k), float(t[k]), float(d[k])) for k in range(6)], "host string, trust double, distrust double")
    out, into = w / np.maximum(w.sum(1, keepdims=True), 1), (w / np.maximum(w.sum(0, keepdims=True), 1)).T
    x, y = 0.15 * t, 0.15 * d
    for _ in range(5):
        x, y = 0.15 * t + 0.85 * x @ out, 0.15 * d + 0.85 * y @ into
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(seeds, edges, Cut(spark, "t"), rounds=5).collect()}
    for k in range(6):
        assert got[str(k)] == pytest.approx((x[k], y[k]))


def test_small_sources_lie_where_their_words_do(spark):
    """A source smaller than a block is not put at the end of the mix, and the block does not follow the corpus."""
    goals = spark.createDataFrame([("a", 900_000), ("b", 90_000)] + [(f"s{k}", 30) for k in range(40)], "source string, goal bigint")
    slots, counts = mixing.schedule(goals, 1000)
    rows = slots.collect()
    assert {r.source: r.slots for r in counts.collect()} == Counter(r.source for r in rows)
    assert sum(r.slots for r in counts.collect()) == 900 + 90 + 40
    end = max(r.k for r in rows)
    small = [r.k for r in rows if r.source.startswith("s")]
    # Those that a point met lie where it is; the others in the middle, where their own words would.
    assert all(abs(k / end - 0.5) < 0.3 for k in small if k % 2) and sum(k > 0.9 * end for k in small) <= 10


def test_repeated_labels_leave_the_sample_bounded(spark):
    """100,000 repeated rows, and as many with a null id, are no more documents than before."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("you are an idiot and a moron")).otherwise(F.concat(F.lit("a quiet day number "), "id")).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic"))
    many = labels.unionAll(labels.where("doc_id = 7")).unionAll(spark.range(100_000).select(F.lit(None).cast("bigint"), F.lit(1)))
    many = many.unionAll(spark.range(100_000).select(F.lit(9).cast("bigint"), F.lit(1)))
    one, other = toxicity.train(docs, labels, Cut(spark, "t"), 50), toxicity.train(docs, many, Cut(spark, "t"), 50)
    assert np.allclose(one.beta, other.beta)


@pytest.mark.parametrize("k", range(6))
def test_a_language_of_one_text_is_learned(spark, k):
    rows = [("the cat and the dog sat on the mat with a hat " * 3 + f"{i}", "en") for i in range(40)] + [(f"le chat et le chien sont dans la maison avec la souris {k}", "fr")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["en", "fr"]


@pytest.mark.parametrize(("linkers", "trusted"), [(1, 0), (1, 1), (1, 2), (2, 10), (10, 2), (1, 100), (100, 1), (100, 100)])
def test_a_wholly_bad_host_is_blocked_however_many_trusted_hosts_link_to_it(spark, linkers, trusted):
    pages = [(f"http://farm{k}.com/", '<a href="http://bad.net/">') for k in range(linkers)] + [("http://bad.net/", "")]
    pages += [(f"http://good{k}.org/fr/", '<a href="http://farm0.com/"><a href="http://known.io/">') for k in range(trusted)] + [("http://known.io/", '<a href="http://other.io/">')]
    rows = [(i, *p) for i, p in enumerate(pages)]
    got = {r.host: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), Cut(spark, "t")).collect()}
    assert got["farm0.com"] == "block" and got["known.io"] == "allow" and got["bad.net"] == "block"


def test_distrust_alone_changes_a_verdict(spark):
    """One link more to a blocked host, all else alike."""
    page = lambda to: [(1, "http://x.com/", "".join(f'<a href="http://{h}/">' for h in to)), (2, "http://bad.net/", ""), (3, "http://fine.io/", ""), (4, "http://good.org/fr/", '<a href="http://x.com/"><a href="http://fine.io/">')]
    verdict = lambda to: {r.host: r.verdict for r in url_filter.judge(spark.createDataFrame(page(to), "page_id bigint, url string, html string"), Cut(spark, "t")).collect()}["x.com"]
    assert verdict(["fine.io"]) == "allow" and verdict(["bad.net"]) == "block"
