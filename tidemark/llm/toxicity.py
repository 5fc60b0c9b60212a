"""Toxicity by a weighted finite-state grammar over the clauses of a text.

A lexicon gives words their classes: insult, threat, target, negation, reporting
verb. Small transducers read the classes of a clause, two from its end and five
from its start, each set composed into one machine. They put out a weight for each
matched insult or threat: less where it is denied, before or at the end of the
clause, or reported, in speech with or without quotation marks; more where it has a
target; none for a threat without one. A text's score follows from the weights of
its matched clauses.

The lexicon has a few seeds; the rest of the insults are stems learned from
labelled texts, as are the weights of the arcs and the step from clause weights to
a probability.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cut, remembers, table
from .language_id import held_out

#: Labelled documents of each class that the lexicon and the scale are learned from, about.
SAMPLE = 3_000
#: Words up to this length and their beginnings from 3 to 8 letters are patterns to learn.
LONGEST = 24
STEM = range(3, 9)
#: A learned pattern is this many times likelier in a toxic text than in another, at least.
TIMES = 5.0
#: Patterns of a toxic text that count as explained by those chosen before.
DEPTH = 3
THRESHOLD = 0.3
REMEMBERED = 500_000

WORDS = re.compile(r"[^\W\d_]+")
TOKENS = re.compile(r"[^\W\d_]+|[.!?;:|\n\"“”«»„]")

SEEDS = {
    "insult": "idiot moron stupid loser scum worthless pathetic disgusting imbecile bastard dumbass arschloch trottel vollidiot connard imbécile salaud gilipollas imbécil pendejo",
    "target": "you your you're yours he she they him her them du dich dir ihr euch sie er tu toi te vous il elle ils elles tú usted ustedes él ella ellos",
    "negation": "not no never isn aren wasn don doesn without nicht kein keine niemals pas jamais ni sin nunca jamás",
    "report": "said says say wrote writes claimed called calls quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó",
}
#: Threats as stems with the endings that they take.
THREATS = (
    ("kill murder hurt threaten", ("", "s", "ed", "ing")), ("strangl destroy", ("", "e", "es", "s", "ed", "ing")), ("stab", ("", "s", "bed", "bing")),
    ("töt ermord erstech", ("en", "e", "est", "et", "ete")), ("umbring", ("en", "e", "st", "t")),
    ("tu étrangl frapp", ("er", "e", "es", "ez", "ent", "é", "erai", "era")), ("mat golpe", ("ar", "o", "as", "a", "an", "aré", "ará")),
)
SYMBOL = {"insult": "I", "threat": "H", "target": "T", "negation": "N", "report": "R"}
#: Marks that open or close what is quoted.
QUOTES = '"“”«»„'

#: What a matched insult or threat weighs times its word's weight, before labels are seen.
DENIED, REPORTED, TARGETED, THREAT_WEIGHT = 0.5, 0.6, 1.5, 4.0


class Arcs(NamedTuple):
    """The weights of the arcs that have one; the others' is 1."""

    denied: float = DENIED
    reported: float = REPORTED
    targeted: float = TARGETED
    threat: float = THREAT_WEIGHT


#: With primes for weights, the product of a match tells which arcs it took, and how often.
PATHS = Arcs(2, 3, 5, 7)
#: Spread of an arc's logarithm around that of its weight above, and the least and greatest it can become.
SPREAD, BOUNDS = 0.5, (1 / 8, 8.0)
#: Words between an insult or threat and the negation that ends its clause, at most.
REACH = 4


class Transducer:
    """A deterministic transducer: arcs from (state, symbol) to (state, symbol put out, weight)."""

    def __init__(self, start):
        self.start, self.arcs = start, {}

    def arc(self, state, symbol, to, out, weight=1.0):
        self.arcs[state, symbol] = to, out, weight

    def compose(self, other: Transducer) -> Transducer:
        """Reads what this one reads, puts out what the other puts out for this one's output; weights multiply."""
        both = Transducer((self.start, other.start))
        symbols, todo, seen = {x for _, x in self.arcs}, [both.start], {both.start}
        while todo:
            a, b = todo.pop()
            for x in symbols:
                if (a, x) in self.arcs:
                    to, mid, w = self.arcs[a, x]
                    after, out, v = other.arcs[b, mid]
                    both.arc((a, b), x, (to, after), out, w * v)
                    if (to, after) not in seen:
                        seen.add((to, after))
                        todo.append((to, after))
        return both


def negation(denied: float = DENIED) -> Transducer:
    """Denies an insult or threat within three words after a negation."""
    t = Transducer(0)
    for s in range(4):
        for x in "oTR":
            t.arc(s, x, max(s - 1, 0), x)
        t.arc(s, "Q", s, "Q")
        t.arc(s, "N", 3, "o")
        for x in "IH":
            t.arc(s, x, max(s - 1, 0), x, denied if s else 1.0)
    return t


def reported(reported: float = REPORTED) -> Transducer:
    """Lowers what follows a reporting verb: what it quotes if a quotation follows, else the rest of the clause.

    States: nothing said, said, in a quotation that was announced, in any other.
    """
    t = Transducer("none")
    for state, at_quote in (("none", "other"), ("said", "quoted"), ("quoted", "none"), ("other", "none")):
        for x in "oT":
            t.arc(state, x, state, x)
        t.arc(state, "R", "said" if state in ("none", "said") else state, "o")
        t.arc(state, "Q", at_quote, "o")
        for x in "IH":
            t.arc(state, x, state, x, reported if state in ("said", "quoted") else 1.0)
    return t


def denied_later(denied: float = DENIED) -> Transducer:
    """Reads a clause from its end: denies an insult or threat a few words before a negation that ends the clause."""
    t = Transducer("end")
    for state in ("end", *range(REACH + 1)):
        left = 0 if state == "end" else state
        for x in "oTRQ":
            t.arc(state, x, max(left - 1, 0) if x != "Q" else state, x)
        t.arc(state, "N", REACH if state == "end" else max(left - 1, 0), "N")
        for x in "IH":
            t.arc(state, x, max(left - 1, 0), x, denied if left else 1.0)
    return t


def reported_later(reported: float = REPORTED) -> Transducer:
    """Reads a clause from its end: lowers what is quoted before a reporting verb."""
    t = Transducer("none")
    for state, at_quote in (("none", "other"), ("said", "quoted"), ("quoted", "none"), ("other", "none")):
        for x in "oTN":
            t.arc(state, x, state, x)
        t.arc(state, "R", "said" if state in ("none", "said") else state, "R")
        t.arc(state, "Q", at_quote, "Q")
        for x in "IH":
            t.arc(state, x, state, x, reported if state == "quoted" else 1.0)
    return t


def target() -> Transducer:
    """Marks an insult that follows a target as aimed (A), a threat that a target follows within four words (K) at that target."""
    t = Transducer((0, 0))
    for seen in (0, 1):
        for wait in range(5):
            t.arc((seen, wait), "o", (seen, max(wait - 1, 0)), "o")
            t.arc((seen, wait), "T", (1, 0), "K" if wait else "o")
            t.arc((seen, wait), "I", (seen, max(wait - 1, 0)), "A" if seen else "I")
            t.arc((seen, wait), "H", (seen, 4), "o")
    return t


def insult(targeted: float = TARGETED) -> Transducer:
    """Weighs aimed and other insults and passes the rest on."""
    t = Transducer(0)
    t.arc(0, "o", 0, "o")
    t.arc(0, "K", 0, "K")
    t.arc(0, "I", 0, "hit")
    t.arc(0, "A", 0, "hit", targeted)
    return t


def threat(threat: float = THREAT_WEIGHT) -> Transducer:
    """Weighs threats with a target."""
    t = Transducer(0)
    t.arc(0, "o", 0, "")
    t.arc(0, "hit", 0, "hit")
    t.arc(0, "K", 0, "threat", threat)
    return t


def plain(symbols: str, out: str | None = None) -> Transducer:
    """Passes every symbol on as it is, or those of ``out`` as themselves and the rest as o."""
    t = Transducer(0)
    for x in symbols:
        t.arc(0, x, 0, x if out is None or x in out else "o")
    return t


def machine(without: str = "", arcs: Arcs = Arcs()) -> tuple[Transducer, Transducer]:
    """(the one that reads a clause from its end, the one that reads it from its start); ``without`` leaves a part out, to see what it adds."""
    back = plain("oTNRQIH") if without == "negation" else denied_later(arcs.denied)
    if without != "reported":
        back = back.compose(reported_later(arcs.reported))
    found = plain("oTRQNIH", "oTRQIH") if without == "negation" else negation(arcs.denied)
    found = found.compose(plain("oTRQIH", "oTIH") if without == "reported" else reported(arcs.reported))
    for t in (plain("oTIH", "oI") if without == "target" else target(), insult(arcs.targeted), threat(arcs.threat)):
        found = found.compose(t)
    return back, found


def patterns(word: str) -> list[str]:
    """The patterns that fit a word: its beginnings, and itself if it isn't long. A beginning ends with an asterisk."""
    return [word[:k] + "*" for k in STEM if k <= len(word)] + [word] * (len(word) <= LONGEST)


@dataclass
class Lexicon:
    """Words and stems with their symbols and weights, and the arcs' weights. The sample bounds its size."""

    entries: dict[str, tuple[str, float]]
    arcs: Arcs = Arcs()
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def look_up(self, word: str) -> tuple[str, float] | None:
        """The entry of the word itself or of its longest stem."""
        return next((self.entries[p] for p in reversed(patterns(word)) if p in self.entries), None)


def seeds() -> dict[str, tuple[str, float]]:
    found = {stem + end: (SYMBOL["threat"], 2.0) for stems, ends in THREATS for stem in stems.split() for end in ends}
    return found | {w: (SYMBOL[kind], 2.0) for kind, words in SEEDS.items() for w in words.split()}


class Grammar:
    """Scores texts; remembers the entries of words."""

    def __init__(self, lexicon: Lexicon, without: str = ""):
        self.lexicon, (self.back, self.machine) = lexicon, machine(without, lexicon.arcs)
        self.known: dict[str, tuple[str, float] | None] = {}

    def entry(self, word: str):
        if word not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known = {}
            self.known[word] = self.lexicon.look_up(word)
        return self.known[word]

    def heavy(self, text: str) -> bool:
        """Whether any word is an insult or a threat: only then can a clause match."""
        found = (m.group() for m in WORDS.finditer(text)) if len(text) > 2_000_000 else iter(WORDS.findall(text))
        while some := list(islice(found, 200_000)):
            try:
                got = {self.known[w] for w in set(some)}
            except KeyError:
                got = {self.entry(w) for w in set(some)}
            if any(e and e[0] in "IH" for e in got):
                return True
        return False

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(weight of the heaviest clause, of all clauses, number of matched clauses)."""
        text = (text or "").lower()
        if not self.heavy(text):
            return 0.0, 0.0, 0.0
        found = [w for w in map(self.weight, self.clauses(text)) if w]
        return max(found, default=0.0), sum(found, 0.0), float(len(found))

    def found(self, text: str | None) -> Iterator[tuple[float, float]]:
        """matches() of all clauses of a text."""
        text = (text or "").lower()
        if self.heavy(text):
            for clause in self.clauses(text):
                yield from self.matches(clause)

    def clauses(self, text: str) -> Iterator[list[tuple[str, float]]]:
        """The symbols and weights of each clause that can match.

        A clause ends at a sign or a line end. Signs inside a quotation don't end it,
        nor does a colon before one.
        """
        clause: list[tuple[str, float]] = []
        heavy = quoted = colon = False
        for m in TOKENS.finditer(text):
            word = m.group()
            if colon and word not in QUOTES:
                if heavy:
                    yield clause
                clause, heavy = [], False
            colon = word == ":" and not quoted
            if colon:
                continue
            if word[0].isalpha():
                e = self.entry(word) or ("o", 0.0)
                clause.append(e)
                heavy |= e[0] in "IH"
            elif word in QUOTES:
                clause.append(("Q", 0.0))
                quoted = not quoted
            elif word == "\n" or not quoted:
                if heavy:
                    yield clause
                clause, heavy, quoted = [], False, False
        if heavy:
            yield clause

    def matches(self, clause: list[tuple[str, float]]) -> Iterator[tuple[float, float]]:
        """(weight of the word, 1 for a threat; product of the arcs taken) of each insult and threat that matches."""
        state, factors = self.back.start, []
        for symbol, _ in reversed(clause):
            state, _, factor = self.back.arcs[state, symbol]
            factors.append(factor)
        state, waiting = self.machine.start, 1.0
        for (symbol, weight), later in zip(clause, reversed(factors), strict=True):
            state, out, factor = self.machine.arcs[state, symbol]
            if symbol == "H":
                waiting = later * factor  # a threat counts where its target follows
            if out == "hit":
                yield weight, factor * later
            elif out == "threat":
                yield 1.0, factor * waiting

    def weight(self, clause: list[tuple[str, float]]) -> float:
        return sum((weight * factor for weight, factor in self.matches(clause)), 0.0)


_grammars: dict[str, Grammar] = {}


def grammar_of(lexicon: Lexicon) -> Grammar:
    remembers("toxicity", _grammars.clear)
    if lexicon.key not in _grammars:
        _grammars.clear()
        _grammars[lexicon.key] = Grammar(lexicon)
    return _grammars[lexicon.key]


def likelihood_ratio(a: float, b: float, n: float, m: float) -> float:
    """G2 of a of n toxic texts against b of m others."""
    def part(x: float, e: float) -> float:
        return x * math.log(x / e) if x > 0 else 0.0

    p = (a + b) / (n + m)
    return 2 * (part(a, n * p) + part(b, m * p) + part(n - a, n * (1 - p)) + part(m - b, m * (1 - p)))


def learn_stems(sample: DataFrame) -> dict[str, tuple[str, float]]:
    """Insult words and stems from ``sample`` (text, toxic), by a greedy cover of the toxic texts.

    A pattern is a candidate if its G2 passes a bound that grows with the number
    of patterns tried (Bonferroni) and it is TIMES likelier in toxic texts. The
    candidates are then chosen one by one, by the G2 of the toxic texts that those
    chosen before haven't explained; a word counts for the first chosen
    pattern that fits it. So words that merely come with an insult aren't chosen.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic == 1].update({p for w in set(WORDS.findall((text or "").lower())) for p in patterns(w)})
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"p": pa.array(keys, "string"), "pos": pa.array([seen[1][k] for k in keys], "int64"), "neg": pa.array([seen[0][k] for k in keys], "int64")})

    per = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, m = per.get(1, 0), per.get(0, 0)
    if not n or not m:
        return {}
    counts = sample.select("text", "toxic").mapInArrow(count, "p string, pos bigint, neg bigint").groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    likely = (F.col("pos") >= 3) & (F.col("pos") * m >= TIMES * n * F.col("neg"))
    rows = counts.where(likely).select("p", "pos", "neg").collect()
    bound = 2 * math.log(max(len(rows), 100)) + 4
    fit = {r["p"]: (r["pos"], r["neg"]) for r in rows if likelihood_ratio(r["pos"], r["neg"], n, m) >= bound}
    if not fit:
        return {}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [[w for w in sorted(set(WORDS.findall((t or "").lower()))) if any(p in fit for p in patterns(w))] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"words": pa.array(words, pa.list_(pa.string()))})

    texts = [set(r["words"]) for r in sample.where("toxic = 1").select("text").mapInArrow(match, "words array<string>").collect()]
    of_word = {w: [p for p in patterns(w) if p in fit] for t in texts for w in t}
    holders, docs_of = defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for w in t:
            docs_of[w].add(i)
            for p in of_word[w]:
                holders[p].add(w)
    explained, chosen = [0] * len(texts), {}
    while holders:
        news = {p: len({i for w in ws for i in docs_of[w] if explained[i] < DEPTH}) for p, ws in holders.items()}
        gain = {p: likelihood_ratio(k, fit[p][1], n, m) if k * m > n * fit[p][1] else 0.0 for p, k in news.items()}
        best = max(gain, key=lambda p: (gain[p], len(p.rstrip("*")), not p.endswith("*"), p))
        if gain[best] < bound:
            break
        pos, neg = fit[best]
        chosen[best] = "I", min(6.0, math.log((pos + 0.5) / (n + 1) * (m + 1) / (neg + 0.5)))
        mine = holders.pop(best)
        for i in {i for w in mine for i in docs_of[w]}:
            explained[i] += 1
        for p in list(holders):
            holders[p] -= mine
            if not holders[p]:
                del holders[p]
    return chosen


def arcs_taken(path: float) -> list[int]:
    """How often each arc of PATHS was taken, from the product."""
    left, times = round(path), []
    for prime in PATHS:
        k = 0
        while left % prime == 0:
            left, k = left // prime, k + 1
        times.append(k)
    return times


def fit_arcs(seen: list[tuple[float, float, int, int]], toxic: int, others: int) -> Arcs:
    """The arcs' weights from (path, word weight, toxic texts, other texts).

    A word's weight is the log of how much likelier it is in toxic texts, so a match
    adds that times its arcs to the log odds of its text. The logarithms of the arcs' weights
    are fitted so, each drawn to the one it has without labels (SPREAD); what the
    labels say nothing of stays as it is.
    """
    start = np.log(np.array(Arcs()))
    if not seen or not toxic or not others:
        return Arcs()
    x = np.array([arcs_taken(r[0]) for r in seen], float)
    w, pos, neg = np.array([r[1:] for r in seen], float).T
    low, high = np.log(BOUNDS)
    theta = start.copy()
    for _ in range(200):
        j = (w * np.exp(x @ theta))[:, None] * x
        p = 1 / (1 + np.exp(-np.clip(math.log(toxic / others) + w * np.exp(x @ theta), -30, 30)))
        g = j.T @ ((pos + neg) * p - pos) + (theta - start) / SPREAD**2
        h = (j * ((pos + neg) * p * (1 - p))[:, None]).T @ j + np.eye(len(theta)) / SPREAD**2
        step = np.clip(np.linalg.solve(h, g), -0.25, 0.25)
        theta = np.clip(theta - step, low, high)
        if np.abs(step).max() < 1e-9:
            break
    return Arcs(*np.exp(theta).tolist())


def learn_arcs(sample: DataFrame, lexicon: Lexicon) -> Arcs:
    """The arcs' weights from the matches in ``sample`` (text, toxic); a text counts once for each path and word weight."""
    held = sample.sparkSession.sparkContext.broadcast(Lexicon(lexicon.entries, PATHS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, seen = grammar_of(held.value), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update({(path, round(w, 2), toxic) for w, path in grammar.found(text)})
        rows = [(path, w, n if toxic == 1 else 0, n if toxic == 0 else 0) for (path, w, toxic), n in seen.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("path", "w", "pos", "neg"), columns, ("double", "double", "int64", "int64"), strict=True)})

    found = sample.select("text", "toxic").mapInArrow(count, "path double, w double, pos bigint, neg bigint")
    # A row for each path and word weight: at most as many as the lexicon has weights, for each of a few dozen paths.
    rows = found.groupBy("path", "w").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    per = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return fit_arcs(sorted(map(tuple, rows)), per.get(1, 0), per.get(0, 0))


@dataclass
class Judge:
    """The lexicon with the weights of the features."""

    lexicon: Lexicon
    beta: list[float]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-design(features) @ np.array(self.beta)))


def design(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), np.minimum(f[:, 0], 20) / 4, np.log1p(f[:, 1]), np.log1p(f[:, 2])])


#: Without labels.
UNLEARNED = [-4.0, 2.0, 1.0, 0.5]


def fit_scale(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method with a ridge; ``weight`` restores the classes' true shares."""
    x, b = design(features), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        g = x.T @ (weight * (p - toxic)) + 0.5 * np.r_[0, b[1:]]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.5, 0.5, 0.5])
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return b.tolist()


def featured(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with most, total and matched of its text."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col("text").cast("string").alias("_tm_text"), *keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = grammar_of(held.value)
        for b in batches:
            found = np.array([grammar.features(t.as_py()) for t in b.column(0)], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(found[:, k]) for k in range(3))], names=[*keep, "most", "total", "matched"])

    schema = T.StructType([*rows.schema.fields[1:], *(T.StructField(n, T.DoubleType()) for n in ("most", "total", "matched"))])
    return rows.mapInArrow(each, schema)


def train(docs: DataFrame, labels: DataFrame, cut: Cut, sample: int = SAMPLE) -> Judge:
    """Learns from about ``sample`` labelled documents of each class, chosen by a hash of doc_id.

    ``labels`` has doc_id and toxic (0 or 1; others, and null ids, are left out). A
    document that is labelled several times counts once, as toxic if any label says so;
    so the chosen ids are about as many as ``sample`` says, whatever the rows, and are
    broadcast. Texts that are alike count once.
    """
    said = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    said = cut(said.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    per = {r["toxic"]: r["n"] for r in said.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)
    limit = F.when(F.col("toxic") == 1, sample / max(per.get(1, 0), 1)).otherwise(sample / max(per.get(0, 0), 1))
    ids = said.where(share < limit)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    rows = cut(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("toxic").alias("toxic")))
    lexicon = Lexicon(seeds() | learn_stems(rows))
    lexicon = Lexicon(lexicon.entries, learn_arcs(rows, lexicon))
    found = sorted(map(tuple, featured(rows, lexicon, ["doc_id", "toxic"]).collect()))
    toxic = np.array([r[1] for r in found], float)
    if not len(found) or toxic.min() == toxic.max():
        return Judge(lexicon, UNLEARNED)
    weight = np.where(toxic == 1, max(1.0, per[1] / sample), max(1.0, per[0] / sample))
    return Judge(lexicon, fit_scale(np.array([r[2:] for r in found]), toxic, weight))


def score(docs: DataFrame, judge: Judge, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score, predicted and matched (clauses) of its text.

    A row for each row: repeated ones score alike. Null and empty texts match
    nothing; a very long text is read clause by clause.
    """
    rows = featured(docs, judge.lexicon, keep)
    b = judge.beta
    z = b[0] + b[1] * F.least(F.col("most"), F.lit(20.0)) / 4 + b[2] * F.log1p("total") + b[3] * F.log1p("matched")
    return rows.withColumn("score", 1 / (1 + F.exp(-z))).select(*keep, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("matched").cast("bigint").alias("matched"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of those not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(4, 2))
    judge = train(docs, labels, Cut(spark, "op7"))
    return score(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), judge, ["doc_id", "held_out"])
