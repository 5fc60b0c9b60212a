"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Each language has one model over the letters of a word and the word's edges. A
text's language is that of the lowest cross-entropy per symbol. The n-grams lie
as 64-bit hashes in sorted arrays, one for each order, beside their discounted
probabilities; contexts lie likewise beside their back-off weights. A word's
score is a sum over its own symbols, so each distinct word is scored once and
remembered.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remembers, table

ORDER = 5
#: Labelled documents of a language that the models are fitted on, about: all if there are fewer.
SAMPLE = 1_000
#: Of the sample, the share kept apart to calibrate confidence and rejection.
APART = 0.2
#: A text is rejected if its cross-entropy is above the mean of its language's calibration texts
#: by this many standard deviations of a text of its length; by SLACK bits a symbol at least, and
#: whatever the deviations by MOST bits and SHORT more divided by the symbols of the text.
DEVIATIONS = 6.0
SLACK = 1.0
MOST = 1.75
SHORT = 8.0
REMEMBERED = 400_000
UNKNOWN = "und"

LETTERS = re.compile(r"[^\W\d_]+")
EDGE = 0x110000  # one past the last code point
FACTOR = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts): every word's code points with an edge before and after."""
    lengths = np.fromiter(map(len, words), "int64", len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 2)])
    out = np.full(starts[-1], EDGE, "uint64")
    inner = np.ones(starts[-1], bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    out[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, starts


def gram_hashes(s: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0..order: the hash of the n symbols that end at each place; near the start, of fewer."""
    out = [np.full(len(s), 7, "uint64")]
    for _ in range(order):
        before = np.concatenate([[np.uint64(7)], out[-1][:-1]])
        out.append(mixed((before + np.uint64(1)) * np.uint64(FACTOR) + s))
    return out


@dataclass
class Model:
    """For n = 1..order: sorted n-gram hashes and their discounted probabilities; sorted context hashes and back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    def log2(self, hashes: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """log2 of each symbol's probability; ``depth``: how many symbols of its word lie before it."""
        p = np.full(len(depth), self.floor)
        for n, ((keys, values), (ckeys, weights)) in enumerate(zip(self.grams, self.contexts, strict=True), 1):
            here = depth >= n - 1
            context = np.concatenate([[np.uint64(0)], hashes[n - 1][:-1]]) if n > 1 else hashes[0]
            at = np.minimum(np.searchsorted(ckeys, context), len(ckeys) - 1)
            known = here & (ckeys[at] == context)
            i = np.minimum(np.searchsorted(keys, hashes[n]), len(keys) - 1)
            seen = np.where(keys[i] == hashes[n], values[i], 0.0)
            p = np.where(known, seen + weights[at] * p, p)
        return np.log2(p)


def fit(words: Counter, order: int = ORDER) -> Model:
    """The model of a language's words with their counts."""
    names = sorted(words)
    s, starts = symbols(names)
    count = np.repeat(np.array([words[w] for w in names], "int64"), np.diff(starts))
    depth = np.arange(len(s)) - np.repeat(starts[:-1], np.diff(starts))
    hashes = gram_hashes(s, order)
    # Of every order: the distinct n-grams with their counts, their contexts and the shorter n-grams that they extend.
    tables = []
    for n in range(1, order + 1):
        full = (depth >= n - 1) & (depth > 0)  # the first edge is given, not predicted
        keys, first, back = np.unique(hashes[n][full], return_index=True, return_inverse=True)
        context = (np.concatenate([[np.uint64(0)], hashes[n - 1][:-1]]) if n > 1 else hashes[0])[full][first]
        tables.append((keys, np.bincount(back, count[full]), context, hashes[n - 1][full][first]))
    grams, contexts = [], []
    for n, (keys, counts, context, _) in enumerate(tables, 1):
        if n < order:  # continuation counts: in how many (n+1)-grams an n-gram ends; words' first symbols have no longer ones
            longer = tables[n][3]
            ext, times = np.unique(longer, return_counts=True)
            at = np.minimum(np.searchsorted(ext, keys), len(ext) - 1)
            counts = np.where(ext[at] == keys, times[at], np.minimum(counts, 1)).astype(float)
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
        ckeys, back = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(back, counts), np.bincount(back)
        grams.append((keys, (counts - discount) / total[back]))
        contexts.append((ckeys, discount * kinds / total))
    return Model(grams, contexts, 1 / (len(tables[0][0]) + 1))


class Scorer:
    """The bits of a text's words in each language."""

    def __init__(self, models: list[Model], order: int):
        self.models, self.order = models, order
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.bits = np.empty((1024, len(self.models) + 1))

    def learn(self, words: list[str]) -> None:
        s, starts = symbols(words)
        sizes = np.diff(starts)
        depth = np.arange(len(s)) - np.repeat(starts[:-1], sizes)
        hashes = gram_hashes(s, self.order)
        told = np.where(depth > 0, 1.0, 0.0)
        n, k = len(self.at), len(words)
        while n + k > len(self.bits):
            self.bits = np.concatenate([self.bits, np.empty_like(self.bits)])
        for j, m in enumerate(self.models):
            self.bits[n : n + k, j] = -np.add.reduceat(m.log2(hashes, depth) * told, starts[:-1])
        self.bits[n : n + k, -1] = sizes - 1
        self.at.update(zip(words, range(n, n + k), strict=True))

    def words(self, words: list[str]) -> np.ndarray:
        """The rows of these words in ``bits``."""
        try:
            return np.fromiter(map(self.at.__getitem__, words), "int64", len(words))
        except KeyError:
            new = set(words).difference(self.at)
            if len(self.at) + len(new) > REMEMBERED:
                self.forget()
                new = set(words)
            self.learn(sorted(new))
            return np.fromiter(map(self.at.__getitem__, words), "int64", len(words))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """For each text the bits in each language and the number of symbols, 0 without letters.

        Words are looked up some 200,000 at a time, of several texts or of part of one.
        """
        out = np.zeros((len(texts), len(self.models) + 1))
        words, spans = [], []

        def add_up() -> None:
            if words:
                at = self.words(words)  # may grow the table
                bits = self.bits[at]
                np.add.at(out, [i for i, _ in spans], np.add.reduceat(bits, [k for _, k in spans], 0))
                words.clear()
                spans.clear()

        for i, text in enumerate(texts):
            for some in word_runs((text or "").lower()):
                if some:
                    spans.append((i, len(words)))
                    words += some
                if len(words) > RUN:
                    add_up()
        add_up()
        return out


RUN = 200_000


def word_runs(text: str) -> Iterator[list[str]]:
    """The words of a text in lists of bounded length."""
    if len(text) < 10 * RUN:
        yield LETTERS.findall(text)
    else:
        found = (m.group() for m in LETTERS.finditer(text))
        while some := list(islice(found, RUN)):
            yield some


@dataclass
class Identifier:
    """The fitted models with what calibration found. A value of some megabytes: the sample bounds it."""

    langs: list[str]
    models: list[Model]
    order: int
    mean: list[float]  # of the cross-entropy of a language's calibration texts
    deviation: list[float]  # of sqrt(symbols) * (cross-entropy - mean)
    sharpness: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def judge(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the language or -1, cross-entropy, confidence, whether accepted)."""
        n = bits[:, -1]
        some = n > 0
        x = bits[:, :-1] / np.maximum(n, 1)[:, None]
        best = np.argmin(x, 1)
        least = x[np.arange(len(x)), best]
        # Bits of a text aren't independent: sharpness scales them so that confidence is right as often as it says.
        gap = (x - least[:, None]) * np.sqrt(np.maximum(n, 1))[:, None] * self.sharpness
        sure = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
        over = least - np.array(self.mean)[best]
        limit = np.clip(DEVIATIONS * np.array(self.deviation)[best] / np.sqrt(np.maximum(n, 1)), SLACK, MOST + SHORT / np.maximum(n, 1))
        return np.where(some, best, -1), least, np.where(some, sure, 0.0), some & (over <= limit)


def calibrate(langs: list[str], models: list[Model], order: int, texts: list[tuple[str, str]]) -> Identifier:
    """``texts``: (lang, text) that the models haven't seen."""
    bits = Scorer(models, order).texts([t for _, t in texts])
    truth, n = np.array([langs.index(lang) for lang, _ in texts], int), bits[:, -1]
    some = n > 0
    x = bits[:, :-1] / np.maximum(n, 1)[:, None]
    mean, deviation = [], []
    for k in range(len(langs)):
        mine = some & (truth == k)
        v, m = x[mine, k], n[mine]
        mean.append(float(np.median(v)) if len(v) else 0.0)
        deviation.append(float(np.sqrt(np.mean((v - mean[-1]) ** 2 * m))) if len(v) else math.inf)
    found = Identifier(langs, models, order, mean, deviation, 1.0)
    losses = {}
    if some.any():
        for c in 2.0 ** np.arange(-6, 7):
            gap = (x - x.min(1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None] * c
            p = np.exp2(-np.minimum(gap, 1000))
            p = (p / p.sum(1, keepdims=True))[np.arange(len(x)), truth]
            losses[c] = -np.log(np.maximum(p[some], 1e-6)).mean()
        found.sharpness = float(min(losses, key=losses.get))
    return found


def train(labelled: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> Identifier | None:
    """Fits on about ``sample`` texts of each language of ``labelled`` (text, lang), chosen by a hash of the text.

    Rows without text or lang are left out, and texts of a language that are alike
    count once, in the rate of the choice too. The hash keeps the choice alike in
    every run. A part of the texts is kept apart for calibration, but never the only one of a language. Words are counted on the executors; the driver gets the distinct
    words of the sample. None if there is no labelled row.
    """
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = F.pmod("h", F.lit(1 << 40)) / (1 << 40)
    limit = F.lit(None).cast("double")
    for lang in langs:
        limit = F.when(F.col("lang") == lang, sample / counts[lang]).otherwise(limit)
    # Copies of a drawn text go on the map side.
    chosen = rows.withColumn("u", share).where(F.col("u") < limit).groupBy("lang", "h").agg(F.min("text").alias("text"))
    # One text of each language is always fitted, so that none is lost to the calibration.
    first = chosen.groupBy("lang").agg(F.min("h").alias("first"))
    chosen = chosen.join(F.broadcast(first), "lang")  # a row for each language
    apart = (F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1000)) < 1000 * APART) & (F.col("h") != F.col("first"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in LETTERS.findall(text.lower()))
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in keys], "string"), "word": pa.array([w for _, w in keys], "string"), "n": pa.array([seen[k] for k in keys], "int64")})

    told = chosen.where(~apart).select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    words: dict[str, Counter] = {lang: Counter() for lang in langs}
    found = told.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    for lang, word, n in zip(*(found[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        words[lang][word] = n
    langs = [lang for lang in langs if words[lang]]
    models = [fit(words[lang], order) for lang in langs]
    texts = [(r["lang"], r["text"]) for r in chosen.where(apart).select("lang", "text").collect() if r["lang"] in langs]
    return calibrate(langs, models, order, texts) if langs else None


_scorers: dict[str, Scorer] = {}


def scorer_of(model: Identifier) -> Scorer:
    """The worker's scorer of this model: what it remembers serves the worker's later tasks too."""
    remembers("language_id", _scorers.clear)
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = Scorer(model.models, model.order)
    return _scorers[model.key]


def identify(docs: DataFrame, model: Identifier | None, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score, cross_entropy and accepted to the columns ``keep`` (all) of ``docs``, which has text.

    A null text, one without letters, and any text if nothing could be learned:
    und, score 0, cross_entropy null, not accepted. Columns of ``docs`` with those
    names are replaced. Texts are read whole, however long; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    new = {"lang_pred": (pa.string(), T.StringType()), "score": (pa.float64(), T.DoubleType()), "cross_entropy": (pa.float64(), T.DoubleType()), "accepted": (pa.bool_(), T.BooleanType())}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = docs.select(F.col("text").cast("string").alias("_tm_text"), *kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = b.column(0).to_pylist()
            if m:
                best, x, sure, fine = m.judge(scorer_of(m).texts(texts))
                tags = [m.langs[k] if k >= 0 else UNKNOWN for k in best]
                found = [tags, sure, [v if k >= 0 else None for k, v in zip(best, x, strict=True)], fine]
            else:
                found = [[UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [False] * len(texts)]
            columns = [pa.array(v, t) for v, (t, _) in zip(found, new.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns], names=[*kept, *new])

    schema = T.StructType([*(f for f in rows.schema.fields[1:]), *(T.StructField(n, t) for n, (_, t) in new.items())])
    return rows.mapInArrow(score, schema)


def held_out(of: int, which: int):
    """Whether the CRC-32 of doc_id as text leaves ``which`` when divided by ``of``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == which


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(5, 0)).select("text", "lang"))
    rows = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    return identify(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")
