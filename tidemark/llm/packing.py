"""Packing: documents as token ids, cut to pieces and packed into sequences by first-fit decreasing.

A document longer than a sequence is cut into full sequences and a rest. The
rests are dealt at random into groups, and each group is packed on its own:
longest piece first, into the first sequence with room, which a tournament tree
over the room left in each sequence finds in logarithmic time.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cut, remembers, table

CAPACITY = 4096
#: Appended to each document.
END = 2
#: Pieces in a group, about: large enough that the one sequence with room at its end weighs little.
GROUP = 4096
#: Words that a Python worker remembers the ids of; it forgets all of them when there are more.
REMEMBERED = 600_000

#: The normaliser and the pre-tokenizer, as a tokenizer file states them, under which a
#: text's ids are those of its words, and neither a plain capital nor a sign at a word's end matters.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: What stands after SPLIT where the model alone gives a plain word's ids: its bytes written as BYTES.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The character that stands for each byte: itself where it prints, else one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b if b in _PRINTED else 256 + k for k, b in enumerate([*_PRINTED, *sorted(set(range(256)) - set(_PRINTED))], -len(_PRINTED))}
#: A plain word, made small: letters that neither the normaliser nor SPLIT changes.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Signs that SPLIT cuts from a word's end.
SIGNS = ".,;:!?|"
#: Full sequences are numbered from here on, the others below.
FULL = 1 << 62

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def by_words(said: dict) -> bool:
    """Whether a tokenizer, as its file states it, has the normaliser and the cuts that reading word by word takes for granted."""
    pre = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    plain = said["truncation"] is None and said["padding"] is None and not any(set(" \t\r\n") & set(t["content"]) for t in said["added_tokens"])
    return plain and (said["normalizer"] or {}).get("normalizers") == NORMALIZERS and pre[0] == SPLIT


class WordIds:
    """Ids of whole texts.

    A tokenizer that is known to cut at white space (``by_words``) gives a text the
    ids of its words one after another, so the ids of a word are computed once and
    remembered. Words are cut at space, tab and line ends only; any other white
    space stays inside and the tokenizer cuts there itself. Any other tokenizer
    reads whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered, self.ids = Tokenizer.from_file(path), remembered, {"": b""}
        said = json.loads(self.tokenizer.to_str())
        self.whole, self.model = not by_words(said), self.tokenizer.model
        letters = any(t["content"].isalpha() for t in said["added_tokens"])
        self.plain = not self.whole and not letters and said["pre_tokenizer"]["pretokenizers"][1:] == [BYTE_LEVEL] and not said["model"].get("dropout")
        self.signs = {c: array("I", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes() for c in SIGNS}

    def words(self, text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def learn(self, words: set[str]) -> None:
        """Remembers the words: plain ones from the model alone, with a sign at the end or without, the others as the tokenizer reads them."""
        if len(self.ids) + 2 * len(words) > self.remembered:
            self.ids = {"": b""}
        ids, others, plain, tokenize = self.ids, [], self.plain, self.model.tokenize
        for w in words:
            if w in ids:
                continue
            sign = w[-1] if w[-1] in SIGNS else ""
            head = (w[:-1] if sign else w).lower()
            if not plain or not PLAIN.fullmatch(head):
                others.append(w)
                continue
            known = ids.get(head)
            if known is None:
                said = head if head.isascii() else head.encode().decode("latin-1").translate(BYTES)
                known = ids[head] = array("I", [t.id for t in tokenize(said)]).tobytes()
            ids[w] = known + self.signs[sign] if sign else known
        for k in range(0, len(others), 10_000):
            some = others[k : k + 10_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids[w] = array("I", e.ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.whole:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, out = self.words(text), []
        for k in range(0, len(words), 100_000):
            some = words[k : k + 100_000]
            try:
                out += map(self.ids.__getitem__, some)
            except KeyError:
                del out[k:]
                self.learn(set(some))
                out += map(self.ids.__getitem__, some)
        return b"".join(out)


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    remembers("packing", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The documents' pieces of at most ``capacity`` ids; with_ids adds the ids themselves as binary.

    ``docs`` has doc_id and text. Null and empty texts give one piece with the
    end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer or tokenizer_path())
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("ids", pa.binary())] * with_ids)
        stop = np.uint32(end).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.encode(text.as_py() or "") + stop
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), n) + ((part,) if with_ids else ()))
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE + ", ids binary" * with_ids)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, given in the order of placing: the first bin with room."""
    size = 1
    while size < len(lengths):
        size *= 2
    room = [capacity] * (2 * size)
    bins, offsets = [], []
    for n in lengths:
        k = 1
        while k < size:
            k *= 2
            if room[k] < n:
                k += 1
        bins.append(k - size)
        offsets.append(capacity - room[k])
        room[k] -= n
        while k > 1:
            k //= 2
            a, b = room[2 * k], room[2 * k + 1]
            room[k] = a if a > b else b
    return bins, offsets


def pack(parts: DataFrame, group: int = GROUP, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``parts``, a table on disk: a full piece is a sequence, the others are packed in random groups.

    The groups have about ``group`` pieces each, however many full ones there are.
    A group is chosen by a hash of the piece and its place in the table, so a
    retried task deals alike and repeated rows don't meet in one group. Pieces
    alike in length follow doc_id, start and checksum; sequences are numbered
    within their group, the group in the upper 32 bits.
    """

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit(t["length"].to_pylist(), capacity)
        first = t["_tm_group"][0].as_py() << 32
        t = t.append_column("sequence_id", pa.array(first + np.array(bins, "int64"))).append_column("offset", pa.array(np.array(offsets, "int64")))
        return t.drop_columns(["_tm_group"])

    rests, place = parts.where(F.col("length") < capacity), F.monotonically_increasing_id()
    groups = max(1, round(rests.count() / group))
    dealt = rests.withColumn("_tm_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", place), F.lit(groups)))
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    full = parts.where(F.col("length") == capacity).select("*", (place + FULL).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return full.unionByName(dealt.groupBy("_tm_group").applyInArrow(fill, schema))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group: int = GROUP, with_ids: bool = False, cut: Cut | None = None) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text), each with its sequence and offset there.

    Every row counts, repeated ones too; a null or empty text is the end id alone;
    a very long text is mostly full pieces, which pass by the packing. An empty
    table gives no pieces. The pieces are written once, so no text is read twice.
    """
    cut = cut or Cut(docs.sparkSession, "packing")
    return pack(cut(pieces(docs, tokenizer, capacity, with_ids=with_ids)), group, capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), cut=Cut(spark, "op6"))
