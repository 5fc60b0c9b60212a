"""A corpus made ready for training: five stages, each one operator over all that the one before kept.

Every stage but the last returns the columns of ``documents``, extra ones
included. Null and empty texts are rejected by the first stage. Texts are read whole,
however long; repeated rows are rows of their own in every stage but near-dedup; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, minhash_dedup, mixing, packing
from tidemark.llm.common import Cut, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; the models are learned from their own lang column.

    Equal texts are judged alike. Null, empty and letterless texts go; if no row has a language, all go.
    """
    model = language_id.train(docs.select("text", "lang"))
    wide = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return language_id.identify(wide, model, ["doc"]).where("accepted").select("doc.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes the later copies of runs of lines; documents of which nothing is left go.

    Earlier documents are those with a lower doc_id, null last, ties by a hash of the text; rows alike in both stay as they are.
    """
    out = line_dedup.deduplicated(docs, Cut(spark, "lines"))
    out = out.where("lines_deleted = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("lines_deleted") > 0, F.length("text")).otherwise(F.col("doc.n_chars"))}
    return out.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"doc.`{c}`") for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest doc_id.

    Rows that share a doc_id stay or go together; rows without one, and texts without words, stay.
    """
    found = minhash_dedup.near_duplicates(docs.select("doc_id", "text"), Cut(spark, "near"))
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it.

    Repeated rows are numbered and each counts; texts without words are never taken.
    """
    return mixing.mixed_documents(docs, Cut(spark, "mix"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids.

    A null or empty text is one id. Repeated rows have pieces each; equal pieces may lie in any order.
    """
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL has language models, tokenizers or components by this route; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    cut, docs = Cut(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
