import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that the operators use inside.
CLASHES = ("key", "at", "rep", "n", "size", "block", "i", "k", "p", "q", "m", "doc", "passes", "taken", "h", "word", "ids", "start", "vector", "caps", "label2", "shard", "slot", "score", "lang_pred", "_cut")


def prose(rnd, words, vocabulary):
    return " ".join(rnd.choice(vocabulary) for _ in range(words))


def odd_documents():
    """Nulls in every column, empty and blank texts, a very long one, exact and near copies, repeated rows, shared passages."""
    rnd = random.Random(5)
    en = [a + b for a in ("th", "er", "on", "an", "re") for b in ("the", "ing", "ed", "and", "ion", "ly")]
    de = [a + b for a in ("sch", "ein", "ver", "ge") for b in ("ung", "heit", "keit", "lich", "und", "ä")]
    rows = []
    for i in range(60):
        lang, v = ("en", en) if i % 2 else ("de", de)
        rows.append((i, "\n".join(prose(rnd, rnd.randrange(5, 30), v) + "." for _ in range(rnd.randrange(2, 7))), lang, f"s{i % 4}"))
    passage = prose(rnd, 70, en) + "."
    for i in (61, 62, 63):
        rows.append((i, prose(rnd, 12, en) + "\n" + passage + "\n" + prose(rnd, 9, en), "en", "s0"))
    rows += [(70, rows[3][1], "en", "s1"), (71, rows[3][1] + " and", "en", "s1"), (72, rows[3][1], None, None)]
    rows += [(80, None, "en", "s2"), (81, "", "de", "s2"), (82, " \n\t ", None, "s2"), (83, "123 !!", "en", None), (84, "\U0001f600é", "en", "s9"), (85, "one two", "en", "s9")]
    rows.append((90, prose(rnd, 40_000, en), "en", "s3"))
    rows.append((None, "no id here at all today", "en", "s1"))
    rows += [rows[7], rows[7]]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Folders with the odd tables, and with empty ones."""
    at = tmp_path_factory.mktemp("odd")
    docs = odd_documents()
    rnd = random.Random(9)
    base = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    vectors = [(i, [x + rnd.gauss(0, 0.08) for x in base[i % 12]], i % 3 if i % 12 % 2 else 7) for i in range(60)]
    vectors += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] + [1.0] * 15, 1), (103, base[0], None), (104, base[1] + [1.0], 7), (None, base[0], 7), (105, [], 1), vectors[3], vectors[3]]
    pages = [(0, "https://A.Example.NET/en/x?q#f", '<a href="http://Good.org/x">'), (1, "http://b.example.com/de/1", None), (2, "http://b.example.com/en/1", ""), (3, None, "<a href='//bad.net/'>"), (4, "nothing", "x"), (5, "ftp://good.org/fr/", '<a href="https://other.io">'), (6, "http://", ""), (None, "http://other.io?x", '<a href="http://b.example.com">')]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(None, 1, 1), (3, None, None), (999, 1, 0)]
    said = [(c, t, "user" if t % 2 else "assistant" if c % 3 else "system", rnd.choice(["Yes.", "No", "well", " \n", "why?", "a.b.c"])) for c in range(80) for t in range(c % 9)]
    said += [(500, t, "ua"[t % 2] + "x", f"turn {t}.") for t in range(600)] + [(501, None, None, None), (501, 3, "tool", "x."), (501, 3, "user", "y"), (502, None, "user", ""), (503, -5, "", "z!"), (503, 9, "User", "z!")]
    said += [(None, 1, "user", "hi."), (None, 2, "assistant", "ho!"), (504, 1, "user", "end.\u2028"), (504, 2, "assistant", "\x85"), said[40], said[40], said[41]]
    frames = {
        "conversations": spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", *[f"'clash' AS `{c}`" for c in ("gone", "kind", "copy", "seen", "place", "turns", "best")]),
        "documents": spark.createDataFrame(docs, DOCUMENTS).selectExpr("*", *[f"'clash' AS `{c}`" for c in CLASHES]),
        "embeddings": spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").selectExpr("*", *[f"'clash' AS `{c}`" for c in CLASHES]),
        "pages": spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "'clash' AS host", "'clash' AS rule", "'clash' AS trust"),
        "labels": spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "'clash' AS text"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{at}/full/{name}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{at}/none/{name}.parquet")
    return {"full": f"{at}/full", "none": f"{at}/none", "docs": docs, "vectors": vectors}
