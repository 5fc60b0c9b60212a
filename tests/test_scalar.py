from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S

TEXTS = [None, "", "  ", " 12 ", "+5", "12\n", "abc", "12.7", "-3", "12", "99999999999999999999"]


@pytest.mark.parametrize(("make", "fits"), [(S.to_long, {"12": 12}), (S.to_amount, {"12.7": 13, "12": 12})])
def test_guarded_casts(spark, make, fits):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", make(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows if r.v is not None} == fits


def test_dates(spark):
    texts = [None, "2023-02-30", "2023-02-28 10:00:00", "28.02.2023", "2023-02-28\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.to_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [None, None, date(2023, 2, 28), None, date(2023, 2, 28)]


def test_age_of_a_leap_day(spark):
    d = [(date(2018, 2, 28), 17), (date(2018, 3, 1), 18), (date(1999, 1, 1), None)]
    rows = spark.createDataFrame([(a, date(2000, 2, 29)) for a, _ in d], "a date, b date").select(S.age(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r.y for r in rows] == [y for _, y in d]


def test_age_bands(spark):
    ages = [None, 3, 19, 20, 22, 23, 25, 26, 28, 29, 31, 32, 70]
    rows = spark.createDataFrame([(a,) for a in ages], "a int").select(S.age_band(F.col("a")).alias("b"), S.age_band_order(S.age_band(F.col("a"))).alias("o")).collect()
    assert [r.b for r in rows] == ["Unknown", "Under 20", "Under 20", "20-22", "20-22", "23-25", "23-25", "26-28", "26-28", "29-31", "29-31", "32+", "32+"]
    assert [r.o for r in rows] == [7, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]


def test_ratio_rounds_half_away_from_zero(spark):
    rows = spark.createDataFrame([(1, 8), (-1, 8), (1, 0), (None, 3), (2, 3)], "a bigint, b bigint").select(S.ratio("a", "b", 2).alias("r")).collect()
    assert [r.r for r in rows] == [0.13, -0.13, None, None, 0.67]


def test_fee_status_takes_the_first_that_holds(spark):
    texts = [None, "free", "-5", "0", "0.0", "12.5", "12\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.fee_status(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == ["unknown_or_undisclosed", "invalid_format", "invalid_negative", "recorded_zero_ambiguous", "recorded_zero_ambiguous", "numeric_fee", "invalid_format"]


def test_lag_status(spark):
    lags = [None, 0, 1, 30, 31, 90, 91, 365, 366]
    rows = spark.createDataFrame([(x,) for x in lags], "x int").select(S.lag_status(F.col("x"), same_day=True).alias("s")).collect()
    assert [r.s for r in rows] == ["no_prior_valuation", "same_day", "within_30_days", "within_30_days", "within_90_days", "within_90_days", "within_365_days", "within_365_days", "stale_over_365_days"]


def test_text_repair(spark):
    texts = [None, "plain", "FuÃŸballclub", "Ã unmappable 一", "Köln"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.repaired(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [None, "plain", "Fußballclub", "Ã unmappable 一", "Köln"]


def test_search(spark):
    names = spark.createDataFrame([("Köln",), ("Großaspach",), (None,)], "n string")
    assert names.where(S.sounds_like(F.col("n"), "koln")).count() == 1
    assert names.where(S.like_text(F.col("n"), "K_L")).count() == 1


def test_z_score_and_joined(spark):
    row = spark.range(1).select(S.z_score(F.lit(3.0), F.lit(1.0), F.lit(0.0)).alias("a"), S.z_score(F.lit(3.0), F.lit(1.0), F.lit(None)).alias("b"), S.joined(F.lit("a"), F.lit(None).cast("string"), F.lit("c")).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.0, 0.0, "ac")


#: What a text looks like after its UTF-8 was read as Windows-1252, and the text.
DAMAGED = {
    "FuÃŸball": "Fußball", "Ã‰COLE": "ÉCOLE", "KÃ¶ln": "Köln", "naÃ¯ve": "naïve", "â‚¬5": "€5", "â€œquotesâ€\u201c": None, "â€™s": "’s", "Å½iÅ¾ka Ã©": "Žižka é",
    "Ã©\n": "é\n", "Â£3": "£3", "â„¢": "™", "Â\xa0x": "\xa0x",
}
#: No such damage: no mark, characters that no byte of the code page has, or bytes that are no UTF-8.
SOUND = [None, "", "plain", "é", "Â", "Ãx", "Ã\u0081", "Â\u0080", "â日", "日本", "Fußball", "Ðorđe", "ÃÃ", "â€", "x Ã", "Ã© 一", "Ã© Ä\u0090"]


def test_text_repair(spark):
    """Damaged texts come out right, sound ones as they are."""
    pairs = [(t, right) for t, right in DAMAGED.items() if right] + [(t, t) for t in SOUND]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(pairs)], "k int, t string").select("k", S.repaired(F.col("t")).alias("t")).orderBy("k").collect()
    assert [r.t for r in rows] == [right for _, right in pairs]


def test_every_letter_beyond_ascii_survives_the_damage(spark):
    """Latin letters encoded and read again byte by byte through the code page's own table."""
    table = {**{b: chr(b) for b in range(256)}, **{ord(at): mark for at, mark in zip(S.AT_BYTES, S.SPECIALS, strict=True)}}
    letters = [chr(c) for c in range(0xC0, 0x180) if all(b in map(ord, S.AT_BYTES) or b >= 0xA0 for b in chr(c).encode())]
    damaged = ["".join(table[b] for b in f"Ã{c}é".encode()) for c in letters]
    got = [r.t for r in spark.createDataFrame(list(enumerate(damaged)), "k int, t string").select("k", S.repaired(F.col("t")).alias("t")).orderBy("k").collect()]
    assert len(letters) > 100 and got == [f"Ã{c}é" for c in letters]


def test_height_status(spark):
    from tidemark.functions.scalar import height_status

    texts = [(None,), ("tall",), ("99.9",), ("100",), ("230",), ("230.1",), ("-5",), ("180.5\n",)]
    got = [r.s for r in spark.createDataFrame(texts, "t string").select(height_status(F.col("t")).alias("s")).collect()]
    assert got == ["missing", "invalid_format", "out_of_range", "valid", "valid", "out_of_range", "invalid_format", "invalid_format"]
