"""Scalar expressions with fixed semantics: guarded casts, ages, exact rounding, bands, text repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted texts. ``\\z``: Java's ``$`` would let a last line end through.
INTEGER = r"\A[0-9]+\z"
DECIMAL = r"\A[0-9]+(?:\.[0-9]+)?\z"
SIGNED = r"\A-?[0-9]+(?:\.[0-9]+)?\z"
ISO_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def to_long(text: Column) -> Column:
    """A long, null unless the text is all digits and in range."""
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def to_amount(text: Column, pattern: str = DECIMAL) -> Column:
    """A decimal text rounded half up to a long, null for any other text."""
    return F.when(text.rlike(pattern), F.round(text.try_cast("decimal(38,10)"), 0).try_cast("bigint"))


def to_date(text: Column) -> Column:
    """The date in the first ten characters, null unless they are a real ISO date."""
    head = F.left(text, F.lit(10))
    return F.when(head.rlike(ISO_DATE), F.try_to_date(head, "yyyy-MM-dd"))


def bounded(value: Column, low, high) -> Column:
    """The value, null outside [low, high]."""
    return F.when(value.between(low, high), value)


def age(at: Column, born: Column) -> Column:
    """Full years at a date; someone born on 29 February has a birthday on 1 March in other years. Null before birth."""
    before = F.date_format(at, "MMdd") < F.date_format(born, "MMdd")
    return F.when(at >= born, F.year(at) - F.year(born) - before.cast("int"))


#: (name, order, lowest age, highest age); fixed values of the method.
AGE_BANDS = (("Under 20", 1, None, 19), ("20-22", 2, 20, 22), ("23-25", 3, 23, 25), ("26-28", 4, 26, 28), ("29-31", 5, 29, 31), ("32+", 6, 32, None), ("Unknown", 7, None, None))


def age_band(years: Column) -> Column:
    out = F.when(years.isNull(), "Unknown")
    for name, _, _, high in AGE_BANDS[:5]:
        out = out.when(years <= high, name)
    return out.otherwise("32+")


def age_band_order(band: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, order, _, _ in AGE_BANDS:
        out = F.when(band == name, order).otherwise(out)
    return out


def ratio(num: str, den: str, digits: int) -> Column:
    """num / den rounded half away from zero, computed in whole numbers; null unless den > 0.

    ``num`` and ``den`` are SQL of whole-number expressions. No binary fraction
    takes part, so every engine rounds alike.
    """
    scale = 10**digits
    return F.expr(
        f"CASE WHEN ({den}) > 0 THEN sign({num}) * CAST((2 * abs(CAST({num} AS BIGINT)) * {scale} + ({den})) div (2 * ({den})) AS DOUBLE) / {scale} END"
    )


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Winsorised: null bounds are ignored, as in LEAST and GREATEST."""
    return F.greatest(low, F.least(high, value))


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """Standard score; 0 where the deviation is zero or unknown."""
    return F.coalesce((value - mean) / F.nullif(deviation, F.lit(0.0)), F.lit(0.0))


def joined(*parts: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *parts)


# The labels of lag_status, fee_status and height_status are fixed values of the method.
def lag_status(days: Column, same_day: bool = False) -> Column:
    """How fresh a value is that was observed so many days before."""
    out = F.when(days.isNull(), "no_prior_valuation")
    if same_day:
        out = out.when(days == 0, "same_day")
    return out.when(days <= 30, "within_30_days").when(days <= 90, "within_90_days").when(days <= 365, "within_365_days").otherwise("stale_over_365_days")


def fee_status(text: Column) -> Column:
    """What a fee's text says; the first that holds."""
    value = text.try_cast("decimal(38,10)")
    return (
        F.when(text.isNull(), "unknown_or_undisclosed").when(~text.rlike(SIGNED), "invalid_format")
        .when(value < 0, "invalid_negative").when(value == 0, "recorded_zero_ambiguous").otherwise("numeric_fee")
    )


def height_status(text: Column) -> Column:
    """What a height in centimetres says; the first that holds."""
    value = text.try_cast("decimal(38,10)")
    out = F.when(text.isNull(), "missing").when(~text.rlike(DECIMAL), "invalid_format")
    return out.when(~value.between(100, 230), "out_of_range").otherwise("valid")


#: The characters that Windows-1252 has at bytes 80 to 9F, and those bytes as characters; five bytes have none.
SPECIALS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
AT_BYTES = "".join(map(chr, [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]))
#: Fixed value: the characters of which a damaged text has one.
MARKERS = "[ÃÂâ]"


def repaired(text: Column) -> Column:
    """UTF-8 that was once read as Windows-1252, put right; any other text unchanged.

    A text is such if it has one of the MARKERS, all its characters are bytes of
    that code page and the bytes are valid UTF-8.
    """
    bytes_as_text = F.translate(text, SPECIALS, AT_BYTES)
    encodable = text.rlike(MARKERS) & ~text.rlike("[\u0080-\u009F]") & bytes_as_text.rlike(r"\A[\u0000-\u00FF]*\z")
    # Only what can be encoded is: an error otherwise.
    read_again = F.encode(F.when(encodable, bytes_as_text), "ISO-8859-1").cast("string")
    return F.coalesce(F.when(F.is_valid_utf8(read_again), read_again), text)


def like_text(column: Column, query: str) -> Column:
    """Whether the column holds the query, in any case; % and _ in it match as in LIKE."""
    return column.ilike(f"%{query}%")


def sounds_like(column: Column, query: str) -> Column:
    """Whether the column holds the query, whatever the case and the diacritics."""
    return F.contains(F.collate(column, "UNICODE_CI_AI"), F.collate(F.lit(query), "UNICODE_CI_AI"))
