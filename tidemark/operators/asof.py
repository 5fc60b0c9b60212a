"""As-of operators: for each row of one table the latest, or the highest, row of another up to a date.

All are one shuffle of both tables on the key and one pass over each key's rows in
the order of time: nothing is multiplied, as a join with a date condition would.
A key with very many rows is cut into spans of time, either all keys by days
(``span_days``) or the keys alone that are measured to be hot, at the quantiles of their
own times (``like``); what a span starts with comes from one aggregated row
per span before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored


#: A key is hot if it has more than this share of all rows, and more rows than FLOOR.
HOT, FLOOR = 1 / 256, 10_000
#: Spans that a hot key is cut into.
SPANS = 128


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def hot_cuts(like: DataFrame, right: DataFrame, key: str, time: str) -> DataFrame | None:
    """_tm_key and _tm_cuts, the times at which a hot key's rows are cut, of fewer than 1 / HOT keys; None if no key is hot.

    Both tables are read for their keys and times alone: in ``like`` they are the first two columns.
    """
    rows = like.toDF("_tm_key", "_tm_at").unionByName(right.select(F.col(key).alias("_tm_key"), F.col(time).alias("_tm_at"))).dropna()
    counts = rows.groupBy("_tm_key").agg(F.count("*").alias("c"))
    total, most = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    least = max(total * HOT, FLOOR)
    if most <= least:
        return None
    hot = counts.where(F.col("c") > least).select("_tm_key")
    shares = [k / SPANS for k in range(1, SPANS)]
    return stored(rows.join(F.broadcast(hot), "_tm_key").groupBy("_tm_key").agg(F.array_distinct(F.percentile_approx(micros(F.col("_tm_at")), F.lit(shares), F.lit(20 * SPANS))).alias("_tm_cuts")))


def _carried(left: DataFrame, right: DataFrame, key: str, at: str, time: str, best, span_days: int | None, like: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``left`` with _tm_hit: ``best`` of the structs of right's rows with the key and a time up to ``at``; keys, or spans of those that are cut, are dealt to ``tasks`` tasks if given."""
    fields = right.columns
    cuts = None if like is None else hot_cuts(like, right, key, time)
    rows = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("_tm_key"), F.col(time).alias("_tm_time"), F.lit(0).alias("_tm_side"), F.lit(None).cast(F_struct(left)).alias("_tm_left"), F.struct(*fields).alias("_tm_right")
    )
    asks = left.select(F.col(key).alias("_tm_key"), F.col(at).alias("_tm_time"), F.lit(1).alias("_tm_side"), F.struct(*left.columns).alias("_tm_left"), F.lit(None).cast(F_struct(right)).alias("_tm_right"))
    both = rows.unionByName(asks)
    span, split = F.lit(0), F.lit(True)
    if cuts is not None:
        both = both.join(F.broadcast(cuts), "_tm_key", "left")  # fewer than 1 / HOT rows
        span, split = F.size(F.filter("_tm_cuts", lambda c: c < micros(F.col("_tm_time")))), F.col("_tm_cuts").isNotNull()
    elif span_days is not None:
        span = F.floor(F.unix_date(F.col("_tm_time").cast("date")) / span_days)
    cut = span_days is not None or cuts is not None
    both = both.withColumn("_tm_span", F.when(split, F.coalesce(span, F.lit(0))).otherwise(0)) if cut else both
    both = both if tasks is None else both.repartition(tasks, "_tm_key", *["_tm_span"] * cut)
    order = Window.partitionBy("_tm_key", *["_tm_span"] * cut).orderBy(F.col("_tm_time").asc_nulls_first(), "_tm_side")
    hit = best(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("_tm_hit", hit)
    if cut:
        # Of hot keys alone, if they were measured: one row for each span.
        both = both.where(split)
        ends = both.where("_tm_side = 0").groupBy("_tm_key", "_tm_span").agg(best(None).alias("e"))
        # best() of a span, then of the spans before: a row per span and key.
        spans = Window.partitionBy("_tm_key").orderBy("_tm_span")
        ends = both.select("_tm_key", "_tm_span").distinct().join(ends, ["_tm_key", "_tm_span"], "left")
        ends = ends.withColumn("_tm_before", best(spans.rowsBetween(Window.unboundedPreceding, -1), "e")).drop("e")
        ends = ends if cuts is None else F.broadcast(ends)  # at most SPANS / HOT rows
        out = out.join(ends, (out["_tm_key"].eqNullSafe(ends["_tm_key"])) & (out["_tm_span"] == ends["_tm_span"]), "left").select(out["*"], "_tm_before")
        out = out.withColumn("_tm_hit", best.pick(F.col("_tm_before"), F.col("_tm_hit")))
    asked = out.where("_tm_side = 1")
    none = F.lit(None).cast(out.schema["_tm_hit"].dataType)
    usable = F.col("_tm_key").isNotNull() & F.col("_tm_time").isNotNull()
    # The key is that of the shuffle, so what follows by the key needs none.
    same = out.schema["_tm_key"].dataType == left.schema[key].dataType
    kept = [F.col("_tm_key").alias(c) if c == key and same else F.col(f"_tm_left.`{c}`") for c in left.columns]
    return asked.select(*kept, F.when(usable, F.col("_tm_hit")).otherwise(none).alias("_tm_hit"))


def F_struct(df: DataFrame) -> str:
    return df.schema.simpleString()


class _Latest:
    """The last row up to here."""

    def __call__(self, window, column: str = "_tm_right") -> Column:
        if window is None:
            return F.max_by(column, "_tm_time")
        return F.last(column, ignorenulls=True).over(window)

    def pick(self, before: Column, here: Column) -> Column:
        return F.coalesce(here, before)


class _Highest:
    """The row with the greatest value up to here, the earliest of those."""

    def __init__(self, value: str, time: str):
        self.value, self.time = value, time

    def _rank(self, column) -> Column:
        return F.when(column.isNotNull(), F.struct(column[self.value].alias("v"), (-F.unix_date(column[self.time].cast("date"))).alias("t")))

    def __call__(self, window, column: str = "_tm_right") -> Column:
        found = F.max_by(F.col(column), self._rank(F.col(column)))
        return found if window is None else found.over(window)

    def pick(self, before: Column, here: Column) -> Column:
        return F.when(here.isNull() | (self._rank(before) >= self._rank(here)), F.coalesce(before, here)).otherwise(here)


class _Both:
    """The latest row and the highest, in one pass."""

    def __init__(self, value: str, time: str):
        self.latest, self.highest = _Latest(), _Highest(value, time)

    def __call__(self, window, column: str = "_tm_right") -> Column:
        # Of spans that are summed up already, each side goes by its own.
        both = [(b, column if column == "_tm_right" else f"{column}.{n}") for n, b in (("latest", self.latest), ("highest", self.highest))]
        return F.struct(*[b(window, c).alias(n) for (b, c), n in zip(both, ("latest", "highest"), strict=True)])

    def pick(self, before: Column, here: Column) -> Column:
        return F.struct(self.latest.pick(before["latest"], here["latest"]).alias("latest"), self.highest.pick(before["highest"], here["highest"]).alias("highest"))


def _payload(hit: DataFrame, columns: dict[str, str], keep: Column | None = None) -> DataFrame:
    fine = F.lit(True) if keep is None else keep
    return hit.select(*[c for c in hit.columns if c != "_tm_hit"], *[F.when(fine, F.col(f"_tm_hit.{c}")).alias(n) for n, c in columns.items()])


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, time: str, columns: dict[str, str], after: str | None = None, span_days: int | None = None, like: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``left`` with columns of right's latest row of the same key with time <= at; null where there is none.

    ``columns`` maps new names to right's. With ``after``, a column of left, the
    row's time must also be greater than that: the window (after, at]. Several rows
    of right at one time: any of them, so make (key, time) unique first. ``like``
    (a key and a time, and nothing else) is what stands for left's rows when hot keys are looked
    for: left itself where it is cheap to read twice, or the table that it comes from.
    """
    hit = _carried(left, right, key, at, time, _Latest(), span_days, like, tasks)
    return _payload(hit, columns, None if after is None else F.col(f"_tm_hit.{time}") > F.col(after))


def peak_to_date(left: DataFrame, right: DataFrame, key: str, at: str, time: str, value: str, columns: dict[str, str], span_days: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """``left`` with columns of right's row of the highest value with time <= at, the earliest on ties."""
    return _payload(_carried(left, right.where(F.col(value).isNotNull()), key, at, time, _Highest(value, time), span_days, like), columns)


def latest_and_peak(left: DataFrame, right: DataFrame, key: str, at: str, time: str, value: str, latest: dict[str, str], peak: dict[str, str], like: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """asof_backward and peak_to_date of the same tables in one pass; rows of right without a ``value`` are left out."""
    hit = _carried(left, right.where(F.col(value).isNotNull()), key, at, time, _Both(value, time), None, like, tasks)
    found = [F.col(f"_tm_hit.{side}.{c}").alias(n) for side, columns in (("latest", latest), ("highest", peak)) for n, c in columns.items()]
    return hit.select(*[c for c in hit.columns if c != "_tm_hit"], *found)


def top_one(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in this order."""
    return df.withColumn("_tm_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_tm_n = 1").drop("_tm_n")
