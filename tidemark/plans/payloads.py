"""One nested document for each dashboard question, put together in Spark from bounded parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dashboard

#: Rows of a part, at most; more is an error of the caller's limits.
MOST = 2000
HORIZONS = (6, 12, 24)
FEES = ("numeric_fee", "recorded_zero_ambiguous", "unknown_or_undisclosed", "invalid_format", "invalid_negative")


def json_safe(column: Column, kind: T.DataType) -> Column:
    """A value as JSON can hold it: decimals as doubles, dates and times as ISO text, NaN and infinities as null; arrays, structs and maps within."""
    match kind:
        case T.DecimalType():
            return column.cast("double")
        case T.DoubleType() | T.FloatType():
            return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
        case T.DateType():
            return F.date_format(column, "yyyy-MM-dd")
        case T.TimestampType() | T.TimestampNTZType():
            return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        case T.ArrayType():
            return F.transform(column, lambda x: json_safe(x, kind.elementType))
        case T.MapType():
            return F.transform_values(column, lambda _, v: json_safe(v, kind.valueType))
        case T.StructType():
            return F.when(column.isNotNull(), F.struct(*[json_safe(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return column


def safe_row(df: DataFrame) -> Column:
    return F.struct(*[json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def listed(df: DataFrame, order: list[Column | str], most: int = MOST) -> DataFrame:
    """One row, x: the rows of ``df`` in this order as an array of structs. ``df`` has at most ``most`` rows by its own limit or grouping."""
    first = df.orderBy(*order).limit(most + 1)
    numbered = first.select(F.row_number().over(Window.orderBy(*order)).alias("n"), safe_row(df).alias("v"))  # at most MOST rows
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n", "v")), lambda a, b: a["n"] - b["n"]), lambda r: r["v"])
    return numbered.agg(F.when(F.count("*") <= most, rows).otherwise(F.raise_error(F.lit("too many rows in a part"))).alias("x"))


def single(df: DataFrame) -> DataFrame:
    """One row, x: the only row of ``df`` as a struct, null if there is none."""
    return df.limit(1).agg(F.first(safe_row(df)).alias("x"))


def document(**parts: DataFrame | Column | Callable[[dict[str, Column]], Column]) -> DataFrame:
    """One row, payload: the JSON of an object with these parts in their order. Frames have one row, x; so their product has one.

    A function makes its part from the frames' columns before it, by their names.
    """
    out, columns, before = None, [], {}
    for k, (name, part) in enumerate(parts.items()):
        if isinstance(part, DataFrame):
            one = part.select(F.col("x").alias(f"p{k}"))
            out = one if out is None else out.join(F.broadcast(one))
            before[name] = F.col(f"p{k}")
            columns.append(before[name].alias(name))
        else:
            columns.append((part(before) if callable(part) else part).alias(name))
    return out.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload"))


def said(filters: dict) -> Column:
    """All filters, null where not set."""
    kinds = {"competition": "string", "season": "int", "position": "string"}
    return F.struct(*[F.lit(filters.get(n)).cast(t).alias(n) for n, t in kinds.items()])


def whole(value, name: str) -> int:
    """A positive whole number, or an error that names the parameter."""
    text = str(value).strip()
    if not text.isdigit() or int(text) < 1:
        raise ValueError(f"{name} must be a positive integer")
    return int(text)


def overview(scores: DataFrame, filters: dict, allowed: dict[str, set]) -> DataFrame:
    f = dashboard.checked(filters, allowed)
    by = {n: dashboard.overview_by(scores, f, c) for n, c in (("byPosition", "position_group"), ("byCompetition", "competition_key"), ("byAge", "age_band"))}
    ordered = {n: listed(d, [d.columns[0]]) for n, d in by.items()}
    return document(filters=said(f), summary=single(dashboard.overview(scores, f)), **ordered)


def transfers(outcomes: DataFrame, entities: DataFrame, horizon, fee_status: str | None = None) -> DataFrame:
    """The summary of a horizon by fee status and its largest gains."""
    h = whole(horizon, "horizon")
    if h not in HORIZONS:
        raise ValueError("horizon must be 6, 12 or 24")
    if fee_status is not None and fee_status not in FEES:
        raise ValueError("unsupported fee status")
    best = dashboard.top_outcomes(outcomes, entities, h, fee_status)
    per = outcomes.where(F.col("horizon_months") == h).groupBy("fee_status").agg(F.count("*").alias("transfers"), F.count_if("is_change_eligible").alias("change_eligible"))
    return document(horizon=F.lit(h), byFeeStatus=listed(per, ["fee_status"]), top=listed(best, [F.desc_nulls_last("value_change"), "transfer_key"], 40))


def clubs(development: DataFrame, club: DataFrame, filters: dict, allowed: dict[str, set]) -> DataFrame:
    f = dashboard.checked(filters, allowed)
    found = dashboard.clubs_by_change(development, club, f)
    return document(filters=said(f), clubs=listed(found, [F.desc("median_change"), F.desc("comparisons"), "club_key"], 60))


def team(stints: DataFrame, filters: dict, allowed: dict[str, set], club_key) -> DataFrame:
    """A club's season: summary, positions and ages. A season is required; a club without rows is a LookupError."""
    f, key = dashboard.checked(filters, allowed), whole(club_key, "club_key")
    if "season" not in f:
        raise ValueError("season is required for team analysis")
    if dashboard.team(stints, f, key).isEmpty():
        raise LookupError("team was not found in the selected season")
    ages = dashboard.team_by_age(stints, f, key)
    return document(filters=said(f), summary=single(dashboard.team_summary(stints, f, key)), byPosition=listed(dashboard.team_by_position(stints, f, key), ["position_group"]), byAge=listed(ages, ["age_band_order"]))


def meta(scores: DataFrame, snapshot: DataFrame, version: str) -> DataFrame:
    """What can be chosen, the method's version and how fresh the sources are."""
    return document(version=F.lit(version), options=single(dashboard.meta(scores)), sources=listed(snapshot, ["source_table"]))


def quality(ledger: DataFrame, parameters: DataFrame) -> DataFrame:
    """The published audit by table, what failed of it, and the parameters."""
    per = ledger.groupBy("table_name").agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "PASS").alias("passed"))
    failed = ledger.where("status <> 'PASS'").select("table_name", "check_name", "actual")
    return document(tables=listed(per, ["table_name"]), failed=listed(failed, ["table_name", "check_name"]), parameters=single(parameters))
