"""An audit as rules over tables: all that is asked of a table comes from one scan of it.

Rules are declared and compiled to one aggregation. Each row gives what it counts
itself, and a key for each uniqueness rule and each reference that it breaks; the
first grouping, by key, adds up the counts and sees repeated keys, the second is
over its few facts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import blank, union_all


@dataclass(frozen=True)
class Missing:
    """Rows in which the column is null, or blank after trimming."""

    column: str


@dataclass(frozen=True)
class Unique:
    """Rows with a blank part of the key; groups of repeated keys; rows beyond the first of each."""

    columns: tuple[str, ...]


@dataclass(frozen=True)
class Known:
    """Rows, and distinct keys, whose key is in no row of the parent; null keys aren't checked."""

    column: str
    table: str
    key: str


@dataclass(frozen=True)
class Within:
    """Numbers that are below ``low`` or above ``high``."""

    column: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Dated:
    """Dates after ``last``, and days from the first to the last date."""

    column: str
    last: str


Rule = Missing | Unique | Known | Within | Dated


def _text(columns: tuple[str, ...]) -> Column:
    """One text for a key: parts with their lengths, so that different keys never look alike."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("|", *parts)


def audit_table(df: DataFrame, name: str, rules: list[Rule], parents: Callable[[str], DataFrame]) -> DataFrame:
    """table_name, check_name, metric, actual (long) of every rule; row_count besides. One scan of ``df``."""
    counts: dict[tuple[str, str], Column] = {("table", "row_count"): F.lit(1)}
    least: dict[tuple[str, str], Column] = {}
    keys: list[tuple[str, Column, Column]] = []  # (check, which rows, key)
    for r in rules:
        match r:
            case Missing(column):
                counts[f"{column}_present", "missing_rows"] = blank(column).cast("int")
            case Within(column, low, high):
                value = F.col(column)
                counts[f"{column}_in_range", "below_rows"] = F.lit(0) if low is None else (value < low).cast("int")
                counts[f"{column}_in_range", "above_rows"] = F.lit(0) if high is None else (value > high).cast("int")
            case Dated(column, last):
                day = F.col(column).cast("date")
                counts[f"{column}_not_later", "future_rows"] = (day > F.lit(last).cast("date")).cast("int")
                least[f"{column}_not_later", "first_day"] = F.unix_date(day)
                least[f"{column}_not_later", "last_day"] = -F.unix_date(day)
            case Unique(columns):
                check, empty = "+".join(columns) + "_unique", F.lit(False)
                for c in columns:
                    empty = empty | blank(c)
                counts[check, "null_key_rows"] = empty.cast("int")
                keys.append((check, ~empty, _text(columns)))
            case Known(column, table, key):
                check, mark = f"{column}_in_{table}", f"_tm_known_{column}"
                known = parents(table).select(F.col(key).alias(mark)).where(F.col(mark).isNotNull()).distinct()
                df = df.join(known, F.col(column) == F.col(mark), "left")
                lost = F.col(column).isNotNull() & F.col(mark).isNull()
                counts[check, "checked_rows"] = F.col(column).isNotNull().cast("int")
                counts[check, "orphan_rows"] = lost.cast("int")
                keys.append((check, lost, _text((column,))))
    cells, days = list(counts), list(least)
    # The row's own counts ride on one of its keys, so that every row is grouped once for each key and read once.
    own = F.struct(*[F.coalesce(counts[c], F.lit(0)).cast("bigint").alias(f"n{k}") for k, c in enumerate(cells)], *[least[c].alias(f"d{k}") for k, c in enumerate(days)])
    none = F.lit(None)
    asked = [F.when(rows, F.struct(F.lit(k).alias("kind"), key.alias("key"))) for k, (_, rows, key) in enumerate(keys)]
    marks = F.filter(F.array(*asked), lambda x: x.isNotNull()) if asked else F.array().cast("array<struct<kind:int,key:string>>")
    marks = F.when(F.size(marks) > 0, marks).otherwise(F.array(F.struct(F.lit(-1).alias("kind"), none.cast("string").alias("key"))))
    rows = df.select(own.alias("own"), F.posexplode(marks).alias("at", "x")).withColumn("own", F.when(F.col("at") == 0, F.col("own"))).select("x.*", "own.*")
    per = rows.groupBy("kind", "key").agg(F.count("*").alias("n"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(cells))], *[F.min(f"d{k}").alias(f"d{k}") for k in range(len(days))])
    facts = [F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(len(cells))] + [F.min(f"d{k}").alias(f"d{k}") for k in range(len(days))]
    found: list[tuple[str, str, str]] = [(c, m, f"n{k}") for k, (c, m) in enumerate(cells)] + [(c, m, f"{'-' if m == 'last_day' else ''}d{k}") for k, (c, m) in enumerate(days)]
    for k, (check, _, _) in enumerate(keys):
        mine = F.col("kind") == k
        if check.endswith("_unique"):
            facts += [F.count_if(mine & (F.col("n") > 1)).alias(f"g{k}"), F.coalesce(F.sum(F.when(mine, F.col("n") - 1)), F.lit(0)).alias(f"x{k}")]
            found += [(check, "duplicate_groups", f"g{k}"), (check, "excess_rows", f"x{k}")]
        else:
            facts.append(F.count_if(mine).alias(f"o{k}"))
            found.append((check, "orphan_keys", f"o{k}"))
    out = per.agg(*facts)
    told = F.array(*[F.struct(F.lit(c).alias("check_name"), F.lit(m).alias("metric"), F.expr(e).cast("bigint").alias("actual")) for c, m, e in found])
    return out.select(F.lit(name).alias("table_name"), F.explode(told).alias("x")).select("table_name", "x.*")


def audit(tables: dict[str, DataFrame], rules: dict[str, list[Rule]]) -> DataFrame:
    """The findings of all tables."""
    return union_all([audit_table(tables[name], name, of, lambda n: tables[n]) for name, of in rules.items()])


def audit_sql(rules: dict[str, list[Rule]]) -> str:
    """The same findings in plain SQL, a query for each: what the compiled aggregation is held against."""
    out = []
    for t, of in rules.items():
        said = [("table", "row_count", f"SELECT count(*) FROM {t}")]
        empty = lambda c: f"coalesce(trim({c}::VARCHAR), '') = ''"
        for r in of:
            match r:
                case Missing(c):
                    said.append((f"{c}_present", "missing_rows", f"SELECT count(*) FROM {t} WHERE {empty(c)}"))
                case Within(c, low, high):
                    said.append((f"{c}_in_range", "below_rows", "SELECT 0" if low is None else f"SELECT count(*) FROM {t} WHERE {c} < {low}"))
                    said.append((f"{c}_in_range", "above_rows", "SELECT 0" if high is None else f"SELECT count(*) FROM {t} WHERE {c} > {high}"))
                case Dated(c, last):
                    said.append((f"{c}_not_later", "future_rows", f"SELECT count(*) FROM {t} WHERE {c}::DATE > DATE '{last}'"))
                    said += [(f"{c}_not_later", m, f"SELECT {f}({c}::DATE) - DATE '1970-01-01' FROM {t}") for m, f in (("first_day", "min"), ("last_day", "max"))]
                case Unique(columns):
                    name, any_empty, k = "+".join(columns) + "_unique", " OR ".join(map(empty, columns)), ", ".join(columns)
                    said.append((name, "null_key_rows", f"SELECT count(*) FROM {t} WHERE {any_empty}"))
                    groups = f"(SELECT count(*) AS n FROM {t} WHERE NOT ({any_empty}) GROUP BY {k} HAVING count(*) > 1)"
                    said += [(name, "duplicate_groups", f"SELECT count(*) FROM {groups}"), (name, "excess_rows", f"SELECT coalesce(sum(n - 1), 0) FROM {groups}")]
                case Known(c, p, k):
                    lost = f"FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p} WHERE {k} IS NOT NULL)"
                    said += [(f"{c}_in_{p}", "checked_rows", f"SELECT count({c}) FROM {t}"), (f"{c}_in_{p}", "orphan_rows", f"SELECT count(*) {lost}"), (f"{c}_in_{p}", "orphan_keys", f"SELECT count(DISTINCT {c}) {lost}")]
        out += [f"SELECT '{t}' AS table_name, '{c}' AS check_name, '{m}' AS metric, ({q})::BIGINT AS actual" for c, m, q in said]
    return " UNION ALL ".join(out)
