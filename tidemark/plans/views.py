"""The seven enriched views of the model: facts with the names that a reader asks for first.

Each is a frame; ``offer`` makes them known to SQL under a prefix that the caller
chooses, so that two models in one session keep apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _club(clubs: DataFrame, key: str, name: str) -> DataFrame:
    return clubs.select(F.col("club_key").alias(key), F.col("club_name").alias(name))


def named(facts: DataFrame, entities: DataFrame, clubs: DataFrame, club_keys: dict[str, str], who: tuple[str, ...] = ("entity_name",), optional: bool = False) -> DataFrame:
    """``facts`` with columns of their entity (rows without one go unless ``optional``) and the names of their clubs, null where unknown.

    ``club_keys`` maps a key column of ``facts`` to the new name's column.
    """
    out = facts.join(entities.select("entity_key", *who), "entity_key", "left" if optional else "inner")
    for key, name in club_keys.items():
        out = out.join(_club(clubs, key, name), key, "left")
    return out


def entity_season(seasons: DataFrame, entities: DataFrame, clubs: DataFrame, scope: Column) -> DataFrame:
    """Seasons in scope with the entity's description and both clubs' names."""
    return named(seasons.where(scope), entities, clubs, {"primary_club_key": "primary_club_name", "season_end_club_key": "season_end_club_name"}, ("entity_name", "date_of_birth", "country"))


def club_season(stints: DataFrame, entities: DataFrame, clubs: DataFrame, scope: Column) -> DataFrame:
    """Stints in scope at known clubs."""
    return named(stints.where(scope), entities, clubs, {"club_key": "club_name"}).where("club_name IS NOT NULL")


def historical_transfers(transfers: DataFrame, entities: DataFrame, clubs: DataFrame) -> DataFrame:
    """Transfers up to the cutoff; ``transfers`` has from_club_key and to_club_key."""
    return named(transfers.where("is_historical"), entities, clubs, {"from_club_key": "from_club_name", "to_club_key": "to_club_name"})


def efficiency_ranking(scores: DataFrame, entities: DataFrame, clubs: DataFrame) -> DataFrame:
    return named(scores, entities, clubs, {"primary_club_key": "primary_club_name", "season_end_club_key": "season_end_club_name"}, ("entity_name", "country"))


def value_development(development: DataFrame, entities: DataFrame, clubs: DataFrame) -> DataFrame:
    return named(development, entities, clubs, {"season_end_club_key": "season_end_club_name"})


def transfer_outcomes(outcomes: DataFrame, entities: DataFrame, clubs: DataFrame) -> DataFrame:
    """Outcomes with names; a transfer of an unknown entity stays."""
    return named(outcomes, entities, clubs, {"from_club_key": "from_club_name", "to_club_key": "to_club_name"}, optional=True)


def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """source_table, min_business_date, max_business_date, row_count of each table by its date column."""
    rows = [
        df.agg(F.min(F.col(c).cast("date")).alias("min_business_date"), F.max(F.col(c).cast("date")).alias("max_business_date"), F.count("*").alias("row_count")).select(F.lit(n).alias("source_table"), "*")
        for n, (df, c) in tables.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def offer(frames: dict[str, DataFrame], prefix: str, register: Callable[[DataFrame, str], None] = DataFrame.createOrReplaceTempView) -> list[str]:
    """Makes the frames known to SQL as ``prefix`` and their name; gives the names."""
    for name, df in frames.items():
        register(df, prefix + name)
    return [prefix + name for name in frames]
