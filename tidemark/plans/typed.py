"""From raw text tables to typed dimensions and facts.

Every raw column is text. A key that isn't all digits drops a dimension's row and
joins with nothing in a fact; any other text that doesn't fit gives null, and a
status says why. The labels are fixed values of the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DECIMAL, INTEGER, bounded, height_status, to_amount, to_date, to_long
from ..sources.files import stored

LONGEST_MATCH = 130


def _or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def competitions(raw: DataFrame, overrides: DataFrame, groups: DataFrame, scope: list[str]) -> DataFrame:
    """Raw competitions and the overrides that they lack, with their group: the override's, else their type's, else Unknown.

    ``raw``: competition_id, name, type, country_name, total_clubs. ``overrides``:
    competition_id, name, type, country_name, competition_group, evidence, one row
    for each id. ``groups``: type, competition_group; a null and an empty type are alike.
    """
    known = raw.select(
        F.col("competition_id").alias("competition_key"), "name", "type", "country_name", to_long(F.col("total_clubs")).alias("total_clubs"),
        F.lit(False).alias("is_override"), F.lit(None).cast("string").alias("evidence"),
    )
    new = overrides.join(raw.select("competition_id"), "competition_id", "left_anti").select(
        F.col("competition_id").alias("competition_key"), "name", "type", "country_name", F.lit(None).cast("bigint").alias("total_clubs"), F.lit(True).alias("is_override"), "evidence"
    )
    said = overrides.select(F.col("competition_id").alias("competition_key"), F.col("competition_group").alias("_said"))
    typed = groups.select(_or_empty("type").alias("_type"), F.col("competition_group").alias("_typed"))
    d = known.unionByName(new).join(said, "competition_key", "left").join(typed, _or_empty("type") == F.col("_type"), "left")
    d = d.withColumn("competition_group", F.coalesce("_said", "_typed", F.lit("Unknown"))).withColumn("in_scope", F.col("competition_key").isin(scope))
    return d.drop("_said", "_type", "_typed")


def clubs(raw: DataFrame, competition: DataFrame) -> DataFrame:
    """club_key, club_name, competition_key (null if unknown), squad_size, average_age, has_competition."""
    known = competition.select("competition_key")
    d = raw.where(F.col("club_id").rlike(INTEGER)).join(known, F.col("domestic_competition_id") == F.col("competition_key"), "left")
    age = F.when(F.col("average_age").rlike(DECIMAL), F.round(F.col("average_age").try_cast("decimal(38,10)"), 2).cast("double"))
    return d.select(
        to_long(F.col("club_id")).alias("club_key"), F.col("name").alias("club_name"), "competition_key", to_long(F.col("squad_size")).alias("squad_size"),
        age.alias("average_age"), F.col("competition_key").isNotNull().alias("has_competition"),
    )


def players(raw: DataFrame, club: DataFrame, positions: DataFrame) -> DataFrame:
    """Players with their position group, height and current club, and what each of them lacks.

    ``positions``: position, sub_position, position_group; a null and an empty
    sub_position are alike.
    """
    groups = positions.select(F.col("position").alias("_p"), _or_empty("sub_position").alias("_s"), "position_group")
    d = raw.where(F.col("player_id").rlike(INTEGER)).join(groups, (F.col("position") == F.col("_p")) & (_or_empty("sub_position") == F.col("_s")), "left")
    d = d.withColumn("_club", to_long(F.col("current_club_id"))).join(club.select("club_key"), F.col("_club") == F.col("club_key"), "left")
    group = F.coalesce("position_group", F.lit("Unknown"))
    return d.select(
        to_long(F.col("player_id")).alias("player_key"), F.col("name").alias("player_name"), to_date(F.col("date_of_birth")).alias("date_of_birth"),
        group.alias("position_group"), bounded(to_amount(F.when(F.col("height_in_cm").try_cast("double").between(100, 230), F.col("height_in_cm"))), 100, 230).alias("height_cm"),
        height_status(F.col("height_in_cm")).alias("height_quality_status"), F.col("club_key").alias("current_club_key"), (group != "Goalkeeper").alias("is_outfield"),
        F.col("position_group").isNotNull().alias("has_position_mapping"), F.col("club_key").isNotNull().alias("has_current_club"),
    )


def lineups(raw: DataFrame) -> DataFrame:
    """A row for each game and player of the line-ups: how many rows, and of which kinds."""
    return raw.groupBy("game_id", "player_id").agg(
        F.count("*").alias("lineup_rows"), F.bool_or(F.col("type") == "starting_lineup").alias("started"), F.bool_or(F.col("type") == "substitutes").alias("on_bench")
    )


#: A key is hot if it has more than this share of all rows, and more rows than FLOOR; its rows are dealt to as many parts as SALTS.
HOT, FLOOR, SALTS = 1 / 256, 10_000, 128


def with_known(d: DataFrame, column: str, keys: DataFrame, key: str, like: DataFrame, by: list[str]) -> DataFrame:
    """``d`` with ``key`` of the row of ``keys``, unique, that its ``column`` names; null where there is none.

    Rows of a hot key, null included, are dealt by the columns ``by`` to SALTS parts, each with a copy
    of that key, so no task has them all. Hot keys, fewer than 1 / HOT, are counted in ``like``, a table
    with ``column`` that is cheap to read twice.
    """
    counts = like.groupBy(F.col(column).alias("_hot")).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    least = max(total * HOT, FLOOR)
    if most <= least:
        return d.join(keys.select(key), F.col(column) == F.col(key), "left")
    hot = F.broadcast(stored(counts.where(F.col("_n") > least).select("_hot", F.lit(True).alias("_is_hot"))))  # fewer than 1 / HOT rows
    part = F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    d = d.join(hot, F.col(column).eqNullSafe(F.col("_hot")), "left").withColumn("_part", F.when(F.col("_is_hot"), part).otherwise(0)).drop("_hot", "_is_hot")
    parts = F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = keys.select(key).join(hot, F.col(key) == F.col("_hot"), "left").select(key, F.explode(parts).alias("_copy"))
    return d.join(copies, (F.col(column) == F.col(key)) & (F.col("_part") == F.col("_copy")), "left").drop("_part", "_copy")


def appearances(raw: DataFrame, game: DataFrame, player: DataFrame, club: DataFrame, lineup: DataFrame) -> DataFrame:
    """Appearances in known games, with what the line-ups say of them and whether they can be summed.

    ``raw``: appearance_id, game_id, player_id, player_club_id, minutes_played,
    goals, assists, yellow_cards, red_cards. ``game``: game_key, competition_key,
    season_key, game_date. The line-ups are reduced to one row for each game and
    player before they are joined, so they multiply nothing.
    """
    numbers = ("goals", "assists", "yellow_cards", "red_cards")
    raw = raw.withColumns({"game_key": to_long(F.col("game_id")), "_player": to_long(F.col("player_id")), "_club": to_long(F.col("player_club_id"))})
    d = with_known(raw.join(game, "game_key"), "_player", player, "player_key", raw, ["appearance_id", "game_id"]).join(club.select("club_key"), F.col("_club") == F.col("club_key"), "left")
    d = d.join(lineup.withColumnsRenamed({"game_id": "_g", "player_id": "_p"}), (F.col("game_id") == F.col("_g")) & (F.col("player_id") == F.col("_p")), "left")
    minutes = F.col("minutes_played")
    well_formed, exact = minutes.rlike(DECIMAL), minutes.try_cast("decimal(38,10)")
    in_range = exact.between(0, LONGEST_MATCH)
    whole = F.lit(True)
    for c in numbers:
        whole &= F.col(c).rlike(INTEGER)
    matched = (
        F.when(F.col("lineup_rows").isNull(), "missing").when(F.col("lineup_rows") == 1, "matched_unique")
        .when(F.col("started") & F.col("on_bench"), "duplicate_conflict").otherwise("matched_duplicate")
    )
    quality = (
        F.when(F.col("player_key").isNull(), "missing_player_dimension").when(F.col("club_key").isNull(), "missing_club_dimension")
        .when(~well_formed, "invalid_minutes_format").when(~in_range, "minutes_out_of_range").when(~whole, "invalid_metric_format").otherwise("valid")
    )
    valid = F.col("player_key").isNotNull() & F.col("club_key").isNotNull() & well_formed & in_range & whole
    return d.select(
        F.col("appearance_id").alias("appearance_key"), "player_key", "game_key", "club_key", "competition_key", "season_key", F.col("game_date").alias("appearance_date"),
        to_amount(F.when(in_range, minutes)).alias("minutes_played"), *[to_long(F.col(c)).alias(c) for c in numbers],
        F.when(F.col("lineup_rows").isNotNull(), F.coalesce("started", F.lit(False))).alias("is_starter"), matched.alias("lineup_match_status"),
        F.coalesce("lineup_rows", F.lit(0)).alias("lineup_rows"), valid.alias("is_valid"), quality.alias("data_quality_status"),
    )
