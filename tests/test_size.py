"""What must not grow with the tables: the rows that one task holds, and how often rows are shuffled."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.operators.asof import asof_backward
from tidemark.plans import dashboard, typed
from tidemark.plans.bindings import Model
from tidemark.plans.store import Spec, Store
from tidemark.sources import files

SF = "/root/testdata/sf0.001"


def test_stint_sums_take_more_tasks_not_larger_ones(spark, monkeypatch):
    few = Model(spark, SF).stint_sums()
    monkeypatch.setattr(files, "TASK_ROWS", 100)
    many = Model(spark, SF).stint_sums()
    assert len(many.inputFiles()) > 40 and sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_scores_alone_build_no_wider_table(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/model")
    assert set(s.build(Model(spark, SF), ["scores"])["tables"]) == {"entities", "valuations", "kpi", "scores"}
    said = ("entity_key", "competition_key", "season_key", "value", "peers", "efficiency_rank", "efficiency_band")
    assert sorted(map(str, s.table("scores").select(*said).collect())) == sorted(map(str, Model(spark, SF).scores().select(*said).collect()))


def test_a_written_table_is_shuffled_once_by_its_key_and_reference(spark, tmp_path, capsys):
    """Rows that are asked as of a date and named, then counted by key and reference and written, lie by the entity all along."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(1000).select((F.col("id") % 50).alias("k"), F.date_add(F.lit("1997-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
        known = spark.range(50).select(F.col("id").alias("k"))
        found = asof_backward(facts, facts.select("k", F.col("d").alias("seen")), "k", "d", "seen", {"s": "seen"}).join(known, "k")
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("k", "d").orderBy("d")))
        found.explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange hashpartitioning") == 2  # of the as-of rows and of what they are joined with
        rows, ledger = Store(spark, f"{tmp_path}/m").write(found, Spec("t", (), key=("k", "d"), refers={"k": ("t", "k")}), f"{tmp_path}/t", None, lambda n: known)
        assert rows == {"": 1000} and not any(n for _, _, n in ledger)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_appearances_of_few_players_lie_in_more_tasks_than_players(spark):
    """A player of very many appearances is dealt to several tasks, an unknown or missing one too; results are those of the plain join."""
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(k, v)
    try:
        games = spark.range(500).selectExpr("id AS game_key", "'EUROPE' AS competition_key", "1997 AS season_key", "DATE '1997-05-01' AS game_date")
        raw = spark.range(60_000).selectExpr(
            "CAST(id AS STRING) AS appearance_id", "CAST(id % 500 AS STRING) AS game_id", "CASE id % 3 WHEN 0 THEN '0' WHEN 1 THEN '7' END AS player_id", "'1' AS player_club_id",
            "'90' AS minutes_played", "'1' AS goals", "'0' AS assists", "'0' AS yellow_cards", "'0' AS red_cards",
        )
        players, club = spark.range(5).withColumnRenamed("id", "player_key"), F.broadcast(spark.range(3).withColumnRenamed("id", "club_key"))
        lineup = F.broadcast(typed.lineups(spark.createDataFrame([("3", "0", "substitutes")], "game_id string, player_id string, type string")))
        found = typed.appearances(raw, games, players, club, lineup)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) < 15_000  # with whole keys 20,000 at least
        said = {tuple(r) for r in found.groupBy("player_key", "is_valid", "data_quality_status").count().collect()}
        assert said == {(0, True, "valid", 20_000), (None, False, "missing_player_dimension", 40_000)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_stints_are_valued_in_more_tasks_not_larger_ones(spark, monkeypatch):
    few = sorted(map(str, Model(spark, SF).stints().collect()))
    monkeypatch.setattr(files, "TASK_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = Model(spark, SF).stints().select("entity_key", "stint_value")
        assert many.rdd.getNumPartitions() > 40
        assert sorted(map(str, Model(spark, SF).stints().collect())) == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_valuations_take_more_tasks_not_larger_ones(spark, monkeypatch):
    few = Model(spark, SF).valuations()
    monkeypatch.setattr(files, "TASK_ROWS", 100)
    many = Model(spark, SF).valuations()
    assert many.rdd.getNumPartitions() > 10 and sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_medians_of_overviews_gather_no_group(spark, monkeypatch, capsys):
    """The values of a group are cut into ranges; the figures are those of Spark's own median, of null groups and of no rows too."""
    monkeypatch.setattr(ranks, "FLOOR", 20)
    value = F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(500)))
    d = spark.range(4000).select((F.col("id") % 700).alias("entity_key"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), value.alias("value"), F.lit("1997-01-01").cast("date").alias("value_date"), F.lit(1997).alias("season_key"))
    whole, by = dashboard.overview(d, {}), dashboard.overview_by(d, {"season": 1997}, "g")
    for df in (whole, by):
        df.explain("extended")
        plan = capsys.readouterr().out
        assert "_tm_range" in plan and "percentile(" not in plan
    want = d.agg(F.count("*"), F.countDistinct("entity_key"), F.sum("value"), F.percentile("value", F.lit(0.5)), F.min("value_date"), F.max("value_date"))
    assert list(map(tuple, whole.collect())) == list(map(tuple, want.collect()))
    want = d.groupBy("g").agg(F.count("*"), F.sum("value"), F.percentile("value", F.lit(0.5)))
    assert sorted(map(str, map(tuple, by.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert [tuple(r) for r in dashboard.overview(d, {"season": 1}).collect()] == [(0, 0, None, None, None, None)]
    assert dashboard.overview_by(d, {"season": 1}, "g").collect() == []
