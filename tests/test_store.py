"""Builds that commit once, write only what changed, and refuse rows that break what a table declares."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.checksum import checksums, reconcile
from tidemark.plans import store
from tidemark.plans.bindings import Model
from tidemark.plans.store import Spec, Store, Violated

SF = "/root/testdata/sf0.001"


class Changed(Model):
    """The test model with one of its raw tables changed."""

    def __init__(self, spark, sf_dir, changes=None):
        super().__init__(spark, sf_dir)
        raw, changes = self.t, changes or {}
        self.t = lambda name: changes.get(name, lambda d: d)(raw(name))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    s = Store(spark, f"{tmp_path_factory.mktemp('model')}")
    s.build(Model(spark, SF))
    return s


def rows(df):
    return sorted(map(str, df.collect()))


def folders(s):
    return {f"{t}/{v}" for t in s.files.names(s.root) if t != "commits" for v in s.files.names(f"{s.root}/{t}")}


def test_built_tables_are_the_model(spark, built):
    m = Model(spark, SF)
    for name in ("stints", "seasons", "development", "transfers"):
        want = getattr(m, name)()
        got = built.table(name)
        assert got.columns == want.columns and rows(got) == rows(want)
    said = built.manifest()["tables"]
    assert sum(p["rows"] for p in said["stints"]["parts"].values()) == built.table("stints").count()


def test_equal_inputs_write_nothing(spark, built):
    before, version = folders(built), built.version()
    built.build(Model(spark, SF))
    assert built.version() == version and folders(built) == before


def test_equal_content_in_other_files_writes_no_table(spark, built, monkeypatch):
    before, version = folders(built), built.version()
    monkeypatch.setattr(store, "files_of", lambda m: "other times")
    built.build(Model(spark, SF))
    assert folders(built) == before and built.version() == version + 1


def test_a_changed_season_is_the_only_one_written(spark, built, monkeypatch):
    monkeypatch.setattr(store, "files_of", lambda m: "changed")
    late = F.col("l_orderkey").isin([r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").where("year(o_orderdate) = 1995").select("o_orderkey").limit(5).collect()])
    m = Changed(spark, SF, {"lineitem": lambda d: d.withColumn("l_quantity", F.when(late, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))})
    before = built.manifest()["tables"]
    after = built.build(m, ["seasons"])["tables"]
    for name in ("stints", "seasons"):
        assert {s for s, p in after[name]["parts"].items() if p != before[name]["parts"][s]} == {"1995"}
    assert after["valuations"] == before["valuations"] and after["entities"] == before["entities"]
    assert rows(built.table("seasons")) == rows(m.seasons())
    built.build(Model(spark, SF))
    assert rows(built.table("seasons")) == rows(Model(spark, SF).seasons())


def test_a_killed_build_leaves_the_old_model(spark, built, monkeypatch):
    monkeypatch.setattr(store, "files_of", lambda m: "killed")
    version, before, held = built.version(), rows(built.table("seasons")), built.manifest()
    m = Changed(spark, SF, {"orders": lambda d: d.withColumn("o_totalprice", F.col("o_totalprice") + 1)})
    monkeypatch.setattr(Model, "seasons", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        built.build(m)
    assert built.version() == version and built.manifest() == held and rows(built.table("seasons")) == before


def test_what_a_killed_process_left_is_swept(spark, built):
    spark.range(3).write.parquet(f"{built.root}/stints/v=999")
    held = folders(built)
    assert built.vacuum() == [f"{built.root}/stints/v=999"] or "stints/v=999" not in folders(built)
    assert folders(built) < held and built.table("stints").count() > 0


@pytest.mark.parametrize(("change", "check"), [
    ({"orders": lambda d: d.withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "2-HIGH", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))}, "value_not_negative"),
    ({"customer": lambda d: d.unionAll(d.limit(1))}, "key_is_unique"),
    ({"customer": lambda d: d.where("c_custkey % 2 > 0")}, "entity_key_is_in_entities"),
])
def test_a_bad_row_leaves_the_old_table(spark, built, monkeypatch, change, check):
    monkeypatch.setattr(store, "files_of", lambda m: f"bad {check}")
    version, before = built.version(), rows(built.table("valuations"))
    with pytest.raises(Violated) as e:
        built.build(Changed(spark, SF, change))
    assert {c for c, _, n in e.value.ledger if n} == {check}
    assert built.version() == version and rows(built.table("valuations")) == before


def test_checks_are_counted_while_writing(spark, built, tmp_path):
    """The plan that writes is the only one: no job but it reads the table."""
    d = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    tracker, group = spark.sparkContext.statusTracker(), "write-once"
    spark.sparkContext.setJobGroup(group, group)
    counts, ledger = built.write(d, Spec("t", (), key=("id",), holds={"small": "x < 6"}), f"{tmp_path}/t", None, lambda n: None)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts == {"": 1000} and dict((c, n) for c, _, n in ledger) == {"key_is_unique": 0, "key_has_no_null": 0, "small": 142}
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert len(tracker.getJobIdsForGroup(group)) <= 3 and len(set(stages)) <= 3


def test_ledger_is_published(built):
    found = built.ledger().collect()
    assert len(found) > 20 and all(r.status == "PASS" and r.actual == 0 for r in found)
    assert {"horizon_known", "key_is_unique", "entity_key_is_in_entities"} <= {r.check_name for r in found}


def test_checksums_do_not_depend_on_the_order(spark):
    d = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 2).alias("x"))
    one, other = checksums(d, ["id", "x"]).first(), checksums(d.repartition(7).orderBy(F.desc("id")), ["x", "id"]).first()
    assert one == other
    assert checksums(d.fillna(0), ["id", "x"]).first() != one and checksums(d.unionAll(d.limit(2)), ["id", "x"]).first() != one
    assert tuple(checksums(d.limit(0), ["id"]).first()) == (0, 0, 0)


def test_a_planted_difference_names_its_range(spark):
    d = spark.range(2000).select("id", (F.col("id") % 12).alias("period"), (F.col("id") * 3).alias("amount"))
    bad = d.withColumn("amount", F.when(F.col("id") == 31, 0).otherwise(F.col("amount"))).where("id <> 40").unionAll(d.where("id = 53"))
    got = {r.key_range: r for r in reconcile("t", d, bad, ["id", "amount"], F.col("period"), amounts={"paid": "amount"}).collect()}
    assert {k: r.status for k, r in got.items() if r.status != "MATCH"} == {"7": "DIFFERENT", "4": "SHORT", "5": "EXCESS"}
    assert got["7"].source_paid - got["7"].target_paid == 93 and len(got) == 12
    by_key = reconcile("t", d, bad, ["id", "amount"], key="id").where("status <> 'MATCH'").count()
    assert by_key == 3
