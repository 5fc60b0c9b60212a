"""The model as tables that are committed together: all of a build or nothing of it.

Every build writes into folders of its own and ends by renaming one manifest into
place; readers follow the highest manifest, so a build that is killed leaves the
old model as it was. A table, or a season of a table, whose inputs and parameters
are those of the last build is not written again: its key is a checksum of what it
is made from.

A table declares what must hold of it. The pass that writes it counts what
violates that, and on a violation nothing is committed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checksum import checksums
from .bindings import Model

#: Goes into every key: raise it when the meaning of a table changes.
REVISION = 2


class Violated(Exception):
    """A table breaks what it declares; ``ledger`` has (check_name, table_name, violations) of every check that was counted."""

    def __init__(self, ledger: list[tuple[str, str, int]]):
        super().__init__("; ".join(f"{t}.{c}: {n} rows" for c, t, n in ledger if n))
        self.ledger = ledger


@dataclass(frozen=True)
class Spec:
    """A table: ``key`` is unique and has no nulls, ``holds`` maps names to SQL that no row makes false, ``refers`` maps a column to (table, column)."""

    name: str
    inputs: tuple[str, ...]
    needs: tuple[str, ...] = ()
    by_season: bool = False
    key: tuple[str, ...] = ()
    holds: dict[str, str] = field(default_factory=dict)
    refers: dict[str, tuple[str, str]] = field(default_factory=dict)


SEASON_KEY = ("entity_key", "competition_key", "season_key")
#: In the order of their needs. ``inputs`` are frames of the model that are checksummed; those by season count up to the season.
SPECS = (
    Spec("entities", ("entities",), key=("entity_key",), holds={"named": "entity_name <> ''"}),
    Spec("clubs", ("clubs",), key=("club_key",)),
    Spec("valuations", ("valuations", "entities"), key=("entity_key", "valuation_date"), holds={"value_not_negative": "market_value >= 0"}, refers={"entity_key": ("entities", "entity_key")}, needs=("entities",)),
    Spec("stints", ("stint_sums", "valuations", "entities"), ("entities", "valuations"), True, ("entity_key", "club_key", "competition_key", "season_key"),
        {"value_not_after_stint": "stint_value_date <= last_date", "rows_add_up": "valid_appearances + rejected_rows <= appearance_rows", "minutes_not_negative": "minutes_played >= 0"},
        {"entity_key": ("entities", "entity_key")}),
    Spec("seasons", ("stint_sums", "valuations", "entities"), ("stints", "valuations", "entities"), True, SEASON_KEY, {"value_not_after_season": "value_date <= season_end_date", "share_of_starts": "start_rate BETWEEN 0 AND 1"}, {"entity_key": ("entities", "entity_key")}),
    Spec("kpi", ("stint_sums", "valuations", "entities"), ("valuations",), True, SEASON_KEY, {"peak_not_below_value": "peak_value >= value", "peak_not_after_season": "peak_value_date <= season_end_date"}),
    Spec("scores", ("stint_sums", "valuations", "entities"), ("kpi",), True, SEASON_KEY, {"scored": "score IS NOT NULL", "share_in_range": "efficiency_pct > 0 AND efficiency_pct <= 100"}),
    Spec("development", ("stint_sums", "valuations", "entities"), ("kpi",), False, ("entity_key", "season_key"), {"gap_is_positive": "season_gap > 0"}),
    Spec("transfers", ("raw_transfers", "valuations"), ("valuations",), False, ("transfer_key",), {"value_not_after_transfer": "matched_date <= transfer_date"}),
    Spec("outcomes", ("raw_transfers", "valuations", "entities"), ("transfers", "valuations", "entities"), False, ("transfer_key", "horizon_months"),
        {"horizon_known": "horizon_months IN (6, 12, 24)", "post_value_after_transfer": "post_date > transfer_date", "post_value_by_target": "post_date <= target_date", "target_at_horizon": "target_date = add_months(transfer_date, horizon_months)"}),
)
#: The column that tells the season of a row, of the frames that have one.
SEASON_OF = {"stint_sums": "season_key", "valuations": "year(valuation_date)"}


class Files:
    """The few file operations of a commit, on whatever store Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.fs.exists(self.path(p)) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, p: str, text: str) -> None:
        """The file ``p`` at once, or an error if it exists."""
        stream = self.fs.create(self.path(p + ".new"), True)
        stream.write(text.encode())
        stream.close()
        if self.fs.exists(self.path(p)) or not self.fs.rename(self.path(p + ".new"), self.path(p)):
            raise FileExistsError(p)

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


def digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


class Store:
    """A folder of committed tables: ``build`` brings it up to date, ``table`` reads what the last commit holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    # Commits ------------------------------------------------------------------------------------------------------
    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        found = [n for n in self.files.names(f"{self.root}/commits") if n.endswith(".json")]
        return int(found[-1].removesuffix(".json")) if found else 0

    def manifest(self) -> dict:
        v = self.version()
        return json.loads(self.files.read(f"{self.root}/commits/{v:08d}.json")) if v else {"tables": {}, "ledger": [], "files": None}

    def commit(self, manifest: dict) -> None:
        self.files.put(f"{self.root}/commits/{self.version() + 1:08d}.json", json.dumps(manifest, sort_keys=True))

    def table(self, name: str, seasons: Iterable | None = None, manifest: dict | None = None) -> DataFrame:
        """The committed table, of these seasons alone if they are given."""
        said = (manifest or self.manifest())["tables"][name]
        chosen = None if seasons is None else {str(s) for s in seasons}
        parts = [p for s, p in said["parts"].items() if p["path"] and (chosen is None or s in chosen)]
        schema = T.StructType.fromJson(said["schema"])
        if not parts:
            return self.spark.createDataFrame([], schema)
        wide = T.StructType([*schema.fields, T.StructField("v", T.IntegerType())])
        rows = self.spark.read.schema(wide).option("basePath", f"{self.root}/{name}").parquet(*[p["path"] for p in parts])
        return rows.select(*[f.name for f in schema.fields])

    def ledger(self) -> DataFrame:
        """The published audit: what each table's writing pass counted. check_name, table_name, expected, actual, status."""
        rows = [(c, t, 0, n, "PASS" if n == 0 else "FAIL") for c, t, n in self.manifest()["ledger"]]
        return self.spark.createDataFrame(rows, "check_name string, table_name string, expected bigint, actual bigint, status string")

    def vacuum(self) -> list[str]:
        """Deletes the folders that the last commit doesn't name, as of builds that were killed; gives their paths."""
        held = {p["path"].split("/season_key=")[0] for t in self.manifest()["tables"].values() for p in t["parts"].values() if p["path"]}
        lost = [f"{self.root}/{t}/{v}" for t in self.files.names(self.root) if t != "commits" for v in self.files.names(f"{self.root}/{t}") if f"{self.root}/{t}/{v}" not in held]
        for p in lost:
            self.files.delete(p)
        return lost

    # Writing ------------------------------------------------------------------------------------------------------
    def write(self, df: DataFrame, spec: Spec, path: str, seasons: list | None, parent: Callable[[str], DataFrame]) -> tuple[dict, list[tuple[str, str, int]]]:
        """Writes ``df``; counts rows and violations in the same pass. (rows by season, or under '' of all; the ledger's rows)."""
        kept, checks = df.columns, {}
        # References first: rows that lie by a column of the key are not shuffled again to count its repeats.
        for column, (table, key) in spec.refers.items():
            known = parent(table).select(F.col(key).alias(f"_tm_{column}")).distinct()
            df = df.join(known, F.col(column) == F.col(f"_tm_{column}"), "left")
            checks[f"{column}_is_in_{table}"] = F.count_if(F.col(column).isNotNull() & F.col(f"_tm_{column}").isNull())
        if spec.key:
            empty = " OR ".join(f"`{k}` IS NULL" for k in spec.key)
            df = df.withColumn("_tm_nth", F.row_number().over(Window.partitionBy(*spec.key).orderBy(spec.key[0])))
            checks["key_is_unique"] = F.count_if(F.col("_tm_nth") > 1)
            checks["key_has_no_null"] = F.count_if(F.expr(empty))
        for name, holds in spec.holds.items():
            checks[name] = F.count_if(~F.expr(holds))
        rows = {"": F.count(F.lit(1))} if seasons is None else {str(s): F.count_if(F.col("season_key") == s) for s in seasons}
        seen = Observation(f"{spec.name}-{digest(path)}")
        df = df.observe(seen, *[c.alias(f"check {n}") for n, c in checks.items()], *[c.alias(f"rows {n}") for n, c in rows.items()]).select(*kept)
        if seasons is None:
            df.write.parquet(path)
        else:
            # A season has a file of each task: the rows are not shuffled again for larger ones.
            df.write.partitionBy("season_key").parquet(path)
        got = seen.get
        return {n: got[f"rows {n}"] for n in rows}, [(n, spec.name, got[f"check {n}"]) for n in checks]

    def build(self, m: Model, need: Iterable[str] | None = None) -> dict:
        """Brings the tables in ``need`` (all if None), and what they need, up to date; gives the manifest then current.

        Seasons of a table are written again where the sums of their stints, the
        valuations up to them, the entities or the parameters changed.
        """
        wanted = self._with_needs({s.name for s in SPECS} if need is None else set(need))
        before = self.manifest()
        files = files_of(m)
        if before["files"] == files and wanted <= set(before["tables"]):
            return before
        own, written = m.copy(), []
        sums, params, version = Sums(own), asdict(m.p), self.version() + 1
        now = {"tables": dict(before["tables"]), "ledger": list(before["ledger"])}
        # Tables that this build leaves alone may be older than the files.
        now["files"] = files if wanted >= set(before["tables"]) or before["files"] == files else None
        try:
            for spec in SPECS:
                if spec.name not in wanted:
                    continue
                known = before["tables"].get(spec.name)
                had, keys = (known or {"parts": {}})["parts"], sums.keys(spec, params)
                stale = [s for s, k in keys.items() if had.get(s, {}).get("key") != k]
                now["tables"][spec.name] = {"schema": known and known["schema"], "parts": {s: had[s] for s in keys if s not in stale}}
                if stale or not known:
                    seasons = sorted(map(int, stale)) if spec.by_season else None
                    part = own if seasons is None else own.of_seasons(seasons, lambda n: self.table(n, seasons, now))
                    df, path = getattr(part, spec.name)(), f"{self.root}/{spec.name}/v={version}"
                    written.append(path)
                    self.files.delete(path)  # of a build that was killed
                    rows, ledger = self.write(df, spec, path, seasons, lambda n: self.table(n, manifest=now))
                    if any(n for _, _, n in ledger):
                        raise Violated(ledger)
                    at = lambda s: path if seasons is None else f"{path}/season_key={s}"
                    fresh = {s: {"key": keys[s], "rows": rows[s], "path": at(s) if rows[s] or seasons is None else None} for s in stale}
                    now["tables"][spec.name] = {"schema": df.schema.jsonValue(), "parts": now["tables"][spec.name]["parts"] | fresh}
                    now["ledger"] = [x for x in now["ledger"] if x[1] != spec.name] + [list(x) for x in ledger]
                own._made[spec.name] = self.table(spec.name, manifest=now)
            if now != before:
                self.commit(now)
        except BaseException:
            for p in written:
                self.files.delete(p)
            raise
        return now

    @staticmethod
    def _with_needs(names: set[str]) -> set[str]:
        needs, size = {s.name: s.needs for s in SPECS}, -1
        while size != len(names):
            size, names = len(names), names | {x for n in names for x in needs[n]}
        return names


class Sums:
    """Checksums of a model's frames, each computed once, and the keys of tables that follow from them."""

    def __init__(self, m: Model):
        self.m, self._known = m, {}

    def of(self, frame: str) -> dict[str, str]:
        """season (or '') -> checksum. A season has one row, so the driver holds as many rows as there are seasons."""
        if frame not in self._known:
            df = getattr(self.m, frame)()
            by = F.expr(SEASON_OF[frame]) if frame in SEASON_OF else None
            rows = checksums(df, df.columns, by).collect()
            self._known[frame] = {(r["key_range"] or "" if by is not None else ""): digest(r["row_count"], r["xor"], str(r["total"])) for r in rows}
        return self._known[frame]

    def keys(self, spec: Spec, params: dict) -> dict[str, str]:
        seasons = sorted(s for s in self.of("stint_sums") if s) if spec.by_season else [""]
        out = {}
        for s in seasons:
            seen = {}
            for frame in spec.inputs:
                have = self.of(frame)
                if s and frame == "stint_sums":
                    seen[frame] = have[s]
                elif s and frame == "valuations":
                    seen[frame] = [have[y] for y in sorted(have) if y <= s]
                else:
                    seen[frame] = sorted(have.items())
            out[s] = digest(REVISION, spec.name, params, seen)
        return out


#: The raw tables that the model reads.
RAW = ("customer", "nation", "region", "supplier", "orders", "lineitem")


def files_of(m: Model) -> str:
    """A digest of the names, sizes and times of the files that the model reads, by their listing alone, and of its parameters."""
    out = []
    for name in RAW:
        listed = m.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{m.sf_dir}/{name}.parquet")
        out.append([name, *listed.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()])
    return digest(REVISION, asdict(m.p), out)
