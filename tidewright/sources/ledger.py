"""The ledger as immutable Parquet files that a manifest makes visible: a step's effects appear together, once."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{label}/{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix=f"tidewright-{label}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


class Ledger:
    """Tables of a ledger folder.

    commit() stages every table's rows of a step in files of their own, then writes the step's manifest under a
    temporary name and renames it: before the rename nothing is visible, after it everything is. A step that is
    committed already is left alone, so a replay after a crash at any point leaves its effects exactly once. That of
    two writers of one step only one wins rests on a rename that fails when its target is there, as file systems have
    it; a store without such a rename needs a single writer.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, step: str) -> str:
        return f"{self.path}/manifests/{step}.json"

    def steps(self) -> list[str]:
        """Committed steps, in the order of their names."""
        at = self._path(f"{self.path}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(s.getPath().getName()[:-5] for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))

    def stage(self, step: str, effects: dict[str, DataFrame]) -> dict[str, str]:
        """Writes a step's rows by table, invisible yet, and returns where they are."""
        places = {}
        for table, rows in effects.items():
            places[table] = f"data/{table}/{step}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{places[table]}")
        return places

    def commit(self, step: str, effects: dict[str, DataFrame]) -> bool:
        """True if this call made the step's effects visible."""
        if self._fs.exists(self._path(self._manifest(step))):
            return False
        places = self.stage(step, effects)
        return self._tell(step, [{"step": step, "table": t, "place": p} for t, p in places.items()])

    def kept(self, label: str, rows: DataFrame) -> DataFrame:
        """rows written aside and read again: what a commit works on stays the same however often it is read, and no lineage grows. forget() deletes it."""
        place = f"{self.path}/aside/{label}-{uuid.uuid4().hex}"
        rows.write.parquet(place)
        return self.spark.read.schema(rows.schema).parquet(place)

    def forget(self, label: str) -> None:
        """Deletes what was written aside under labels that begin so."""
        at = self._path(f"{self.path}/aside")
        if self._fs.exists(at):
            for s in self._fs.listStatus(at):
                if s.getPath().getName().startswith(f"{label}-"):
                    self._fs.delete(s.getPath(), True)

    def rewrite(self, step: str, tables: dict[str, DataFrame]) -> bool:
        """Replaces all that some tables have now by rows, as one commit: its manifest names the new files and the places that they stand for. Readers see all of the one or all of the other; the old files are deleted last, as the rows may be made of them. False if the step was there already."""
        if self._fs.exists(self._path(self._manifest(step))):
            return False
        old = {name: self._places(name) for name in tables}
        places = self.stage(step, tables)
        done = self._tell(step, [{"step": step, "table": name, "place": place, "drops": old[name]} for name, place in places.items()])
        for p in [p for ps in old.values() for p in ps] if done else ():
            self._fs.delete(self._path(f"{self.path}/{p}"), True)
        return done

    def _places(self, name: str) -> list[str]:
        told = self._manifests()
        found = [] if told is None else told.where(F.col("table") == name).select("place", "drops").collect()
        gone = {p for r in found for p in r["drops"] or ()}
        return sorted({r["place"] for r in found} - gone)

    def _tell(self, step: str, lines: list[dict]) -> bool:
        temporary = f"{self.path}/manifests/.{step}-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(temporary))
        out.write(bytearray("\n".join(json.dumps(x, sort_keys=True) for x in lines).encode()))
        out.close()
        # A rename onto a name that is there fails: of two writers of a step one wins.
        return bool(self._fs.rename(self._path(temporary), self._path(self._manifest(step))))

    def _read(self, places: list[str], schema: str) -> DataFrame:
        found = [f"{self.path}/{p}" for p in places]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _manifests(self) -> DataFrame | None:
        """All manifests as one table (step, table, place), read in one job however many steps there are."""
        at = self._path(f"{self.path}/manifests")
        if not self._fs.exists(at) or not any(s.getPath().getName().endswith(".json") for s in self._fs.listStatus(at)):
            return None
        return self.spark.read.schema("step string, table string, place string, drops array<string>").option("pathGlobFilter", "*.json").json(f"{self.path}/manifests")

    def table(self, name: str, schema: str) -> DataFrame:
        """All committed rows of a table."""
        return self._read(self._places(name), schema)

    def of(self, step: str, name: str, schema: str) -> DataFrame:
        """The rows of a table that one committed step wrote."""
        text = "\n".join(r[0] for r in self.spark.read.text(self._manifest(step)).collect())
        return self._read([x["place"] for x in map(json.loads, text.splitlines()) if x["table"] == name], schema)
