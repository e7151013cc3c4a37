"""Sharding: small immutable arrivals, size-tiered compaction, atomically committed manifests.

A store is a folder with Parquet shards that never change, lists of at most ``LISTED`` shards
that never change either, and numbered manifests that name the live lists. A commit writes
the lists it changes and a manifest, not the whole table of shards. ``append`` writes arrivals
as small shards and commits a manifest with them. ``compact`` takes shards of one size tier (each tier is ``FAN_IN`` times the one below),
in order of arrival, and merges runs of at least FAN_IN of them into files of at most the
target size, until no tier has such a run; every round commits one manifest. A reader
opens one manifest and sees exactly its shards, whatever happens meanwhile.

Merging never shuffles: a merged file is one task that reads its shards one after the other
(the larger ones first), and up to ``MERGES_AT_ONCE`` merges are one job. A commit writes the manifest under a
name of its own and gives it the next number in one step that fails if the number is taken (a
hard link on a local file system, elsewhere a rename, which HDFS refuses on an existing
name; stores whose renames overwrite need one writer at a time); then it starts again from
the other writer's manifest. Shards left by a failed job are in no manifest and ``vacuum``
removes them. What reaches the driver is the list of shards: about 200 bytes a shard.

Defined results: all rows and columns are kept as they are (nulls, repeated rows, any
columns); an empty table commits a manifest without new shards.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder, table

ARRIVAL_ROWS = 2000
TARGET_BYTES = 64 << 20
FAN_IN = 4
TIER_BASE = 1 << 20
#: Merges that run side by side and are committed together.
MERGES_AT_ONCE = 256
#: Shards of a list.
LISTED = 4096
#: Arrivals that the query deals the table out to.
ARRIVALS = 4


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    bytes: int
    sequence: int  # of its first arrival

    def tier(self, base: int, fan_in: int) -> int:
        tier, size = 0, self.bytes
        while size >= base * fan_in:
            tier, size = tier + 1, size // fan_in
        return tier


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{folder}/manifests"))

    # manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n[0] == "v" and n.endswith(".json"))

    def _load(self, name: str) -> dict | list:
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, name: str, body: dict | list) -> None:
        out = self._fs.create(self._path(f"{self.folder}/manifests/{name}"), False)
        out.write(json.dumps(body, sort_keys=True).encode())
        out.close()

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, next (sequence number), lists (names)."""
        if version is None:
            have = self.versions()
            if not have:
                return {"version": 0, "schema": None, "next": 0, "lists": []}
            version = have[-1]
        return self._load(f"v{version:08d}.json")

    def _listed(self, name: str) -> list[Shard]:
        return [Shard(**s) for s in self._load(name)]

    def shards(self, version: int | None = None) -> list[Shard]:
        return sorted((s for name in self.manifest(version)["lists"] for s in self._listed(name)), key=lambda s: (s.sequence, s.path))

    def _publish(self, body: dict) -> None:
        """Gives the manifest its number; a Conflict if another has it."""
        temp, target = f".{uuid.uuid4().hex}", f"v{body['version']:08d}.json"
        self._save(temp, body)
        old, new = (self._path(f"{self.folder}/manifests/{n}") for n in (temp, target))
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(old.toUri().getPath(), new.toUri().getPath())
            elif self._fs.exists(new) or not self._fs.rename(old, new):
                raise FileExistsError(target)
        except FileExistsError:
            raise Conflict(f"version {body['version']} is there already") from None
        finally:
            self._fs.delete(old, False)

    def _commit_change(self, gone: set[str], new: list[Shard], schema: str | None, renumber: bool) -> int:
        while True:
            base = self.manifest()
            lists = {name: self._listed(name) for name in base["lists"]} if gone else dict.fromkeys(base["lists"], ())
            if gone - {s.path for have in lists.values() for s in have}:
                raise Conflict("a shard to be merged is no longer live")
            touched = [name for name, have in lists.items() if any(s.path in gone for s in have)]
            rest = [s for name in touched for s in lists[name] if s.path not in gone]
            following = base["next"] + len(new) * renumber
            added = [Shard(s.path, s.bytes, base["next"] + k) for k, s in enumerate(new)] if renumber else new
            live = sorted(rest + added, key=lambda s: (s.sequence, s.path))
            names = []
            for at in range(0, len(live), LISTED):
                names.append(f"list-{uuid.uuid4().hex}.json")
                self._save(names[-1], [asdict(s) for s in live[at : at + LISTED]])
            body = {"version": base["version"] + 1, "schema": schema or base["schema"], "next": following, "lists": [n for n in base["lists"] if n not in touched] + names}
            try:
                self._publish(body)
                return body["version"]
            except Conflict:
                for name in names:
                    self._fs.delete(self._path(f"{self.folder}/manifests/{name}"), False)

    # data

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """Part files of a written folder and their sizes, in order of their tasks."""
        found = [(f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(self._path(f"{self.folder}/{folder}"))]
        return sorted((f"{folder}/{n}", size) for n, size in found if n.startswith("part-"))

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(f"{self.folder}/{folder}")
        new = [Shard(p, size, 0) for p, size in self._files(folder)]
        return self._commit_change(set(), new, df.schema.json(), True)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        paths = [f"{self.folder}/{s.path}" for name in m["lists"] for s in self._listed(name)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def plan(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN, base: int = TIER_BASE) -> list[list[Shard]]:
        """Runs to be merged now: of one tier, in order, at least fan_in shards, at most the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards():
            if s.bytes < target // 2:
                tiers.setdefault(s.tier(base, fan_in), []).append(s)
        out = []
        for tier in sorted(tiers):
            run, size = [], 0
            for s in tiers[tier]:
                if size + s.bytes > target:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.bytes
            out.append(run)
        return [r for r in out if len(r) >= fan_in or len(r) > 1 and sum(s.bytes for s in r) > target // 2]

    def _merge(self, runs: list[list[Shard]], schema: T.StructType) -> list[Shard]:
        """A file of each run's shards; one job, one task a file. A run without rows gives no file."""
        folder, name = f"data/{uuid.uuid4().hex}", "spark.sql.unionOutputPartitioning"
        before = self.spark.conf.get(name, "true")
        self.spark.conf.set(name, "false")  # else single partitions are united into one
        try:
            parts = [self.spark.read.schema(schema).parquet(*(f"{self.folder}/{s.path}" for s in run)).coalesce(1) for run in runs]
            reduce(DataFrame.unionAll, parts).write.parquet(f"{self.folder}/{folder}")
        finally:
            self.spark.conf.set(name, before)
        made = self._files(folder)
        task = [int(path.rpartition("/")[2].split("-")[1]) for path, _ in made]  # part-<task>-...
        if len(set(task)) < len(task) or any(k >= len(runs) for k in task):
            raise RuntimeError(f"{folder}: not one file a run")
        return [Shard(path, size, runs[k][0].sequence) for k, (path, size) in zip(task, made, strict=True)]

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN, base: int = TIER_BASE) -> int:
        """Rounds of merges until no tier has a run; gives the number of the last manifest."""
        m = self.manifest()
        while runs := self.plan(target, fan_in, base):
            schema = T.StructType.fromJson(json.loads(m["schema"]))
            for at in range(0, len(runs), MERGES_AT_ONCE):
                part = runs[at : at + MERGES_AT_ONCE]
                self._commit_change({s.path for run in part for s in run}, self._merge(part, schema), None, False)
        return self.manifest()["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes shards that none of the last ``keep`` manifests lists, and older manifests."""
        have = self.versions()
        live = {s.path for v in have[-keep:] for s in self.shards(v)}
        gone = 0
        if self._fs.exists(self._path(f"{self.folder}/data")):
            for d in self._fs.listStatus(self._path(f"{self.folder}/data")):
                name = f"data/{d.getPath().getName()}"
                for p, _ in self._files(name):
                    if p not in live:
                        self._fs.delete(self._path(f"{self.folder}/{p}"), False)
                        gone += 1
        listed = {name for v in have[-keep:] for name in self.manifest(v)["lists"]}
        for v in have[:-keep]:
            for name in self.manifest(v)["lists"]:
                if name not in listed:
                    self._fs.delete(self._path(f"{self.folder}/manifests/{name}"), False)
            self._fs.delete(self._path(f"{self.folder}/manifests/v{v:08d}.json"), False)
        return gone


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document of all arrivals as the compacted store holds it: doc_id, text_md5, arrival, fits (its file is within the target size) and settled (its file is in the version read and no tier has a run to merge)."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").withColumn("arrival", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)))
    for k in range(ARRIVALS):  # together all rows
        store.append(docs.where(F.col("arrival") == k))
    version = store.compact()
    store.vacuum()
    settled = not store.plan() and {s.path for s in store.shards(version)} == {s.path for s in store.shards()}
    rows = store.read(version)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "arrival", (F.col("_metadata.file_size") <= TARGET_BYTES).alias("fits"), F.lit(settled).alias("settled"))


OP4_SQL = "SELECT doc_id, md5(text) AS text_md5, coalesce(doc_id, 0) % 4 AS arrival, true AS fits, true AS settled FROM documents"
