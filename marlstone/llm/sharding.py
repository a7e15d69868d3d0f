"""Sharding with size-tiered compaction and a versioned manifest, in DataFrame operations only.

* ``append`` writes an arrival as a small immutable shard, a folder of Parquet files; ``append_all`` writes many
  arrivals, told apart by a column, in one scan. Rows and bytes are counted by the job that writes.
* ``compact`` puts shards into tiers by the logarithm of their mean file size. ``fan_in`` shards or more of one
  tier are a run and are merged into one shard of target-sized files; this repeats until no tier holds a run.
  Files of ``SEALED`` of the target or more are never merged again, so a row is rewritten a bounded number of times.
  Merging joins whole input splits (no shuffle), so it costs one read and one write of the run.
* Every step commits a new manifest: a JSON list of the live shards, written aside and renamed to the next
  version's name. The rename fails if that version exists, so of two writers one commits and the other
  tries again on the new state. Readers name a version and never see a half-done step. This needs a file system
  whose rename is atomic (HDFS); Hadoop's local file system looks and then renames, so two writers on one local disk may both commit, and an
  object store needs a lock or a conditional put beside it.
* ``vacuum`` deletes shard folders that no kept version names. A writer puts a marker beside a folder before it writes
  and takes it away after its commit; marked folders stay, unless the marker is older than ``retention_s``, and so do
  the folders of versions, younger than that, which readers may hold.

The manifest has one entry per shard, not per row, and is all that passes the driver.

Defined results: empty arrivals commit no shard. Nulls, repeated rows and any columns are kept as they are;
all arrivals must have the columns of the first, and ``read`` replaces a column named shard. Sizes are the bytes of the
``size_col`` text plus 64 a row; a very long text is a row like any other (files are cut between rows). Shards of equal size are
ordered by number. A null arrival is one of its own.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import read_table, scratch_root

TARGET_BYTES = 64 << 20
FAN_IN = 4
TIER_RATIO = 4.0
LEAST_BYTES = 1 << 12
#: Share of the target size from which a file is left alone.
SEALED = 0.5
#: Age in seconds up to which markers hold and old versions stay readable.
RETENTION_S = 7 * 86400
#: Arrivals into which the query deals the documents.
ARRIVALS = 8


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, size_col: str = "text"):
        self.spark, self.target_bytes, self.fan_in, self.size_col = spark, target_bytes, fan_in, size_col
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folder = self._jvm.org.apache.hadoop.fs.Path(path)
        self.path = folder.getFileSystem(self._conf).makeQualified(folder).toString()

    # manifests

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._file("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        found = self._fs().globStatus(self._file("manifest-*.json")) or []
        return sorted(int(x.getPath().getName()[9:-5]) for x in found)

    def manifest(self, version: int | None = None) -> dict:
        """``version, next, shards``; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "next": 1, "shards": []}
        stream = self._fs().open(self._file(f"manifest-{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], next_: int) -> dict:
        new = {"version": base["version"] + 1, "next": next_, "shards": sorted(shards, key=lambda s: s["shard"])}
        aside, to = self._file(f".aside-{uuid.uuid4().hex}"), self._file(f"manifest-{new['version']:08d}.json")
        out = self._fs().create(aside, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        try:
            fs.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, to, self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
        except Exception as e:
            self._fs().delete(aside, False)
            if self._fs().exists(to):
                raise Conflict(f"version {new['version']} exists") from e
            raise
        return new

    # data

    def _weight(self, df: DataFrame) -> Column:
        return F.coalesce(F.octet_length(self.size_col), F.lit(0)).cast("long") + 64 if self.size_col in df.columns else F.lit(64).cast("long")

    def _mark(self) -> str:
        """A new folder's name, marked as being written."""
        name = uuid.uuid4().hex
        self._fs().create(self._file(f"pending/{name}"), True).close()
        return name

    def _unmark(self, names: list[str]) -> None:
        for n in names:
            self._fs().delete(self._file(f"pending/{n}"), False)

    def _n_files(self, folder: str) -> int:
        return len(self._fs().globStatus(self._file(f"{folder}/*.parquet")) or [])

    def append(self, df: DataFrame, label: str | None = None) -> dict:
        """Adds an arrival and commits; returns the new manifest."""
        return self._append(df, None, [None], lambda _: label)

    def append_all(self, df: DataFrame, arrival: Column, values: list) -> dict:
        """Adds the rows of each listed value of ``arrival`` as a shard of its own, all in one scan; returns the manifest."""
        return self._append(df, arrival, values, lambda v: f"arrival {v}")

    def _append(self, df: DataFrame, arrival: Column | None, values: list, label) -> dict:
        name, seen, weight = self._mark(), Observation(), self._weight(df)
        mine = [F.lit(True) if arrival is None else arrival.eqNullSafe(F.lit(v)) for v in values]
        counts = [c for i, m in enumerate(mine) for c in (F.count_if(m).alias(f"n{i}"), F.coalesce(F.sum(F.when(m, weight)), F.lit(0)).alias(f"b{i}"))]
        watched = df.observe(seen, *counts)
        if arrival is None:
            watched.write.parquet(f"{self.path}/shards/{name}")
        else:
            at = F.coalesce(*[F.when(m, F.lit(i)) for i, m in enumerate(mine)])
            watched.withColumn("_arrival", at).where("_arrival is not null").write.partitionBy("_arrival").parquet(f"{self.path}/shards/{name}")
        got, new = seen.get, []
        for i, v in enumerate(values):
            if got[f"n{i}"]:
                folder = f"shards/{name}" if arrival is None else f"shards/{name}/_arrival={i}"
                new.append({"folder": folder, "rows": got[f"n{i}"], "bytes": got[f"b{i}"], "files": self._n_files(folder), "from": label(v)})
        if not new:
            self._fs().delete(self._file(f"shards/{name}"), True)
        while new:
            base = self.manifest()
            shards = [{**s, "shard": base["next"] + k, "from": [s["from"] or str(base["next"] + k)]} for k, s in enumerate(new)]
            try:
                self._commit(base, [*base["shards"], *shards], base["next"] + len(shards))
                break
            except Conflict:
                continue
        self._unmark([name])
        return self.manifest()

    def tier(self, shard: dict) -> int:
        """The logarithm of the mean file size."""
        return max(0, math.floor(math.log(max(shard["bytes"] / max(1, shard["files"]), LEAST_BYTES) / LEAST_BYTES, TIER_RATIO)))

    def sealed(self, shard: dict) -> bool:
        return shard["bytes"] >= SEALED * self.target_bytes * shard["files"]

    def runs(self, manifest: dict) -> list[list[dict]]:
        """Runs that are due, smallest tier first."""
        tiers: dict[int, list[dict]] = {}
        for s in manifest["shards"]:
            if not self.sealed(s):
                tiers.setdefault(self.tier(s), []).append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in]

    def compact(self) -> dict:
        """Merges runs until none is due; returns the manifest."""
        while True:
            base = self.manifest()
            due = self.runs(base)
            if not due:
                return base
            run, name = due[0], self._mark()
            n_bytes, folder = sum(s["bytes"] for s in run), f"shards/{name}"
            merged = self.spark.read.parquet(*[f"{self.path}/{s['folder']}" for s in run])
            merged.coalesce(max(1, math.ceil(n_bytes / self.target_bytes))).write.parquet(f"{self.path}/{folder}")
            gone = {s["shard"] for s in run}
            new = {
                "shard": base["next"], "folder": folder, "rows": sum(s["rows"] for s in run), "bytes": n_bytes, "files": self._n_files(folder),
                "from": [x for s in run for x in s["from"]],
            }
            try:
                self._commit(base, [*(s for s in base["shards"] if s["shard"] not in gone), new], base["next"] + 1)
            except Conflict:
                self._fs().delete(self._file(folder), True)
            self._unmark([name])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with the column ``shard``; None for the empty store."""
        shards = self.manifest(version)["shards"]
        if not shards:
            return None
        df = self.spark.read.parquet(*[f"{self.path}/{s['folder']}" for s in shards])
        of = F.create_map(*[F.lit(x) for s in shards for x in (s["folder"], s["shard"])])
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"(shards/[^/]+(?:/_arrival=[^/]+)?)/[^/]+$", 1)
        return df.withColumn("shard", of[F.replace(folder, F.lit("%3D"), F.lit("="))].cast("long"))

    def vacuum(self, retention_s: float = RETENTION_S) -> int:
        """Deletes folders that no version of the last ``retention_s`` seconds, nor the newest, names; returns how many.

        Folders are listed before markers, and markers before manifests: a folder without a marker has been committed by
        then, or given up."""
        fs, oldest = self._fs(), (time.time() - retention_s) * 1000
        listed = [x.getPath().getName() for x in fs.globStatus(self._file("shards/*")) or []]
        marked = {x.getPath().getName() for x in fs.globStatus(self._file("pending/*")) or [] if x.getModificationTime() > oldest}
        found = sorted((x.getPath().getName(), x.getModificationTime()) for x in fs.globStatus(self._file("manifest-*.json")) or [])
        held = [n for k, (n, _) in enumerate(found) if k + 1 == len(found) or found[k + 1][1] > oldest]  # a version lives until the next one
        live = {s["folder"].split("/")[1] for n in held for s in self.manifest(int(n[9:-5]))["shards"]}
        n = 0
        for name in listed:
            if name not in live and name not in marked:
                n += bool(fs.delete(self._file(f"shards/{name}"), True))
        return n


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in arrivals, compacted; per document its arrival, its shard and that shard's tier, rows and bytes."""
    docs = read_table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{scratch_root(spark)}/marlstone/store-{uuid.uuid4().hex}")
    arrival = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)).cast("int")
    store.append_all(docs, arrival, list(range(ARRIVALS)))
    manifest = store.compact()
    rows = store.read()
    if rows is None:
        return docs.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("arrival", "shard", "tier", "shard_rows", "shard_bytes")])
    facts = F.create_map(*[x for s in manifest["shards"] for x in (F.lit(s["shard"]).cast("long"), F.array(*[F.lit(v).cast("long") for v in (store.tier(s), s["rows"], s["bytes"])]))])
    return rows.select("doc_id", arrival.cast("long").alias("arrival"), "shard", *[facts[F.col("shard")][k].alias(c) for k, c in enumerate(("tier", "shard_rows", "shard_bytes"))])
