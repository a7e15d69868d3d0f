"""Tables of hashed buckets with versions.

A version is a small JSON file that lists, for each bucket, the folders that make it up. Data folders are written first and
never changed; then the next version's file is created under a name that must not exist, which is the commit. So a reader finds a
whole version at any moment, a writer that dies before its commit leaves the last version as it was, and of two writers one
gets ``Conflict``. Appending adds a folder to the buckets of the new rows; an upsert writes the buckets of its keys anew
and leaves all others alone.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.sources.tables import written

BUCKETS = 16
#: Age in seconds up to which files without a version are left to their writer.
RETENTION_S = 7 * 86400
#: Keys up to which a look-up is a filter, and beyond which a join.
FEW = 200


class Conflict(Exception):
    """Another writer has made this version."""


class Folder:
    """A folder in any of Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._spark = spark
        root = self._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = root.getFileSystem(self._conf)
        self.path = self.fs.makeQualified(root).toString()

    def at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self, pattern: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.globStatus(self.at(pattern)) or [])

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Makes a file with all of its text at once, or raises ``Conflict`` if the name is taken. Local disks do it by a hard link and
        HDFS by a rename that doesn't overwrite, both of which fail for all but one writer. An object store without such a rename
        needs a conditional put in its place."""
        aside = f".aside-{uuid.uuid4().hex}"
        self.fs.mkdirs(self.at(name).getParent())
        out = self.fs.create(self.at(aside), True)
        out.write(bytearray(text.encode()))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        try:
            if self.fs.getUri().getScheme() == "file":
                local = [self._jvm.java.io.File(self.at(x).toUri().getPath()).toPath() for x in (name, aside)]
                self._jvm.java.nio.file.Files.createLink(*local)
            else:
                none = self._spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
                fs.FileContext.getFileContext(self.at().toUri(), self._conf).rename(self.at(aside), self.at(name), none)
        except Exception as e:
            if self.exists(name):
                raise Conflict(f"{name} exists") from e
            raise
        finally:
            self.delete(aside)


class VersionedTable:
    """Rows with a ``key``, in buckets by the hash of ``bucket_by`` (the key, if not said)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", bucket_by: str | None = None, buckets: int = BUCKETS):
        self.spark, self.key, self.bucket_by, self.buckets = spark, key, bucket_by or key, buckets
        self.folder = Folder(spark, path)

    # versions

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.folder.names("_versions/v*.json")]

    def state(self, version: int | None = None) -> dict:
        """``version, buckets, schema, folders``; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "buckets": self.buckets, "schema": None, "folders": {}}
        return json.loads(self.folder.read(f"_versions/v{version:08d}.json"))

    def _commit(self, base: dict, schema: StructType, folders: dict[str, list[str]]) -> int:
        new = {"version": base["version"] + 1, "buckets": base["buckets"], "schema": json.loads(schema.json()), "folders": folders}
        self.folder.create(f"_versions/v{new['version']:08d}.json", json.dumps(new))
        return new["version"]

    # reading

    def _read(self, state: dict, names: list[str]) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.path}/{n}" for n in names])

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        if not state["version"]:
            raise ValueError(f"nothing at {self.folder.path}")
        return self._read(state, [f for b in sorted(state["folders"], key=int) for f in state["folders"][b]])

    def lookup(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """The rows whose ``bucket_by`` column has a value of ``wanted`` (a table with that column): only the folders of those buckets are read."""
        state = self.state(version)
        if not state["version"]:
            raise ValueError(f"nothing at {self.folder.path}")
        keys = wanted.select(self.bucket_by).distinct()
        buckets = [str(r.b) for r in keys.select(self._bucket(state).alias("b")).distinct().collect()]  # as many as there are buckets
        found = self._read(state, [f for b in buckets for f in state["folders"].get(b, [])])
        some = [r[0] for r in keys.limit(FEW + 1).collect()]
        if len(some) <= FEW:  # reaches the row groups' statistics and bloom filters
            return found.where(F.col(self.bucket_by).isin(some))
        return found.join(keys, self.bucket_by, "left_semi")

    # writing

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(self.bucket_by).cast("string")), F.lit(state["buckets"])).cast("int")

    def _write(self, state: dict, rows: DataFrame) -> dict[str, list[str]]:
        """Writes rows below a new folder; the folder of each bucket."""
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(state)).hint("rebalance", "_bucket")
        dealt.sortWithinPartitions("_bucket", self.bucket_by, self.key).write.option(f"parquet.bloom.filter.enabled#{self.bucket_by}", "true").partitionBy("_bucket").parquet(f"{self.folder.path}/{name}")
        return {n[len("_bucket=") :]: [f"{name}/{n}"] for n in self.folder.names(f"{name}/_bucket=*")}

    def append(self, rows: DataFrame) -> int:
        """Adds rows, whatever keys are there; returns the new version."""
        state = self.state()
        new = self._write(state, rows if state["schema"] is None else rows.select(*[f["name"] for f in state["schema"]["fields"]]))
        folders = {b: state["folders"].get(b, []) + new.get(b, []) for b in {*state["folders"], *new}}
        return self._commit(state, rows.schema if state["schema"] is None else StructType.fromJson(state["schema"]), folders)

    def overwrite(self, rows: DataFrame) -> int:
        state = self.state() | {"buckets": self.buckets}
        return self._commit(state, rows.schema, self._write(state, rows))

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Adds rows; those of a key that is there already take its place. Of new rows of one key, that with the greatest ``order``
        stays (of equal ones, any one)."""
        state = self.state()
        if not state["version"]:
            state["schema"] = json.loads(rows.schema.json())
        names = [f["name"] for f in state["schema"]["fields"]]
        last = Window.partitionBy(self.key).orderBy(F.col(order).desc() if order else F.xxhash64(*[F.col(f"`{n}`") for n in names]))
        new = rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(*names)
        new = written(new)  # read three times
        buckets = [str(r.b) for r in new.select(self._bucket(state).alias("b")).distinct().collect()]
        if self.bucket_by != self.key and state["folders"]:  # a key may have moved from another bucket
            keys = new.select(self.key)
            held = self.read().select(self.key, self.bucket_by).join(keys, self.key, "left_semi")
            buckets = sorted({*buckets, *[str(r.b) for r in held.select(self._bucket(state).alias("b")).distinct().collect()]})
        kept = self._read(state, [f for b in buckets for f in state["folders"].get(b, [])]).join(new.select(self.key), self.key, "left_anti")
        made = self._write(state, kept.unionByName(new))
        folders = {b: f for b, f in state["folders"].items() if b not in buckets} | made
        return self._commit(state, StructType.fromJson(state["schema"]), folders)

    def vacuum(self, keep: int = 1, retention_s: float = RETENTION_S) -> list[str]:
        """Deletes all but the last ``keep`` versions, and the data folders that no kept version names, unless they are younger than
        ``retention_s`` (a writer may be about to commit them, a reader may hold them). Returns the folders' names."""
        versions = self.versions()
        for v in versions[:-keep]:
            if self.folder.age(f"_versions/v{v:08d}.json") > retention_s:
                self.folder.delete(f"_versions/v{v:08d}.json")
        live = {f.split("/")[1] for v in self.versions() for fs in self.state(v)["folders"].values() for f in fs}
        gone = [n for n in self.folder.names("data/*") if n not in live and self.folder.age(f"data/{n}") > retention_s]
        for n in gone:
            self.folder.delete(f"data/{n}")
        return gone
