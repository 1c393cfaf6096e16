"""A table in versions: a log that says which files are live, snapshots of any version, and files that are put together again.

Every change is one entry of the log, a JSON file that is created only if it isn't there yet, so that of two writers of a
version one fails and may try again. An entry names the files that it adds, with their bucket, and those that it takes away;
executors write and read the rows. A batch has a name, and a name that the log knows changes nothing. Every LOG_KEEP entries a
list of what is live is written beside the log, so that reading it takes a bounded number of files; files and entries that no
kept version needs are deleted by vacuum.

Rows are dealt into buckets by a key. merge rewrites the buckets that a batch touches, and keeps the last row of a key; append
adds files, and puts those of a bucket together once it has more than MANY of them. So a table has at most MANY files a bucket
and writing task, however many batches made it.

Cases: a batch without rows is known by its name and adds no file; a null key is a key; of equal orders any row stays; a table
that isn't there has no rows, and reading it needs a schema.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of the log between two lists of live files; files of a bucket that are left apart.
LOG_KEEP, MANY = 20, 8


@dataclass
class Snapshot:
    version: int
    files: dict[str, int]  # path below the table's folder -> bucket
    batches: set[str]


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder))) if self._fs.exists(self._at(folder)) else []

    def _read_text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        stream = self._fs.create(self._at(name), False)  # an error if another writer was first
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    # --- the log

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("log") if re.fullmatch("[0-9]+[.]json", n)]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """What is live in a version, the latest unless one is named: the last list before it and the entries since."""
        lists = [int(n.removesuffix(".json")) for n in self._names("live") if n.endswith(".json")]
        known = [v for v in self.versions() if version is None or v <= version]
        base = max((v for v in lists if not known or v <= known[-1]), default=-1)
        if version is not None and version not in known and version != base:
            raise ValueError(f"{self.path} has no version {version}")
        files, batches = {}, set()
        if base >= 0:
            kept = json.loads(self._read_text(f"live/{base:012d}.json"))
            files, batches = kept["files"], set(kept["batches"])
        for v in known:
            if v > base:
                entry = json.loads(self._read_text(f"log/{v:012d}.json"))
                files = {f: b for f, b in files.items() if f not in set(entry["remove"])} | entry["add"]
                batches.add(entry["batch"])
        return Snapshot(max([base, *known], default=-1), files, batches)

    def _commit(self, now: Snapshot, batch: str, add: dict[str, int], remove: list[str]) -> Snapshot:
        version = now.version + 1
        self._create(f"log/{version:012d}.json", json.dumps({"batch": batch, "add": add, "remove": sorted(remove)}))
        gone = set(remove)
        after = Snapshot(version, {f: b for f, b in now.files.items() if f not in gone} | add, now.batches | {batch})
        if version % LOG_KEEP == LOG_KEEP - 1:
            self._create(f"live/{version:012d}.json", json.dumps({"files": after.files, "batches": sorted(after.batches)}))
        return after

    # --- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, files: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def read(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The rows of a version. A read keeps to the files that were live when it began."""
        return self._rows(sorted(self.snapshot(version).files), schema)

    def _write(self, rows: DataFrame) -> dict[str, int]:
        """New files of rows with __bucket: one for each bucket and task that has rows of it."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        out = {}
        for part in self._names(folder):
            if part.startswith("__bucket="):
                out |= {f"{folder}/{part}/{f}": int(part.removeprefix("__bucket=")) for f in self._names(f"{folder}/{part}") if f.endswith(".parquet")}
        return out

    def append(self, batch: DataFrame, name: str) -> bool:
        """Adds a batch's rows; false if the table has had it. Buckets with many files are put together after it."""
        now = self.snapshot()
        if name in now.batches:
            return False
        rows = batch.withColumn("__bucket", self._bucket())
        now = self._commit(now, name, self._write(rows.repartition("__bucket")), [])
        self._compact(now, batch.schema)
        return True

    def merge(self, batch: DataFrame, name: str, order: str) -> bool:
        """Merges a batch: of a key the row with the greatest order stays. False if the table has had it."""
        now = self.snapshot()
        if name in now.batches:
            return False
        rows = batch.withColumn("__bucket", self._bucket())
        touched = {r[0] for r in rows.select("__bucket").distinct().collect()}  # at most the number of buckets
        old = sorted(f for f, b in now.files.items() if b in touched)
        both = rows.unionByName(self._rows(old, batch.schema).withColumn("__bucket", self._bucket()))
        # a key with many rows in a batch is summed up before it is shuffled
        last = both.groupBy("__bucket", self.key).agg(F.max_by(F.struct(*batch.columns), order).alias("__row")).select("__row.*", "__bucket")
        self._commit(now, name, self._write(last), old)
        return True

    def compact(self, schema: T.StructType) -> None:
        self._compact(self.snapshot(), schema, 1)

    def _compact(self, now: Snapshot, schema: T.StructType, many: int = MANY) -> None:
        """Puts the files of buckets with more than many together; the rows stay as they are."""
        sizes: dict[int, list[str]] = {}
        for f, b in now.files.items():
            sizes.setdefault(b, []).append(f)
        old = sorted(f for fs in sizes.values() if len(fs) > many for f in fs)
        if old:
            rows = self._rows(old, schema).withColumn("__bucket", self._bucket())
            self._commit(now, f"compaction-{uuid.uuid4().hex}", self._write(rows.repartition("__bucket")), old)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data files that none of the last so many versions needs, and entries of the log that these versions don't
        need either; the number of files that went. Readers of older versions fail from then on."""
        known = self.versions()
        if not known:
            return 0
        kept = known[-keep:]
        needed = set().union(*(self.snapshot(v).files for v in kept))
        gone = 0
        for folder in self._names("data"):
            for part in self._names(f"data/{folder}"):
                for f in self._names(f"data/{folder}/{part}") if part.startswith("__bucket=") else []:
                    if f.endswith(".parquet") and f"data/{folder}/{part}/{f}" not in needed:
                        self._fs.delete(self._at(f"data/{folder}/{part}/{f}"), False)
                        gone += 1
            if not any(n.startswith(f"data/{folder}/") for n in needed):
                self._fs.delete(self._at(f"data/{folder}"), True)
        base = max((int(n.removesuffix(".json")) for n in self._names("live") if n.endswith(".json") and int(n.removesuffix(".json")) <= kept[0]), default=-1)
        for n in self._names("live"):
            if n.endswith(".json") and int(n.removesuffix(".json")) < base:
                self._fs.delete(self._at(f"live/{n}"), False)
        for v in known:
            if v <= base and v < kept[0]:
                self._fs.delete(self._at(f"log/{v:012d}.json"), False)
        return gone
