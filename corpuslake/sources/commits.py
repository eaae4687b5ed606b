"""Versioned tables with atomic commits over several of them.

Rows lie in folders that are never changed, by hash buckets of one key. A commit writes new folders and then a numbered log entry that lists, for each table and bucket, the folders that are its
content now; the entry appears by one rename that fails where another writer has taken the number. Readers take the newest entry, so that they see all of a
commit or nothing, and a writer that dies leaves no more than folders that no entry names.

Rows with new keys are added beside a bucket's folders; where a commit replaces keys, the buckets that these fall into are written anew, and so are buckets of
MOST_FOLDERS folders. What reaches the driver is bounded by tables, buckets and folders.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, MOST_FOLDERS = 64, 16
BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another writer has committed since this one began."""


class Store:
    """Tables under ``path`` that share the key column ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(self._conf)

    def _log(self, version: int) -> str:
        return f"{self.path}/_log/{version:012d}.json"

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """The number of the newest commit; 0 before the first."""
        return max((int(n[:12]) for n in self._names(f"{self.path}/_log") if n.endswith(".json") and n[0].isdigit()), default=0)

    def entry(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "key": self.key, "buckets": self.buckets, "tables": {}, "marks": {}}
        stream = self._fs.open(self._path(self._log(version)))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table as of a version, or as of the newest; some of its buckets only, where they are given."""
        return self._rows(self.entry(version), table, buckets)

    def _rows(self, entry: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        held = entry["tables"].get(table)
        if held is None:
            raise KeyError(table)
        schema = StructType.fromJson(held["schema"])
        folders = [f"{self.path}/{f}" for b, fs in sorted(held["folders"].items()) if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` fall into."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def commit(self, rows: dict[str, DataFrame], replaced: DataFrame | None = None, mark: tuple[str, int] | None = None) -> int:
        """Add ``rows`` to their tables, in all tables in place of the rows whose keys are in ``replaced``, as one version; its number is returned.

        ``mark`` (a writer's name and a number of its own, rising) makes repeats harmless: where the newest version has as high a number of
        that writer, nothing is done."""
        old = self.entry()
        if old["version"] and (old["key"], old["buckets"]) != (self.key, self.buckets):
            raise ValueError(f"the tables are kept by {old['key']} in {old['buckets']} buckets")
        if mark is not None and old["marks"].get(mark[0], -1) >= mark[1]:
            return old["version"]
        touched = set(self.buckets_of(replaced)) if replaced is not None else set()
        gone = replaced.select(self.key).distinct() if replaced is not None else None
        version = old["version"] + 1
        home, tables = f"data/{version:012d}-{uuid.uuid4().hex}", {}
        for name in sorted(old["tables"].keys() | rows.keys()):
            held = old["tables"].get(name, {"schema": None, "folders": {}})
            new = rows.get(name)
            full = {int(b) for b, fs in held["folders"].items() if len(fs) >= MOST_FOLDERS} if new is not None else set()
            anew = sorted(b for b in touched | full if str(b) in held["folders"])
            parts = [] if new is None else [new.drop(BUCKET)]
            if anew:
                kept = self._rows(old, name, anew)
                kept = kept.join(gone, self.key, "left_anti") if gone is not None else kept
                parts.append(kept if new is None else kept.select(*new.columns))
            folders = {b: fs for b, fs in held["folders"].items() if int(b) not in anew}
            if parts:
                out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
                out.withColumn(BUCKET, self.bucket()).hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{home}/{name}")
                for made in self._names(f"{self.path}/{home}/{name}"):
                    if made.startswith(f"{BUCKET}="):
                        b = made.split("=")[1]
                        folders[b] = [*folders.get(b, []), f"{home}/{name}/{made}"]
            schema = json.loads(new.drop(BUCKET).schema.json()) if new is not None else held["schema"]
            tables[name] = {"schema": schema, "folders": folders}
        marks = old["marks"] | ({mark[0]: mark[1]} if mark is not None else {})
        self._publish(version, {"version": version, "key": self.key, "buckets": self.buckets, "tables": tables, "marks": marks})
        return version

    def _publish(self, version: int, entry: dict) -> None:
        """Make the entry the newest version, by a rename that fails where there is one of that number."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        draft, final = self._path(f"{self.path}/_log/.draft-{uuid.uuid4().hex}"), self._path(self._log(version))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, final, none)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {version} is there already") from e
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Remove the entries before the last ``keep`` and the folders that only they name, or that no entry names and that are no newer than these; the
        number of folders removed is returned. Call it when no reader uses older versions."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        named = {f.split("/")[1] for v in kept for t in self.entry(v)["tables"].values() for fs in t["folders"].values() for f in fs}
        gone = [n for n in self._names(f"{self.path}/data") if n not in named and int(n[:12]) <= newest]
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/data/{name}"), True)
        for name in self._names(f"{self.path}/_log"):
            if name.endswith(".json") and name[0].isdigit() and int(name[:12]) < kept.start:
                self._fs.delete(self._path(f"{self.path}/_log/{name}"), False)
        return len(gone)
