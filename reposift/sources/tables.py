"""Parquet tables under one root that change together.

A commit is a manifest: a numbered JSON file that names the files of every
table. Data goes to new folders first, and one rename that never overwrites
makes the manifest visible, so a reader sees all tables before a commit or all
after it, and a job that dies leaves nothing but unnamed files. Two jobs that
end at once both stay if neither changed what the other one read or wrote;
otherwise the later one runs again on the newer tables.

Tables with a layout keep their rows in buckets of their key: by the first
column of the key (so that a job over some users reads theirs only) and, within
that, by the rest (so that a user with very many rows has several). A change
rewrites the buckets it touches; the manifest keeps naming the files of the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Out = TypeVar("Out")
BUCKET = "__bucket"


class Layout(NamedTuple):
    """Key columns, and numbers of buckets: groups by the first column times spread by the others. Choose them so that a bucket is a few hundred MB."""

    keys: tuple[str, ...]
    groups: int
    spread: int = 1

    def group(self) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.groups)).cast("int")

    def bucket(self) -> Column:
        rest = F.pmod(F.xxhash64(*self.keys[1:]), F.lit(self.spread)) if self.spread > 1 else F.lit(0)
        return (self.group() * self.spread + rest).cast("int")


LAYOUTS = {
    "stars": Layout(("user_id", "id"), 16, 2),
    "cursors": Layout(("user_id",), 4),
    "pulls": Layout(("user_id",), 4),
    "vectors": Layout(("star_id", "id"), 16),
}


class Staged(NamedTuple):
    """Rows that a job has written for itself by the buckets of a table."""

    tables: Snapshots
    entry: dict

    def buckets(self) -> list[int]:
        return sorted(map(int, self.entry["buckets"]))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        return self.tables.rows(self.entry, buckets)


class Conflict(Exception):
    """Other commits changed what a job used, as often as it was tried."""


class Change:
    """One job's view of the tables: its base version, and what it has written itself."""

    def __init__(self, tables: Snapshots, base: int):
        self.tables, self.base = tables, base
        self.entries = tables.manifest(base)["tables"]
        self.used: set[str] = set()
        self.written: set[str] = set()

    def layout(self, table: str) -> Layout | None:
        """The layout that the table has, or will get when it is first written."""
        entry = self.entries.get(table)
        if entry is None:
            return self.tables.layouts.get(table)
        return Layout(tuple(entry["keys"]), entry["groups"], entry["spread"]) if "keys" in entry else None

    def _bucketed(self, table: str) -> Layout:
        layout = self.layout(table)
        if layout is None:
            raise ValueError(f"{table} has no layout: give one to Snapshots before it is first written")
        return layout

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The table's rows, or those of some buckets; None if there is no such table."""
        self.used.add(table)
        return self.tables.rows(self.entries.get(table), buckets)

    def buckets(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets that rows with these keys can be in. keys: with the layout's first column, or all of its columns."""
        layout = self._bucketed(table)
        whole = all(x in keys.columns for x in layout.keys)
        found = [r[0] for r in keys.select((layout.bucket() if whole else layout.group()).alias(BUCKET)).distinct().collect()]  # as many as there are buckets at most
        return sorted(found if whole else [g * layout.spread + k for g in found for k in range(layout.spread)])

    def write(self, table: str, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        """The rows in place of the whole table."""
        self.entries.pop(table, None)
        layout = self.layout(table)
        if layout:
            self.rewrite(table, rows, list(range(layout.groups * layout.spread)))
        else:
            self._put(table, {"schema": rows.schema.json(), "folders": [self.tables.save(table, rows, partition_by)]})

    def append(self, table: str, rows: DataFrame) -> None:
        """The rows beside those of a table without layout; its files stay."""
        old = self.entries.get(table, {"folders": []})
        schema = self.tables.merged_schema(old.get("schema"), rows.schema)
        self._put(table, {"schema": schema.json(), "folders": [*old["folders"], self.tables.save(table, rows)]})

    def rewrite(self, table: str, rows: DataFrame, buckets: list[int], order: list[str] | None = None) -> None:
        """The rows in place of those of the buckets, where they belong, each file in the order asked for; other buckets keep their files."""
        layout, old = self._bucketed(table), self.entries.get(table, {})
        placed = rows.withColumn(BUCKET, layout.bucket())
        strange = F.raise_error(F.lit(f"a row of {table} belongs to a bucket that is not rewritten")).cast("boolean")
        if len(buckets) < layout.groups * layout.spread:
            placed = placed.where(F.when(F.col(BUCKET).isin(buckets), F.lit(True)).otherwise(strange))
        # By the bytes that are there, a large bucket is written by several tasks and small ones share a task.
        placed = placed.repartitionByRange(BUCKET, *order).sortWithinPartitions(BUCKET, *order) if order else placed.hint("rebalance", BUCKET)
        folder = self.tables.save(table, placed, [BUCKET])
        kept = {k: v for k, v in old.get("buckets", {}).items() if int(k) not in set(buckets)}
        new = self.tables.bucket_folders(folder)
        schema = self.tables.merged_schema(old.get("schema") if kept else None, rows.schema)
        self._put(table, {"schema": schema.json(), "keys": layout.keys, "groups": layout.groups, "spread": layout.spread, "buckets": kept | new})

    def stage(self, rows: DataFrame) -> DataFrame:
        """The rows written once and read back, for a job's own use; no table names them."""
        folder = self.tables.save("staged", rows)
        return self.tables.rows({"schema": rows.schema.json(), "folders": [folder]})

    def stage_buckets(self, table: str, rows: DataFrame) -> Staged:
        """The rows written once, in the buckets of the table that they belong to, for a job's own use; no table names them."""
        layout = self._bucketed(table)
        folder = self.tables.save("staged", rows.withColumn(BUCKET, layout.bucket()), [BUCKET])
        return Staged(self.tables, {"schema": rows.schema.json(), "keys": layout.keys, "buckets": self.tables.bucket_folders(folder)})

    def steps(self, table: str, staged: Staged, most: int) -> list[list[int]]:
        """The buckets of the staged rows, as many at a time as hold some `most` bytes with the table's own rows; one at least."""
        found: list[list[int]] = []
        room = 0
        for k in staged.buckets():
            folders = [x for entry in (staged.entry, self.entries.get(table, {})) for x in entry.get("buckets", {}).get(str(k), [])]
            held = sum(map(self.tables.bytes, folders))
            if not found or held > room:
                found.append([])
                room = most
            found[-1].append(k)
            room -= held
        return found

    def _put(self, table: str, entry: dict) -> None:
        self.entries[table] = entry
        self.used.add(table)
        self.written.add(table)


class Snapshots:
    """The tables under a root; root is a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, Layout] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.layouts = LAYOUTS if layouts is None else layouts

    # Files

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path, files = self._path(folder), self._files()
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def bytes(self, folder: str) -> int:
        return self._files().getContentSummary(self._path(folder)).getLength()

    def bucket_folders(self, folder: str) -> dict[str, list[str]]:
        return {name.partition("=")[2]: [f"{folder}/{name}"] for name in self.names(folder) if name.startswith(f"{BUCKET}=")}

    def _read_text(self, path: str) -> str:
        stream = self._files().open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, path: str, text: str) -> bool:
        """Write a file that was not there; False if it is there already."""
        jvm, files = self.spark._jvm, self._files()
        draft, target = self._path(f"_drafts/{uuid.uuid4()}"), self._path(path)
        files.mkdirs(target.getParent())
        stream = files.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if files.getUri().getScheme() == "file":  # whose rename overwrites; a second name for a file does not
                plain = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(plain(target), plain(draft))
                files.delete(draft, False)
            else:
                never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, never)
            return True
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                files.delete(draft, False)
                return False
            raise

    def save(self, table: str, rows: DataFrame, partition_by: list[str] | None = None) -> str:
        folder = f"data/{table}/{uuid.uuid4()}"
        (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(f"{self.root}/{folder}")
        return folder

    def rows(self, entry: dict | None, buckets: list[int] | None = None) -> DataFrame | None:
        if entry is None:
            return None
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if "keys" in entry:
            folders = [x for k, own in entry["buckets"].items() if buckets is None or int(k) in set(buckets) for x in own]
        else:
            folders = entry["folders"]
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{x}" for x in folders)) if folders else self.spark.createDataFrame([], schema)

    @staticmethod
    def merged_schema(old: str | None, new: T.StructType) -> T.StructType:
        """The old columns and the new ones; older files give nulls for those that they lack."""
        before = T.StructType.fromJson(json.loads(old)).fields if old else []
        names = {f.name for f in before}
        return T.StructType([*before, *(f for f in new.fields if f.name not in names)])

    # Commits

    @staticmethod
    def _name(version: int) -> str:
        return f"_log/{version:020d}.json"

    def commits(self) -> list[int]:
        return sorted(int(x[:20]) for x in self.names("_log") if x.endswith(".json") and x[:20].isdigit())

    def version(self) -> int:
        return max(self.commits(), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(self._read_text(self._name(version))) if version else {"changed": [], "tables": {}}

    def commit(self, job: Callable[[Change], Out], tries: int = 5) -> Out:
        """What the job returns, after all that it wrote has become visible at once. The job runs again if others changed what it used."""
        for _ in range(tries):
            change = Change(self, self.version())
            out = job(change)
            if not change.written or self._visible(change):
                return out
        raise Conflict(f"given up after {tries} tries")

    def _visible(self, change: Change) -> bool:
        seen, newest = change.base, self.version()
        while True:
            for k in range(seen + 1, newest + 1):
                if set(self.manifest(k)["changed"]) & change.used:
                    return False
            latest = self.manifest(newest)["tables"]
            own = {x: change.entries[x] for x in change.written}
            if self._publish(self._name(newest + 1), json.dumps({"changed": sorted(own), "tables": latest | own})):
                return True
            seen, newest = newest, self.version()

    def write(self, table: str, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        """A commit of one table; returns its version."""
        self.commit(lambda change: change.write(table, rows, partition_by))
        return self.version()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The table as the newest commit, or the one asked for, names it; None if there is none."""
        return self.rows(self.manifest(self.version() if version is None else version)["tables"].get(table))

    def _versions(self, table: str) -> list[int]:
        """The commits that changed the table."""
        return [k for k in self.commits() if table in self.manifest(k)["changed"]]

    def vacuum(self, keep: int = 10) -> int:
        """Delete the data folders that none of the last commits names, and older manifests; returns the number of folders. Run it while no job is writing."""
        commits = self.commits()
        named: set[str] = set()
        for k in commits[-keep:]:
            for entry in self.manifest(k)["tables"].values():
                lists = entry["buckets"].values() if "keys" in entry else [entry["folders"]]
                named |= {"/".join(x.split("/")[:3]) for own in lists for x in own}
        gone = [f"data/{t}/{x}" for t in self.names("data") for x in self.names(f"data/{t}") if f"data/{t}/{x}" not in named]
        for path in [*gone, *(self._name(k) for k in commits[:-keep])]:
            self._files().delete(self._path(path), True)
        return len(gone)
