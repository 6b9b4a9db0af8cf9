"""Reading repository listings and file bodies."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposift import schemas


def explode_trees(trees: DataFrame, repo_id: str = "repo_id") -> DataFrame:
    """One row per entry of each repository's listing, with its position."""
    entries = trees.select(repo_id, F.posexplode("tree").alias("pos", "entry"))
    return entries.select(repo_id, "pos", "entry.*")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField("repo_id", T.LongType()), *schemas.TREE.fields])).json(path)


def decode_body(content: Column) -> Column:
    """Text of base64 with wrapped lines; bad bytes become U+FFFD and one leading byte-order mark is dropped."""
    text = F.make_valid_utf8(F.unbase64(F.regexp_replace(content, r"\s+", "")).cast("string"))
    return F.regexp_replace(text, "^﻿", "")


def file_bodies(contents: DataFrame) -> DataFrame:
    """Decoded files; entries that are no files or not base64 are dropped."""
    files = contents.where((F.col("type") == "file") & (F.col("encoding") == "base64"))
    return files.withColumn("content", decode_body(F.col("content"))).drop("type", "encoding")


#: Bytes of the largest file that is worth reading.
LARGEST_FILE = 1 << 20


def read_source_tree(spark: SparkSession, root: str, glob: str = "*", largest: int | None = None) -> DataFrame:
    """(path, content, bytes) of all files below root; paths are relative to it.

    Sizes come from the listing. Files over largest bytes are left out there, so
    they are never opened, and Spark packs the rest by size into tasks of
    spark.sql.files.maxPartitionBytes, each file with what opening it costs.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    some = files if largest is None else files.where(F.col("length") <= largest)
    return some.select(
        F.regexp_replace(F.substr("path", F.instr("path", base) + F.lit(len(base))), "^/+", "").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("bytes"),
    )


#: Bytes of contents, and entries of a listing, that a task gathers before it passes them on.
BATCH_BYTES, BATCH_ENTRIES = 4 << 20, 4096


def list_folders(folders: DataFrame, glob: str = "*", largest: int | None = None, folder: str = "folder") -> DataFrame:
    """(folder, path, bytes) of all files below the folders; paths are relative to theirs.

    Tasks list, so a tree of many millions of files does not pass through the
    driver. Folders are paths or URIs that pyarrow reads on every executor.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            for own in batch.column(0).to_pylist():
                store, base = fs.FileSystem.from_uri(own)
                for x in store.get_file_info(fs.FileSelector(base, recursive=True)):
                    if x.type == fs.FileType.File and fnmatchcase(x.base_name, glob) and (largest is None or x.size <= largest):
                        found.append((own, x.path[len(base.rstrip("/")) + 1 :], x.size))
                    if len(found) >= BATCH_ENTRIES:
                        yield _batch(found, ("folder", "path", "bytes"))
                        found = []
        yield _batch(found, ("folder", "path", "bytes"))

    return folders.select(folder).where(F.col(folder).isNotNull()).repartition(_tasks(folders.sparkSession), folder).mapInArrow(run, "folder string, path string, bytes long")


def read_folders(folders: DataFrame, glob: str = "*", largest: int | None = None, folder: str = "folder") -> DataFrame:
    """(folder, path, content, bytes) of all files below the folders, for many small files.

    What list_folders() finds is dealt out by its path, so a large folder is
    read by many tasks; files over largest bytes are never opened.
    """
    listed = list_folders(folders, glob, largest, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[tuple] = []
        size = 0
        for batch in batches:
            for entry in batch.to_pylist():
                store, base = fs.FileSystem.from_uri(entry["folder"])
                with store.open_input_stream(f"{base.rstrip('/')}/{entry['path']}") as stream:
                    read.append((entry["folder"], entry["path"], stream.read(), entry["bytes"]))
                size += entry["bytes"]
                if size >= BATCH_BYTES or len(read) >= BATCH_ENTRIES:
                    yield _batch(read, ("folder", "path", "content", "bytes"))
                    read, size = [], 0
        yield _batch(read, ("folder", "path", "content", "bytes"))

    files = listed.repartition(_tasks(folders.sparkSession), "folder", "path").mapInArrow(run, "folder string, path string, content binary, bytes long")
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def _tasks(spark: SparkSession) -> int:
    """Tasks that names are dealt to; by the bytes of the names alone they would be put into a few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"folder": pa.string(), "path": pa.string(), "content": pa.binary(), "bytes": pa.int64()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x]) for c, x in zip(columns, names, strict=True)], names=list(names))
