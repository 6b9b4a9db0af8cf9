"""Helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass holds at a time; a single longer text is a pass of its own.
BLOCK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a
    temporary one is made for a session that runs in one process, as in tests;
    on a cluster, whose executors would not share it, that is an error.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """df written as a table below the checkpoint folder and read back, so that later filters reach the files."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.option("parquet.page.size", 1 << 16).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not have, in any letter case."""
    taken = {x.lower() for x in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive rows of a string or binary column.

    Null counts as empty. The bytes are one contiguous array; row i of the block
    is bytes[offsets[i]:offsets[i + 1]]. With lower the texts are lower-cased
    first, block by block. Memory that Arrow keeps for later is given back after
    the last block, so that idle workers stay small.
    """
    n, first = len(column), 0
    wide = column.type in (pa.large_string(), pa.large_binary())
    kind = np.int64 if wide else np.int32
    _, where, _ = column.buffers()
    ends = np.frombuffer(where, kind)[column.offset : column.offset + n + 1] if n else np.zeros(1, kind)
    while first < n:
        end = min(n, max(first + 1, int(np.searchsorted(ends, int(ends[first]) + limit, "right")) - 1))
        part = column.slice(first, end - first)
        if part.null_count:
            part = part.fill_null("" if part.type in (pa.string(), pa.large_string()) else b"")
        if lower:
            part = pc.utf8_lower(part)
        _, where, data = part.buffers()
        offsets = np.frombuffer(where, kind)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        yield first, end, raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        first = end
    pa.default_memory_pool().release_unused()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() reads the hash of any span of raw."""
    power, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:-1], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end]; equal bytes give equal hashes wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each whitespace-separated word, and the first word of each row (rows + 1)."""
    word = ~WHITE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] = word[inner]
    start = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    stops[inner - 1] = word[inner - 1]
    end = np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(start, offsets)


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + length[i] - 1 of all i, one after the other."""
    total = int(length.sum())
    shift = first - np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else first
    return np.repeat(shift, length) + np.arange(total)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
