"""Byte-level BPE encoding and decoding with a given vocabulary of ranks.

Distinct pieces of a block of texts are put in padded matrices by length. In
each round every row merges its leftmost pair of minimum rank; pair ranks come
from an open-addressing hash table, and rows without a pair left are compacted
away. The vocabulary is a parameter (a file of base64 tokens and ranks); it is
read by each Python worker, never trained here.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposift.llm.common import ragged, text_blocks

NONE = np.int32(2**31 - 1)
#: Distinct pieces that a task remembers before it starts anew.
REMEMBERED = 150_000
#: Pieces of one text handled at a time.
PIECES = 100_000
#: Longest piece, in bytes, that goes through the padded matrices.
WIDEST = 256
#: Cells of one padded matrix.
CELLS = 1 << 19


class PairTable:
    """Open-addressing hash table from a pair of token ids to the rank of their merger."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(rank)) - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            at, put = at[free], todo[free]
            at, one = np.unique(at, return_index=True)
            put = put[one]
            self.keys[at], self.ranks[at] = key[put], rank[put]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return mixed.astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is no merger or a side is padding (negative)."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left.ravel()[todo].astype(np.int64) << 32) | right.ravel()[todo]
        slot, flat = self._slot(key), out.ravel()
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            flat[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (there >= 0)
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & (len(self.keys) - 1)
        return flat.reshape(left.shape)


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        n = max(self.rank.values()) + 1
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        size = np.zeros(n, np.int64)
        for token, r in self.rank.items():
            size[r] = len(token)
        self.size, self.first = size, np.concatenate(([0], np.cumsum(size)[:-1]))
        self.bytes = np.zeros(int(size.sum()), np.uint8)
        pairs = []
        for token, r in self.rank.items():
            self.bytes[self.first[r] : self.first[r] + len(token)] = np.frombuffer(token, np.uint8)
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, r))
        a, b, r = np.array(pairs, np.int32).reshape(-1, 3).T
        self.table = PairTable(a, b, r)
        # A token is steady if no pair with it as a part ranks below it: then all its mergers can go at once.
        lowest = np.full(n, NONE, np.int32)
        np.minimum.at(lowest, a, r)
        np.minimum.at(lowest, b, r)
        self.steady = lowest > np.arange(n)
        self._forget()

    def _forget(self) -> None:
        self.seen = Numbered()
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of each piece; all are of 2 to width bytes."""
        out: list = [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width)[None, :] < sizes[:, None]] = self.byte_id[raw]
        row = np.arange(len(pieces))
        ranks = self.table.find(ids[:, :-1], ids[:, 1:])
        while len(row):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            lowest = ranks[np.arange(len(row)), best] if ranks.shape[1] else np.full(len(row), NONE)
            done = lowest == NONE
            if done.any():
                left = ids[done]
                flat, at = left[left >= 0], 0
                for k, end in zip(row[done].tolist(), np.cumsum((left >= 0).sum(axis=1)).tolist(), strict=True):
                    out[k], at = flat[at:end], end
                go = ~done
                row, ids, ranks, best, lowest = row[go], ids[go], ranks[go], best[go], lowest[go]
                if not len(row):
                    break
            # Each row merges one pair, so each row loses one column.
            k, width = np.arange(len(row)), ids.shape[1]
            ids[k, best] = lowest
            keep = np.ones(ids.shape, bool)
            keep[k, best + 1] = False
            ids = ids[keep].reshape(len(row), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[k, best] = False
            ranks = ranks[keep].reshape(len(row), width - 2)
            if width > 2:
                for near in (best - 1, best):
                    inner = (near >= 0) & (near < width - 2)
                    r, c = k[inner], near[inner]
                    ranks[r, c] = self.table.find(ids[r, c], ids[r, c + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same rounds for one long row; the mergers of a steady token go together."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        ranks = self.table.find(ids[:-1], ids[1:])
        while len(ranks) and (lowest := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == lowest)
            if not self.steady[lowest]:
                at = at[:1]
            elif len(at) > 1:  # in a run of overlapping pairs every other one, from the left
                new = np.concatenate(([True], np.diff(at) > 1))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = lowest
            ids, spot = ids[keep], at - np.arange(len(at))
            ranks = ranks[keep[1:]]
            for near in (spot - 1, spot):
                near = near[(near >= 0) & (near < len(ids) - 1)]
                ranks[near] = self.table.find(ids[near], ids[near + 1])
        return ids

    def merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each non-empty piece: itself if it is a token, else by merging."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (r := self.rank.get(piece)) is not None:
                out[k] = np.array([r], np.int32)
            elif len(piece) > WIDEST:
                out[k] = self._merge_long(piece)
            else:
                buckets.setdefault(1 << (len(piece) - 1).bit_length() if len(piece) > 24 else -(-len(piece) // 2) * 2, []).append(k)
        for width, where in buckets.items():
            step = max(1, CELLS // width)
            for lo in range(0, len(where), step):
                part = where[lo : lo + step]
                for k, ids in zip(part, self._merge_rows([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _pieces_to_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, one after the other, and the number of ids of each piece."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        n = len(self.seen)
        code = np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))
        if fresh := list(islice(reversed(self.seen), len(self.seen) - n))[::-1]:
            found = self.merged([x.encode() for x in fresh])
            count = np.fromiter(map(len, found), np.int64, len(found))
            more = int(count.sum())
            while len(self.ids) < self.n_ids + more:
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            while len(self.at) < n + len(fresh):
                self.at, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.count))
            self.ids[self.n_ids : self.n_ids + more] = np.concatenate(found)
            self.count[n : n + len(fresh)] = count
            self.at[n : n + len(fresh)] = self.n_ids + np.cumsum(count) - count
            self.n_ids += more
        count = self.count[code]
        return self.ids[ragged(self.at[code], count)], count

    def _cut(self, text: str) -> Iterator[list[str]]:
        if len(text) <= 4 * PIECES:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, PIECES)):
            yield part

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        ids, rows = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owner: list[tuple[int, int]] = []

        def flush() -> None:
            got, count = self._pieces_to_ids(pieces)
            ids.append(got)
            ends = np.concatenate(([0], np.cumsum(count)))
            at = 0
            for row, n in owner:
                rows[row] += ends[at + n] - ends[at]
                at += n
            pieces.clear()
            owner.clear()

        for row, text in enumerate(texts):
            for part in self._cut(text) if text else ():
                pieces.extend(part)
                owner.append((row, len(part)))
                if len(pieces) >= PIECES:
                    flush()
        if pieces:
            flush()
        return np.concatenate(ids), rows

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after the other, and the number of bytes of each id."""
        size = self.size[ids]
        return self.bytes[ragged(self.first[ids], size)], size


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _list_array(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(rows))), pa.int32()), pa.array(values, pa.int32()))


def _binary_array(raw: np.ndarray, rows: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(rows))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _with(df: DataFrame, work, last=lambda: None, **new: T.DataType) -> DataFrame:
    """Run work(batch) -> iterator of (first row, end row, new columns) over df, and last() after it; new columns replace those of the same name."""
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in new.items())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, columns in work(batch):
                cut = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([columns[x] if x in columns else cut.column(x) for x in names], names=names)
        last()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of each text as array<int>, and with decoded the bytes those ids stand for.

    Null and empty texts give an empty array. No special token is known: their
    strings are ordinary text. An input column named like a new one is
    replaced; other columns and repeated rows pass unchanged; an empty table
    gives an empty table. path must be readable by the executors. Work and
    memory of a text of any length are bounded by blocks of pieces; a single
    piece of n bytes takes at most n rounds.
    """

    def work(batch: pa.RecordBatch):
        own = codec(path, pattern)
        column = batch.column(text)
        for lo, hi, raw, offsets in text_blocks(column):
            data = raw.tobytes()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            got, rows = own.encode(texts)
            columns = {ids: _list_array(got, rows)}
            if decoded:
                back, size = own.decode(got)
                ends = np.concatenate(([0], np.cumsum(size)))
                row_ends = ends[np.concatenate(([0], np.cumsum(rows)))]
                columns[decoded] = _binary_array(back, np.diff(row_ends))
            yield lo, hi, columns

    def forget() -> None:  # an idle worker holds the vocabulary only
        codec(path, pattern)._forget()

    new = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.BinaryType()} if decoded else {})
    return _with(df, work, forget, **new)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that the ids of each row stand for; null ids give empty bytes, an id outside the vocabulary fails."""

    def work(batch: pa.RecordBatch):
        own = codec(path, pattern)
        column = batch.column(ids)
        for lo in range(0, len(column), 1000):
            part = column.slice(lo, 1000)
            rows = np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
            back, size = own.decode(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            ends = np.concatenate(([0], np.cumsum(size)))
            yield lo, lo + len(part), {decoded: _binary_array(back, np.diff(ends[np.concatenate(([0], np.cumsum(rows)))]))}

    return _with(df, work, **{decoded: T.BinaryType()})


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, from its real ids and bytes."""
    done = encode(documents.select("doc_id", "text"), path, pattern, decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
