"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if a string of `length` bytes that covers it starts earlier too. The
work is cut so that a suffix array never spans more than a few documents' worth
of text, wherever its copies stand:

1. Of every window of `length` bytes the gram with the smallest hash is its
   anchor. Equal windows have equal anchors, so they meet under the anchor's hash.
2. All windows that share an anchor make one string around it. Strings of one
   anchor with the same hash are one string with several places: at all
   places but the first, every window is a repetition. Their bytes are not
   compared, but the hash is one that no text can be made up to collide in (see
   sound.py). Anchors with one place are dropped.
3. The different strings of an anchor (they meet where a repetition begins or
   ends) are put in a suffix array by linear grouping. Neighbours in it share
   windows; the window at the smallest place stays, the others are repetitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposift.llm.common import checkpointed, mix, prefix_hash, ragged, shuffle_partitions, span_hash, text_blocks
from reposift.llm.sound import SoundHash

LENGTH = 100
#: Bytes of an anchor gram, and of a symbol of the suffix arrays.
GRAM, SYMBOL = 32, 8
#: Window starts looked at in one numpy pass (below 2 ** 20).
CHUNK = 900_000
#: Strings of one anchor that a suffix array takes; more are first split by the bytes that nearby windows share.
HOT = 20_000
#: Windows that a split keeps together.
SPLIT = 8
#: Bytes of strings that one suffix array takes, but for a single larger group.
BATCH = 500_000
_LOW = np.uint64((1 << 20) - 1)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of width consecutive values."""
    n = len(values)
    v = np.append(values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(prefix: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, gram start, first window, last window, gram hash) for each gram that windows of its row choose; the last smallest gram is chosen."""
    gram = min(GRAM, length)
    n, width = len(prefix) - 1, length - gram + 1
    out = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]]
    for lo in range(0, max(n - length + 1, 0), CHUNK):
        start = np.arange(lo, min(n, lo + CHUNK + length - 1) - gram + 1)
        h = span_hash(prefix, start, start + gram)
        low = window_minima((h & ~_LOW) | (_LOW - (start - lo).astype(np.uint64)), width)
        p = np.arange(lo, lo + len(low))
        row = np.searchsorted(offsets, p, "right") - 1
        good = p + length <= offsets[row + 1]
        p, row = p[good], row[good]
        at = (_LOW - (low[good] & _LOW)).astype(np.int64)
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        last = np.append(new[1:], len(p))[: len(new)] - 1
        out.append([row[new], at[new] + lo, p[new], p[last], h[at[new]]])
    row, at, first, last, h = (np.concatenate(x) for x in zip(*out, strict=True))
    # Windows on both sides of a pass's border that choose one gram belong together.
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1]) | (first[1:] != last[:-1] + 1)
    return row[new], at[new], first[new], last[np.append(np.flatnonzero(new)[1:], len(row)) - 1] if len(row) else last, h[new]


def suffix_array(text: list[int]) -> list[int]:
    """Starts of all suffixes of text in order; symbols are positive integers.

    Linear grouping: suffixes are grouped by their longest Lyndon prefix found so
    far. Groups are taken from the largest down; each of a group's suffixes points
    to the nearest start before it in a smaller group (previous-smaller pointer),
    and the suffixes pointed at move to new groups right after their old ones,
    higher the more often they are pointed at. Then, from the smallest suffix up,
    each emitted suffix lets the one before it, and what its pointers reach, take
    the next place of their groups. Nothing is renamed or sorted again.
    """
    text = [*text, 0]
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        first.setdefault(symbol, []).append(i)
    names = sorted(first)
    members = [first[x] for x in names]
    size = [len(x) for x in members]
    label = {x: g for g, x in enumerate(names)}
    group = [label[x] for x in text]
    below, above = list(range(-1, len(names) - 1)), [*range(1, len(names)), -1]
    pointer, passed = [-1] * n, bytearray(n)
    g = len(names) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g] if len(members[g]) != size[g] else members[g]
        for i in own:
            passed[i] = 1
        moved: dict[tuple[int, int], list[int]] = {}
        before, times = -1, 0
        for i in own:
            p = i - 1
            while p >= 0 and passed[p]:
                p = pointer[p]
            pointer[i] = p
            if p == before:
                times += 1
            else:
                if before >= 0:
                    moved.setdefault((times, group[before]), []).append(before)
                before, times = p, 1
        if before >= 0:
            moved.setdefault((times, group[before]), []).append(before)
        for (_, old), found in sorted(moved.items(), reverse=True) if len(moved) > 1 else moved.items():
            if len(found) == size[old]:
                continue
            new = len(members)
            members.append(found)
            size.append(len(found))
            size[old] -= len(found)
            for p in found:
                group[p] = new
            up = above[old]
            above[old] = new
            below.append(old)
            above.append(up)
            if up >= 0:
                below[up] = new
        g = below[g]
    free, at, g = [0] * len(members), 0, 0
    while g >= 0:
        free[g] = at
        at += size[g]
        g = above[g]
    order, placed = [0] * n, bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    for k in range(n):
        s = order[k] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = pointer[s]
    return order[1:]


def _partial(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The size (below 8) bytes from each start, as one integer."""
    out = np.zeros(len(start), np.uint64)
    for t in range(SYMBOL - 1):
        some = np.flatnonzero(size > t)
        out[some] |= raw[start[some] + t].astype(np.uint64) << np.uint64(8 * t)
    return out


def repeated_windows(raw: np.ndarray, begin: np.ndarray, anchor: np.ndarray, windows: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For the windows of all strings, in order: whether an earlier string of its group has the same one.

    String j is raw[begin[j]:begin[j] + windows[j] + length - 1] with its anchor at begin[j] + anchor[j]; strings of a
    group have the same anchor gram, so equal windows lie equally to it. Symbols are SYMBOL bytes cut in step with the
    anchor; the suffix array of all symbol strings brings windows with equal inner symbols together, whose at most
    SYMBOL - 1 bytes on either side are then compared.
    """
    size = windows + length - 1
    shift = anchor % SYMBOL
    count = (size - shift) // SYMBOL
    base = np.cumsum(count + 1) - count - 1
    places = ragged(np.zeros(len(count), np.int64), count)
    where = np.repeat(begin + shift, count) + SYMBOL * places
    value = np.zeros(len(where), np.uint64)
    for t in range(SYMBOL):
        value |= raw[where + t].astype(np.uint64) << np.uint64(8 * t)
    symbols = np.ones(int(count.sum() + len(count)), np.int64)
    symbols[np.repeat(base, count) + places] = np.unique(value, return_inverse=True)[1] + 2
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    most = length // SYMBOL
    padded = np.concatenate((symbols, -np.arange(1, most + 2)))
    same, depth = np.ones(len(order) - 1, bool), np.zeros(len(order) - 1, np.int64)
    for t in range(most):
        same &= padded[order[1:] + t] == padded[order[:-1] + t]
        depth += same
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # interval[k][x]: number of the run of sorted suffixes with k symbols in common to which the x-th belongs.
    interval = {k: np.concatenate(([0], np.cumsum(depth < k))) for k in {(length - t) // SYMBOL for t in range(SYMBOL)}}

    string = np.repeat(np.arange(len(windows)), windows)
    offset = ragged(np.zeros(len(windows), np.int64), windows)
    chunk = -((shift[string] - offset) // SYMBOL)
    left = shift[string] + SYMBOL * chunk - offset
    inner = (length - left) // SYMBOL
    right = length - left - SYMBOL * inner
    start = begin[string] + offset
    run = np.zeros(len(string), np.int64)
    for k, runs in interval.items():
        own = np.flatnonzero(inner == k)
        run[own] = runs[rank[base[string[own]] + chunk[own]]]
    keys = (string, _partial(raw, start + length - right, right), _partial(raw, start, left), run, offset - anchor[string], group[string])
    sort = np.lexsort(keys)
    equal = np.ones(len(sort) - 1, bool)
    for key in keys[1:]:
        own = key[sort]
        equal &= own[1:] == own[:-1]
    out = np.zeros(len(string), bool)
    out[sort[1:]] = equal
    return out


def _runs(flags: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags within one string."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on
    new = np.flatnonzero((np.diff(on, prepend=-2) != 1) | (np.diff(string[on], prepend=-1) != 0))
    return on[new], on[np.append(new[1:], len(on)) - 1]


def _numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with __id: in the order of doc_id, one for each document."""
    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select(low.alias("__id"), "doc_id", "text")
    if docs.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs
    # Repeated ids: number the different (id, text) by range-partitioned order.
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    each = keyed.select("__id", "__key").distinct().repartitionByRange("__id", "__key").sortWithinPartitions("__id", "__key")
    each = checkpointed(each.withColumn("__n", F.monotonically_increasing_id()))
    return keyed.join(each, ["__id", "__key"]).select(F.col("__n").alias("__id"), "doc_id", "text")


def _list_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    """Length of each row's list (null: 0) and the structs of all lists."""
    column = batch.column(batch.schema.get_field_index(name))
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    size[~column.is_valid().to_numpy(zero_copy_only=False)] = 0
    return size, column.flatten()


def _field(items: pa.StructArray, name: str) -> np.ndarray:
    return items.field(name).to_numpy(zero_copy_only=False)


STRINGS = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("key", "id", "at", "anchor", "end")] + [T.StructField("string", T.BinaryType())]
)  # a string: its anchor's place and offset in it; or, with string null, a span from at to end


def _batch(key, who, at, anchor, end, string) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (key, who, at, anchor, end)), string], schema=pa.schema([(f.name, pa.binary() if f.name == "string" else pa.int64()) for f in STRINGS.fields]))


def _strings_array(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    data, ends = raw[ragged(begin, size)], np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _solve(rows: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Spans of the strings of complete groups (sorted by key, id, at) that earlier strings of their group hold too."""
    key, who, at, anchor = (rows.column(k).to_numpy() for k in range(4))
    first = np.append(True, (np.diff(key) != 0) | (np.diff(who) != 0) | (np.diff(at) != 0))
    rows = rows.filter(pa.array(first))  # a repeated row is the same place
    key, who, at, anchor = (rows.column(k).to_numpy() for k in range(4))
    column = rows.column(5)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    windows = np.diff(ends) - length + 1
    group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    flags = repeated_windows(raw, ends[:-1], anchor, windows, group, length)
    string = np.repeat(np.arange(len(windows)), windows)
    lo, hi = _runs(flags, string)
    own, skipped = string[lo], (np.cumsum(windows) - windows)[string[lo]]
    start = at[own] - anchor[own]
    return _batch(mix(who[own].astype(np.uint64)).view(np.int64), who[own], start + lo - skipped, np.zeros(len(own)), start + hi - skipped + length, pa.nulls(len(own), pa.binary()))


def _split(rows: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """The strings cut into stretches of SPLIT window offsets from the anchor, under keys of the bytes that all windows of a stretch share."""
    key, who, at, anchor = (rows.column(k).to_numpy() for k in range(4))
    column = rows.column(5)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    prefix = prefix_hash(raw)
    first, last = -anchor, -anchor + np.diff(ends) - length  # offsets of the windows from the anchor
    for lo in range(int(first.min()) // SPLIT * SPLIT, int(last.max()) + 1, SPLIT):
        own = np.flatnonzero((first < lo + SPLIT) & (last >= lo))
        a, b = np.maximum(first[own], lo), np.minimum(last[own], lo + SPLIT - 1)
        zero = ends[own] + anchor[own]
        shared = span_hash(prefix, zero + lo + SPLIT - 1, zero + lo + length)
        new = mix(key[own].view(np.uint64) + mix(shared + np.uint64(lo + (1 << 20))))
        yield _batch(new.view(np.int64), who[own], at[own], -a, np.zeros(len(own)), _strings_array(raw, zero + a, b - a + length))


def _stage(length: int, hot: int | None):
    """Turns sorted strings into spans, group by group; spans pass. A group of over hot strings is split instead."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, splitting = 0, None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=[f.name for f in STRINGS.fields])
            spans = batch.column(5).is_null().to_numpy(zero_copy_only=False)
            if spans.any():
                yield batch.filter(pa.array(spans))
                batch = batch.filter(pa.array(~spans))
            if not len(batch):
                continue
            key = batch.column(0).to_numpy()
            if splitting is not None:  # the rest of a group that is being split
                n = len(key) if key[-1] == splitting else int((key == splitting).sum())
                if n:
                    yield from _split(batch.slice(0, n), length)
                if n < len(key):
                    splitting = None
                batch, key = batch.slice(n), key[n:]
                if not len(batch):
                    continue
            held.append(batch)
            size += batch.nbytes
            if size < BATCH and not (hot and sum(map(len, held)) > hot):
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = table.column(0).to_numpy()
            cut = int(np.flatnonzero(np.append(True, np.diff(key) != 0))[-1])
            yield from _groups(table.slice(0, cut), length, hot)
            rest = table.slice(cut)
            if hot and len(rest) > hot:
                yield from _split(rest, length)
                splitting, rest = key[-1], rest.slice(0, 0)
            held, size = ([rest], rest.nbytes) if len(rest) else ([], 0)
        if held:
            yield from _groups(pa.Table.from_batches(held).combine_chunks().to_batches()[0], length, hot)

    return run


def _groups(rows: pa.RecordBatch, length: int, hot: int | None) -> Iterator[pa.RecordBatch]:
    """Complete groups: several small ones share a suffix array of about BATCH bytes; hot ones are split."""
    if not len(rows):
        return
    key = rows.column(0).to_numpy()
    edges = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
    lo = 0
    per = max(1, BATCH // (length + GRAM))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        big = hot is not None and b - a > hot
        if a > lo and (big or b - lo > per):
            yield _solve(rows.slice(lo, a - lo), length)
            lo = a
        if big:
            yield from _split(rows.slice(a, b - a), length)
            lo = b
    if lo < len(key):
        yield _solve(rows.slice(lo), length)


def repeated_spans(docs: DataFrame, length: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Two tables of (__id, spans) that together hold the byte spans covered by strings which start earlier as well. docs: __id, doc_id, text."""
    parts, sound = shuffle_partitions(docs), SoundHash()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, offsets in text_blocks(batch.column(1)):
                prefix = prefix_hash(raw)
                row, at, first, last, h = anchors(prefix, offsets, length)
                whole = sound.spans(raw, first, last + length, prefix)
                place = ((at - offsets[row]) << 24) | ((at - first) << 12) | (last - first + 1)
                who = batch.column(0).to_numpy()[lo + row]
                # A string that stands earlier in the block too is a copy whatever else there is: it needs no meeting under its anchor and is dealt anywhere.
                order = np.lexsort((place, who, whole, h))
                again = order[1:][(h[order[1:]] == h[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])]
                copy = np.zeros(len(h), bool)
                copy[again] = True
                new = order[~copy[order]]
                first_of = np.repeat(new, np.diff(np.append(np.flatnonzero(~copy[order]), len(order))))
                same = (who[order] == who[first_of]) & (place[order] == place[first_of])
                copy[order[same]] = False
                spread = np.where(copy, mix(who.astype(np.uint64) ^ (place.astype(np.uint64) << np.uint64(20))), h)
                kinds = np.where(copy, np.uint64(0), whole)
                yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.array(kinds.view(np.int64)), pa.array(who), pa.array(place), pa.array(copy)], names=["h", "c", "id", "place", "copy"])

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted anchors: the later copies of a string, and the first copies of the strings of anchors that have several."""
        held, several = [np.zeros(0, np.int64)] * 4, False  # the first copy of the last string, and whether its anchor had another before
        out = lambda keep, copy, x: pa.RecordBatch.from_arrays([*(pa.array(x[k][keep]) for k in (0, 2, 3)), pa.array(copy)], names=["h", "id", "place", "copy"])
        for batch in batches:
            sure = batch.column(4).to_numpy(zero_copy_only=False)
            if sure.any():
                yield out(np.flatnonzero(sure), sure[sure], [batch.column(k).to_numpy() for k in range(4)])
                batch = batch.filter(pa.array(~sure))
            x = [np.append(a, batch.column(k).to_numpy()) for k, a in enumerate(held)]
            if not len(x[0]):
                continue
            h, c, who, place = x
            new_h = np.append(True, np.diff(h) != 0)
            new = new_h | np.append(True, np.diff(c) != 0)
            kind = np.flatnonzero(new)
            before = ~new_h[kind]
            before[0] = several
            after = np.append(~new_h[kind[1:]], False)
            ready = kind[:-1][(before | after)[:-1]]
            first = kind[np.cumsum(new) - 1]
            copies = np.flatnonzero(~new & ((who != who[first]) | (place != place[first])))
            yield out(np.append(ready, copies), np.arange(len(ready) + len(copies)) >= len(ready), x)
            held, several = [a[kind[-1] : kind[-1] + 1] for a in x], bool(before[-1])
        if several:
            yield out(np.array([0]), np.array([False]), held)

    grams = docs.select("__id", "text").mapInArrow(scan, "h long, c long, id long, place long, copy boolean")
    sifted = grams.repartition(parts, "h").sortWithinPartitions("h", "c", "id", "place").mapInArrow(sift, "h long, id long, place long, copy boolean")
    each = sifted.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("h", "place", "copy")).alias("items"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, items = _list_of(batch, "items")
            ends = np.append(0, np.cumsum(size))
            h, place = _field(items, "h"), _field(items, "place")
            for lo, hi, raw, offsets in text_blocks(batch.column(2)):
                own = slice(ends[lo], ends[hi])
                row = np.repeat(np.arange(hi - lo), size[lo:hi])
                at, anchor, windows = place[own] >> 24, (place[own] >> 12) & 4095, place[own] & 4095
                for k in range(0, len(row), 20_000):  # strings overlap: they take several times the text's bytes
                    s = slice(k, k + 20_000)
                    begin = offsets[row[s]] + at[s] - anchor[s]
                    who = batch.column(0).to_numpy()[lo + row[s]]
                    yield _batch(h[own][s], who, at[s], anchor[s], np.zeros(len(who)), _strings_array(raw, begin, windows[s] + length - 1))

    wanted = each.select("__id", F.filter("items", lambda x: ~x["copy"]).alias("items")).where(F.size("items") > 0)
    # The same columns as in the last join, so that one exchange of the texts serves both.
    strings = docs.join(wanted.hint("shuffle_hash"), "__id").mapInArrow(cut, STRINGS)
    in_order = lambda df: df.repartition(parts, "key").sortWithinPartitions("key", "id", "at")
    solved = in_order(in_order(strings).mapInArrow(_stage(length, hot), STRINGS)).mapInArrow(_stage(length, None), STRINGS)
    begin = lambda x: F.shiftright(x["place"], 24) - F.shiftright(x["place"], 12).bitwiseAND(4095)
    copies = each.select("__id", F.transform(F.filter("items", lambda x: x["copy"]), lambda x: F.struct(begin(x).alias("begin"), (begin(x) + x["place"].bitwiseAND(4095) + (length - 1)).alias("end"))).alias("spans"))
    return copies, solved.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct(F.col("at").alias("begin"), "end")).alias("more"))


def covered(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of size bytes the spans cover."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, begin, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def dedup_bytes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, kept, n_bytes, removed): the UTF-8 bytes of each text without repeated ones, its size, and the removed (begin, end) runs.

    Removed is every byte covered by a string of length bytes that also starts
    earlier: in a text of smaller doc_id (null is the smallest) or earlier in
    the same text. Strings are judged on the input, may overlap, and never
    cross texts. Null texts are empty; texts shorter than length keep all.
    Repeated rows with one doc_id and text are one text and lose the same
    bytes; different texts under one doc_id count in the order of a hash of the
    text. Other columns are left out. An empty table gives no rows.
    """
    if length < SYMBOL * 2 or length > 2048:
        raise ValueError("length must be from 16 to 2048")
    docs = _numbered(df.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")))
    copies, more = repeated_spans(docs, length, hot)
    joined = docs.join(copies.hint("shuffle_hash"), "__id", "left").join(more.hint("shuffle_hash"), "__id", "left").select("doc_id", "text", "spans", "more")
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([df.select(F.col(doc_id).alias("doc_id")).schema[0], T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("removed", span)])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_list_of(batch, x) for x in ("spans", "more")]
            ends = [np.append(0, np.cumsum(size)) for size, _ in lists]
            for lo, hi, raw, offsets in text_blocks(batch.column(1)):
                begin, end = [], []
                for (size, items), at in zip(lists, ends, strict=True):
                    shift = np.repeat(offsets[:-1], size[lo:hi])
                    begin.append(_field(items, "begin")[at[lo] : at[hi]] + shift)
                    end.append(_field(items, "end")[at[lo] : at[hi]] + shift)
                gone = covered(len(raw), np.concatenate(begin).astype(np.int64), np.concatenate(end).astype(np.int64))
                # A run also ends with its text.
                edge = np.zeros(len(raw) + 1, bool)
                edge[offsets] = True
                opens = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])))
                closes = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1
                row = np.searchsorted(offsets, opens, "right") - 1
                runs = pa.StructArray.from_arrays([pa.array(opens - offsets[row]), pa.array(closes - offsets[row])], names=["begin", "end"])
                left = np.append(0, np.cumsum(~gone))[offsets].astype(np.int32)
                kept = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(left), pa.py_buffer(raw[~gone])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), kept, pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32()), runs)],
                    names=[f.name for f in schema.fields],
                )

    return joined.mapInArrow(cut, schema)


def digests(documents: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return dedup_bytes(documents).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
