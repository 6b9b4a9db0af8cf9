"""Benchmark decontamination by spaced-seed hashing.

A mask compares five of the words it spans and ignores the others. The masks are
fixed so that two equally long word sequences of 10 to 20 words that agree in at
least SIMILARITY of their places share a masked hash at some place, wherever the
substituted words stand (the tests try all of them). Shared hashes give a
diagonal, along which the overlap is verified word by word: first by hashes of
words, and what passes by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposift.llm.common import checkpointed, mix, prefix_hash, ragged, span_hash, text_blocks, unused, word_spans

# Five compared words each.
MASKS = ("11111", "110111", "11010011")
#: Words of a verified window; an item with fewer is one window.
WINDOW = 20
SIMILARITY = 0.8
#: Items with fewer words than this must be found word for word.
SHORT = 10
#: Most masked hashes of the benchmark that are sent to every executor (16 bytes each); above it they are joined by shuffle.
BROADCAST_SEEDS = 1_000_000
#: Bits of the sieve that the shuffle join sends ahead (16 MB whatever the benchmark's size).
SIEVE_BITS = 27
#: Parts into which the shuffle join deals the documents of one masked hash, one text or one item.
SALTS = 32
#: Candidates of one document that travel with one copy of its text, about.
LIST = 1000
#: Pairs of places that one numpy pass looks at.
PAIRS = 1 << 20


class Words:
    """The words of the rows of a text block: hashes, first word of each row (rows + 1), and the words themselves on demand."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        self.start, self.end, self.rows = word_spans(raw, offsets)
        self.hashes = span_hash(prefix_hash(raw), self.start, self.end)

    def row(self, k: int) -> np.ndarray:
        return self.hashes[self.rows[k] : self.rows[k + 1]]

    def spelt(self, lo: int, hi: int) -> list[bytes]:
        """Words number lo to hi of the block."""
        return [self.raw[a:b].tobytes() for a, b in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]


def _salts(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def masked(words: np.ndarray, rows: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the mask laid on every place of every row where it fits."""
    room = np.maximum(np.diff(rows) - len(mask) + 1, 0)
    at = ragged(rows[:-1], room)
    total = np.full(len(at), salt, np.uint64)
    for k, factor in zip([i for i, x in enumerate(mask) if x == "1"], _salts(len(mask)), strict=False):
        total += words[at + k] * factor
    return at, mix(total)


def all_seeds(words: np.ndarray, rows: np.ndarray, short: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Masked places of the MASKS, and one solid mask for each of the short lengths."""
    for k, mask in enumerate(MASKS):
        yield masked(words, rows, mask, k)
    for n in short:
        yield masked(words, rows, "1" * n, 1000 + n)


def item_seeds(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of the items: items below SHORT words by their solid mask, the others by the MASKS."""
    size = np.diff(rows)
    found = []
    for n in range(1, SHORT):
        at, h = masked(words, rows, "1" * n, 1000 + n)
        own = size[np.searchsorted(rows, at, "right") - 1] == n
        found.append((h[own], at[own]))
    for k, mask in enumerate(MASKS):
        at, h = masked(words, rows, mask, k)
        own = size[np.searchsorted(rows, at, "right") - 1] >= SHORT
        found.append((h[own], at[own]))
    h, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, h))
    return h[order], at[order]


def _windows(same: np.ndarray, size: int) -> tuple[int, int, float] | None:
    """First place, end place and best share of the windows of size places that pass; same: whether each place agrees."""
    total = np.concatenate(([0], np.cumsum(same)))
    agree = total[size:] - total[:-size]
    good = np.flatnonzero(agree >= (size if size < SHORT else ceil(SIMILARITY * size)))
    if not len(good):
        return None
    return int(good[0]), int(good[-1]) + size, float(agree.max() / size)


def overlap(items: Words, item: int, docs: Words, doc: int, shift: int) -> tuple[int, int, float] | None:
    """First word, end word in the document and best share of the windows that pass, the item's first word lying on the document's word number shift."""
    own, text = items.row(item), docs.row(doc)
    size = min(len(own), WINDOW)
    lo, hi = max(0, -shift), min(len(own), len(text) - shift)
    if hi - lo < size or not _windows(own[lo:hi] == text[lo + shift : hi + shift], size):
        return None
    # What agrees by hash is compared as words.
    mine = items.spelt(items.rows[item] + lo, items.rows[item] + hi)
    theirs = docs.spelt(docs.rows[doc] + lo + shift, docs.rows[doc] + hi + shift)
    found = _windows(np.array([a == b for a, b in zip(mine, theirs, strict=True)]), size)
    return found and (lo + shift + found[0], lo + shift + found[1], found[2])


def _whole(texts: pa.Array) -> Words:
    """The words of all rows of a bounded column, lower-cased, as one block."""
    raw, ends = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
    for _, _, data, offsets in text_blocks(texts, lower=True):
        raw.append(data.copy())
        ends.append(offsets[1:] + ends[-1][-1])
    return Words(np.concatenate(raw), np.concatenate(ends))


class Index:
    """The benchmark's masked hashes in a task."""

    def __init__(self, texts: pa.Array):
        self.items = _whole(texts)
        rows = self.items.rows
        self.h, self.at = item_seeds(self.items.hashes, rows)
        size = np.diff(rows)
        self.short = [n for n in range(1, SHORT) if (size == n).any()]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.h >> np.uint64(42)).astype(np.int64)] = True
        self.item_of = np.searchsorted(rows, self.at, "right") - 1
        self.place = self.at - rows[self.item_of]

    def diagonals(self, words: Words) -> np.ndarray:
        """Distinct (row, item, shift) that share a masked hash, in order; a bounded number of pairs of places at a time."""
        found = np.zeros((0, 3), np.int64)
        for place, key in all_seeds(words.hashes, words.rows, self.short):
            maybe = np.flatnonzero(self.seen[(key >> np.uint64(42)).astype(np.int64)])
            place, key = place[maybe], key[maybe]
            first, end = np.searchsorted(self.h, key, "left"), np.searchsorted(self.h, key, "right")
            some = end > first
            place, first, n = place[some], first[some], (end - first)[some]
            total = np.append(0, np.cumsum(n))
            lo = 0
            while lo < len(place):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
                hit, seed = np.repeat(place[lo:hi], n[lo:hi]), ragged(first[lo:hi], n[lo:hi])
                row = np.searchsorted(words.rows, hit, "right") - 1
                new = np.stack((row, self.item_of[seed], hit - words.rows[row] - self.place[seed]), 1)
                found = np.unique(np.concatenate((found, new)), axis=0)
                lo = hi
        return found

    def overlaps(self, words: Words) -> Iterator[tuple]:
        """(row, item, first word, end word, share) of all verified overlaps of a block."""
        for row, item, shift in self.diagonals(words).tolist():
            if got := overlap(self.items, item, words, row, shift):
                yield row, item, *got


OUT = "doc_id {0}, item_id {1}, first_word int, end_word int, similarity double"


def _rows(found: list, doc_type: pa.DataType, item_type: pa.DataType, names: tuple[str, str] = ("doc_id", "item_id")) -> pa.RecordBatch:
    doc, item, first, end, share = ([x[k] for x in found] for k in range(5))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, doc_type), pa.array(item, item_type), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(share, pa.float64())],
        names=[*names, "first_word", "end_word", "similarity"],
    )


def _by_broadcast(docs: DataFrame, items: pa.Table, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.combine_chunks()
        names, index = table.column(0).to_pylist(), Index(table.column(1).combine_chunks())
        for batch in batches:
            for lo, _, raw, offsets in text_blocks(batch.column(1), lower=True):
                found = [(batch.column(0)[lo + row].as_py(), names[item], *rest) for row, item, *rest in index.overlaps(Words(raw, offsets))]
                if found:
                    yield _rows(found, batch.column(0).type, table.column(0).type)

    return docs.mapInArrow(run, schema)


def _content(text: Column) -> Column:
    """Key of a text. Overlaps depend on the text alone, so that copies are looked at once and rows without id are found like any other."""
    return F.sha2(text, 256)


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _dealt(small: DataFrame) -> DataFrame:
    """The rows once for each of the SALTS parts of the other side."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _sieve(seeds: DataFrame) -> np.ndarray:
    """Bits of the top SIEVE_BITS of all hashes; at most 2 ** (SIEVE_BITS - 15) rows of 4 KB reach the driver."""
    top = F.shiftrightunsigned("h", 64 - SIEVE_BITS) + 1  # from 1 on, so that part k + 1 holds the values from 32768 * k on
    parts = seeds.groupBy(F.bitmap_bucket_number(top).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(top)).alias("bits")).collect()
    out = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for r in parts:
        lo = (r["part"] - 1) * 4096
        out[lo : lo + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _in_sieve(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    value = (h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
    return (sieve[value >> 3] >> (value & 7).astype(np.uint8)) & 1 == 1


def _by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_key, first_word, end_word, similarity): the same by a join of masked hashes, for a benchmark of any size; keys are those of the texts.

    A sieve of fixed size leaves out the documents' hashes that no item has.
    Rows of one hash, one text or one item are dealt into SALTS parts.
    """
    context = docs.sparkSession.sparkContext
    items = items.select(_content(F.col("text")).alias("item_key"), "text").dropDuplicates(["item_key"])

    def of_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, offsets in text_blocks(batch.column(1), lower=True):
                words = Words(raw, offsets)
                h, at = item_seeds(words.hashes, words.rows)
                row = np.searchsorted(words.rows, at, "right") - 1
                size = np.diff(words.rows)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row + lo)), pa.array(at - words.rows[row], pa.int32()), pa.array(size, pa.int32())], names=["h", "item_key", "item_at", "size"]
                )

    right = checkpointed(items.mapInArrow(of_items, "h long, item_key string, item_at int, size int"))
    short = [r["size"] for r in right.where(F.col("size") < SHORT).select("size").distinct().orderBy("size").collect()]
    sieve = context.broadcast(_sieve(right))

    def of_docs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, offsets in text_blocks(batch.column(1), lower=True):
                words = Words(raw, offsets)
                for at, h in all_seeds(words.hashes, words.rows, short):
                    some = np.flatnonzero(_in_sieve(sieve.value, h))
                    at, h = at[some], h[some]
                    row = np.searchsorted(words.rows, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row + lo)), pa.array(at - words.rows[row], pa.int32())], names=["h", "key", "at"])

    keyed = docs.select(_content(F.col("text")).alias("key"), "text")
    left = keyed.mapInArrow(of_docs, "h long, key string, at int").withColumn("salt", _salt("key", "at"))
    shifts = left.join(_dealt(right), ["h", "salt"]).select("key", "item_key", "size", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    shifts = checkpointed(shifts)
    # Each candidate takes the piece of the document that the item lies on; texts themselves are joined to lists of candidates, of about LIST each however many a document has.
    lists = shifts.groupBy("key").agg(F.ceil(F.count("*") / LIST).alias("lists"))
    dealt = shifts.join(lists, "key").withColumn("list", F.pmod(F.xxhash64("item_key", "shift"), F.col("lists")))
    listed = dealt.groupBy("key", "list").agg(F.collect_list(F.struct("item_key", "size", "shift")).alias("items")).drop("list")
    texts = keyed.dropDuplicates(["key"]).join(listed, "key")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                words = _whole(batch.column(1).slice(k, 1))
                wanted = batch.column(2)[k].as_py()
                for at in range(0, len(wanted), 1000):
                    out = [(x["item_key"], x["shift"], b" ".join(words.spelt(max(0, x["shift"]), max(0, x["shift"] + x["size"])))) for x in wanted[at : at + 1000]]
                    own = [batch.column(0)[k].as_py()] * len(out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.string()), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2].decode() for x in out], pa.string())],
                        names=["key", "item_key", "shift", "piece"],
                    )

    cut = texts.mapInArrow(pieces, "key string, item_key string, shift int, piece string").withColumn("salt", _salt("key", "shift"))
    both = cut.join(_dealt(items), ["item_key", "salt"]).select("key", "item_key", "shift", "piece", "text")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(len(batch)):
                shift = batch.column(2)[k].as_py()
                piece, item = _whole(batch.column(3).slice(k, 1)), _whole(batch.column(4).slice(k, 1))
                if got := overlap(item, 0, piece, 0, min(shift, 0)):
                    skipped = max(shift, 0)
                    found.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), got[0] + skipped, got[1] + skipped, got[2]))
            if found:
                yield _rows(found, pa.string(), pa.string(), ("key", "item_key"))

    return both.mapInArrow(verify, "key string, item_key string, first_word int, end_word int, similarity double")


def _small(items: DataFrame, most_seeds: int) -> bool:
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")) * len(MASKS)), F.sum(F.length("text"))).first()
    return (size[0] or 0) <= most_seeds and (size[1] or 0) <= 16 * most_seeds


def overlaps(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, similarity): one row per verified overlap of a document and a benchmark item on one diagonal.

    An overlap is a window of WINDOW words (or the whole item, if shorter) that
    agrees in at least SIMILARITY of its words, in any letter case; an item of
    fewer than SHORT words must agree in all. The words from first_word to
    end_word cover all such windows. Null or empty texts and items overlap
    nothing; rows without id overlap like any other; each repeated row, of
    either table, repeats its overlaps; empty tables give none. Columns besides
    the four named ones are not read. The benchmark is sent to the executors
    only if it has at most most_seeds masked hashes, counted first; else the
    hashes are joined by shuffle, with the same rows as result.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text"))
    if _small(items, most_seeds):
        schema = OUT.format(own.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
        return _by_broadcast(own, items.toArrow(), schema)
    found = _by_shuffle(own, items)
    named = items.select("item_id", _content(F.col("text")).alias("item_key"))
    keyed = own.select("doc_id", _content(F.col("text")).alias("key")).withColumn("salt", _salt("doc_id"))
    found = found.withColumn("salt", _salt("key", "first_word")).join(_dealt(named), ["item_key", "salt"]).drop("salt")
    return keyed.join(_dealt(found), ["key", "salt"]).select("doc_id", "item_id", "first_word", "end_word", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", most_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The documents without a verified overlap with any benchmark item.

    Each row is judged by its own text, so rows without id, or with an id that
    other rows have too, stay or go by themselves. Null and empty texts stay.
    All columns stay; an empty table stays empty, an empty benchmark drops none.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    if _small(items, most_seeds):
        sent = docs.sparkSession.sparkContext.broadcast(items.select("text").toArrow())
        at = docs.columns.index(text)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value.combine_chunks().column(0).combine_chunks())
            for batch in batches:
                for lo, hi, raw, offsets in text_blocks(batch.column(at), lower=True):
                    keep = np.ones(hi - lo, bool)
                    keep[[x[0] for x in index.overlaps(Words(raw, offsets))]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(keep))

        return docs.mapInArrow(run, T.StructType(docs.schema.fields))
    key, salt = unused(docs, "key"), unused(docs, "salt")
    found = _dealt(_by_shuffle(docs.select(F.coalesce(text, F.lit("")).alias("text")), items).select("key").distinct())
    keyed = docs.withColumns({key: _content(F.coalesce(text, F.lit(""))), salt: _salt(doc_id)})
    return keyed.join(found.toDF(key, salt), [key, salt], "left_anti").select(*docs.columns)


def oracle() -> str:
    """The overlaps of documents and benchmark in DuckDB SQL: equal words give diagonals, on which every window is counted."""
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
    return f"""
WITH doc_words AS (SELECT doc_id, i AS p, w[i] AS word, len(w) AS n FROM (SELECT doc_id, {words} AS w FROM documents), unnest(range(1, len(w) + 1)) AS r(i)),
item_words AS (SELECT item_id, i AS q, w[i] AS word, len(w) AS m, least(len(w), {WINDOW}) AS size FROM (SELECT item_id, {words} AS w FROM benchmark), unnest(range(1, len(w) + 1)) AS r(i)),
met AS (SELECT doc_id, item_id, p - q AS shift, q, n, m, size, CASE WHEN size < {SHORT} THEN size ELSE ceil({SIMILARITY} * size) END AS need FROM doc_words JOIN item_words USING (word)),
kept AS (SELECT doc_id, item_id, shift, any_value(n) AS n, any_value(m) AS m, any_value(size) AS size, any_value(need) AS need, list(q) AS qs FROM met GROUP BY doc_id, item_id, shift HAVING count(*) >= any_value(need)),
windows AS (SELECT *, k, len(list_filter(qs, lambda x: x >= k AND x < k + size)) AS agree FROM kept, unnest(range(greatest(1, 1 - shift), least(m, n - shift) - size + 2)) AS r(k))
SELECT doc_id, item_id, (min(k) FILTER (WHERE agree >= need) + shift - 1)::INTEGER AS first_word,
  (max(k) FILTER (WHERE agree >= need) + shift - 1 + any_value(size))::INTEGER AS end_word, max(agree) / any_value(size) AS similarity
FROM windows GROUP BY doc_id, item_id, shift HAVING max(agree) >= any_value(need)"""
