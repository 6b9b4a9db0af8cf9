"""Spelling variants: words one edit apart, found by probing Bloom filters, then an exact join.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, with only
A-Z lower-cased, so that a word is a string of bytes in Latin-1. Two words are
near if they differ by one inserted, deleted or replaced letter.

The vocabulary sets bits in blocked Bloom filters, one for each length of word
(lengths from LONG on share one). The filters go to all tasks, and each word
probes those edits of its own that could be words: its deletions, and its
replacements by a higher letter, so that each pair is generated from one side
only. Positives alone are shuffled, to an exact join with the vocabulary that
removes the false ones.

A filter is cut by hash into parts, and parts that exceed FILTER_BYTES together
are sent in several passes, each of which probes its own parts only; so what is
broadcast is bounded at any size of the vocabulary.

Defined results: null and empty texts have no words; a null id counts as an
empty one for slips; repeated rows count again; of the given columns only the id
and the text are read, so clashing names do not matter; an empty table has no
words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.checksum import CRC_TABLE, continued, crc
from reposift.llm.common import lower_ascii, mix, powers, ragged, shuffle_partitions, stored, text_blocks

#: Code points and occurrences that a word has at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of this length or more share one filter.
LONG = 64
#: Filter bits of a word; bytes of filters that one pass sends to the tasks; blocks of 64 bits in a part at most.
BITS, FILTER_BYTES, PART_BLOCKS = 32, 64 << 20, 1 << 20
#: Bytes of text counted together; letters, and candidates' letters, that a pass of numpy holds.
COUNT_BYTES, CELLS = 4 << 20, 1 << 18

_LEAD = 0xC3  # of the two bytes of U+00C0 to U+00FF
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), _LEAD]] = True
_CODE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_SECOND = np.uint64(0xA0761D6478BD642F)


def letter_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and number of code points of each maximal run of letters; runs end with their text."""
    follows = np.zeros(len(raw), bool)
    follows[1:] = raw[:-1] == _LEAD
    letter = _LETTER[raw] | follows
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1 if len(raw) else np.zeros(0, np.int64)
    inner = offsets[1:-1]
    cuts = np.unique(np.concatenate(([0], edge, inner[(inner > 0) & (inner < len(raw))], [len(raw)])))
    start, end = cuts[:-1], cuts[1:]
    own = letter[start] if len(raw) else np.zeros(len(start), bool)
    start, end = start[own], end[own]
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return start, end, before[end] - before[start]


def _strings(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[ragged(start, length)]))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int | None = None) -> DataFrame:
    """(word, n): the words of all texts with at least so many code points and occurrences.

    With slips, typing errors are planted before counting: where it divides h,
    the CRC-32 of `<key>:<word>`, the word loses its code point h % length.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_blocks(batch.column(1), COUNT_BYTES):
                start, end, points = letter_runs(raw, offsets)
                some = points >= least_length
                start, length = start[some], (end - start)[some]
                if not len(start):
                    continue
                low, changed = lower_ascii(raw), []
                if slips:
                    state = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in batch.column(0).slice(lo, hi - lo).to_pylist()], np.uint32)
                    h = continued(state[np.searchsorted(offsets, start, "right") - 1], low, start, length)
                    hit = h % np.uint32(slips) == 0
                    for at, n, k in zip(start[hit].tolist(), length[hit].tolist(), h[hit].tolist(), strict=True):
                        word = low[at : at + n].tobytes().decode()
                        k %= len(word)
                        changed.append(word[:k] + word[k + 1 :])
                    start, length = start[~hit], length[~hit]
                words = pa.concat_arrays([_strings(low, start, length), pa.array([w for w in changed if len(w) >= least_length], pa.string())])
                counts = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["word", "n"])

    counted = docs.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Layout:
    """Where the bits of a word of a given length and hash lie: which part, and which two blocks of it."""

    def __init__(self, counts: dict[int, int]):
        self.first, self.parts, self.blocks, sizes = {}, {}, {}, []
        for length in sorted(counts):
            blocks = max(1, -(-counts[length] * BITS // 64))
            parts = -(-blocks // PART_BLOCKS)
            self.first[length], self.parts[length], self.blocks[length] = len(sizes), parts, -(-blocks // parts)
            sizes += [self.blocks[length]] * parts
        self.starts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
        #: (first block, end) of each pass: whole parts of FILTER_BYTES together, a single part at least.
        self.passes, begin = [], 0
        for k in range(len(sizes)):
            if (self.starts[k + 1] - self.starts[begin]) * 8 > FILTER_BYTES and k > begin:
                self.passes.append((int(self.starts[begin]), int(self.starts[k])))
                begin = k
        if sizes:
            self.passes.append((int(self.starts[begin]), int(self.starts[-1])))

    def place(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First block and its bits, second block and its bits, of hashes of words of one length."""
        length = min(length, LONG)
        one, two = mix(h), mix(h ^ _SECOND)
        part = ((one & np.uint64(0xFFFF)) * np.uint64(self.parts[length]) >> np.uint64(16)).astype(np.int64)
        base, blocks = self.starts[self.first[length] + part], np.uint64(self.blocks[length])
        return (*self._in(base, blocks, one), *self._in(base, blocks, two))

    @staticmethod
    def _in(base: np.ndarray, blocks: np.uint64, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.zeros(len(h), np.uint64)
        for k in (16, 22, 28, 34):
            bits |= np.uint64(1) << ((h >> np.uint64(k)) & np.uint64(63))
        return base + ((h >> np.uint64(40)) * blocks >> np.uint64(24)).astype(np.int64), bits


def _contains(layout: Layout, part: np.ndarray, begin: int, h: np.ndarray, length: int) -> np.ndarray:
    """Which hashes may be those of words of the length; part: the filter's blocks from begin on, others hold none."""
    if min(length, LONG) not in layout.first or not len(h):
        return np.zeros(0, np.int64)
    block, bits, other, more = layout.place(h, length)
    block -= begin
    maybe = np.flatnonzero((block >= 0) & (block < len(part)))
    maybe = maybe[part[block[maybe]] & bits[maybe] == bits[maybe]]
    return maybe[part[other[maybe] - begin] & more[maybe] == more[maybe]]


def _latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a letter, and where each word begins (words + 1)."""
    codes, starts = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
    for _, _, raw, offsets in text_blocks(words):
        lead = raw == _LEAD
        follows = np.zeros(len(raw), bool)
        follows[1:] = lead[:-1]
        codes.append(np.where(follows, raw | 0x40, raw)[~lead])
        starts.append(np.concatenate(([0], np.cumsum(~lead)))[offsets[1:]] + starts[-1][-1])
    return np.concatenate(codes), np.concatenate(starts)


def _utf8(codes: np.ndarray) -> pa.Array:
    """The words of a matrix of letters."""
    wide = codes >= 0x80
    room = 1 + wide
    at = np.cumsum(room.ravel()).reshape(codes.shape) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[at] = np.where(wide, _LEAD, codes)
    out[at[wide] + 1] = codes[wide] & 0xBF
    offsets = np.concatenate(([0], np.cumsum(room.sum(1)))).astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(out))


def _groups(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of letters) of words of equal length, a bounded number of letters at a time."""
    length = np.diff(starts)
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        step = max(1, CELLS // max(n, 1))
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            yield own, codes[starts[own][:, None] + np.arange(n)]


def _hashes(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each letter's share of its word's hash, and the sums of the shares up to each letter."""
    power = powers(letters.shape[1])[0]
    share = _CODE[letters] * power
    return power, share, np.cumsum(share, axis=1)


def _edits(letters: np.ndarray, alphabet: list[int]) -> Iterator[tuple[int, int | None, np.ndarray, np.ndarray]]:
    """(length, new letter or None, cells, hashes) of the deletions, then of the replacements by each letter.

    Of equal letters in a row only the first is deleted, and only lower letters are replaced.
    """
    n = letters.shape[1]
    power, share, sums = _hashes(letters)
    whole = sums[:, -1:]
    first = np.ones(letters.shape, bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    cells = np.flatnonzero(first)
    yield n - 1, None, cells, ((sums - share) + (whole - sums) * powers(2)[1][1]).ravel()[cells]
    rest = whole - share
    for c in alphabet:
        cells = np.flatnonzero(letters < c)
        yield n, c, cells, rest.ravel()[cells] + (_CODE[c] * power)[cells % n]


def _candidates(letters: np.ndarray, cells: np.ndarray, new: int | None) -> np.ndarray:
    n = letters.shape[1]
    rows, at = cells // n, cells % n
    if new is None:
        keep = np.ones((len(rows), n), bool)
        keep[np.arange(len(rows)), at] = False
        return letters[rows][keep].reshape(len(rows), n - 1)
    out = letters[rows]
    out[np.arange(len(rows)), at] = new
    return out


def _positives(vocabulary: DataFrame) -> DataFrame | None:
    """(word, n, near): edits of each word that a filter holds, each pair of near words from one side; None for an empty vocabulary."""
    spark = vocabulary.sparkSession
    lengths = vocabulary.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("length")).count().collect()  # up to LONG rows
    layout = Layout({r["length"]: r["count"] for r in lengths})
    alphabet = sorted(ord(r[0]) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect() if r[0])  # up to 90 letters

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in _groups(*_latin(batch.column(0))):
                found = layout.place(_hashes(letters)[2][:, -1], letters.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[::2])), pa.array(np.concatenate(found[1::2]).view(np.int64))], names=["block", "bits"])

    filters = vocabulary.select("word").mapInArrow(place, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    filters = stored(filters) if len(layout.passes) > 1 else filters
    spread, found = vocabulary.repartition(shuffle_partitions(vocabulary)), None
    for begin, end in layout.passes:
        rows = filters.where(F.col("block").between(begin, end - 1)).toArrow()  # twice FILTER_BYTES at most, or one part
        part = np.zeros(end - begin, np.uint64)
        part[rows.column("block").to_numpy() - begin] = rows.column("bits").to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast(part)

        def probe(batches: Iterable[pa.RecordBatch], begin: int = begin, sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, counts = batch.columns
                for rows, letters in _groups(*_latin(words)):
                    for length, new, cells, h in _edits(letters, alphabet):
                        cells = cells[_contains(layout, sent.value, begin, h, length)]
                        step = max(1, 4 * CELLS // max(1, letters.shape[1]))
                        for lo in range(0, len(cells), step):
                            own = cells[lo : lo + step]
                            source = pa.array(rows[own // letters.shape[1]])
                            yield pa.RecordBatch.from_arrays([words.take(source), counts.take(source), _utf8(_candidates(letters, own, new))], names=["word", "n", "near"])

        own = spread.select("word", "n").mapInArrow(probe, "word string, n long, near string")
        found = own if found is None else found.unionByName(own)
    return found


def near_pairs(vocabulary: DataFrame) -> DataFrame | None:
    """(word, n, near, near_n) of near words, each pair once. vocabulary: (word, n), a stored table of different words."""
    probed = _positives(vocabulary)
    return None if probed is None else probed.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. A form has twice its word's count at least, so doubling ends after a few steps."""
    found = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        found = stored(found.drop("moved").join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        if found.where("moved").isEmpty():
            return found.drop("moved")


def variants(counted: DataFrame) -> DataFrame:
    """Each word of (word, n) with form, root, n_near and form_n.

    form is the near word of largest n, ties by code points, if it occurs twice
    as often at least; root is the last word reached by following forms.
    """
    vocabulary = stored(counted.select("word", "n"))
    pairs = near_pairs(vocabulary)
    none = F.lit(None).cast("string")
    if pairs is None:
        return vocabulary.select("word", none.alias("form"), "word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n")).toDF("word", "form", "root", "n", "n_near", "form_n")
    side = lambda word, n, near, near_n: F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.struct((-F.col(near_n)).alias("order"), F.col(near).alias("near")).alias("best"))
    both = pairs.select(F.explode(F.array(side("word", "n", "near", "near_n"), side("near", "near_n", "word", "n"))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"), F.first("n").alias("n"))
    better = -F.col("best.order") >= 2 * F.col("n")
    chosen = stored(near.select("word", "n_near", F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.order")).alias("form_n")))
    roots = _roots(chosen.where("form IS NOT NULL"))
    out = vocabulary.join(chosen, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def digests(docs: DataFrame) -> DataFrame:
    """The variants of the words of documents, with slips planted."""
    return variants(count_words(docs, slips=97))


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{upper}', '{upper.lower()}') AS run FROM documents),
summed AS (SELECT run, {crc("doc_id || ':' || run")} AS h, count(*) AS k FROM (SELECT * FROM runs WHERE length(run) >= {LEAST_LENGTH}), crc_table GROUP BY run, h),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM summed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
cut AS (SELECT word, n, length(word) AS l, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM words, unnest(range(length(word))) AS r(i)),
pairs AS (SELECT DISTINCT c.word, w.word AS near, c.n, w.n AS near_n FROM cut c JOIN words w ON w.word = c.less
  UNION ALL SELECT a.word, b.word, a.n, b.n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.l = b.l AND a.word < b.word),
sided AS (SELECT word, near, n, near_n FROM pairs UNION ALL SELECT near, word, near_n, n FROM pairs),
chosen AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min({{'form': near, 'n': near_n}}, (-near_n, encode(near))) AS best FROM sided GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * w.n THEN best.form END AS form, CASE WHEN best.n >= 2 * w.n THEN best.n END AS form_n FROM words w LEFT JOIN chosen c USING (word)),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""
