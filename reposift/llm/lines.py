"""Line dedup by winnowing over line hashes.

The non-blank lines of a document, stripped of white space at both ends, are a
sequence of hashes. Of every window of min_lines consecutive lines the rightmost
smallest hash is selected as a fingerprint, so a run of min_lines lines that two
places share has one fingerprint at the same line of both. Only selected lines
are sent, each with the lines around it. Equal fingerprints join positions; from
there a match is extended line by line, to the left and to the right, up to
min_lines in all: a longer run holds further fingerprints, whose matches overlap,
so together they cover it. The match of a position that stands later (by document
id, then line) is deleted. A line of long_words words or more is a run by itself
and always selected.

Lines are compared by 64-bit hashes, a run by one of them and 128 bits of the
others; a single long line by its hash and its length. The hash is one that no text
can be made up to collide in (see sound.py).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposift.llm.common import stored, text_blocks, unused, word_spans
from reposift.llm.sound import SoundHash

MIN_LINES = 3
LONG_WORDS = 20
#: Parts into which the positions of one match are dealt.
SALTS = 4


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-blank lines: start and end without white space around, number of words, and first line of each row (rows + 1)."""
    start, end, _ = word_spans(raw, offsets)
    breaks = np.union1d(np.flatnonzero(raw == 10) + 1, offsets)
    line = np.searchsorted(breaks, start, "right")
    first = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(line)) - 1 if len(first) else first
    words = np.diff(np.append(first, len(line)))
    begin = start[first]
    return begin, end[last] if len(first) else begin, words, np.searchsorted(begin, offsets)


def selected(h: np.ndarray, rows: np.ndarray, min_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, starts): the lines that windows of min_lines lines of one row select; bit k of starts: the window that begins k lines before the line selects it."""
    n = len(h)
    left = np.repeat(rows[1:], np.diff(rows)) - np.arange(n)  # lines from here to the row's end
    first = np.flatnonzero(left >= min_lines)
    chosen, low = first.copy(), h[first] if len(first) else np.zeros(0, np.uint64)
    for k in range(1, min_lines):
        own = h[first + k]
        at = own <= low
        chosen[at], low = first[at] + k, np.minimum(low, own)
    starts = np.zeros(n, np.int64)
    np.bitwise_or.at(starts, chosen, np.int64(1) << (chosen - first))
    line = np.flatnonzero(starts)
    return line, starts[line]


def positions(raw: np.ndarray, offsets: np.ndarray, min_lines: int, long_words: int, sound: SoundHash) -> tuple[np.ndarray, ...]:
    """(row, line, hash, starts, size, around) of the selected lines.

    starts as in selected(), size the bytes of a long line (else 0), around the
    hashes of the min_lines - 1 lines before and after, 0 beyond the row.
    """
    begin, end, words, rows = line_spans(raw, offsets)
    h = sound.spans(raw, begin, end)
    line, starts = selected(h, rows, min_lines)
    size = np.where(words >= long_words, end - begin, 0)
    also = np.setdiff1d(np.flatnonzero(size), line)
    line, starts = np.append(line, also), np.append(starts, np.zeros(len(also), np.int64))
    row = np.searchsorted(rows, line, "right") - 1
    side = [k for k in range(1 - min_lines, min_lines) if k]
    around = np.zeros((len(line), len(side)), np.uint64)
    for c, k in enumerate(side):
        inside = np.flatnonzero((line + k >= rows[row]) & (line + k < rows[row + 1]))
        around[inside, c] = h[line[inside] + k]
    return row, line - rows[row], h[line], starts, size[line], around


def without_lines(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the runs (first, number) of its non-blank lines, and how many were deleted; blank lines inside a run go too."""
    lines = text.split("\n")
    full = [k for k, x in enumerate(lines) if x.encode().strip()]
    gone = np.zeros(len(full) + 1, np.int64)
    for first, n in runs:
        gone[first] += 1
        gone[first + n] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    drop = {full[k] for k in np.flatnonzero(gone)}
    for k in np.flatnonzero(gone[1:] & gone[:-1]):
        drop.update(range(full[k], full[k + 1]))
    return "\n".join(x for k, x in enumerate(lines) if k not in drop), int(gone.sum())


def repeated_runs(df: DataFrame, doc_id: str, text: str, min_lines: int, long_words: int) -> DataFrame:
    """(id, key, runs): the matches of each document that stand earlier as well; key is row_key() of the document."""
    side, sound = [k for k in range(1 - min_lines, min_lines) if k], SoundHash()

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_blocks(batch.column(2)):
                row, line, h, starts, size, around = positions(raw, offsets, min_lines, long_words, sound)
                at = pa.array(row + lo)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * len(side), pa.int32()), pa.array(around.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(h.view(np.int64)), pa.array(starts, pa.int32()), pa.array(size, pa.int32()), lists],
                    names=["key", "id", "line", "h", "starts", "size", "around"],
                )

    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"key long, id {kind}, line int, h long, starts int, size int, around array<bigint>"
    # One pass over the texts; the selected lines are read again from there.
    found = stored(df.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("id"), text).mapInArrow(select, schema))
    place = F.struct("id", "key", "line")
    # A fingerprint at one place only has no partner.
    met = found.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("h")
    near = found.join(met, "h")
    # A match: how far it goes to the left (the rest to the right), with the lines there; or a long line alone (-1), with its size.
    both_ways = [
        F.when(F.col("starts").bitwiseAND(1 << left) != 0, F.struct(F.lit(left).alias("left"), F.slice("around", min_lines - left, min_lines - 1).alias("lines")))
        for left in range(min_lines)
    ]
    alone = F.when(F.col("size") > 0, F.struct(F.lit(-1).alias("left"), F.array(F.col("size").cast("long")).alias("lines")))
    matches = near.select("h", "key", "id", "line", F.explode(F.array_compact(F.array(*both_ways, alone))).alias("m")).select("h", "key", "id", "line", "m.left", F.xxhash64("m.lines").alias("reach"), F.xxhash64(F.lit(1), "m.lines").alias("again"))
    same = ["h", "left", "reach", "again"]  # the lines of the match by 64 bits of its fingerprint and 128 of the others
    first = matches.groupBy(*same).agg(F.min(place).alias("origin"), F.max(place).alias("end")).where("origin <> end").select(*same, "origin")
    dealt = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = matches.withColumn("salt", F.pmod(F.xxhash64("key", "line"), F.lit(SALTS)).cast("int")).join(dealt, [*same, "salt"]).where(place > F.col("origin"))
    run = F.struct((F.col("line") - F.greatest("left", F.lit(0))).alias("first"), F.when(F.col("left") < 0, 1).otherwise(min_lines).alias("lines"))
    return later.groupBy("id", "key").agg(F.collect_set(run).alias("runs"))  # a repeated row has the same runs


def row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.col(text))


def dedup_lines(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, long_words: int = LONG_WORDS, removed: str = "n_removed"
) -> DataFrame:
    """df with repeated runs of lines deleted from text, and the number of deleted lines of each row in removed.

    Deleted: every line in a run of min_lines non-blank lines, or of one line
    of long_words words, that starts earlier too: under a smaller doc_id (null
    is the smallest), or before it in the same document. Different texts under
    one doc_id, or without one, count in the order of a hash of id and text, so
    that one of them keeps a run that both hold. Repeated rows with one doc_id
    and text are one place, so both keep their lines. Null text stays null,
    with 0 deleted; texts without a repeated run are unchanged. All rows and
    other columns stay; a column named like removed is replaced. An empty table
    gives an empty table.
    """
    if not 1 <= min_lines <= 30:
        raise ValueError("min_lines must be from 1 to 30")
    runs = repeated_runs(df, doc_id, text, min_lines, long_words)
    plain = df.drop(removed)
    key, own, found = unused(plain, "key"), unused(plain, "id"), unused(plain, "runs")
    keyed = plain.withColumn(key, row_key(doc_id, text))
    placed = runs.toDF(own, f"{key}_", found).hint("shuffle_hash")
    joined = keyed.join(placed, (F.col(key) == F.col(f"{key}_")) & F.col(doc_id).eqNullSafe(F.col(own)), "left").drop(key, f"{key}_", own)

    new = [f for f in df.schema.fields if f.name != removed]
    names = [f.name for f in new]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(batch.schema.get_field_index(found))
            at = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
            count, column = np.zeros(len(runs), np.int32), batch.column(batch.schema.get_field_index(text))
            if len(at):
                texts = column.to_pylist()
                for k in at.tolist():
                    texts[k], count[k] = without_lines(texts[k], [(x["first"], x["lines"]) for x in runs[k].as_py()])
                column = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays([*(column if x == text else batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(count)], names=[*names, removed])

    return joined.mapInArrow(cut, T.StructType([*new, T.StructField(removed, T.IntegerType())]))


def digests(documents: DataFrame) -> DataFrame:
    """Per document: deleted lines, length and digest of the kept text (null text: empty)."""
    kept = F.coalesce("text", F.lit(""))
    return dedup_lines(documents.select("doc_id", "text")).select(
        "doc_id", F.col("n_removed").cast("long").alias("n_removed_lines"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256")
    )


def oracle(min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> str:
    """The digests of the documents table in DuckDB SQL, by grouping every window of lines; doc_id must be unique."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    runs = f"SELECT doc_id, n, {min_lines} AS lines, list(s) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND {min_lines - 1} FOLLOWING) AS run FROM full_lines"
    return rf"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
every AS (SELECT doc_id, i, x[i] AS line, trim(x[i], {white}) AS s FROM texts, unnest(range(1, len(x) + 1)) AS r(i)),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, len(list_filter(string_split_regex(s, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words FROM every WHERE s <> ''),
runs AS (SELECT * FROM ({runs}) WHERE len(run) = {min_lines} UNION ALL SELECT doc_id, n, 1, [s] FROM full_lines WHERE words >= {long_words}),
later AS (SELECT doc_id, n, lines FROM (SELECT *, row_number() OVER (PARTITION BY lines, run ORDER BY doc_id, n) AS place FROM runs) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, n + k AS n FROM later, unnest(range(lines)) AS r(k)),
marked AS (SELECT f.doc_id, f.i, f.n, g.n IS NOT NULL AS gone, lag(g.n IS NOT NULL) OVER w AS before, lag(f.i) OVER w AS last
  FROM full_lines f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.n = f.n WINDOW w AS (PARTITION BY f.doc_id ORDER BY f.n)),
dropped AS (SELECT doc_id, i FROM marked WHERE gone UNION SELECT doc_id, k FROM marked, unnest(range(last + 1, i)) AS r(k) WHERE gone AND before),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM every ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_removed_lines, length(coalesce(k.text, ''))::BIGINT AS kept_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)"""
