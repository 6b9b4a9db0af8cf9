"""Substring search with an index of trigrams.

Texts are dealt to blocks of some ROWS rows by the hash of their key, and kept
sorted by block, so that a filter on blocks reaches the files. Postings name the
blocks in which each run of three characters occurs. A search meets the
postings of its own trigrams, reads only the blocks that have them all, and
looks for the text itself there. A refresh compares keys and hashes, and makes
the postings anew for the blocks of changed rows alone.

Searches of less than three characters, and those that no trigram narrows down,
read every block. A null text is found by nothing, not even by an empty search.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.operators import keys
from reposift.sources.tables import Change, Layout, Snapshots

GRAM = 3
#: Rows of a block, about; buckets of files; blocks that a search names one by one to the files.
ROWS, BUCKETS, NAMED = 256, 16, 10_000
#: Trigrams that a task holds at a time.
GRAMS = 100_000
TEXTS, POSTINGS, SHAPE = "index_texts", "index_postings", "index_shape"


def layouts(buckets: int = BUCKETS) -> dict[str, Layout]:
    """For Snapshots: the layouts of the index's tables."""
    return {TEXTS: Layout(("block",), buckets), POSTINGS: Layout(("block",), buckets)}


def _postings(texts: DataFrame) -> DataFrame:
    """(block, gram): the trigrams of each block; a block with more than GRAMS of them may give some twice."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, found = None, set()
        frame = lambda: pd.DataFrame({"block": pd.Series(block, range(len(found)), "int64"), "gram": pd.Series(sorted(found), dtype=object)})
        for part in parts:
            for b, t in zip(part["block"].tolist(), part["text"].tolist(), strict=True):
                if found and (b != block or len(found) >= GRAMS):
                    yield frame()
                    found.clear()
                block = b
                for lo in range(0, len(t or "") - GRAM + 1, GRAMS):
                    if lo:
                        yield frame()
                        found.clear()
                    found.update(t[k : k + GRAM] for k in range(lo, min(lo + GRAMS, len(t) - GRAM + 1)))
        if found:
            yield frame()

    # Block after block, so that a task holds the trigrams of one at a time.
    placed = texts.select("block", "text").repartition("block").sortWithinPartitions("block")
    return placed.mapInPandas(run, "block long, gram string")


def refresh(tables: Snapshots, rows: DataFrame, key: str = "id", text: str = "text") -> dict[str, int]:
    """Make the index hold exactly the rows (key, text); keys must be unique. Returns rows there are, rows changed, new or gone, and blocks indexed anew."""
    return tables.commit(lambda t: _refresh(t, rows.select(F.col(key).alias("key"), F.col(text).alias("text"))))


def _refresh(t: Change, rows: DataFrame) -> dict[str, int]:
    shape = t.read(SHAPE)
    if shape is None:
        blocks = max(1, -(-rows.count() // ROWS))
        t.write(SHAPE, rows.sparkSession.range(1).select(F.lit(blocks).cast("long").alias("blocks")))
    else:
        blocks = shape.first()["blocks"]
    # From here on only (key, hash) meet, until the touched blocks are known.
    rows = t.stage(rows.select("key", "text", F.xxhash64("text").alias("hash"), F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")))
    old = t.read(TEXTS)
    marks = ["key", "hash", "block"]
    if old is None:
        changed = rows.select(*marks)
    else:
        new, gone = rows.select(*marks).exceptAll(old.select(*marks)), old.select(*marks).exceptAll(rows.select(*marks))
        changed = new.unionByName(gone)
    changed = t.stage(changed)
    counts = {"rows": rows.count(), "changed": changed.select("key").distinct().count(), "blocks": changed.select("block").distinct().count()}
    touched = t.stage(changed.select("block").distinct())
    buckets = t.buckets(TEXTS, touched)
    if not buckets and old is not None:
        return counts
    all_buckets = list(range(t.layout(TEXTS).groups)) if old is None else buckets
    in_buckets = rows.where(t.layout(TEXTS).bucket().isin(all_buckets))
    fresh = t.stage(_postings(keys.keep(in_buckets, touched, "block")))
    kept = t.read(POSTINGS, all_buckets)
    postings = fresh if kept is None else keys.drop(kept, touched, "block").unionByName(fresh)
    t.rewrite(TEXTS, in_buckets, all_buckets, order=["block"])
    t.rewrite(POSTINGS, postings, all_buckets, order=["gram", "block"])
    return counts


class Found(NamedTuple):
    """hits: (key, text); read and blocks: blocks looked into and blocks there are."""

    hits: DataFrame
    read: int
    blocks: int


def find(tables: Snapshots, wanted: str) -> Found:
    """The rows whose text contains wanted, letter case as it is."""
    version = tables.version()
    texts, postings, shape = (tables.read(x, version) for x in (TEXTS, POSTINGS, SHAPE))
    if texts is None:
        raise ValueError("there is no index; refresh() makes it")
    blocks = shape.first()["blocks"]
    hits = lambda rows: rows.where(F.contains("text", F.lit(wanted))).select("key", "text")
    grams = sorted({wanted[k : k + GRAM] for k in range(len(wanted) - GRAM + 1)})
    if not grams:
        return Found(hits(texts), blocks, blocks)
    held = postings.where(F.col("gram").isin(grams)).groupBy("block").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("block")
    named = [r[0] for r in held.limit(NAMED + 1).collect()]
    if len(named) > NAMED:
        return Found(hits(texts.join(held, "block", "left_semi")), held.count(), blocks)
    return Found(hits(texts.where(F.col("block").isin(named)) if named else texts.limit(0)), len(named), blocks)
