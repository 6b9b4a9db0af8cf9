"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import checkpointed


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of all nodes that are not themselves the smallest."""
    names, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _contracted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        a, b = forest(part["a"].to_numpy(), part["b"].to_numpy())
        yield pd.DataFrame({"a": a, "b": b})


def _all_stars(links: DataFrame) -> bool:
    """Whether every node points to one other, which itself points to none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable.

    Ids are longs; null ends, loops and repeated edges have no effect; no edges
    give no rows. Each round links every node to the smallest neighbour
    (large star, then small star) by aggregation and join, so no node's
    neighbours are gathered in one place. Rounds: about the logarithm of the
    longest path; each one is checkpointed.
    """
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    links = checkpointed(links.mapInPandas(_contracted, "a long, b long").distinct())
    while not _all_stars(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        links = checkpointed(small.select("e.a", "e.b").where("a <> b").distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
