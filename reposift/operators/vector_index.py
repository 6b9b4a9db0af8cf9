"""Exact nearest vectors with an index that skips files.

Vectors are dealt to the nearest of some pivots, and those of a pivot to rings by
their angle to it; each ring is a folder of files. For a query, the angle to
the pivot and the ring's two angles bound the cosine of every vector in it. A
search reads each query's most promising rings first, and then only those whose
bound reaches the score of the query's last hit. Where vectors stand in groups
most files are never opened; where they have no direction at all every ring is
read and the result is the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reposift.operators.search import DEFAULT_LIMIT, QUERY_BYTES, Best, unit_queries

#: Vectors that pivots are chosen from, pivots, and rings of a pivot.
SAMPLE, PIVOTS, RINGS = 8192, 64, 4
#: Room for rounding, in radians.
SLACK = 1e-6


class Index(NamedTuple):
    """root: of the files; pivots: one unit vector a row; ring: (pivot, least angle, largest angle, rows), one row for each folder.

    Pivot -1 is of zero vectors, whose score is always 0.
    """

    root: str
    pivots: np.ndarray
    rings: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest score that a vector of each ring can have, for each query: queries x rings."""
        zero = self.rings[:, 0] < 0
        angle = np.arccos(np.clip(queries @ self.pivots.T, -1, 1))[:, self.rings[:, 0].astype(int)]
        apart = np.maximum(np.maximum(angle - self.rings[:, 2], self.rings[:, 1] - angle) - SLACK, 0)
        return np.where(zero, 0.0, np.cos(np.minimum(apart, np.pi)))


def choose_pivots(vectors: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots far apart: from a bounded sample by the order of a hash, each the one farthest from those before."""
    order = F.xxhash64("id")
    last = vectors.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = [] if last is None else vectors.where((order <= F.lit(last)) & F.exists("vector", lambda v: v != 0)).select("vector").limit(sample).toArrow().column(0).to_pylist()
    if not rows:
        return np.zeros((0, 1))
    x = np.array(rows, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    chosen, near = [int(np.lexsort(x.T[::-1])[0])], np.full(len(x), -2.0)
    while len(chosen) < min(count, len(x)):
        near = np.maximum(near, x @ x[chosen[-1]])
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-12:
            break
        chosen.append(far)
    return x[chosen]


def build(vectors: DataFrame, root: str, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE) -> Index:
    """Write the index of (id, vector) below root and return it. Null vectors are left out; unequal lengths fail."""
    spark, points = vectors.sparkSession, choose_pivots(vectors, pivots, sample)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            size = np.linalg.norm(x, axis=1)
            near = np.full(len(x), -1)
            angle = np.zeros(len(x))
            if len(points):
                cosine = (x / np.where(size == 0, 1, size)[:, None]) @ points.T
                near = np.where(size == 0, -1, cosine.argmax(1))
                angle = np.where(size == 0, 0, np.arccos(np.clip(cosine.max(1), -1, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(angle)], names=["id", "vector", "pivot", "angle"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    dealt = f"{root}/dealt"
    vectors.where("vector IS NOT NULL").select("id", "vector").mapInArrow(deal, f"id {kinds['id']}, vector {kinds['vector']}, pivot int, angle double").write.parquet(dealt)
    rows = spark.read.parquet(dealt)
    steps = [k / rings for k in range(1, rings)]
    cuts = rows.groupBy("pivot").agg(F.percentile_approx("angle", steps).alias("cuts") if steps else F.array().cast("array<double>").alias("cuts"))
    ring = F.size(F.filter("cuts", lambda c: c < F.col("angle")))
    placed = rows.join(F.broadcast(cuts), "pivot").withColumn("ring", ring)  # a row for each pivot
    # A large ring is written by several tasks; each keeps its own file.
    placed.repartition(max(1, pivots * rings), "pivot", "ring", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("pivot", "ring").parquet(f"{root}/rings")
    spans = placed.groupBy("pivot", "ring").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")).collect()  # pivots x rings
    found = sorted((r.pivot, r.ring, r.lo, r.hi, r.n) for r in spans)
    spark.createDataFrame([(json.dumps({"pivots": points.tolist(), "rings": found}),)], "value string").coalesce(1).write.text(f"{root}/index")
    return load(spark, root)


def load(spark: SparkSession, root: str) -> Index:
    found = json.loads(spark.read.text(f"{root}/index").first()[0])
    pivots = np.array(found["pivots"], np.float64)
    # The ring's number is kept as the fifth column: the folder's name.
    rings = np.array([(p, lo, hi, n, ring) for p, ring, lo, hi, n in found["rings"]], np.float64).reshape(-1, 5)
    return Index(root, pivots.reshape(len(pivots), -1) if len(pivots) else np.zeros((0, 1)), rings)


def _scan(spark: SparkSession, index: Index, needs: np.ndarray, names: pa.Array, matrix: np.ndarray, limit: int, query_id: str, kind: str) -> DataFrame | None:
    """Hits of the rings that some query needs (queries x rings), each ring scored for the queries that need it."""
    wanted = np.flatnonzero(needs.any(0))
    if not len(wanted):
        return None
    number = {(int(index.rings[k, 0]), int(index.rings[k, 4])): int(k) for k in wanted}
    folders = [f"{index.root}/rings/pivot={p}/ring={r}" for p, r in number]
    rows = spark.read.option("basePath", f"{index.root}/rings").parquet(*folders).select("id", "vector", F.col("pivot").cast("int"), F.col("ring").cast("int"))
    packed = {k: np.flatnonzero(needs[:, k]) for k in wanted.tolist()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = Best(matrix, limit), pa.string()
        for batch in batches:
            ids = batch.column(0).type
            pivot, ring = (batch.column(k).to_numpy() for k in (2, 3))
            edges = np.concatenate(([0], np.flatnonzero((np.diff(pivot) != 0) | (np.diff(ring) != 0)) + 1, [len(pivot)]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi > lo:
                    part = batch.slice(lo, hi - lo)
                    best.add(part.column(0), part.column(1), packed[number[int(pivot[lo]), int(ring[lo])]])
        if any(len(x) for x in best.scores):
            yield best.batch(names, query_id, ids)

    return rows.mapInArrow(run, f"{query_id} {kind}, id {rows.schema['id'].dataType.simpleString()}, score double")


class Found(NamedTuple):
    """hits: (query_id, id, score, rank); read and rings: folders opened and folders there are, summed over the blocks of queries."""

    hits: DataFrame
    read: int
    rings: int


def search(spark: SparkSession, index: Index, queries: DataFrame, limit: int = DEFAULT_LIMIT, query_id: str = "query_id", query: str = "query") -> Found:
    """The limit most like vectors of every query, ties by id; as search.batch_search() over the indexed vectors.

    Queries come in blocks of QUERY_BYTES; each block reads the rings that it
    needs. What comes to the driver are the block's queries and their last scores.
    """
    width = queries.agg(F.coalesce(F.max(F.size(query)), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    blocks = max(1, -(-width["n"] * width["rows"] * 8 // QUERY_BYTES))
    kind = queries.schema[query_id].dataType.simpleString()
    none = f"{query_id} {kind}, id {spark.read.parquet(f'{index.root}/dealt').schema['id'].dataType.simpleString()}, score double"
    parts, opened = [spark.createDataFrame([], none)], 0
    for k in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == k)
        names, matrix = unit_queries(own, query_id, query)
        if not len(matrix) or not len(index.rings):
            continue
        bounds, sizes = (index.bounds(matrix) if len(index.pivots) else np.zeros((len(matrix), len(index.rings)))), index.rings[:, 3]
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, order, before < limit, axis=1)
        hits = _scan(spark, index, first, names, matrix, limit, query_id, kind)
        folder = f"{index.root}/hits/{k}-{np.random.default_rng().integers(1 << 62)}"
        hits.write.parquet(folder)
        hits = spark.read.schema(hits.schema).parquet(folder)
        place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), "id"))
        last = {r[0]: r[1] for r in hits.withColumn("place", place).where(F.col("place") == limit).select(query_id, "score").collect()}  # a row for each query of the block
        reach = np.array([last.get(x, -np.inf) for x in names.to_pylist()])
        rest = (bounds >= reach[:, None] - 1e-9) & ~first
        parts.append(hits)
        more = _scan(spark, index, rest, names, matrix, limit, query_id, kind)
        parts += [] if more is None else [more]
        opened += int((first.any(0) | rest.any(0)).sum())
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), "id"))
    return Found(found.withColumn("rank", place).where(F.col("rank") <= limit), opened, blocks * len(index.rings))
