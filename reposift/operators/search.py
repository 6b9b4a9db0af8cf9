"""Exact cosine search over star and code vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposift.functions import vectors as V
from reposift.operators import keys

DEFAULT_LIMIT = 10
#: Bytes of query vectors that one pass over the corpus carries.
QUERY_BYTES = 50_000_000
#: Scores that a task holds at a time.
SCORES = 1 << 20


def with_norm(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("norm", V.norm(F.col("vector")))


def score(vectors: DataFrame, query: list[float]) -> DataFrame:
    """vectors with their cosine to one query; uses the stored norm where there is one."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    size = F.lit(float(np.sqrt(np.dot(query, query))))
    return vectors.withColumn("score", V.cosine(wanted, F.col("vector"), size, F.col("norm") if "norm" in vectors.columns else None))


def search(vectors: DataFrame, query: list[float], limit: int = DEFAULT_LIMIT, where: Column | None = None, min_score: float | None = None) -> DataFrame:
    """The limit vectors most like the query, ties by id. where filters before scoring; scores below min_score are dropped; a zero query finds nothing."""
    rows = vectors if where is None else vectors.where(where)
    if not any(query):
        rows = rows.limit(0)
    found = score(rows, query)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    return found.orderBy(F.desc("score"), "id").limit(limit)


def _top(ids: np.ndarray, scores: np.ndarray, limit: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:limit]


def _likely(scores: np.ndarray, limit: int) -> np.ndarray:
    """Where the limit highest scores stand, and all that are as high but for rounding."""
    if len(scores) <= limit:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= -np.partition(-scores, limit - 1)[limit - 1] - 1e-9)


def batch_search(queries: DataFrame, vectors: DataFrame, limit: int = DEFAULT_LIMIT, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, id, score, rank): the limit most like vectors of every query.

    Queries travel to the corpus, a bounded block at a time; each task
    multiplies a block of vectors with all of them and keeps limit rows per
    query, which a window then merges. Zero queries find nothing, zero vectors
    score 0, unequal lengths fail.
    """
    table = queries.select(query_id, query)
    width = table.agg(F.coalesce(F.max(F.size(query)), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    blocks = max(1, -(-width["n"] * width["rows"] * 8 // QUERY_BYTES))
    found = None
    for k in range(blocks):
        own = table if blocks == 1 else table.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == k)
        part = _one_block(own, vectors, limit, query_id, query)
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= limit)


class Best:
    """The limit best vectors so far of each of some queries, in one task. matrix: the queries, one unit vector a row."""

    def __init__(self, matrix: np.ndarray, limit: int):
        self.matrix, self.limit = matrix, limit
        self.ids = [np.array([], object)] * len(matrix)
        self.scores = [np.array([])] * len(matrix)

    def add(self, ids: pa.Array, vectors: pa.Array, queries: Iterable[int] | None = None) -> None:
        """Score a block of vectors for all queries, or for some of them."""
        chosen = np.arange(len(self.matrix)) if queries is None else np.asarray(queries, np.int64)
        if not len(chosen) or not len(ids):
            return
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        if x.shape[1] != self.matrix.shape[1]:
            raise ValueError(f"vectors of lengths {self.matrix.shape[1]} and {x.shape[1]}")
        size = np.linalg.norm(x, axis=1)
        x /= np.where(size == 0, 1, size)[:, None]
        step = max(1, SCORES // len(x))
        for lo in range(0, len(chosen), step):
            tile = chosen[lo : lo + step]
            self._add_tile(tile, ids, x, self.matrix[tile] @ x.T)

    def _add_tile(self, queries: np.ndarray, ids: pa.Array, x: np.ndarray, scores: np.ndarray) -> None:
        for row, q in enumerate(queries.tolist()):
            # Products of matrices may round equal vectors apart; the few that matter are multiplied one by one.
            some = _likely(scores[row], self.limit)
            own_ids = np.append(self.ids[q], np.array(ids.take(pa.array(some)).to_pylist(), object))
            own = np.append(self.scores[q], (x[some] * self.matrix[q]).sum(1))
            top = _top(own_ids, own, self.limit)
            self.ids[q], self.scores[q] = own_ids[top], own[top]

    def batch(self, names: pa.Array, query_id: str, kind: pa.DataType) -> pa.RecordBatch:
        who = np.repeat(np.arange(len(self.matrix)), [len(x) for x in self.scores])
        ids = pa.array(np.concatenate(self.ids).tolist() if len(who) else [], kind)
        return pa.RecordBatch.from_arrays([names.take(pa.array(who)), ids, pa.array(np.concatenate([*self.scores, np.array([])]))], names=[query_id, "id", "score"])


def unit_queries(queries: DataFrame, query_id: str, query: str) -> tuple[pa.Array, np.ndarray]:
    """Ids and unit vectors of the queries that are not zero or null; all must be of one length. For a bounded block of queries."""
    rows = queries.select(query_id, query).toArrow()
    names = rows.column(0).combine_chunks()
    wanted = [np.array(x.as_py() or [], np.float64) for x in rows.column(1)]
    kept = [k for k, x in enumerate(wanted) if x.any()]
    if len({len(wanted[k]) for k in kept}) > 1:
        raise ValueError("queries of unequal lengths")
    return names.take(pa.array(kept, pa.int64())), np.array([wanted[k] / np.linalg.norm(wanted[k]) for k in kept])


def _one_block(queries: DataFrame, vectors: DataFrame, limit: int, query_id: str, query: str) -> DataFrame:
    names, matrix = unit_queries(queries, query_id, query)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(matrix, limit), pa.string()
        for batch in batches:
            kind = batch.column(0).type
            best.add(batch.column(0), batch.column(1))
        if any(len(x) for x in best.scores):
            yield best.batch(names, query_id, kind)

    kinds = queries.schema[query_id].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vector").mapInArrow(run, f"{query_id} {kinds[0]}, id {kinds[1]}, score double")


def rehydrate(hits: DataFrame, stars: DataFrame) -> DataFrame:
    """Hits with the columns of their star; hits without one are dropped."""
    return hits.join(stars.withColumnRenamed("id", "star_id"), "star_id")


def typed_hits(hits: DataFrame) -> DataFrame:
    """Star hits, and the code hits that have a path and lines."""
    whole = F.col("path").isNotNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    return hits.where((F.col("kind") == "star") | whole)


def permalink(html_url: Column, branch: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat(html_url, F.lit("/blob/"), branch, F.lit("/"), path, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))


def orphans(vectors: DataFrame, stars: DataFrame) -> DataFrame:
    """Vectors whose star is gone. Keys are joined first, then the few vectors picked."""
    gone = keys.missing(vectors, stars.select(F.col("id").alias("star_id")), "star_id")
    return keys.keep(vectors, gone, "star_id")


def corpus(star_vectors: DataFrame, code_vectors: DataFrame) -> DataFrame:
    return star_vectors.unionByName(code_vectors, allowMissingColumns=True)
