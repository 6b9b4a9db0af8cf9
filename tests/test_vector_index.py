import numpy as np
import pytest

from reposift.operators import search, vector_index


def frame(spark, x, first=0):
    return spark.createDataFrame([(f"v{k + first:05d}", [float(v) for v in row]) for k, row in enumerate(x)], "id string, vector array<float>").repartition(4)


def asked(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "query_id long, query array<float>")


def rows(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())


def grouped(rnd, n=3000, groups=20, width=24):
    centers = rnd.normal(size=(groups, width))
    return np.repeat(centers, n // groups, axis=0) + rnd.normal(size=(n, width)) * 0.05


def test_grouped_vectors_leave_most_files_unopened(spark, tmp_path):
    rnd = np.random.default_rng(1)
    x = grouped(rnd)
    x[5] = 0
    vectors, queries = frame(spark, x), asked(spark, np.concatenate((x[10:400:97], np.zeros((1, 24)))))
    index = vector_index.build(vectors, str(tmp_path / "index"), pivots=24, rings=3)
    found = vector_index.search(spark, index, queries, 7)
    assert rows(found.hits) == rows(search.batch_search(queries, vectors, 7))
    assert found.rings > 40 and found.read < 0.4 * found.rings


def test_vectors_without_direction_are_all_read_and_right(spark, tmp_path):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(600, 32))
    x[::50] = x[1]  # ties
    x[7] = 0
    vectors, queries = frame(spark, x), asked(spark, np.concatenate((rnd.normal(size=(6, 32)), x[1:2], -x[:1])))
    index = vector_index.build(vectors, str(tmp_path / "index"), pivots=8, rings=2)
    found = vector_index.search(spark, index, queries, 12)
    assert rows(found.hits) == rows(search.batch_search(queries, vectors, 12)) and found.read >= found.rings - 1  # all but that of zero vectors


@pytest.mark.parametrize("limit", [1, 50])
def test_blocks_of_queries_and_more_hits_than_vectors(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(vector_index, "QUERY_BYTES", 24 * 8 * 3)
    rnd = np.random.default_rng(3)
    x = grouped(rnd, 40, 4)
    vectors, queries = frame(spark, x), asked(spark, x[:9])
    index = vector_index.build(vectors, str(tmp_path / "index"), pivots=5, rings=2)
    assert rows(vector_index.search(spark, index, queries, limit).hits) == rows(search.batch_search(queries, vectors, limit))


def test_empty_tables(spark, tmp_path):
    none, queries = frame(spark, []), asked(spark, [[1.0, 2.0]])
    assert vector_index.search(spark, vector_index.build(none, str(tmp_path / "a")), queries).hits.count() == 0
    zeros = frame(spark, [[0.0, 0.0], [0.0, 0.0]])
    assert [(r.id, r.score) for r in vector_index.search(spark, vector_index.build(zeros, str(tmp_path / "b")), queries).hits.collect()] == [("v00000", 0.0), ("v00001", 0.0)]
    assert vector_index.search(spark, vector_index.build(zeros, str(tmp_path / "c")), queries.limit(0)).hits.count() == 0
