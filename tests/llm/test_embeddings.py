import numpy as np

from reposift.llm import embeddings


def brute(rows, least=0.95):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[k] = x / np.sqrt(x @ x)
    links = {k: {j for j in good if j != k and len(good[j]) == len(good[k]) and good[j] @ good[k] >= least} if k in good else set() for k in range(len(rows))}
    out = []
    for k, (name, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((name, len(links[k]), low, name is not None and name == low))
    return sorted(out, key=str)


def clusters(seed, n, dims, spread):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(max(2, n // 12), dims))
    x = centres[rnd.integers(0, len(centres), n)] + spread * rnd.normal(size=(n, dims))
    return x.astype(np.float32)


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "STRETCH", 64)
    monkeypatch.setattr(embeddings, "SMALL", 16)
    x = clusters(1, 400, 24, 0.25)
    rows = [(k * 3, [float(v) for v in x[k]]) for k in range(len(x))]
    rows += [(5000 + k, rows[7][1]) for k in range(40)]
    rows += [(None, rows[7][1]), (None, [float(v) for v in -x[9]]), (6000, None), (6001, [0.0] * 24), (6002, [float("nan")] * 24), (6003, [1.0, None] * 12), (6004, [float("inf")] + [0.0] * 23)]
    rows += [(6005, [1.0, 2.0]), (6006, [2.0, 4.0]), (6007, []), (6008, [4 * v for v in rows[3][1]])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, kept int").repartition(5)
    got = sorted((tuple(r) for r in embeddings.link_embeddings(df).collect()), key=str)
    assert got == brute(rows)


def test_many_tiles_and_double_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "STRETCH", 16)
    monkeypatch.setattr(embeddings, "TILE", 3)
    x = clusters(2, 300, 12, 0.2).astype(float)
    rows = [(k, [float(v) for v in x[k]]) for k in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((tuple(r) for r in embeddings.link_embeddings(df).collect()), key=str)
    rows = [(k, v) for k, v in rows]
    unit = embeddings.unit(x)
    assert [r[1] for r in sorted(got)] == [int((unit @ unit[k] >= 0.95).sum()) - 1 for k in range(len(x))]


def test_far_stretches_are_not_sent(spark, monkeypatch):
    """Vectors in a few tight groups: less than a fifth of the pairs of stretches is left."""
    monkeypatch.setattr(embeddings, "STRETCH", 64)
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(40, 32))
    x = np.repeat(centres, 50, axis=0) + 0.05 * rnd.normal(size=(40 * 50, 32))
    df = spark.createDataFrame([(k, [float(y) for y in v], 1) for k, v in enumerate(x)], "rep long, embedding array<double>, copies long")
    n, axes = embeddings.principal_axes(df, 32)
    packed = embeddings.stretches(df, n, axes, 0.95).select("node", "lo", "hi").cache()
    count, left = packed.count(), embeddings.near_pairs(packed, 0.95).count()
    assert count >= 32 and left < 0.2 * count * (count + 1) / 2


def test_empty_and_unlinked(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embeddings.link_embeddings(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embeddings.link_embeddings(df.limit(0)).count() == 0


def test_join_prunes_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(embeddings, "SMALL", 8)
    x = embeddings.unit(clusters(3, 300, 10, 0.2).astype(float))
    x = x[np.lexsort(x.T[::-1])]
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    for least in (0.8, 0.95, 0.999):
        want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= least), strict=True) if i < j}
        side = lambda y: embeddings.Side(y, axes[:, :4])
        assert {(i, j) for a, b in embeddings.join(side(x), None, least) for i, j in zip(a, b, strict=True)} == want
        got = {(i, j + 100) for a, b in embeddings.join(side(x[:100]), side(x[100:]), least) for i, j in zip(a, b, strict=True)}
        assert got == {(i, j) for i, j in want if i < 100 <= j}
