"""Indexes and sums that are changed by what changed, and joins that move keys."""

import random

import pytest
from pyspark.sql import functions as F

from reposift.operators import keys, profile_state, text_index
from reposift.sources.tables import Snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("few", "blocks"), [(0, 1000), (100, 1000), (0, 1)])
def test_keys_are_kept_and_dropped_alike_by_every_way(spark, monkeypatch, few, blocks):
    monkeypatch.setattr(keys, "FEW", few)
    monkeypatch.setattr(keys, "BLOCKS", blocks)
    rnd = random.Random(few + blocks)
    data = [(rnd.choice([None, *range(60)]), f"k{rnd.randrange(3)}", n) for n in range(400)]
    table = spark.createDataFrame(data, "a long, b string, n long").repartition(3)
    wanted = spark.createDataFrame([(k, f"k{k % 3}") for k in range(0, 90, 2)] + [(None, "k1"), (4, "k1")], "a long, b string")
    both = {(a, b) for a, b in wanted.collect() if a is not None}
    inside = [r for r in data if (r[0], r[1]) in both]
    assert rows(keys.keep(table, wanted, ["a", "b"])) == sorted(inside)
    assert sorted(map(repr, keys.drop(table, wanted, ["a", "b"]).collect())) == sorted(repr(r) for r in table.collect() if (r.a, r.b) not in both)
    assert rows(keys.missing(table, wanted, ["a", "b"])) == sorted({(a, b) for a, b, _ in data if a is not None} - both)
    assert keys.keep(table, wanted.limit(0), "a").count() == 0 and keys.drop(table, wanted.limit(0), "a").count() == 400
    assert keys.keep(table, wanted, "a").columns == keys.drop(table, wanted, "a").columns == ["a", "b", "n"]


def test_rows_that_the_filter_does_not_hold_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(keys, "FEW", 0)
    table = spark.range(20_000).withColumn("payload", F.repeat(F.lit("x"), 100))
    wanted = spark.range(0, 20_000, 500)
    some = keys.marked(table, wanted, wanted.count(), ["id"]).where("__maybe")
    assert 40 <= some.count() < 300 and {r.id for r in wanted.collect()} <= {r.id for r in some.collect()}


def test_substrings_by_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "ROWS", 4)
    rnd = random.Random(2)
    texts = {k: " ".join("".join(rnd.choices("abcdé𝒳", k=rnd.randrange(1, 6))) for _ in range(rnd.randrange(9))) for k in range(150)}
    texts |= {150: "", 151: None, 152: "a", 153: "the needle is here"}
    frame = lambda x: spark.createDataFrame(list(x.items()), "id long, text string")
    tables = Snapshots(spark, str(tmp_path), text_index.layouts(3))
    with pytest.raises(ValueError, match="no index"):
        text_index.find(tables, "abc")
    first = text_index.refresh(tables, frame(texts))
    assert first["rows"] == first["changed"] == 154 and first["blocks"] <= 39

    def check():
        for wanted in ("", "a", "ab", "abc", "é𝒳a", "a b", "needle", "is here", "nowhere at all"):
            found = text_index.find(tables, wanted)
            assert {r.key for r in found.hits.collect()} == {k for k, t in texts.items() if t is not None and wanted in t}, wanted
        return text_index.find(tables, "needle")

    narrow = check()
    assert narrow.read == 1 < narrow.blocks and text_index.find(tables, "ab").read == narrow.blocks and text_index.find(tables, "nowhere at all").read == 0
    assert text_index.refresh(tables, frame(texts)) == {"rows": 154, "changed": 0, "blocks": 0}
    version = tables.version()
    files = tables.manifest(version)["tables"][text_index.TEXTS]["buckets"]
    texts[7] = "a needle too"
    del texts[153]
    texts[900] = "abc needle"
    done = text_index.refresh(tables, frame(texts))
    assert done["changed"] == 3 and done["blocks"] <= 3
    check()
    texts[7] = "no more"
    assert text_index.refresh(tables, frame(texts)) == {"rows": 154, "changed": 1, "blocks": 1}
    check()
    after = tables.manifest(tables.version())["tables"][text_index.TEXTS]["buckets"]
    assert any(files[k] != after[k] for k in files)
    monkeypatch.setattr(text_index, "NAMED", 2)
    check()


def test_postings_hold_few_trigrams_at_a_time(spark, monkeypatch):
    texts = [(k % 3, "".join(random.Random(k).choices("abcdefghij", k=70 * (k % 5)))) for k in range(40)] + [(1, None), (7, "ab")]
    want = {(b, t[i : i + 3]) for b, t in texts for i in range(len(t or "") - 2)}
    rows = spark.createDataFrame(texts, "block long, text string").repartition(5)
    got = [tuple(r) for r in text_index._postings(rows).collect()]
    assert set(got) == want and len(got) == len(want)  # a block whole in one task, so each trigram once
    monkeypatch.setattr(text_index, "GRAMS", 50)
    got = [tuple(r) for r in text_index._postings(rows).collect()]
    assert set(got) == want and len(got) > len(want)


@pytest.mark.parametrize(("popular", "sent"), [(10**6, 10**6), (3, 10**6), (3, 0)])
def test_kept_profiles_follow_changes(spark, tmp_path, popular, sent):
    rnd = random.Random(popular + sent)
    vector = lambda: [rnd.uniform(-1, 1) for _ in range(3)]
    pairs = {(u, rnd.randrange(12)) for u in range(9) for _ in range(8)} | {(u, 1) for u in range(30)}
    vectors = {k: vector() for k in range(10)}
    frames = lambda: (spark.createDataFrame(sorted(pairs), "user_id long, id long"), spark.createDataFrame(sorted(vectors.items()), "id long, vector array<double>"))
    tables = Snapshots(spark, str(tmp_path), profile_state.layouts(4))

    def check():
        got = {r.user_id: (r.n, r.sums) for r in tables.read(profile_state.TABLE).collect()}
        want = {}
        for u in {u for u, _ in pairs}:
            own = [vectors[k] for v, k in pairs if v == u and k in vectors]
            if own:
                want[u] = (len(own), [sum(x) for x in zip(*own)])
        assert got.keys() == want.keys()
        for u, (n, sums) in want.items():
            assert got[u][0] == n and got[u][1] == pytest.approx(sums, abs=1e-12)

    before = frames()
    profile_state.refresh(tables, None, before, popular=popular, sent_bytes=sent)
    check()
    pairs -= {p for p in pairs if p[0] in (2, 3) and p[1] != 1}  # stars go,
    pairs |= {(2, 9), (40, 4), (41, 11)}  # and come, with and without vectors;
    pairs.discard((29, 1))  # a user has none left;
    vectors[4], vectors[10] = vector(), vector()  # a vector is made anew, and one for a star that had none;
    del vectors[0]  # and one is deleted
    after = frames()
    assert profile_state.refresh(tables, before, after, popular=popular, sent_bytes=sent) > 0
    check()
    assert profile_state.refresh(tables, after, after, popular=popular, sent_bytes=sent) == 0
    check()


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    from reposift.sources.tables import Layout

    tables = Snapshots(spark, str(tmp_path), {"rows": Layout(("user_id", "id"), 2)})
    rows = spark.range(0, 40_000, 1, 8).select(F.lit(1).cast("long").alias("user_id"), "id", F.sha2(F.col("id").cast("string"), 512).alias("payload"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "400k")
    try:
        tables.write("rows", rows)
    finally:
        spark.conf.unset(size)
    folder = tables.manifest(1)["tables"]["rows"]["buckets"]
    files = [x for own in folder.values() for f in own for x in tables.names(f) if x.endswith(".parquet")]
    assert len(folder) == 1 and len(files) > 3
    assert tables.read("rows").exceptAll(rows).isEmpty() and tables.read("rows").count() == 40_000
