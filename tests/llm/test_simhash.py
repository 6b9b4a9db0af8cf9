import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from reposift.llm import components, simhash


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    made = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in made]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components_of(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def test_documents(spark):
    rnd = random.Random(1)
    words = [f"w{k}É" for k in range(500)]
    docs = {k: " ".join(rnd.choices(words, k=rnd.choice([0, 1, 2, 3, 40, 300]))) for k in range(80)}
    for k in range(80, 140):
        own = docs[rnd.randrange(80)].split()
        if own:
            own[rnd.randrange(len(own))] = "changed"
        docs[k] = "\t".join(own).upper() if k % 3 else " ".join(own)
    docs |= {200: None, 201: "", 202: " \n"}
    df = spark.createDataFrame([(k, t, k) for k, t in docs.items()], "doc_id long, text string, component_id long").repartition(6)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.digests(df).collect()}
    prints = {k: fingerprint(t) for k, t in docs.items()}
    assert {k: v[0] for k, v in got.items()} == prints
    links = [(a, b) for a in docs for b in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {k: v[1] for k, v in got.items()} == components_of(docs, links)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_sketches_of_several_fingerprints(spark):
    rnd = random.Random(3)
    docs = {k: [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([60, 150, 400]))] for k in range(60)}
    for k in range(60, 160):
        own = list(docs[rnd.randrange(60)])
        for _ in range(rnd.randrange(1, 9)):
            own[rnd.randrange(len(own))] = "changed"
        docs[k] = own
    docs |= {200: [], 201: [], 202: docs[0]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()] + [(203, None)], "doc_id long, text string").repartition(5)
    whole = simhash.bits_at(0.8, 4) + 2
    got = {r.doc_id: r for r in simhash.near_duplicates(df, shingle=5, distance=7, parts=4, whole=whole, repeats=False).collect()}
    prints = {k: [np.uint64(r[x] % (1 << 64)) for x in simhash.names(4)] for k, r in got.items()}
    for k, v in docs.items():
        data = " ".join(v).encode()
        assert prints[k] == simhash.block_fingerprints(data, [0, len(data)], 5, 42, 4, repeats=False)[:, 0].tolist()
        distinct = dict.fromkeys(" ".join(v[j : j + 5]) for j in range(max(len(v) - 4, 1)) if v)
        assert bool(distinct) == bool(v)
        h = [xxhash.xxh64_intdigest(x, 42) for x in distinct]
        assert prints[k][0] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    apart = {(a, b): [int(np.bitwise_count(x ^ y)) for x, y in zip(prints[a], prints[b], strict=True)] for a in got for b in got if a < b}
    links = [p for p, bits in apart.items() if min(bits) <= 7 and sum(bits) <= whole]
    assert {k: r.component_id for k, r in got.items()} == components_of(got, links)
    # Pairs that the first fingerprint alone does not find are found, and pairs that it alone would join are not.
    assert any(apart[p][0] > 7 for p in links) and any(min(bits) <= 7 and sum(bits) > whole for bits in apart.values())
    assert simhash.near_duplicates(df.limit(0), parts=4, whole=whole).count() == 0


def test_near_copies_of_given_documents(spark):
    """Of the pairs of whole texts with a similarity of 0.85 or more, the sketch meets nine tenths; of those below 0.6 one in a hundred at most, as repeated shingles count once."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").distinct().orderBy("text").collect() if r.text]
    rnd = random.Random(2)
    texts = [x.split() for x in texts if len(x.split()) > 40]
    shingles = lambda words: {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    close, far = [], []
    for words in texts[:600]:
        copy = list(words)
        for _ in range(max(1, len(words) // rnd.choice([15, 40, 80, 160]))):
            copy[rnd.randrange(len(copy))] = "changed"
        a, b = shingles(words), shingles(copy)
        similar = len(a & b) / len(a | b)
        prints = [simhash.block_fingerprints(" ".join(x).encode(), [0, len(" ".join(x).encode())], 5, 42, 4, repeats=False)[:, 0] for x in (words, copy)]
        bits = np.bitwise_count(prints[0] ^ prints[1])
        found = bits.min() <= 7 and bits.sum() <= simhash.bits_at(0.8, 4) + 2
        if similar >= 0.85:
            close.append(found)
        elif similar < 0.6:
            far.append(found)
    assert len(close) > 50 and np.mean(close) >= 0.9
    assert len(far) > 50 and np.mean(far) <= 0.01


def test_first_of_groups_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{k}" for k in range(200))
    df = spark.createDataFrame([(1, text, "a", 1), (2, text, "b", 2), (2, text, "c", 3), (3, None, "d", 4), (None, text, "e", 5)], "doc_id long, text string, __gone string, __GONE_ int")
    kept = simhash.first_of_groups(df, shingle=5, distance=6)
    assert kept.columns == df.columns and sorted(r["__gone"] for r in kept.collect()) == ["a", "d", "e"]
    assert simhash.first_of_groups(df.limit(0)).count() == 0


def test_a_text_longer_than_a_block(spark):
    text = " ".join(f"w{k % 5000}" for k in range(300_000))
    df = spark.createDataFrame([(1, text), (2, "short text here"), (3, text)], "doc_id long, text string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.digests(df).collect()}
    assert got[1] == (fingerprint(text), 1) and got[3] == (fingerprint(text), 1) and got[2][1] == 2


def test_links_of_clusters_with_any_plan(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    centres = rnd.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = []
    for c in centres:
        for _ in range(120):
            x = int(c)
            for b in rnd.integers(0, 64, rnd.integers(0, 9)):
                x ^= 1 << int(b)
            fp.append(x)
    fp = sorted(set(fp))
    links = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3]
    want = components_of(range(len(fp)), links)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)), k) for k, x in enumerate(fp)], "fp long, rep long")
    monkeypatch.setattr(simhash, "BLOCK", 50)
    bits = list(range(64))
    for plan in (None, [(bits[:32], 1), (bits[32:], 1)], [(bits[:20], 1), (bits[20:40], 0), (bits[40:], 0)], [(bits[::2], 2), (bits[1::2], 0)]):
        if plan:
            monkeypatch.setattr(simhash, "allocate", lambda *_, p=plan: p)
        found = components.connected_components(simhash.near_links(df)).collect()
        assert {**{k: k for k in want}, **{r.node: r.component for r in found}} == want


def test_thresholds_sum_and_grow_with_the_input():
    rnd = np.random.default_rng(0)
    bits = (rnd.random((500, 64)) < np.linspace(0.05, 0.5, 64)).astype(float)
    plans = []
    for n in (500, 10**7, 10**10):
        plan = simhash.allocate(n, bits.T @ bits * (n / 500), 3)
        assert sorted(b for own, _ in plan for b in own) == list(range(64))
        assert sum(t for _, t in plan) == 3 - len(plan) + 1
        plans.append([t for _, t in plan])
    assert len(set(plans[-1])) > 1 or len(plans[-1]) < 4


def test_components(spark):
    rnd = random.Random(5)
    for n, m in ((1, 0), (40, 30), (200, 150), (300, 900)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1100)] * (n == 40)
        df = spark.createDataFrame([(a, b, 0) for a, b in edges] + [(None, 1, 0), (3, 3, 0)], "a long, b long, c int").repartition(3)
        nodes = {x for e in edges for x in e if e[0] != e[1]}
        got = {r.node: r.component for r in components.connected_components(df).collect()}
        assert got == {k: v for k, v in components_of(nodes, edges).items()}
    assert components.connected_components(df.where(F.lit(False))).count() == 0
