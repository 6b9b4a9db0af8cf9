import random

import numpy as np
import pytest

from reposift.llm import suffix


def test_suffix_array_is_the_sorted_one():
    rnd = random.Random(1)
    cases = [[], [1], [1, 1, 1], [2, 1], [1, 2, 1, 2, 1], [ord(c) for c in "mississippi"], [3, 2, 1] * 20, [1, 2, 3] * 20]
    cases += [[rnd.randrange(1, k + 1) for _ in range(n)] for k in (1, 2, 3, 30) for n in (5, 40, 300)]
    for text in cases:
        assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_window_minima():
    v = np.random.default_rng(0).integers(0, 99, 57)
    for width in (1, 2, 7, 57):
        assert suffix.window_minima(v, width).tolist() == [v[k : k + width].min() for k in range(57 - width + 1)]


def brute(docs, length):
    """docs: (order, bytes) in order; the covered bytes of each."""
    seen, out = set(), []
    for raw in docs:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(raw[k : k + length])
        out.append(gone)
    return out


def corpus(seed, n=50):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randrange(1, 9)))
    pool = [" ".join(word() for _ in range(rnd.randrange(8, 60))) for _ in range(12)]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(0, 5)):
            own = rnd.choice(pool)
            lo = rnd.randrange(len(own) // 2)
            own = own[lo : rnd.randrange(lo, len(own)) + 1] if rnd.random() < 0.6 else own
            if own and rnd.random() < 0.4:
                k = rnd.randrange(len(own))
                own = own[:k] + "#" + own[k + 1 :]
            parts.append(own + word())
        docs.append("".join(parts))
    docs += ["a" * 400, "ab" * 150 + "x" + "ab" * 80, "a" * 130, "", "short"]
    return docs


@pytest.mark.parametrize(("length", "hot"), [(100, suffix.HOT), (40, 3), (33, 1), (20, 2)])
def test_same_as_brute_force(spark, length, hot, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH", 2000)
    texts = corpus(length)
    rows = [(3 * k, t, "x") for k, t in enumerate(texts)] + [(1000, None, "y"), (None, texts[0] + "tail" * 20, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    want = {r[0]: (gone, (r[1] or "").encode()) for r, gone in zip(order, brute([(r[1] or "").encode() for r in order], length), strict=True)}
    got = suffix.dedup_bytes(df, length=length, hot=hot).collect()
    assert len(got) == len(rows) and any(w[0].any() for w in want.values())
    for r in got:
        gone, raw = want[r.doc_id]
        assert bytes(r.kept) == bytes(np.frombuffer(raw, np.uint8)[~gone]), r.doc_id
        assert r.n_bytes == len(raw)
        edges = np.diff(np.concatenate(([0], gone, [0])).astype(int))
        assert [(x.begin, x.end) for x in r.removed] == list(zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True))


def test_repeated_rows_and_ids(spark):
    text = "".join(random.Random(3).choices("abcdefghij", k=300))
    rows = [(5, text), (5, text), (9, "x" + text[:150]), (9, "x" + text[:150])]
    got = sorted((r.doc_id, len(r.kept)) for r in suffix.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 300), (5, 300), (9, 1), (9, 1)]
    other = suffix.dedup_bytes(spark.createDataFrame([(5, text), (5, text[100:] + "y")], "doc_id long, text string")).collect()
    assert sorted(len(r.kept) for r in other) in ([1, 300], [100, 201])
    assert suffix.dedup_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def thue_morse(n, a, b):
    """Two different strings whose polynomials modulo 2**64 agree for every odd base."""
    flips = [bin(k).count("1") & 1 for k in range(n)]
    return "".join((a, b)[x] for x in flips), "".join((b, a)[x] for x in flips)


def test_strings_made_to_collide_are_told_apart(spark):
    anchor = "zq" * 16
    one, other = thue_morse(1024, "a", "b")
    docs = [one[:600] + anchor + one, other[:600] + anchor + other, one, other]
    for length in (100, 1024):
        want = [int(x.sum()) for x in brute([x.encode() for x in docs], length)]
        got = {r.doc_id: r.n_bytes - len(r.kept) for r in suffix.dedup_bytes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), length=length).collect()}
        assert [got[k] for k in range(4)] == want
    import numpy as np

    from reposift.llm.common import prefix_hash, span_hash
    from reposift.llm.sound import SoundHash

    raw = np.frombuffer((one + other + one).encode(), np.uint8)
    start = np.array([0, 1024, 2048])
    fast, sound = span_hash(prefix_hash(raw), start, start + 1024), SoundHash().spans(raw, start, start + 1024)
    assert fast[0] == fast[1] and sound[0] == sound[2] != sound[1]


@pytest.mark.parametrize("chunk", [257, 900])
def test_repeats_over_the_border_of_a_pass(spark, monkeypatch, chunk):
    """Repeats that begin and end at every offset around a border."""
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    rnd = random.Random(chunk)
    fresh = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    passage = fresh(260)
    texts = [passage] + [fresh(chunk - 200 + k * 7) + passage[: 200 + k] + fresh(300) for k in range(50)]
    want = [int(x.sum()) for x in brute([x.encode() for x in texts], 100)]
    got = {r.doc_id: r.n_bytes - len(r.kept) for r in suffix.dedup_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == want and sum(want) > 9000


def test_a_long_text_with_repeats_around_the_border_of_its_passes(spark):
    rnd = random.Random(8)
    text = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=1_500_000))
    for k in range(40):
        at = suffix.CHUNK - 130 + k * 7
        rows = [(1, text[:at] + text[5000 + k * 400 : 5260 + k * 400] + text[at + 260 :])]
        if k % 13 == 0:
            got = suffix.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).first()
            assert [(x.begin, x.end) for x in got.removed] == [(at, at + 260)] or got.n_bytes - len(got.kept) in range(260, 264)
