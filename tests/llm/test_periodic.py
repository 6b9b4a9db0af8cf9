import hashlib
import random
import zlib

import pytest

from reposift.llm import periodic


def brute(words, least):
    """Every maximal stretch by comparing all distances; of equal stretches the smallest period counts."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in best.items()), key=lambda x: (x[0], x[2]))


def collapse(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sequence(rnd):
    n, letters = rnd.randrange(80), "abcdefgh"[: rnd.choice([1, 2, 2, 3, 8])]
    words = [rnd.choice(letters) for _ in range(n)]
    if n and rnd.random() < 0.6:
        a = rnd.randrange(n)
        p = rnd.randrange(1, n - a + 1)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("least", [4, 12])
def test_runs_of_one_sequence(least):
    rnd = random.Random(least)
    for _ in range(600):
        words = sequence(rnd)
        assert periodic.runs(words, least) == brute(words, least), words


def texts():
    rnd = random.Random(5)
    out = [(k, "".join(w + rnd.choice([" ", "\n", "\t ", "  "]) for w in sequence(rnd))) for k in range(150)]
    for k in range(150, 190):  # runs within longer texts of many words, and passages that come again far away
        fill = [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(300))]
        cut = rnd.randrange(len(fill) + 1)
        middle = [f"é{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 9))] * rnd.randrange(1, 7)
        out.append((k, " ".join(fill[:cut] + middle + fill[cut:] + fill[: rnd.randrange(40)])))
    return out


@pytest.mark.parametrize("least", [5, 12])
def test_whole_texts_in_blocks(spark, least):
    rows = [*texts(), (500, ""), (501, None), (502, " \n "), (None, "a b " * 9), (503, "x " * 40000), (504, " ".join(map(str, range(9000))) + " go" * 20)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, Runs string").repartition(3)
    got = {r.doc_id: r for r in periodic.find_runs(df, least=least).collect()}
    assert len(got) == len(rows) and periodic.find_runs(df).columns == ["doc_id", "text", "runs", "collapsed"]
    for key, text in rows:
        words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        want = brute(words, least) if key != 503 else [(0, 40000, 1)]
        assert [tuple(x) for x in got[key].runs] == want, key
        assert got[key].collapsed == collapse(words, want)


def test_equal_hashes_of_words_do_not_make_a_run(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(periodic, "span_hash", lambda prefix, start, end: np.zeros(len(start), np.uint64))
    text = " ".join(map(str, range(30))) + " tick tock" * 7
    found, _, _ = periodic._block(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 12)
    assert found == [[(30, 14, 2)]]


def test_digests_plant_periods_by_the_id(spark):
    rows = [(k, " ".join(f"w{i * i % 97}" for i in range(k % 50))) for k in range(400)] + [(400, None), (None, "a b c")]
    got = {r.doc_id: r for r in periodic.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = 0
    for key, text in rows:
        words = (text or "").split()
        h = None if key is None else zlib.crc32(str(key).encode())
        if h is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        found, r = brute(words, 12), got[key]
        best = min(((-n, a, q) for a, n, q in found), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *((best[1], -best[0], best[2]) if best else (None,) * 3))
        assert r.exponent_milli == (1000 * -best[0] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, found).encode()).hexdigest()
    assert planted > 10 and any(r.n_runs for r in got.values())


def test_empty_table_and_repeated_rows(spark):
    assert periodic.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "go " * 15)] * 3
    assert [r.n_runs for r in periodic.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1, 1, 1]
