import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reposift.llm import checksum, spelling


def edits(word, alphabet):
    cut = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in alphabet} | {a + c + b for a, b in cut for c in alphabet}
    return out - {word}


def brute(counts):
    alphabet, out = sorted({c for w in counts for c in w}), {}
    for word, n in counts.items():
        near = [w for w in edits(word, alphabet) if w in counts]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best and counts[best] >= 2 * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)
    roots = {}
    for word in counts:
        roots[word] = word
        while out[roots[word]][0]:
            roots[word] = out[roots[word]][0]
    return {w: (f, roots[w], n, k, m) for w, (f, n, k, m) in out.items()}


def vocabulary(seed):
    rnd = random.Random(seed)
    counts = {}
    while len(counts) < 400:
        counts["".join(rnd.choices("aéÿ", k=rnd.randrange(5, 8)))] = rnd.choice([3, 3, 4, 6, 9, 20, 41, 100, 500])
    long = "ab" * 40
    counts |= {"aaaaa": 7, "aaaaaa": 14, "aaaaaaa": 28, "aaaaaaaa": 3, long: 50, long[1:]: 5, long[:63] + "z" + long[64:]: 9, long[:63]: 4, long[:64]: 4, "é" * 2000: 3, "é" * 1999 + "ê": 6}
    return counts


def rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_same_as_brute_force(spark):
    counts = vocabulary(1)
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(counts)
    assert rows(got) == want and sum(x[0] is not None for x in want.values()) > 50 and max(x[3] for x in want.values()) > 5
    assert any(want[w][0] and want[want[w][0]][0] for w in want)  # a chain of forms


@pytest.mark.parametrize(("bits", "size", "part"), [(32, 64, 1), (1, 64 << 20, 4), (4, 16, 1)])
def test_many_passes_and_false_positives_change_nothing(spark, monkeypatch, bits, size, part):
    monkeypatch.setattr(spelling, "BITS", bits)
    monkeypatch.setattr(spelling, "FILTER_BYTES", size)
    monkeypatch.setattr(spelling, "PART_BLOCKS", part)
    counts = dict(list(vocabulary(2).items())[-60:])
    assert len(spelling.Layout(Counter(min(len(w), spelling.LONG) for w in counts)).passes) > (size < 1000)
    assert rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_each_pair_is_probed_once_and_positives_are_few(spark):
    counts = vocabulary(3)
    stored = spelling.stored(spark.createDataFrame(list(counts.items()), "word string, n long"))
    pairs = [tuple(sorted((r.word, r.near))) for r in spelling.near_pairs(stored).collect()]
    want = {tuple(sorted((a, b))) for a in counts for b in edits(a, sorted({c for w in counts for c in w})) if b in counts}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    probed = spelling._positives(stored).count()
    assert len(want) <= probed < 1.1 * len(want) + 20


def test_without_the_filters_nothing_is_found(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_contains", lambda layout, part, begin, h, length: np.zeros(0, np.int64))
    assert {x[3] for x in rows(spelling.variants(spark.createDataFrame([("aaaaa", 5), ("aaaab", 50)], "word string, n long"))).values()} == {0}


def counted(texts, slips):
    out = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if slips and h % slips == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("slips", [None, 3, 97])
def test_words_are_counted_over_whole_texts(spark, slips, monkeypatch):
    monkeypatch.setattr(spelling, "COUNT_BYTES", 500)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("aBÉé×ñ", k=rnd.randrange(1, 7)))
    texts = [(k, "".join(word() + rnd.choice([" ", "1", "\n", "ŀ", "-", "中"]) for _ in range(rnd.randrange(60)))) for k in range(200)]
    texts += [(900, None), (901, ""), (None, "Slipped slipped SLIPPED"), (902, "x" * 5000 + " é" * 3), (902, "x" * 5000), (902, "x" * 5000), (903, "ended"), (904, "ended"), (905, "ended")]
    df = spark.createDataFrame([(*t, "q") for t in texts], "doc_id long, text string, word string").repartition(3)
    assert {r.word: r.n for r in spelling.count_words(df, slips=slips).collect()} == counted(texts, slips)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.digests(none).count() == 0
    assert spelling.digests(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(spelling.digests(spark.createDataFrame([(1, "alone alone alone")], "doc_id long, text string"))) == {"alone": (None, "alone", 3, 0, None)}


def test_checksums_of_many_spans():
    raw = np.frombuffer(random.Random(6).randbytes(3000), np.uint8)
    start = np.array([0, 5, 5, 100, 700, 2990, 3000])
    length = np.array([5, 0, 64, 65, 1500, 10, 0])
    state = np.array([zlib.crc32(f"{k}:".encode()) for k in range(7)], np.uint32)
    got = checksum.continued(state, raw, start, length)
    assert got.tolist() == [zlib.crc32(raw[a : a + n].tobytes(), int(s)) for a, n, s in zip(start.tolist(), length.tolist(), state.tolist(), strict=True)]
