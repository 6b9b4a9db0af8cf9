import random
from itertools import combinations
from math import ceil

import numpy as np

from reposift.llm import decontam


def test_masks_are_lossless():
    masks = [[k for k, x in enumerate(m) if x == "1"] for m in decontam.MASKS]
    for n in range(decontam.SHORT, decontam.WINDOW + 1):
        for bad in combinations(range(n), n - ceil(decontam.SIMILARITY * n)):
            assert any(all(i + k not in bad for k in m) for m in masks for i in range(n - m[-1])), (n, bad)


def brute(docs, items):
    """(doc, item, first, end, share) by laying every item on every place of every document."""
    out = set()
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            own = (item or "").lower().split()
            size = min(len(own), decontam.WINDOW)
            if not size:
                continue
            need = size if size < decontam.SHORT else ceil(decontam.SIMILARITY * size)
            for shift in range(size - len(own), len(words) - size + 1):
                good, best = [], 0
                for k in range(max(0, -shift), min(len(own), len(words) - shift) - size + 1):
                    n = sum(own[k + j] == words[k + shift + j] for j in range(size))
                    best = max(best, n)
                    if n >= need:
                        good.append(k)
                if good:
                    out.add((d, i, good[0] + shift, good[-1] + shift + size, best / size))
    return out


def sample(spark):
    """Documents and items with substitutions, upper case, null ids, null texts, repeated rows and repeated ids, and the overlaps of each document row."""
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefghijklmnopqrstuvwxyzÄé")
    items = [(k, " ".join(word() + word() for _ in range(n))) for k, n in enumerate((3, 7, 9, 10, 14, 19, 25, 40, 60))] + [(90, None), (91, ""), (92, "aa " * 30)]
    docs = [(500, None), (501, ""), (None, items[6][1]), (None, items[7][1]), (None, "nothing at all"), (502, "aa " * 200)]
    for k in range(120):
        own = items[rnd.randrange(9)][1].split()
        lo = rnd.randrange(0, 6) if len(own) > 12 else 0
        for _ in range(rnd.randrange(0, 6)):
            own[rnd.randrange(len(own))] = "zz"
        docs.append((k, " ".join([word() + word() for _ in range(rnd.randrange(0, 20))] + [x.upper() for x in own[lo:]] + [word()] * rnd.randrange(3))))
    docs += [docs[10], docs[10], (7, "another text under a known id " + items[5][1]), docs[2]]
    items += [items[3], (None, items[4][1])]
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(4)
    return docs, items, left, spark.createDataFrame(items, "item_id long, text string")


def test_same_as_brute_force_either_way(spark):
    docs, items, left, right = sample(spark)
    want = sorted((row for d in docs for i in items for row in brute([d], [i])), key=str)
    assert len(want) > 100 and len(want) > len(set(want))
    for most in (decontam.BROADCAST_SEEDS, 0):
        assert sorted((tuple(r) for r in decontam.overlaps(left, right, most_seeds=most).collect()), key=str) == want
        assert decontam.overlaps(left.limit(0), right, most_seeds=most).count() == 0 and decontam.overlaps(left, right.limit(0), most_seeds=most).count() == 0


def test_lists_of_candidates_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontam, "LIST", 2)
    docs, items, left, right = sample(spark)
    want = sorted((row for d in docs for i in items for row in brute([d], [i])), key=str)
    assert sorted((tuple(r) for r in decontam.overlaps(left, right, most_seeds=0).collect()), key=str) == want


def test_clean_judges_each_row_by_its_text(spark):
    docs, items, left, right = sample(spark)
    named = left.withColumns({"__key": left["item_id"], "__SALT": left["text"]})
    want = sorted((d for d in docs if not brute([d], items)), key=str)
    assert 10 < len(want) < len(docs) and (None, "nothing at all") in want
    for most in (decontam.BROADCAST_SEEDS, 0):
        kept = decontam.clean(named, right, most_seeds=most)
        assert kept.columns == named.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
        assert decontam.clean(named, right.limit(0), most_seeds=most).count() == len(docs)
        assert decontam.clean(named.limit(0), right, most_seeds=most).count() == 0


def test_a_text_longer_than_a_block(spark):
    rnd = random.Random(4)
    item = [f"i{k}" for k in range(40)]
    text = [f"w{rnd.randrange(5000)}" for _ in range(400_000)]
    text[300_000:300_040] = item
    left = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    right = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    for most in (decontam.BROADCAST_SEEDS, 0):
        assert [tuple(r) for r in decontam.overlaps(left, right, most_seeds=most).collect()] == [(1, 5, 300_000, 300_040, 1.0)]


def test_word_hash_does_not_depend_on_place():
    raw = np.frombuffer("ab cd ab".encode(), np.uint8)
    words = decontam.Words(raw, np.array([0, 8]))
    assert words.hashes[0] == words.hashes[2] != words.hashes[1] and words.rows.tolist() == [0, 3]
