import random

import numpy as np
import pytest

from reposift.llm import lines
from reposift.llm.sound import SoundHash


def brute(docs, min_lines, long_words):
    """Kept text by document, by comparing every run with all earlier ones."""
    seen, out = {}, {}
    for doc in sorted(docs, key=lambda d: (d is not None, d or 0)):
        text = docs[doc]
        if text is None:
            out[doc] = None
            continue
        every = text.split("\n")
        full = [k for k, x in enumerate(every) if x.strip(" \t\r\x0b\x0c\n")]
        own = [every[k].strip(" \t\r\x0b\x0c\n") for k in full]
        gone = set()
        for i in range(len(own)):
            for n, least in ((min_lines, 0), (1, long_words)):
                run = tuple(own[i : i + n])
                if len(run) < n or len(run[0].split()) < least:
                    continue
                if (n, least, run) in seen:
                    gone.update(range(i, i + n))
                seen[(n, least, run)] = True
        drop = {full[i] for i in gone}
        for i in gone:
            if i + 1 in gone:
                drop.update(range(full[i], full[i + 1]))
        out[doc] = "\n".join(x for k, x in enumerate(every) if k not in drop)
    return out


def random_docs(seed, n=60):
    rnd = random.Random(seed)
    pool = ["one", " two ", "three 3", "", "quatre é", "five\r", "  ", "a long line of ten words that should be a run"]
    return {k: "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 14))) for k in range(n)}


def test_same_as_brute_force(spark):
    for seed, (least, long) in enumerate([(2, 9), (3, 99), (1, 99), (4, 8)]):
        docs = random_docs(seed) | {None: "one\n two \nthree 3", 777: None, 778: ""}
        df = spark.createDataFrame([(k, t, 5) for k, t in docs.items()], "doc_id long, text string, n_removed int").repartition(5)
        done = lines.dedup_lines(df, min_lines=least, long_words=long)
        assert done.columns == df.columns
        assert {r.doc_id: r.text for r in done.collect()} == brute(docs, least, long)


def test_repeated_rows_are_one_place_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc\ny")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(df).collect())
    assert got == [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "x\ny", 3)]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_any_shared_run_has_a_fingerprint_at_one_line_of_both():
    rnd = np.random.default_rng(3)
    for least in (1, 2, 3, 5):
        run = rnd.integers(0, 50, least, dtype=np.uint64)
        for _ in range(50):
            a, b = (np.concatenate((rnd.integers(0, 50, rnd.integers(0, 9), dtype=np.uint64), run, rnd.integers(0, 50, rnd.integers(0, 9), dtype=np.uint64))) for _ in "ab")
            found = []
            for h in (a, b):
                at = next(k for k in range(len(h)) if np.array_equal(h[k : k + least], run))
                line, starts = lines.selected(h, np.array([0, len(h)]), least)
                found.append({int(x) - at for x, s in zip(line, starts, strict=True) if x >= at and s >> (x - at) & 1})
            assert found[0] == found[1] and len(found[0]) == 1


def test_only_selected_lines_are_sent():
    rnd = np.random.default_rng(3)
    h = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    line, _ = lines.selected(h, np.array([0, 3000]), 3)
    assert 0.4 < len(line) / 3000 < 0.6


def test_without_the_join_of_fingerprints_nothing_is_found(spark, monkeypatch):
    """Every match hangs on a fingerprint that both places select: with fingerprints made different by place there is none."""
    df = spark.createDataFrame([(k, "u\na\nb\nc\nv") for k in range(5)], "doc_id long, text string").coalesce(1)
    assert sum(r.n_removed for r in lines.dedup_lines(df).collect()) == 20
    plain = lines.positions

    def elsewhere(*args):
        row, line, h, *rest = plain(*args)
        return row, line, h + np.arange(len(h), dtype=np.uint64), *rest

    monkeypatch.setattr(lines, "positions", elsewhere)
    monkeypatch.setattr(lines, "stored", lambda x: spark.createDataFrame(_here(x, df, elsewhere), x.schema))
    assert sum(r.n_removed for r in lines.dedup_lines(df).collect()) == 0


def _here(found, df, positions):
    """The rows of found as the given positions() makes them."""
    texts = [r.text for r in df.collect()]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(x) for x in texts]))
    row, line, h, starts, size, around = positions(raw, offsets, 3, 20, SoundHash())
    return [(int(r), int(r), int(n), int(x.view(np.int64)), int(s), int(z), [int(y) for y in a.view(np.int64)]) for r, n, x, s, z, a in zip(row, line, h, starts, size, around, strict=True)]


@pytest.mark.parametrize("ids", [(1, 1), (None, None), (None, 1)])
def test_one_of_two_texts_of_equal_rank_keeps_a_shared_run(spark, ids):
    df = spark.createDataFrame([(ids[0], "a\nb\nc\nx", 1, 2), (ids[1], "y\na\nb\nc", 3, 4)], "doc_id long, text string, __key int, __RUNS int")
    got = lines.dedup_lines(df)
    assert got.columns == [*df.columns, "n_removed"]
    assert sorted(r.n_removed for r in got.collect()) == [0, 3]


def test_a_text_longer_than_a_block(spark):
    rnd = random.Random(5)
    body = [f"line {k} {rnd.random()}" for k in range(60_000)]
    df = spark.createDataFrame([(1, "\n".join(body[:10])), (2, "\n".join([*body, "end", *body[500:600]]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(df).collect()} == {1: 0, 2: 110}


def test_lines_made_to_collide_are_told_apart(spark):
    flips = [bin(k).count("1") & 1 for k in range(1024)]
    one, other = ("".join((a, b)[x] for x in flips) for a, b in (("a", "b"), ("b", "a")))
    words = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, f"{words} {one}"), (2, f"{words} {other}"), (3, f"{words} {one}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(df).collect()} == {1: 0, 2: 0, 3: 1}


def test_rows_that_share_a_key_are_told_apart_by_their_id(spark, monkeypatch):
    monkeypatch.setattr(lines, "row_key", lambda doc_id, text: lines.F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "x\na\nb\nc"), (3, "p\nq\nr\ns")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(df).collect()} == {1: 0, 2: 3, 3: 0}


def test_repeated_rows_have_one_set_of_runs(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")] + [(2, "a\nb\nc\nd\na\nb\nc")] * 40, "doc_id long, text string")
    assert sorted(r.n_removed for r in lines.dedup_lines(df).collect()) == [0] + [6] * 40
