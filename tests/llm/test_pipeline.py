import random

import pytest

import corpus_pipeline as pipeline
from reposift.llm import bpe, decontam, lines, simhash, toxicity
from reposift.llm.registry import vocabulary


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with toxic documents, repeated lines, near copies and leaks."""
    rnd = random.Random(7)
    root = tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4)))
    vocabulary_ = [word() for _ in range(800)]
    line = lambda n: " ".join(rnd.choice(vocabulary_) for _ in range(n))
    items = [line(30) for _ in range(5)]
    footer = "\n".join(line(8) for _ in range(3))
    docs, kind = [], {}
    for k in range(700):
        text = "\n".join(line(rnd.randrange(8, 16)) for _ in range(rnd.randrange(3, 9)))
        kind[k] = "clean"
        if k % 10 == 3:
            parts = text.split(" ")
            for _ in range(4):
                parts.insert(rnd.randrange(len(parts)), "snarkle")
            text, kind[k] = " ".join(parts), "toxic"
        elif k % 25 == 4:
            text, kind[k] = text + "\n" + items[k // 25 % 5], "leak"
        elif k % 25 == 6:
            text, kind[k] = text + "\n" + footer, "footer"
        docs.append((k, text, "en", "src", len(text)))
    for k in range(700, 720):
        text = docs[k - 690][1] + " again"
        kind[k] = "copy" if kind[k - 690] == "clean" else "other"
        docs.append((k, text, "en", "src", len(text)))
    docs += [(900, None, None, None, None), (901, "", "en", "src", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    labels = [(k, 1, int(kind[k] == "toxic")) for k in range(700) if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), docs, kind


def test_stages_keep_columns_and_take_effect(spark, folder):
    root, docs, kind = folder
    now = spark.read.parquet(f"{root}/documents.parquet")
    columns, after = now.columns, {}
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, root)
        if name != "bpe":
            assert now.columns == columns
        after[name] = {r.doc_id: r for r in now.collect()}
        now = spark.createDataFrame(list(after[name].values()), now.schema)
    known = {d[0] for d in docs if "snarkle" in (d[1] or "")}
    assert set(after["toxicity"]) == {d[0] for d in docs} - known
    lined = after["line_dedup"]
    assert set(lined) == set(after["toxicity"])
    footers = [k for k, v in kind.items() if v == "footer"]
    full = {d[0]: d[1] for d in docs}
    assert lined[footers[0]].text == full[footers[0]]
    assert all(lined[k].text == full[k].rsplit("\n", 3)[0] and lined[k].n_chars == len(lined[k].text) for k in footers[1:])
    kept = after["simhash"]
    assert all(k in kept for k, v in kind.items() if v in ("clean", "leak", "footer"))
    # Line dedup leaves each passage in the first document that holds it; that document is the leak.
    items = [r.text for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    leaks = {k for k, r in kept.items() if any(i in (r.text or "") for i in items)}
    assert len(leaks) >= 5 and set(after["decontamination"]) == set(kept) - leaks
    assert all(k in after["decontamination"] for k, v in kind.items() if v in ("clean", "footer") and k in kept)
    codec = bpe.codec(*vocabulary())
    for r in after["bpe"].values():
        assert r.text == after["decontamination"][r.doc_id].text and r.n_tokens == len(r.ids)
        assert codec.encode([r.text or ""])[0].tolist() == r.ids


def test_run_is_the_stages_in_a_row(spark, folder):
    root, _, _ = folder
    got = pipeline.run(spark, root)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    labels, items = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("labels", "benchmark"))
    near = {"shingle": 5, "distance": pipeline.NEAR_BITS, "parts": pipeline.PARTS, "whole": pipeline.WHOLE_BITS, "repeats": False}
    want = decontam.clean(simhash.first_of_groups(lines.dedup_lines(toxicity.clean(docs, labels)), **near), items)
    assert {(r.doc_id, r.text) for r in got.collect()} == {(r.doc_id, r.text) for r in want.collect()}
    assert pipeline.run(spark, root).columns == [*docs.columns, "n_tokens", "ids"]


def test_nulls_repeated_rows_long_texts_and_clashing_names(spark, folder, tmp_path):
    root, docs, _ = folder
    rnd = random.Random(11)
    long = " ".join(f"w{rnd.randrange(40_000)}" for _ in range(200_000))
    extra = [(None, "a text without id", "en", "src", 17), (None, None, None, None, None), (950, long, "en", "src", len(long)), (950, long, "en", "src", len(long)), (951, "one of a kind, twice", "en", "src", 20), (951, "one of a kind, twice", "en", "src", 20)]
    rows = [(*d, k, "mine", 1.5) for k, d in enumerate([*docs[:200], *extra])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids long, __RUNS string, __gone double"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "__RUNS", "__gone", "n_tokens", "ids"]
    kept = [(r.doc_id, r.text, r.n_tokens) for r in got.collect()]
    assert sum(k is None and t is None for k, t, _ in kept) == 1 and sum(k is None and t == "a text without id" for k, t, _ in kept) == 1
    assert [t == long for k, t, _ in kept if k == 950] == [True] * 2 and [t for k, t, _ in kept if k == 951] == ["one of a kind, twice"] * 2
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
