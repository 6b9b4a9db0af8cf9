import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reposift.operators import code_index, digest, embedding, failures, inference, listing, search, tagging, translate
from reposift.sources import code as code_source

NOW = dt.datetime(2024, 5, 23, 12)


def now():
    return F.lit(str(NOW)).cast("timestamp")


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_digest_of_two_equal_stars_prefers_the_later_push(spark):
    day = lambda d: dt.datetime(2024, 5, d)
    rows = [(1, 1, day(20), False, False), (1, 2, day(22), False, False), (1, 3, day(22), True, False), (1, 4, NOW - dt.timedelta(days=7), False, False), (1, 5, None, False, False), (1, 6, day(22), False, False)]
    stars = spark.createDataFrame(rows, "user_id long, id long, pushed_at timestamp, archived boolean, is_fork boolean")
    vectors = spark.createDataFrame([("star:1", "star", 1, [1.0, 0.0]), ("star:2", "star", 2, [0.0, 1.0]), ("code:2:x:0", "code", 2, [1.0, 0.0])], "id string, kind string, star_id long, vector array<float>")
    got = digest.digest(stars, vectors, now()).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1]
    assert got[0].relevance == pytest.approx(got[1].relevance) == pytest.approx(2**-0.5)
    stats = digest.digest_stats(stars, vectors, now()).first()
    assert (stats.ranked, stats.unembedded, stats.profile_empty) == (2, 1, False)
    assert digest.digest_stats(stars, vectors.limit(0), now()).first().profile_empty
    both = digest.profiles(stars, vectors, "all").first().profile
    assert both == pytest.approx([2 / 3, 1 / 3])
    with pytest.raises(ValueError):
        digest.digest(stars, vectors, now(), window_days=0)
    with pytest.raises(ValueError):
        digest.digest(stars, vectors, now(), limit=0)


def test_batch_search_equals_single_searches(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(60, 8)).astype(np.float32)
    x[7] = x[3]
    x[9] = 0
    vectors = spark.createDataFrame([(f"star:{k:02d}", [float(v) for v in x[k]]) for k in range(60)], "id string, vector array<float>").repartition(4)
    queries = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in (0, 3, 9)], "query_id long, query array<float>")
    got = search.batch_search(queries, vectors, 5).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 3}
    for k in (0, 3):
        alone = search.search(vectors, [float(v) for v in x[k]], 5).collect()
        mine = [r for r in got if r.query_id == k]
        assert [r.id for r in mine] == [r.id for r in alone]
        assert [r.score for r in mine] == pytest.approx([r.score for r in alone])
    assert [r.id for r in got if r.query_id == 3][:2] == ["star:03", "star:07"]
    assert search.search(vectors, [0.0] * 8).count() == 0
    assert search.search(vectors, [float(v) for v in x[0]], min_score=0.9999).count() == 1


def test_inference_halves_refused_batches_and_retries(spark):
    def embed(texts):
        out = []
        for t in texts:
            if "boom" in t:
                raise inference.ModelError("bad_request", "refused")
            counts = Counter(t.lower())
            out.append([float(counts[c]) for c in "abcdefgh"])
        return out

    rows = spark.createDataFrame([(k, "boom" if k == 5 else f"text {k} abc") for k in range(20)], "id long, input string").coalesce(1)
    got = {r.id: r for r in inference.infer(rows, embed, "input", "vector", "array<double>", sleep=lambda s: None).collect()}
    assert {k for k, r in got.items() if r.status == "failed"} == {5}
    assert got[5].error_kind == "bad_request" and got[3].vector == embed(["text 3 abc"])[0]
    whole = inference.infer(rows, embed, "input", "vector", "array<double>", halve=False, sleep=lambda s: None)
    assert whole.where("status = 'failed'").count() == 16
    waits, calls = [], []

    def shaky(x):
        calls.append(1)
        if len(calls) < 3:
            raise inference.ModelError("rate_limit", "wait", 2.0 if len(calls) == 1 else None)
        return x

    assert inference.call(shaky, [1], 3, waits.append) == ([1], 3, None) and waits == [2.0, 1.5]
    assert [x[1:3] for x in inference.outcomes(lambda x: x[:1], [1, 2], 3, True, waits.append)] == [("failed", "bad_output")] * 2
    assert [x[2] for x in inference.outcomes(lambda x: 1 / 0, [1], 3, True, waits.append)] == [None]


def test_chat_asks_equal_prompts_once(spark):
    rows = spark.createDataFrame([(k, "s", f"u{k % 2}") for k in range(6)], "id long, system string, user string")
    got = inference.chat(rows, lambda pairs: [f"{s}:{u}" for s, u in pairs], "system", "user").collect()
    assert {r.id: r.reply for r in got} == {k: f"s:u{k % 2}" for k in range(6)}


def test_strongest_failure(spark):
    log = [(1, 1, None, "weak 1", True), (1, 2, None, "weak 2", True), (2, 1, None, "plain 1", False), (2, 2, None, "plain 2", None), (2, 3, None, "weak", True), (3, 1, "auth", "typed 1", None), (3, 2, "server", "typed 2", None), (3, 3, None, "plain", None)]
    got = failures.strongest(spark.createDataFrame(log, "run long, ord long, kind string, message string, weak boolean"), "run").collect()
    assert {r.run: (r.kind, r.message) for r in got} == {1: (None, "weak 1"), 2: (None, "plain 2"), 3: ("server", "typed 2")}


def chunked(spark, content, language=None, **options):
    df = spark.createDataFrame([(1, "f", content, language)], "repo_id long, path string, content string, language string")
    return [(r.start_line, r.end_line, r.kind, r.header_line) for r in code_index.chunks(df, **options).orderBy("part").collect()]


def test_windows(spark):
    text = lambda n: "\n".join(f"l{k}" for k in range(n))
    spans = lambda n: [x[:2] for x in chunked(spark, text(n))]
    assert spans(1) == [(1, 1)] and spans(40) == [(1, 40)] and spans(41) == [(1, 40), (31, 41)] and spans(71) == [(1, 40), (31, 70), (61, 71)]
    assert chunked(spark, "") == []
    with pytest.raises(ValueError):
        chunked(spark, "a", size=5, overlap=5)


@pytest.mark.parametrize(
    ("language", "content", "want"),
    [
        ("python", "import x\nclass A:\n    def m(self):\n        pass\nasync def f():\n    pass", [(2, 2, "class", "class A:"), (3, 4, "method", "def m(self):"), (5, 6, "function", "async def f():")]),
        ("typescript", "export interface P {\n}\nexport const f = async (x) => x\nclass A {\n  go(x) {\n    if (x) {\n}}}", [(1, 2, "type", "export interface P {"), (3, 3, "function", "export const f = async (x) => x"), (4, 4, "class", "class A {"), (5, 5, "method", "go(x) {"), (6, 7, "method", "if (x) {")]),
        ("rust", "pub struct S;\nimpl S {\n    pub fn new() {}\n}\nfn main() {}", [(1, 1, "type", "pub struct S;"), (2, 2, "impl", "impl S {"), (3, 4, "method", "pub fn new() {}"), (5, 5, "function", "fn main() {}")]),
        ("go", "package x\nfunc (s *S) Go() {\n}\ntype S struct {\n}", [(2, 3, "function", "func (s *S) Go() {"), (4, 5, "type", "type S struct {")]),
        ("java", "public final class A {\n  private int f(int x) {\n  }\n}", [(1, 1, "class", "public final class A {"), (2, 4, "method", "private int f(int x) {")]),
        ("javascript", "function a() {}\nconst b = () => 1\nclass C {\n  m(x) {\n}}", [(1, 1, "function", "function a() {}"), (2, 2, "function", "const b = () => 1"), (3, 3, "class", "class C {"), (4, 5, "method", "m(x) {")]),
        ("python", "x = 1\ny = 2", [(1, 2, "window", "")]),
        ("cobol", "class A:", [(1, 1, "window", "")]),
    ],
)
def test_header_chunks(spark, language, content, want):
    assert chunked(spark, content, language) == want


def test_long_sections_are_cut(spark):
    content = "def f():\n" + "\n".join(f"  x{k}" for k in range(6))
    assert chunked(spark, content, "python", max_lines=3) == [(1, 3, "function", "def f():"), (4, 6, "function", ""), (7, 7, "function", "")]


def test_tree_filter_and_rank(spark):
    rows = [(0, "src/a.ts", "blob", 10), (1, "a.TS", "blob", 10), (2, "node_modules/a.ts", "blob", 10), (3, "src/a.md", "blob", 10), (4, "src/b.ts", "tree", 10), (5, "src/c.ts", "blob", 0), (6, "src/d.ts", "blob", 200_000), (7, "src", "blob", 5), (8, "tests/src/x.py", "blob", 9), (9, "src/e.ts", "blob", None)]
    tree = spark.createDataFrame([(1, *r) for r in rows], "repo_id long, pos int, path string, type string, size long")
    kept = code_index.filter_tree(tree)
    assert {r.pos for r in kept.collect()} == {0, 1, 8}
    assert [(r.pos, r.score) for r in code_index.top_files(kept, 2).orderBy("rank").collect()] == [(0, 8), (1, 4)]


def test_bodies(spark):
    import base64

    wrapped = base64.encodebytes("﻿héllo\nworld".encode() + b"\xff").decode()
    df = spark.createDataFrame([("file", "base64", wrapped), ("dir", "base64", wrapped), ("file", "none", "x")], "type string, encoding string, content string")
    assert [r.content for r in code_source.file_bodies(df).collect()] == ["héllo\nworld�"]


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.md").write_text("no")
    assert [tuple(r) for r in code_source.read_source_tree(spark, str(tmp_path), "*.py").collect()] == [("src/a.py", "x = 1\n", 6)]


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ("Tags: async runtime, rust, concurrency", ["async runtime", "rust", "concurrency"]),
        (" Tags: a", ["Tags: a"]),
        ("1. one\n2) two\n- three\n* four\n• five\nsix", ["one", "two", "three", "four", "five"]),
        ("\"a\", 'b', `c`, d.", ["a", "b", "c", "d"]),
        ("Rust, rust, RUST, go", ["Rust", "go"]),
        ("x" * 41 + ", ok", ["ok"]),
        ("  ", []),
        (None, []),
    ],
)
def test_parse_tags(spark, reply, want):
    assert value(spark, tagging.parse_tags(F.lit(reply).cast("string"))) == want


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ("Translation: Hallo", "Hallo"),
        ("Sure, here is the translation: 翻译结果：你好", "你好"),
        ("ÜBERSETZUNG: gut", "gut"),
        ("Text\n\n(Note: kept)", "Text"),
        ("这是运行时。(I kept React untranslated.)", "这是运行时。"),
        ("**Tokio** is *fast* and `safe`, see [docs](http://x)", "Tokio is fast and safe, see docs"),
        ("a_b_c and 2*3*4", "a_b_c and 2*3*4"),
        ('"whole"', "whole"),
        ('"reliable" async "x"', '"reliable" async "x"'),
        ("「引用」", "引用"),
        ("  ", None),
        ("x" * 1201, None),
        (None, None),
    ],
)
def test_parse_translation(spark, reply, want):
    assert value(spark, translate.parse_translation(F.lit(reply).cast("string"))) == want


@pytest.mark.parametrize(("text", "locale", "want"), [("异步", "zh-CN", True), ("ひらがな", "ja", True), ("한국", "ko", True), ("Среда", "ru", True), ("Việt", "vi", True), ("plain", "vi", False), ("异步", "de", False), ("", "ja", False), (None, "ja", False)])
def test_script(spark, text, locale, want):
    assert value(spark, translate.in_script(F.lit(text).cast("string"), locale)) is want


def test_unknown_locale_is_refused():
    with pytest.raises(ValueError):
        translate.system_prompt("xx")
    assert digest.summary_system_prompt("xx") == digest.summary_system_prompt("en")


def test_orders_put_nulls_where_each_view_wants_them(spark):
    day = lambda d: dt.datetime(2024, 5, d) if d else None
    df = spark.createDataFrame([(1, day(3)), (2, None), (3, day(1))], "id long, pushed_at timestamp")
    ids = lambda x: [r.id for r in x.collect()]
    assert ids(listing.list_stars(df, "pushed_at", descending=False)) == [2, 3, 1]
    assert ids(listing.list_stars(df, "pushed_at")) == [1, 3, 2]
    assert ids(listing.list_stars(df, "pushed_at", drop_null_keys=True, limit=1)) == [1]
    assert ids(df.orderBy(*listing.manage_order("pushed_at", descending=False))) == [3, 1, 2]
    scored = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9)], "id long, relevance double")
    assert ids(scored.orderBy(*listing.manage_order("relevance", descending=False))) == [2, 1, 3]
    assert ids(scored.orderBy(*listing.manage_order("relevance", descending=False, unscored_last=True))) == [1, 3, 2]
    with pytest.raises(ValueError):
        listing.list_stars(df, "id")


def test_worklist_knows_content_and_model(spark):
    stars = spark.createDataFrame([(k, f"o/r{k}", None, "d", []) for k in (1, 2, 3)], "id long, full_name string, language string, description string, topics array<string>")
    inputs = embedding.star_inputs(stars.union(stars), parity=True)
    rows = {r.star_id: r for r in inputs.collect()}
    assert rows[1].input == "o/r1\nd" and len(rows) == 3
    vectors = spark.createDataFrame([("star:1", rows[1].content_hash, "m"), ("star:2", rows[2].content_hash, "old"), ("star:3", "stale", "m")], "id string, content_hash string, model string")
    assert {r.star_id for r in embedding.worklist(inputs, vectors, "m").collect()} == {2, 3}
    assert embedding.worklist(inputs, vectors, "m", force=True).count() == 3


def test_report_keeps_every_failed_id(spark):
    rows = [(k, k % 2, "failed" if k % 2 else "done", 3) for k in range(400)]
    results = spark.createDataFrame(rows, "id long, star_id long, status string, tokens long").repartition(3)
    got = {r.star_id: (r.done, r.failed, r.tokens) for r in failures.run_report(results, ["star_id"]).collect()}
    assert got == {0: (200, 0, 600), 1: (0, 200, 600)}
    assert sorted(tuple(r) for r in failures.failed_rows(results, ["star_id"]).collect()) == [(1, k) for k in range(1, 400, 2)]
    assert failures.failed_rows(results).count() == failures.run_report(results).first().failed == 200


def test_registered_report_lists_more_than_a_hundred_failures(spark, monkeypatch):
    from reposift.plans import catalog

    log = spark.createDataFrame([(k, 7, 500) for k in range(150)] + [(150, 8, 200)], "ord long, star_id long, http_status int")
    monkeypatch.setattr(catalog.fx, "call_log", lambda *_: log)
    got = {r.star_id: r.failed_ids for r in catalog.g7_run_report(spark, "").collect()}
    assert got == {7: ",".join(map(str, range(150))), 8: ""}


def test_missing_keys_of_over_a_thousand_locales(spark):
    rows = [("en", "a"), ("en", "b")] + [(f"l{k}", "a") for k in range(1100)]
    got = listing.missing_keys(spark.createDataFrame(rows, "locale string, key string"))
    assert {tuple(r) for r in got.collect()} == {(f"l{k}", "b") for k in range(1100)}
    assert listing.missing_keys(spark.createDataFrame([("en", "a")], "locale string, key string")).count() == 0


def test_places_of_a_hot_user_over_many_ranges(spark):
    rows = [(1 if k % 3 else k % 7 + 2, k, None if k % 11 == 0 else k * 7919 % 50) for k in range(600)]
    df = spark.createDataFrame(rows, "user_id long, id long, stars long").repartition(5)
    order = [F.desc_nulls_last("stars"), F.asc("id")]
    ranked = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
    want, seen = {}, {}
    for user, id, _ in ranked:
        seen[user] = seen.get(user, 0) + 1
        want[user, id] = seen[user]
    assert {(r.user_id, r.id): r.place for r in listing.places(df, order).collect()} == want
    assert {r.id: r.place for r in listing.places(df, order, by=()).collect()} == {r[1]: k + 1 for k, r in enumerate(ranked)}
    assert listing.places(df.limit(0), order).count() == 0


def test_labels_of_languages_are_normalised_before_chunking(spark):
    code = "import x\ndef f():\n    return 1\n"
    files = spark.createDataFrame([(1, "a", code, " Python"), (2, "b", code, "py"), (3, "c", code, "Cobol"), (4, "d", code, None), (5, "e", "", "python")], "repo_id long, path string, content string, language string")
    got = {(r.repo_id, r.kind, r.start_line, r.end_line) for r in code_index.chunks(files).collect()}
    assert got == {(1, "function", 2, 4), (2, "function", 2, 4), (3, "window", 1, 4), (4, "window", 1, 4)}


def test_a_failure_tells_its_true_number_of_tries():
    def refuse(kind):
        def fn(x):
            raise inference.ModelError(kind)

        return fn

    tries = lambda kind: [x[4] for x in inference.outcomes(refuse(kind), [1, 2], 3, False, lambda s: None)]
    assert tries("bad_request") == [1, 1] and tries("rate_limit") == [3, 3]


def test_a_run_after_a_lost_one_calls_nothing_twice(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    rows = spark.createDataFrame([(k, f"text {k % 50}") for k in range(120)], "id long, input string").repartition(3)

    def model(dies):
        def fn(texts):
            import os
            import uuid

            if dies and any(x.endswith("7") for x in texts) and len(os.listdir(str(log))) > 4:
                raise SystemExit("the executor is gone")
            (log / uuid.uuid4().hex).write_text("\n".join(texts))
            return [x.upper() for x in texts]

        return fn

    run = lambda dies: inference.infer(rows, model(dies), "input", "out", "string", batch=4, in_flight=3, ledger=f"file://{tmp_path}/ledger").collect()
    with pytest.raises(Exception, match="executor is gone|SystemExit|exited|Python worker"):
        run(True)
    before = len(list(log.iterdir()))
    assert before > 4
    with open(next((tmp_path / "ledger").iterdir()), "a") as half:
        half.write('["torn line')
    got = run(False)
    assert {r.id: r.out for r in got} == {k: f"TEXT {k % 50}" for k in range(120)} and all(r.status == "done" for r in got)
    called = [x for f in log.iterdir() for x in f.read_text().split("\n")]
    assert len(called) == len(set(called)) == 50
    run(False)
    assert len(list(log.iterdir())) > before and sum(len(f.read_text().split("\n")) for f in log.iterdir()) == 50


def test_failures_are_asked_again_and_repeats_share_an_answer(spark, tmp_path):
    rows = spark.createDataFrame([(1, "bad"), (2, "good"), (3, "bad"), (4, "good"), (5, None)], "id long, input string")

    def strict(texts):
        if "bad" in texts:
            raise inference.ModelError("bad_request", "no")
        return [str(x) for x in texts]

    run = lambda fn: {r.id: (r.out, r.status) for r in inference.infer(rows, fn, "input", "out", "string", in_flight=1, ledger=str(tmp_path / "l")).collect()}
    assert run(strict) == {1: (None, "failed"), 2: ("good", "done"), 3: (None, "failed"), 4: ("good", "done"), 5: ("None", "done")}
    assert run(lambda x: ["new"] * len(x)) == {1: ("new", "done"), 2: ("good", "done"), 3: ("new", "done"), 4: ("good", "done"), 5: ("None", "done")}


def test_calls_are_paced():
    now, waits = [0.0], []

    def sleep(seconds):
        waits.append(round(seconds, 6))
        now[0] += seconds

    fn = inference.paced(lambda x: x, 2.0, sleep, lambda: now[0])
    fn([1]), fn([2])
    now[0] += 5
    fn([3]), fn([4])
    assert waits == [2.0, 2.0]
    with pytest.raises(ValueError, match="in_flight"):
        inference.infer(None, None, "a", "b", "string", per_second=3)


def test_large_files_are_left_out_by_the_listing(spark, tmp_path):
    from reposift.sources import code

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "small.py").write_text("x = 1")
    (tmp_path / "a" / "b" / "large.bin").write_bytes(b"\0" * 5000)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        found = code.read_source_tree(spark, root, largest=1000)
        assert [(r.path, r.content, r.bytes) for r in found.collect()] == [("a/small.py", "x = 1", 5)]
        assert "LessThanOrEqual(length,1000)" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.path for r in code.read_source_tree(spark, str(tmp_path)).collect()} == {"a/small.py", "a/b/large.bin"}


def test_folders_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(code_source, "BATCH_ENTRIES", 7)
    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        for k in range(30):
            (tmp_path / folder / f"{k}.py").write_text(f"x = {k}\n")
    (tmp_path / "a" / "large.py").write_bytes(b"\0" * 5000)
    (tmp_path / "a" / "__init__.py").write_bytes(b"\xff")
    (tmp_path / "a" / "n.md").write_text("no")
    (tmp_path / "empty").mkdir()
    folders = spark.createDataFrame([(f"file://{tmp_path}/a",), (f"{tmp_path}/b",), (f"{tmp_path}/empty",), (None,)], "folder string")
    got = code_source.read_folders(folders, "*.py", largest=1000).collect()
    want = {(f, f"{p}{k}.py"): (f"x = {k}\n", len(f"x = {k}\n")) for f, p in ((f"file://{tmp_path}/a", ""), (f"{tmp_path}/b", "c/")) for k in range(30)}
    want[f"file://{tmp_path}/a", "__init__.py"] = ("\ufffd", 1)
    assert len(got) == 61 and {(r.folder, r.path): (r.content, r.bytes) for r in got} == want


def test_source_tree_query_makes_no_folder_per_document(spark):
    from reposift.plans import fixtures
    from reposift.session import workspace

    folders = fixtures.source_folders(spark, "/root/testdata/sf0.001", workspace(spark))
    docs = fixtures.load(spark, "/root/testdata/sf0.001", "documents").where("text <> ''")
    assert folders.count() <= 2 + docs.count() // 1000 and code_source.list_folders(folders).count() == docs.count()


def _run_of(rows, fn, **options):
    """What a task of infer() does, here."""
    class Rows:
        schema = rows.schema

        def mapInPandas(self, run, schema):
            return run

    return inference.infer(Rows(), fn, "input", "out", "string", sleep=lambda s: None, **options)


def test_answers_leave_in_large_frames_whatever_the_batch(spark):
    import pandas as pd

    sent = []
    run = _run_of(spark.createDataFrame([(0, "a")], "id long, input string"), lambda x: sent.append(len(x)) or x, batch=1)
    frames = list(run([pd.DataFrame({"id": range(2500), "input": [f"t{k}" for k in range(2500)]})]))
    assert sent == [1] * 2500 and [len(x) for x in frames] == [1024, 1024, 452]
    assert [x for f in frames for x in f["out"]] == [f"t{k}" for k in range(2500)]


def test_flaky_model_keeps_no_answered_text():
    from reposift.plans import catalog

    model = catalog._flaky()
    assert [inference.call(model, [x], 3, lambda s: None)[:2] for x in ("a", "bb", "ccc", "a")] == [([[1.0]], 3), ([[2.0]], 1), ([[3.0]], 3), ([[1.0]], 3)]
    assert [c.cell_contents for c in model.__closure__ if isinstance(c.cell_contents, dict)] == [{}]


def test_search_holds_few_scores_at_a_time(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(5)
    matrix = rnd.normal(size=(40, 4))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    blocks = [rnd.normal(size=(30, 4)) for _ in range(3)]

    def found():
        best = search.Best(matrix, 5)
        for k, x in enumerate(blocks):
            best.add(pa.array([f"{k}-{i}" for i in range(len(x))]), pa.array(x.tolist()))
        return [list(x) for x in best.ids], [list(x) for x in best.scores]

    whole = found()
    sizes, add = [], search.Best._add_tile
    monkeypatch.setattr(search, "SCORES", 100)
    monkeypatch.setattr(search.Best, "_add_tile", lambda self, q, ids, x, scores: sizes.append(scores.size) or add(self, q, ids, x, scores))
    assert found() == whole and max(sizes) <= 100 and sum(sizes) == 40 * 90


def test_tag_facets_do_not_sort_all_tags(spark):
    rows = [(k, dt.datetime(2024, 1, 1 + k % 3), ["Tag", f" t{k % 4} ", "TAG"] if k % 2 else ["tag ", "", None]) for k in range(30)] + [(90, None, ["tAG"])]
    stars = spark.createDataFrame(rows[:-1], "id long, starred_at timestamp, ai_tags array<string>").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = listing.tag_facets(stars)
        assert [tuple(r) for r in found.collect()] == [("tag", 45), ("t1", 8), ("t3", 7)]  # star 2 is the first of the newest
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        late = spark.createDataFrame(rows, stars.schema)
        assert listing.tag_facets(late).first().tag == "tAG"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hash_unpacks_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    from reposift.functions import text

    texts = pa.array(["é" * (k % 40) if k % 7 else None for k in range(300)]).slice(11)
    monkeypatch.setattr(text, "SLICE_BYTES", 200)
    parts = list(text.slices(texts))
    assert pa.concat_arrays(parts).equals(texts) and len(parts) > 30 and max(sum(len((x or "").encode()) for x in p.to_pylist()) for p in parts) <= 280
    assert list(text.slices(pa.array([], pa.string())))[0].to_pylist() == []


def test_feed_has_more_files_for_more_documents(spark, monkeypatch):
    from reposift.plans import fixtures

    n = fixtures.load(spark, "/root/testdata/sf0.001", "documents").count()
    assert fixtures.feed_files(spark, "/root/testdata/sf0.001") == 1
    monkeypatch.setattr(fixtures, "FEED_ROWS", 7)
    assert fixtures.feed_files(spark, "/root/testdata/sf0.001") == -(-n // 21)


def test_the_feed_is_written_in_small_files_without_a_shuffle(spark, monkeypatch, tmp_path):
    import gzip

    from reposift.plans import fixtures

    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(fixtures, "FEED_ROWS", 7)
    rows = fixtures.incoming(spark, small).coalesce(2)
    lines = [r.value for r in fixtures.envelopes(spark, small, rows, ("user_id",)).collect()]
    a_third = fixtures.write_feed(spark, small, rows, str(tmp_path / "in"))
    files = {x.name: gzip.open(x, "rt").read().splitlines() for x in (tmp_path / "in").glob("*.gz")}
    assert sorted(x for own in files.values() for x in own) == sorted(lines) and max(map(len, files.values())) <= 7
    assert len({x[:10] for x in files}) <= 2 and a_third == -(-len(files) // 3)  # the two tasks with the rows have written them
    assert fixtures.write_feed(spark, small, rows.limit(0), str(tmp_path / "none")) == 1


def test_a_session_of_its_own_leaves_no_shuffle_files(spark):
    from reposift.session import tidy

    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        own = tidy(spark, **{"spark.sql.parquet.compression.codec": "zstd"})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert own.conf.get("spark.sql.shuffle.partitions") == "3" and own.conf.get("spark.sql.session.timeZone") == "UTC"
    assert (spark.conf.get(cleanup), own.conf.get(cleanup), own.conf.get("spark.sql.parquet.compression.codec")) == ("false", "true", "zstd")
    grouped = lambda s: s.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count()
    keys = lambda: set(held.keys().mkString(",").split(",")) - {""}
    before = keys()
    assert sorted(grouped(own).collect()) == sorted(grouped(own).collect())
    again = grouped(own)
    assert again.collect() == again.collect()
    assert keys() <= before
    grouped(spark).collect()
    assert keys() - before
