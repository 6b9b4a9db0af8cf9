"""The pipelines end to end with a fake model."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_sync import T0, frame, star

from reposift.plans import jobs
from reposift.sources import stars as source
from reposift.sources.tables import LAYOUTS, Conflict, Layout


SMALL = {name: layout._replace(groups=2) for name, layout in LAYOUTS.items()}


def fake_embed():
    def embed(texts):
        return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    return embed


def fake_chat():
    return lambda pairs: [f"Tags: {len(u)} letters, tagged" if "tags" in s.lower() else f"Übersetzung: {u[:9]}" for s, u in pairs]


def at(day):
    return F.lit(str(dt.datetime(2024, 1, day))).cast("timestamp")


@pytest.fixture
def tables(spark, tmp_path):
    found = source.Snapshots(spark, str(tmp_path), SMALL)
    pull = frame(spark, star(1, 1, description="bees and buzz"), star(1, 2, description="zebra zoo"), star(2, 1, description="bees and buzz"), star(2, 3, description="kayak"))
    jobs.sync_job(found, pull, at(11)).collect()
    return found


def test_sync_then_unstar_then_nothing(spark, tables):
    assert tables.read("stars").count() == 4
    jobs.embed_job(tables, fake_embed(), "m", at(11))
    second = frame(spark, star(1, 1, description="bees and buzz"), star(2, 1, stargazers_count=7), star(2, 4, starred_at=T0 + dt.timedelta(days=1)))
    report = {r.user_id: r for r in jobs.sync_job(tables, second, at(12), force=True).collect()}
    assert (report[1].inserted, report[1].updated, report[1].deleted) == (0, 1, 1) and (report[2].inserted, report[2].updated, report[2].deleted) == (1, 1, 1)
    assert {r.id for r in tables.read("vectors").collect()} == {"star:1"}
    third = {r.user_id: r for r in jobs.sync_job(tables, second, at(13)).collect()}
    assert (third[1].deleted, third[2].deleted, third[2].inserted, third[2].known) == (0, 0, 0, 2)
    assert {r.user_id: r.since for r in tables.read("cursors").collect()}[2] == T0 + dt.timedelta(days=1)


def test_a_pull_like_the_last_one_moves_only_the_cursor(spark, tables):
    pull = frame(spark, star(1, 1, description="bees and buzz"), star(1, 2, description="zebra zoo"), star(2, 1, description="new text"), star(2, 3, description="kayak"))
    before = {r.user_id: r for r in tables.read("cursors").collect()}
    report = {r.user_id: r for r in jobs.sync_job(tables, pull, at(25)).collect()}
    assert (report[1].inserted, report[1].updated, report[1].deleted, report[1].known) == (0, 0, 0, 2) and report[2].updated == 2
    after = {r.user_id: r for r in tables.read("cursors").collect()}
    assert after[1].since == before[1].since and after[1].known_count == before[1].known_count
    assert after[1].updated_at == after[1].last_full_sync_at == after[2].last_full_sync_at > before[1].last_full_sync_at  # a full pull was due
    assert {(r.user_id, r.id) for r in tables.read("stars").collect()} == {(1, 1), (1, 2), (2, 1), (2, 3)}
    again = {r.user_id: r for r in jobs.sync_job(tables, pull, at(26)).collect()}
    assert all((r.inserted, r.updated, r.deleted) == (0, 0, 0) for r in again.values()) and len(again) == 2


def test_embed_search_digest(spark, tables):
    first = jobs.embed_job(tables, fake_embed(), "m", at(11))
    assert first.count() == 3  # a repository kept by two users is embedded once
    assert jobs.embed_job(tables, fake_embed(), "m", at(12)).count() == 0
    assert jobs.embed_job(tables, fake_embed(), "other", at(12)).count() == 3
    query = fake_embed()(["zzz zoo"])[0]
    queries = spark.createDataFrame([(1, query)], "query_id long, query array<float>")
    assert jobs.search_job(tables, queries, 1).first().full_name == "o/r2"
    found = jobs.digest_job(tables, at(12), fake_chat()).collect()
    assert {(r.user_id, r.id) for r in found} == {(1, 1), (1, 2), (2, 1), (2, 3)} and all(r.summary for r in found)


def test_index_and_code_search(spark, tables):
    jobs.embed_job(tables, fake_embed(), "m", at(11))
    tree = spark.createDataFrame([(1, 0, "src/a.py", "blob", 50), (1, 1, "README.md", "blob", 50), (2, 0, "notes.txt", "blob", 9)], "repo_id long, pos int, path string, type string, size long")
    bodies = spark.createDataFrame([(1, "src/a.py", "def quiz():\n    return 'qqq'\nclass Wow:\n    pass"), (1, "README.md", "x")], "repo_id long, path string, content string")
    flags = {r.repo_id: r for r in jobs.index_job(tables, tree, bodies, fake_embed(), "m", at(12)).collect()}
    assert flags[1].n == 2 and flags[1].deep_indexed and not flags[2].deep_indexed and flags[2].reason
    queries = spark.createDataFrame([(1, fake_embed()(["quiz qqq"])[0])], "query_id long, query array<float>")
    hit = jobs.search_job(tables, queries, 1).first()
    assert hit.kind == "code" and hit.link == "https://example.org/x/blob/main/src/a.py#L1-L2"
    again = jobs.index_job(tables, tree, bodies, fake_embed(), "m", at(13)).where("repo_id = 1").first()
    assert again.n == 2 and tables.read("embedded").count() == 0


def test_tag_and_translate(spark, tables):
    assert jobs.tag_job(tables, fake_chat()).count() == 0
    assert all(r.ai_tags[1] == "tagged" for r in tables.read("stars").collect())
    counts = {r.outcome: r["count"] for r in jobs.translate_job(tables, fake_chat(), "de", at(12)).collect()}
    assert counts == {"translated": 4}
    got = {r.id: r for r in tables.read("stars").collect()}
    assert got[2].description_i18n == {"de": "zebra zoo"} and got[2].last_translated_at == dt.datetime(2024, 1, 12)
    assert {r.outcome for r in jobs.translate_job(tables, fake_chat(), "de", at(13)).collect()} == {"skipped"}


def pairs(tables, name="stars"):
    return {(r.user_id, r.id) for r in tables.read(name).select("user_id", "id").collect()}


def test_a_pull_of_some_users_leaves_the_others_alone(spark, tables):
    jobs.embed_job(tables, fake_embed(), "m", at(11))
    before = {r.user_id: r for r in tables.read("cursors").collect()}
    pull = frame(spark, star(1, 1, description="bees and buzz"))
    report = {r.user_id: r for r in jobs.sync_job(tables, pull, at(30)).collect()}  # a full pull is due for both users
    assert set(report) == {1} and (report[1].updated, report[1].deleted, report[1].known) == (1, 1, 1)
    assert pairs(tables) == {(1, 1), (2, 1), (2, 3)}
    assert {r.user_id: r for r in tables.read("cursors").collect()}[2] == before[2]
    assert {r.id for r in tables.read("vectors").collect()} == {"star:1", "star:3"}  # 1 and 3 are still kept by someone
    same = frame(spark, star(2, 1, description="bees and buzz"), star(2, 3, description="kayak"))
    assert [(r.user_id, r.deleted, r.updated, r.known) for r in jobs.sync_job(tables, same, at(30)).collect()] == [(2, 0, 0, 2)]


def test_an_empty_pull_needs_its_user_named(spark, tables):
    jobs.embed_job(tables, fake_embed(), "m", at(11))
    users = spark.createDataFrame([(1,), (7,)], "user_id long")
    none = frame(spark)
    report = {r.user_id: r for r in jobs.sync_job(tables, none, at(12), users=users).collect()}
    assert (report[1].deleted, report[1].known, report[7].known, report[7].summary) == (0, 2, 0, "Synced · 0 stars.")  # incremental: proves nothing
    assert len(pairs(tables)) == 4
    report = {r.user_id: r for r in jobs.sync_job(tables, none, at(30), users=users).collect()}
    assert (report[1].deleted, report[1].known) == (2, 0) and pairs(tables) == {(2, 1), (2, 3)}
    assert {r.id for r in tables.read("vectors").collect()} == {"star:1", "star:3"}
    again = frame(spark, star(1, 1, description="bees and buzz"), star(1, 2, description="zebra zoo"))  # as before the empty one
    assert jobs.sync_job(tables, again, at(31)).first().inserted == 2 and len(pairs(tables)) == 4
    assert jobs.sync_job(tables, none, at(31)).count() == 0  # nobody was pulled


def test_a_job_that_dies_leaves_all_tables_as_they_were(spark, tables, monkeypatch):
    jobs.embed_job(tables, fake_embed(), "m", at(11))
    names, version = ("stars", "cursors", "pulls", "vectors"), tables.version()
    rows = lambda: {x: sorted(map(repr, tables.read(x).collect())) for x in names}
    before = rows()
    done = source.Snapshots.save
    for dies_at in names:

        def save(self, table, *more, dies_at=dies_at):
            if table == dies_at:
                raise OSError("the disk is full")
            return done(self, table, *more)

        with monkeypatch.context() as m, pytest.raises(OSError):
            m.setattr(source.Snapshots, "save", save)
            jobs.sync_job(tables, frame(spark, star(1, 9)), at(30))
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(source.Snapshots, "_publish", lambda self, path, text: (_ for _ in ()).throw(OSError("killed before the rename")))
        jobs.sync_job(tables, frame(spark, star(1, 9)), at(30))
    assert rows() == before and tables.version() == version
    jobs.sync_job(tables, frame(spark, star(1, 9)), at(30))
    assert {(1, 9)} == {x for x in pairs(tables) if x[0] == 1} and tables.version() == version + 1
    assert tables.vacuum(keep=1) > 0 and {(1, 9)} == {x for x in pairs(tables) if x[0] == 1}


def test_two_writers(spark, tmp_path):
    one, other = (source.Snapshots(spark, str(tmp_path), {}) for _ in range(2))
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "id long")
    one.write("a", ids(1))
    runs = []

    def job(t):
        rows = t.read("a")
        runs.append(rows.count())
        if len(runs) == 1:
            other.write("b", ids(7))  # a table that the job does not use
        if len(runs) == 2:
            raise AssertionError("ran again though nothing that it used changed")
        t.write("a", rows.unionByName(ids(2)))

    one.commit(job)
    assert runs == [1] and {r.id for r in one.read("a").collect()} == {1, 2} and one.read("b").count() == 1
    runs.clear()

    def late(t):
        rows = t.read("a")
        runs.append(rows.count())
        if len(runs) == 1:
            other.write("a", ids(1, 2, 3))
        t.write("a", rows.unionByName(ids(9)))

    one.commit(late)
    assert runs == [2, 3] and {r.id for r in one.read("a").collect()} == {1, 2, 3, 9}  # no update is lost

    def always(t):
        t.write("a", t.read("a"))
        other.write("a", ids(5))

    with pytest.raises(Conflict):
        one.commit(always, tries=2)
    with pytest.raises(ValueError, match="no layout"):
        one.commit(lambda t: t.rewrite("a", ids(1), [0]))
    assert not one._publish(one._name(1), "{}") and one.manifest(1)["changed"] == ["a"]  # a manifest is never overwritten


def test_a_merge_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    tables = source.Snapshots(spark, str(tmp_path), {"stars": Layout(("user_id", "id"), 8, 2)})
    tables.write("stars", frame(spark, *(star(u, k) for u in range(6) for k in range(20))))
    files = lambda: tables.manifest(tables.version())["tables"]["stars"]["buckets"]
    before = files()

    def job(t):
        batch = frame(spark, star(3, 4, stargazers_count=50))
        touched = t.buckets("stars", batch.select("user_id", "id"))
        assert len(touched) == 1 and t.buckets("stars", batch.select("user_id"))[::2] in ([touched[0]], [touched[0] - 1])
        old = t.read("stars", touched)
        t.rewrite("stars", old.where("NOT (user_id = 3 AND id = 4)").unionByName(batch), touched)
        return touched

    touched = tables.commit(job)
    after = files()
    assert {k for k in before if before[k] != after[k]} == {str(k) for k in touched} and len(before) >= 8
    rows = {(r.user_id, r.id): r.stargazers_count for r in tables.read("stars").collect()}
    assert len(rows) == 120 and rows[3, 4] == 50 and tables.read("stars", 1).where("stargazers_count = 50").isEmpty()
    with pytest.raises(Exception, match="belongs to a bucket"):
        tables.commit(lambda t: t.rewrite("stars", frame(spark, star(3, 4), star(5, 5), star(0, 1)), touched))
    old = tables.read("stars").count()
    tables.commit(lambda t: t.rewrite("stars", t.read("stars", touched).limit(0).withColumn("extra", F.lit(1)), touched))  # a bucket may become empty, a column may come
    assert tables.read("stars").count() < old and tables.read("stars").where("extra IS NOT NULL").isEmpty()
