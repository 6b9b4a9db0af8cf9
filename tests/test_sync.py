import datetime as dt

import pytest
from pyspark.sql import functions as F

from reposift import schemas
from reposift.operators import sync
from reposift.sources import stars as source
from reposift.sources.tables import Change, Layout

T0 = dt.datetime(2024, 1, 10)


def star(user, key, **more):
    row = {
        "user_id": user, "schema_version": 1, "id": key, "full_name": f"o/r{key}", "html_url": "https://example.org/x", "owner_login": "o", "topics": [], "starred_at": T0, "pushed_at": T0,
        "stargazers_count": 1, "default_branch": "main", "archived": False, "is_fork": False, "last_synced_at": T0, "ai_tags": [], "subscribed_to_releases": False, "deep_indexed": False,
        "description_i18n": {}, "ai_summary_i18n": {}, "ai_tags_i18n": {},
    }
    return row | more


def frame(spark, *rows):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("user_id", T.LongType()), *schemas.STAR.fields])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def modes(spark, *pairs):
    return spark.createDataFrame(list(pairs), "user_id long, mode string")


def test_same_second_stays_and_older_goes(spark):
    rows = frame(spark, star(1, 1), star(1, 2, starred_at=T0 - dt.timedelta(seconds=1)), star(1, 3, starred_at=T0 + dt.timedelta(seconds=1)), star(2, 4))
    cursors = spark.createDataFrame([(1, T0), (2, None)], "user_id long, since timestamp")
    assert {r.id for r in sync.incremental_cut(rows, cursors).collect()} == {1, 3, 4}
    assert {r.user_id: r.since for r in sync.high_water(rows, cursors).collect()} == {1: T0 + dt.timedelta(seconds=1), 2: T0}


def test_mode_bounds(spark):
    now = F.lit("2024-01-31").cast("timestamp")
    rows = [(1, None), (2, dt.datetime(2024, 1, 24)), (3, dt.datetime(2024, 1, 23, 23, 59, 59))]
    df = spark.createDataFrame(rows, "user_id long, last_full_sync_at timestamp")
    assert {r.user_id: r.mode for r in sync.sync_mode(df, now).collect()} == {1: "full", 2: "incremental", 3: "full"}
    assert {r.mode for r in sync.sync_mode(df, now, force=True).collect()} == {"full"}


def test_merge_keeps_local_columns_and_marks_stale(spark):
    old = frame(spark, star(1, 1, ai_tags=["a"], user_note="n", deep_indexed=True, last_deep_indexed_at=T0), star(1, 2, deep_indexed=True, last_deep_indexed_at=T0))
    new = frame(spark, star(1, 1, stargazers_count=9, pushed_at=T0 + dt.timedelta(days=1)), star(1, 2), star(1, 3))
    got = {r.id: r for r in sync.merge_local(new, old).collect()}
    assert (got[1].stargazers_count, got[1].ai_tags, got[1].user_note) == (9, ["a"], "n")
    assert (got[1].deep_indexed, got[1].last_deep_indexed_at) == (False, T0)
    assert got[2].deep_indexed and not got[3].deep_indexed


def test_reconcile_deletes_in_full_mode_only_and_is_idempotent(spark):
    old = frame(spark, star(1, 1), star(1, 2), star(2, 1), star(2, 2))
    new = frame(spark, star(1, 1), star(1, 3), star(2, 1))
    both = modes(spark, (1, "full"), (2, "incremental"))
    done = sync.reconcile(old, new, both)
    assert {(r.user_id, r.id): r.action for r in done.collect()} == {(1, 1): "update", (1, 2): "delete", (1, 3): "insert", (2, 1): "update", (2, 2): "keep"}
    kept = done.where("action <> 'delete'").drop("action")
    again = sync.reconcile(kept, new, both)
    assert {r.action for r in again.collect()} == {"update", "keep"}
    assert sorted(map(repr, again.drop("action").select(*kept.columns).collect())) == sorted(map(repr, kept.collect()))
    gone = sync.unstarred(old, new.limit(0), both)
    assert {(r.user_id, r.id) for r in gone.collect()} == {(1, 1), (1, 2)}


def test_one_user_is_a_slice_of_many(spark):
    old = frame(spark, star(1, 1), star(1, 2), star(2, 1), star(2, 7))
    new = frame(spark, star(1, 2), star(2, 1), star(2, 9))
    both = modes(spark, (1, "full"), (2, "full"))
    whole = sync.reconcile(old, new, both).where("user_id = 2").collect()
    alone = sync.reconcile(old.where("user_id = 2"), new.where("user_id = 2"), both).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, alone))


def test_upsert_repeated_key_last_wins(spark):
    old = frame(spark, star(1, 1))
    rows = frame(spark, star(1, 1, stargazers_count=2), star(1, 1, stargazers_count=3), star(1, 2, stargazers_count=4), star(1, 2, stargazers_count=5))
    batch = rows.withColumn("ord", F.col("stargazers_count"))
    assert {r.id: r.stargazers_count for r in sync.upsert(old, batch, "ord").collect()} == {1: 3, 2: 5}
    assert tuple(sync.upsert_counts(old, batch, "ord").first()) == (1, 3)
    assert tuple(sync.upsert_counts(old, batch.limit(0), "ord").first()) == (0, 0)


def test_report_text(spark):
    row = lambda a, b, c, d: spark.range(1).select(sync.summary(*(F.lit(x) for x in (a, b, c, d)))).first()[0]
    assert row(2, 0, 1, 9) == "2 new · 1 removed · 9 total."
    assert row(0, 0, 0, 9) == "Synced · 9 stars."
    assert spark.range(1).select(sync.summary(*(F.lit(0),) * 4, F.lit(True))).first()[0] == "Up to date · 0 stars."


def test_patches_ignore_vanished_keys_and_clean_notes(spark):
    old = frame(spark, star(1, 1, user_note="x", description_i18n={"de": "alt", "fr": "y"}), star(1, 2, user_note="y"))
    patches = spark.createDataFrame([(1, 1, None), (1, 9, "lost")], "user_id long, id long, user_note string")
    assert {r.id: r.user_note for r in sync.patch(old, patches).collect()} == {1: None, 2: "y"}
    texts = spark.createDataFrame([(1, 1, "neu")], "user_id long, id long, text string")
    got = {r.id: r for r in sync.patch_locale(old, texts, "description_i18n", "de", F.lit(str(T0)).cast("timestamp")).collect()}
    assert got[1].description_i18n == {"de": "neu", "fr": "y"} and got[1].last_translated_at == T0 and got[2].last_translated_at is None
    note = lambda x: spark.range(1).select(sync.clean_note(F.lit(x))).first()[0]
    assert note("  a ") == "a" and note(" 　") is None and len(note("x" * 3000)) == 2000


def test_prefix_and_cascade(spark):
    v = spark.createDataFrame([("star:1", 1), ("code:1:a:0", 1), ("star:2", 2)], "id string, star_id long")
    with pytest.raises(ValueError):
        sync.drop_prefix(v, "")
    assert {r.id for r in sync.drop_prefix(v, "code:1:").collect()} == {"star:1", "star:2"}
    assert {r.id for r in sync.cascade(v, frame(spark, star(5, 1))).collect()} == {"star:1", "code:1:a:0"}


def test_fingerprints_tell_changed_users(spark):
    old = frame(spark, star(1, 1), star(1, 2), star(2, 1))
    new = frame(spark, star(1, 2), star(1, 1), star(2, 1, stargazers_count=5))
    assert {r.user_id for r in sync.changed_only(new, sync.fingerprints(old)).collect()} == {2}


def test_validation_quarantines_or_fails(spark):
    rows = frame(spark, star(1, 1), star(1, -2), star(1, 3, full_name="x", html_url="nonsense"), star(1, 4, topics=None))
    good, bad = source.validate(rows, source.star_rules())
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.violations for r in bad.collect()} == {-2: ["id"], 3: ["full_name", "html_url"], 4: ["topics"]}
    with pytest.raises(Exception, match="invalid row: id"):
        source.validate(rows.where("id < 3"), source.star_rules(), failfast=True)[0].collect()


def test_snapshots_read_the_newest_complete_version(spark, tmp_path):
    tables = source.Snapshots(spark, str(tmp_path))
    assert tables.read("stars") is None
    tables.write("stars", frame(spark, star(1, 1)))
    tables.write("stars", tables.read("stars").unionByName(frame(spark, star(1, 2))))
    assert tables.read("stars").count() == 2 and tables.read("stars", 1).count() == 1


def test_stream_merges_once(spark, tmp_path):
    from reposift.streaming import stars as streaming

    inbox = tmp_path / "in"
    inbox.mkdir()
    line = '{"user_id": %d, "starred_at": "2024-01-10T00:00:00Z", "repo": {"id": %d, "full_name": "o/r%d", "html_url": "https://example.org/x", "owner": {"login": "o"}, "stargazers_count": %d}}\n'
    (inbox / "a.json").write_text(line % (1, 1, 1, 5) + line % (1, 2, 2, 5) + line % (1, 0, 0, 5))
    tables = source.Snapshots(spark, str(tmp_path / "tables"))
    fetched = lambda: F.lit(str(T0)).cast("timestamp")

    def pull():
        streaming.start(streaming.read(spark, str(inbox)), tables, str(tmp_path / "check"), fetched).awaitTermination()
        return {(r.user_id, r.id): r.stargazers_count for r in tables.read("stars").collect()}

    assert pull() == {(1, 1): 5, (1, 2): 5}
    assert [r.violations for r in tables.read("quarantine").collect()] == [["id"]]
    assert pull() == {(1, 1): 5, (1, 2): 5}
    (inbox / "b.json").write_text(line % (1, 2, 2, 8) + line % (2, 1, 1, 1))
    assert pull() == {(1, 1): 5, (1, 2): 8, (2, 1): 1}
    before = len(tables._versions("stars"))
    pull()
    assert len(tables._versions("stars")) == before


def test_a_stream_keeps_no_old_files_and_merges_some_buckets_at_a_time(spark, tmp_path, monkeypatch):
    from reposift.streaming import stars as streaming

    monkeypatch.setattr(streaming, "STEP", 1)  # a bucket in each step
    monkeypatch.setattr(streaming.keys, "FEW", 5)  # so that some steps look their keys up in a filter
    tables = source.Snapshots(spark, str(tmp_path / "tables"), {"stars": Layout(("user_id", "id"), 3, 2)})
    tables.write("stars", frame(spark, *(star(u, k, user_note=f"n{u}-{k}") for u in range(4) for k in range(1, 21))).withColumn("extra", F.lit(7)))
    inbox = tmp_path / "in"
    inbox.mkdir()
    line = '{"user_id": %s, "starred_at": "2024-01-10T00:00:00Z", "repo": {"id": %d, "full_name": "o/r%d", "html_url": "https://example.org/x", "owner": {"login": "o"}, "stargazers_count": %d}}\n'
    want = {(u, k): (star(u, k)["stargazers_count"], f"n{u}-{k}", 7) for u in range(4) for k in range(1, 21)}
    for n, (users, ids) in enumerate([(range(4), range(1, 30, 2)), ([1], [5]), ([0, 9], range(4, 24)), (["null"], [3])]):
        (inbox / f"{n}.json").write_text("".join(line % (u, k, k, 100 + n) for u in users for k in ids) + line % (1, 0, 0, 1))
        for u, k in ((None if u == "null" else u, k) for u in users for k in ids):
            want[u, k] = (100 + n, want.get((u, k), (0, None, 0))[1], None)
        put = []
        rewrite = Change.rewrite
        monkeypatch.setattr(Change, "rewrite", lambda self, table, rows, buckets, *more: put.append(buckets) or rewrite(self, table, rows, buckets, *more))
        streaming.start(streaming.read(spark, str(inbox)), tables, str(tmp_path / "check"), lambda: F.lit(str(T0)).cast("timestamp"), keep=1).awaitTermination()
        monkeypatch.setattr(Change, "rewrite", rewrite)
        assert {(r.user_id, r.id): (r.stargazers_count, r.user_note, r.extra) for r in tables.read("stars").collect()} == want
        assert tables.read("stars").count() == len(want) and tables.read("quarantine").count() == n + 1 == tables.read("batches").count()
        assert all(len(x) == 1 for x in put) and len({x[0] for x in put}) == len(put) >= 1 and (n or len(put) > 3)
        named = {x.split("/")[2] for own in tables.manifest(tables.version())["tables"]["stars"]["buckets"].values() for x in own}
        assert set(tables.names("data/stars")) == named and not tables.names("data/staged") and len(tables.commits()) == 1


def test_a_step_holds_as_many_buckets_as_fit(spark, tmp_path):
    tables = source.Snapshots(spark, str(tmp_path), {"stars": Layout(("user_id", "id"), 4)})
    rows = frame(spark, *(star(u, k) for u in range(12) for k in range(5)))

    def job(t):
        staged = t.stage_buckets("stars", rows)
        assert t.steps("stars", staged, 10**9) == [staged.buckets()] and t.steps("stars", staged, 1) == [[k] for k in staged.buckets()]
        held = sum(tables.bytes(x) for k in staged.buckets()[:2] for x in staged.entry["buckets"][str(k)])
        assert t.steps("stars", staged, held)[0] == staged.buckets()[:2]
        t.write("stars", rows)
        assert t.steps("stars", staged, held)[0] == staged.buckets()[:1]  # the table's own files count, too
        assert t.steps("stars", t.stage_buckets("stars", rows.limit(0)), 1) == []
        assert sorted(r.id for r in staged.read(staged.buckets()[:1]).collect()) == sorted(r.id for r in t.read("stars", staged.buckets()[:1]).collect())

    tables.commit(job)
