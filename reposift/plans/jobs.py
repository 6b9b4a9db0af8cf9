"""The pipelines end to end, over tables that change together.

Each job is one commit: it reads the newest tables, and what it writes becomes
visible at once. Model functions are the caller's (see operators.inference);
their results are written before anything else reads them, so no call is made twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift.operators import code_index, digest, embedding, inference, keys, search, sync, tagging, translate
from reposift.sources import stars as source
from reposift.sources.tables import Change


def sync_job(tables: source.Snapshots, incoming: DataFrame, now: Column, force: bool = False, users: DataFrame | None = None) -> DataFrame:
    """Merge a pull (validated star rows with user_id) into stars, vectors and cursors; returns the report per user.

    users are those who were pulled; one whose pull is empty must be named there.
    Without it, these are the users with a row. Nothing of other users changes:
    their stars, cursors and fingerprints stay, and a vector goes only when no
    user keeps its star any more. All tables change in one commit.
    """
    return tables.commit(lambda t: _sync(t, incoming, now, force, users))


def _sync(t: Change, incoming: DataFrame, now: Column, force: bool, users: DataFrame | None) -> DataFrame:
    empty = incoming.limit(0)
    pulled = incoming.select("user_id").distinct()
    pulled = t.stage(pulled if users is None else pulled.unionByName(users.select("user_id")).distinct())
    touched = {x: t.buckets(x, pulled) for x in ("stars", "cursors", "pulls")}
    # What the touched buckets hold of users who were not pulled goes back as it is.
    own, rest = {}, {}
    for name, buckets in touched.items():
        rows = t.read(name, buckets)
        own[name], rest[name] = (None, None) if rows is None else (rows.join(pulled, "user_id", "left_semi"), rows.join(pulled, "user_id", "left_anti"))
    existing = empty if own["stars"] is None else own["stars"]
    cursors = own["cursors"]
    if cursors is None:
        cursors = pulled.select("user_id", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("timestamp").alias("since"), F.lit(None).cast("timestamp").alias("last_full_sync_at"))
    # Written, so that its size is known: a few users are sent to the rows, not the rows dealt out by user.
    modes = t.stage(sync.sync_mode(pulled.join(cursors, "user_id", "left"), now, force))
    # Users whose pull is the same as their last one keep everything; only their cursor moves.
    prints = t.stage(sync.fingerprints(incoming))
    same = prints.limit(0) if own["pulls"] is None or force else prints.join(own["pulls"], ["user_id", "fingerprint", "n"], "left_semi")
    same = t.stage(same.select("user_id"))
    idle, idle_modes = existing.join(same, "user_id", "left_semi"), modes.join(same, "user_id", "left_semi")
    fresh, modes = incoming.join(same, "user_id", "left_anti"), modes.join(same, "user_id", "left_anti")
    full = modes.where("mode = 'full'").select("user_id")
    # A full pull is taken whole; an incremental one is cut at the user's mark.
    cut = fresh.join(full, "user_id", "left_semi").unionByName(sync.incremental_cut(fresh.join(full, "user_id", "left_anti"), modes))
    merged = sync.reconcile(existing.join(same, "user_id", "left_anti"), cut, modes)
    merged = t.stage(merged.unionByName(idle.withColumn("action", F.lit("keep")), allowMissingColumns=True))
    report = t.stage(sync.report(merged, pulled))
    beside = lambda rows, name: rows if rest[name] is None else rows.unionByName(rest[name], allowMissingColumns=True)
    t.rewrite("stars", beside(merged.where("action <> 'delete'").drop("action"), "stars"), touched["stars"])
    moved = sync.unchanged_cursors(idle_modes, now)
    done = sync.next_cursors(modes, cut, report.join(same, "user_id", "left_anti"), now)
    done = done.unionByName(moved.select(*(x for x in done.columns if x in moved.columns)), allowMissingColumns=True)
    t.rewrite("cursors", beside(done, "cursors"), touched["cursors"])
    t.rewrite("pulls", beside(prints, "pulls"), touched["pulls"])
    if t.read("vectors") is not None:
        gone = t.stage(sync.gone_for_all(merged.where("action = 'delete'"), t.read("stars")).select(F.col("id").alias("star_id")))
        buckets = t.buckets("vectors", gone)
        if buckets:
            t.rewrite("vectors", keys.drop(t.read("vectors", buckets), gone, "star_id"), buckets)
    return report


def _landed(t: Change, results: DataFrame, model: str, now: Column) -> DataFrame:
    """Write the results of inference, put the vectors that came into the vector table, and return the results."""
    t.write("embedded", results)
    results = t.read("embedded")
    rows = t.stage(embedding.vector_rows(results, model, now))
    if not rows.isEmpty():
        buckets = t.buckets("vectors", rows.select("star_id"))
        old = t.read("vectors", buckets)
        t.rewrite("vectors", rows if old is None else keys.drop(old, rows, "id").unionByName(rows, allowMissingColumns=True), buckets)
    elif t.read("vectors") is None:
        t.write("vectors", rows)
    return results


def embed_job(tables: source.Snapshots, embed: Callable[[list], list], model: str, now: Column, force: bool = False, **options) -> DataFrame:
    """Embed the stars whose text or model changed; returns one row per attempt."""

    def job(t: Change) -> DataFrame:
        stars, vectors = t.read("stars"), t.read("vectors")
        todo = embedding.star_inputs(stars) if vectors is None or force else embedding.star_worklist(stars, vectors, model)
        results = inference.infer(todo, embed, "input", "vector", "array<float>", **options)
        return _landed(t, results.withColumn("tokens", F.lit(0)), model, now)

    return tables.commit(job)


def index_job(tables: source.Snapshots, tree: DataFrame, bodies: DataFrame, embed: Callable[[list], list], model: str, now: Column, **options) -> DataFrame:
    """Chunk and embed the best files of each repository in tree (bodies: repo_id, path, content); returns what to patch into the stars."""

    def job(t: Change) -> DataFrame:
        chosen = code_index.top_files(code_index.filter_tree(tree)).select("repo_id", "path")
        files = bodies.join(chosen, ["repo_id", "path"], "left_semi").withColumn("language", code_index.language_of(F.col("path")))
        rows, vectors = code_index.chunk_rows(code_index.chunks(files)), t.read("vectors")
        todo = rows if vectors is None else embedding.worklist(rows, vectors, model)
        results = inference.infer(todo, embed, "input", "vector", "array<float>", halve=False, **options)
        _landed(t, results.withColumn("tokens", F.lit(0)), model, now)
        stored = t.read("vectors").where("kind = 'code'").select("id", "star_id").join(rows.select("id"), "id", "left_semi")
        return t.stage(code_index.mark_indexed(tree.select("repo_id").distinct(), stored.select(F.col("star_id").alias("repo_id")), now))

    return tables.commit(job)


def search_job(tables: source.Snapshots, queries: DataFrame, limit: int = search.DEFAULT_LIMIT) -> DataFrame:
    """The best hits of each query (query_id, query) with the columns of their star, and links to code."""
    vectors = tables.read("vectors")
    found = search.batch_search(queries, vectors, limit)
    hits = search.typed_hits(found.join(vectors.drop("vector", "norm"), "id"))
    stars = tables.read("stars").dropDuplicates(["id"]).select("id", "full_name", "html_url", "default_branch", "description")
    link = search.permalink(*(F.col(x) for x in ("html_url", "default_branch", "path", "start_line", "end_line")))
    return search.rehydrate(hits, stars).withColumn("link", F.when(F.col("kind") == "code", link).otherwise(F.col("html_url")))


def digest_job(tables: source.Snapshots, now: Column, chat: Callable[[list], list] | None = None, locale: str = "en", **options) -> DataFrame:
    """Each user's digest, with summaries where a chat function is given."""
    entries = digest.digest(tables.read("stars"), tables.read("vectors"), now, **options)
    if chat is None:
        return entries
    asked = entries.select("user_id", "id", F.lit(digest.summary_system_prompt(locale)).alias("system"), digest.summary_prompt(F.col("relevance")).alias("user"))
    version = tables.write("summaries", inference.chat(asked, chat, "system", "user"))
    return digest.attach_summaries(entries, tables.read("summaries", version))


def tag_job(tables: source.Snapshots, chat: Callable[[list], list], force: bool = False) -> DataFrame:
    """Tag the stars that have no tags; returns the replies that gave none."""

    def job(t: Change) -> DataFrame:
        stars = t.read("stars")
        asked = tagging.untagged(stars, force).select("user_id", "id", F.lit(tagging.SYSTEM_PROMPT).alias("system"), tagging.tag_prompt().alias("user"))
        patches, failed = tagging.tag_patches(t.stage(inference.chat(asked, chat, "system", "user")))
        buckets = t.buckets("stars", patches.select("user_id", "id"))
        if buckets:
            t.rewrite("stars", sync.patch(t.read("stars", buckets), patches), buckets)
        return failed

    return tables.commit(job)


def translate_job(tables: source.Snapshots, chat: Callable[[list], list], locale: str, now: Column) -> DataFrame:
    """Translate descriptions and tags into the locale, filling in without a call what is in its script already; returns counts by outcome."""

    def job(t: Change) -> DataFrame:
        planned = translate.backfill(translate.plan(t.read("stars"), locale), locale, now)
        planned = t.stage(translate.prompts(planned, locale))
        out, statuses = planned, planned.select("user_id", "id", "plan")
        for what, column, needs in (("description", "description_i18n", translate.description_needs(locale)), ("tags", "ai_tags_i18n", translate.tags_need(locale))):
            asked = planned.where((F.col("plan") == "translate") & needs).select("user_id", "id", f"{what}_system", f"{what}_user")
            replies = t.stage(inference.chat(asked, chat, f"{what}_system", f"{what}_user"))
            done = replies.select("user_id", "id", translate.parse_translation(F.col("reply")).alias("text"))
            out = sync.patch_locale(out, done, column, locale, now)
            status = done.select("user_id", "id", F.when(F.col("text").isNull(), "failed").otherwise("done").alias(f"{what}_status"))
            statuses = statuses.join(status, ["user_id", "id"], "left")
        extra = ("plan", "backfill_description", "backfill_tags", "description_system", "description_user", "tags_system", "tags_user")
        t.write("stars", out.drop(*extra))
        return statuses.groupBy(translate.outcome(F.col("description_status"), F.col("tags_status"), F.col("plan")).alias("outcome")).count()

    return tables.commit(job)
