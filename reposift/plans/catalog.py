"""Registered queries over the derived tables, each with the same query in DuckDB SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.functions import text
from reposift.functions import vectors as V
from reposift.operators import code_index, digest, embedding, failures, inference, listing, profile_state, search, sync, tagging, text_index, translate, vector_index
from reposift.plans import fixtures as fx
from reposift.plans import jobs
from reposift.session import tidy, workspace
from reposift.sources import code as code_source
from reposift.sources import stars as star_source
from reposift.sources import tables as tables_source
from reposift.streaming import stars as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = fx.VIEWS + ("," if sql.lstrip().startswith("--with") else "") + sql.replace("--with", "", 1)
        return fn

    return add


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def n(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')".format


# Sources


@query(f"""--with raw AS (SELECT *, id % 40 <> 0 AND id % 41 <> 0 AND id % 43 <> 0 AS good FROM stars)
SELECT CASE WHEN id % 40 <> 0 THEN id END AS id, CASE WHEN id % 41 = 0 THEN 'x' ELSE full_name END AS full_name, owner_login, description,
  array_to_string(topics, ',') AS topics, language, {STAMP("starred_at")} AS starred_at, {STAMP("pushed_at")} AS pushed_at,
  CASE WHEN id % 43 = 0 THEN -1 ELSE stargazers_count END::BIGINT AS stargazers_count, 'main' AS default_branch, archived, is_fork, false AS deep_indexed, 0::BIGINT AS n_tags FROM raw""")
def s1_flatten(spark, sf_dir):
    rows = star_source.flatten(star_source.parse_envelopes(fx.envelopes(spark, sf_dir)), fx.now())
    return rows.select(
        "id", "full_name", "owner_login", "description", F.array_join("topics", ",").alias("topics"), "language", stamp("starred_at").alias("starred_at"),
        stamp("pushed_at").alias("pushed_at"), "stargazers_count", "default_branch", "archived", "is_fork", "deep_indexed", n(F.size("ai_tags")).alias("n_tags"),
    )


@query("""SELECT full_name, concat_ws(',', CASE WHEN id % 40 = 0 THEN 'id' END, CASE WHEN id % 41 = 0 THEN 'full_name' END, CASE WHEN id % 43 = 0 THEN 'stargazers_count' END) AS broken
FROM (SELECT id, CASE WHEN id % 41 = 0 THEN 'x' ELSE full_name END AS full_name FROM stars) WHERE id % 40 = 0 OR id % 41 = 0 OR id % 43 = 0""")
def s2_validate(spark, sf_dir):
    rows = star_source.flatten(star_source.parse_envelopes(fx.envelopes(spark, sf_dir)), fx.now())
    _, bad = star_source.validate(rows, star_source.star_rules())
    return bad.select("full_name", F.array_join("violations", ",").alias("broken"))


@query("""SELECT name, color, CASE WHEN length(name) BETWEEN 1 AND 64 AND regexp_matches(color, '^#[0-9a-fA-F]{6}$') THEN '' ELSE
  concat_ws(',', CASE WHEN NOT length(name) BETWEEN 1 AND 64 THEN 'name' END, CASE WHEN NOT regexp_matches(color, '^#[0-9a-fA-F]{6}$') THEN 'color' END) END AS broken
FROM (SELECT c_name AS name, '#' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE substr(md5(c_name), 1, 6) END AS color FROM customer)""")
def s3_tag_rules(spark, sf_dir):
    color = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.substring(F.md5("c_name"), 1, 6))
    tags = fx.load(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("#"), color).alias("color"))
    return tags.select("*", F.array_join(star_source.violations(star_source.tag_rules()), ",").alias("broken"))


@query("""SELECT user_id, known_count, CASE WHEN known_count < 0 AND user_id = 3 THEN 'known_count,updated_at' WHEN known_count < 0 THEN 'known_count' WHEN user_id = 3 THEN 'updated_at' ELSE '' END AS broken
FROM (SELECT user_id, CASE WHEN user_id % 2 = 1 THEN -known_count ELSE known_count END AS known_count FROM cursors)""")
def s3_cursor_rules(spark, sf_dir):
    odd, never = F.col("user_id") % 2 == 1, F.lit(None).cast("timestamp")
    rows = fx.cursors(spark, sf_dir).withColumns({"known_count": F.when(odd, -F.col("known_count")).otherwise(F.col("known_count")), "updated_at": F.when(F.col("user_id") == 3, never).otherwise(F.col("updated_at"))})
    return rows.select("user_id", "known_count", F.array_join(star_source.violations(star_source.cursor_rules()), ",").alias("broken"))


@query("""SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY pos) - 1 AS pos, path, type, size FROM tree""")
def s4_tree(spark, sf_dir):
    entries = fx.tree(spark, sf_dir)
    entry = F.struct("path", F.lit("100644").alias("mode"), "type", F.md5("path").alias("sha"), "size", F.lit(None).cast("string").alias("url"))
    listed = entries.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("found"))
    trees = listed.select("repo_id", F.transform("found", lambda x: x["e"]).alias("tree"))
    return code_source.explode_trees(trees).select("repo_id", n("pos").alias("pos"), "path", "type", "size")


@query("SELECT doc_id, text AS content, length(text) AS size FROM documents WHERE doc_id % 6 <> 0")
def s5_bodies(spark, sf_dir):
    d = fx.load(spark, sf_dir, "documents")
    wrapped = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{60})", "$1\n")
    kind = F.when(F.col("doc_id") % 6 == 0, "dir").otherwise("file")
    contents = d.select("doc_id", kind.alias("type"), F.lit("base64").alias("encoding"), wrapped.alias("content"))
    return code_source.file_bodies(contents).select("doc_id", "content", n(F.length("content")).alias("size"))


@query("SELECT doc_id, text || chr(10) AS content, strlen(text) + 1 AS bytes FROM documents WHERE strlen(text) < 20000 AND text <> ''")
def s6_source_tree(spark, sf_dir):
    # A tree with a folder for each 1,000 documents; the largest files are left out by the listing.
    files = code_source.read_folders(fx.source_folders(spark, sf_dir, workspace(spark)), "doc-*", largest=20000)
    return files.select(F.regexp_extract("path", r"^doc-(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "content", "bytes")


# Sync


@query("SELECT i.user_id, i.id FROM incoming i LEFT JOIN cursors c USING (user_id) WHERE c.since IS NULL OR i.starred_at >= c.since")
def y1_incremental(spark, sf_dir):
    return sync.incremental_cut(fx.incoming(spark, sf_dir), fx.cursors(spark, sf_dir)).select("user_id", "id")


@query(f"""SELECT user_id, {STAMP("greatest(any_value(since), max(starred_at))")} AS since FROM cursors FULL JOIN incoming USING (user_id) GROUP BY user_id""")
def y2_watermark(spark, sf_dir):
    return sync.high_water(fx.incoming(spark, sf_dir), fx.cursors(spark, sf_dir)).select("user_id", stamp("since").alias("since"))


@query("SELECT user_id, mode FROM modes")
def y3_mode(spark, sf_dir):
    return sync.sync_mode(fx.cursors(spark, sf_dir), fx.now()).select("user_id", "mode")


@query("SELECT user_id, count(*) AS n FROM existing WHERE user_id % 2 = 0 GROUP BY user_id")
def y4_changed(spark, sf_dir):
    old = fx.existing(spark, sf_dir)
    touched = old.withColumn("stargazers_count", F.col("stargazers_count") + F.when(F.col("user_id") % 2 == 0, 1).otherwise(0))
    return sync.changed_only(touched, sync.fingerprints(old)).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""SELECT user_id, '2024-01-31 00:00:00' AS updated_at, {STAMP("CASE WHEN mode = 'full' THEN TIMESTAMP '2024-01-31' ELSE last_full_sync_at END")} AS last_full_sync_at FROM modes""")
def y4_unchanged_cursors(spark, sf_dir):
    done = sync.unchanged_cursors(sync.sync_mode(fx.cursors(spark, sf_dir), fx.now()), fx.now())
    return done.select("user_id", stamp("updated_at").alias("updated_at"), stamp("last_full_sync_at").alias("last_full_sync_at"))


@query("""SELECT i.user_id, i.id, i.stargazers_count, array_to_string(coalesce(e.ai_tags, i.ai_tags), '|') AS ai_tags, coalesce(e.user_note, i.user_note) AS user_note,
  coalesce(e.desc_zh, i.desc_zh) AS description_zh FROM incoming i LEFT JOIN existing e ON e.user_id = i.user_id AND e.id = i.id""")
def y5_merge_local(spark, sf_dir):
    merged = sync.merge_local(fx.incoming(spark, sf_dir), fx.existing(spark, sf_dir))
    return merged.select("user_id", "id", "stargazers_count", F.array_join("ai_tags", "|").alias("ai_tags"), "user_note", F.try_element_at("description_i18n", F.lit("zh-CN")).alias("description_zh"))


@query(f"""SELECT id, deep_indexed AND NOT coalesce(pushed_at > last_deep_indexed_at, false) AS deep_indexed, {STAMP("last_deep_indexed_at")} AS last_deep_indexed_at FROM stars""")
def y6_stale_index(spark, sf_dir):
    return sync.mark_stale(fx.stars(spark, sf_dir)).select("id", "deep_indexed", stamp("last_deep_indexed_at").alias("last_deep_indexed_at"))


BATCHED = """--with batch AS (SELECT *, 0 AS ord FROM incoming UNION ALL SELECT * REPLACE (stargazers_count + 5 AS stargazers_count), 1 AS ord FROM incoming WHERE id % 3 = 0),
last AS (SELECT user_id, id, arg_max(stargazers_count, ord) AS stargazers_count, count(*) AS repeats FROM batch GROUP BY user_id, id),
known AS (SELECT l.*, e.id IS NULL AS is_new FROM last l LEFT JOIN existing e ON e.user_id = l.user_id AND e.id = l.id)
"""


def _batch(spark, sf_dir):
    rows = fx.incoming(spark, sf_dir)
    again = rows.where("id % 3 = 0").withColumn("stargazers_count", F.col("stargazers_count") + 5)
    return rows.withColumn("ord", F.lit(0)).unionByName(again.withColumn("ord", F.lit(1)))


@query(BATCHED + "SELECT user_id, id, stargazers_count FROM last UNION ALL SELECT e.user_id, e.id, e.stargazers_count FROM existing e ANTI JOIN last l ON e.user_id = l.user_id AND e.id = l.id")
def y7_upsert(spark, sf_dir):
    return sync.upsert(fx.existing(spark, sf_dir), _batch(spark, sf_dir), "ord").select("user_id", "id", "stargazers_count")


@query(BATCHED + "SELECT count(*) FILTER (WHERE is_new) AS inserted, sum(repeats - CASE WHEN is_new THEN 1 ELSE 0 END)::BIGINT AS updated FROM known")
def y7_upsert_counts(spark, sf_dir):
    return sync.upsert_counts(fx.existing(spark, sf_dir), _batch(spark, sf_dir), "ord").select(n("inserted").alias("inserted"), n("updated").alias("updated"))


@query("SELECT e.user_id, e.id FROM existing e JOIN modes m USING (user_id) ANTI JOIN incoming i ON i.user_id = e.user_id AND i.id = e.id WHERE m.mode = 'full'")
def y8_unstarred(spark, sf_dir):
    modes = sync.sync_mode(fx.cursors(spark, sf_dir), fx.now())
    return sync.unstarred(fx.existing(spark, sf_dir), fx.incoming(spark, sf_dir), modes).select("user_id", "id")


@query("SELECT v.id, v.star_id FROM vectors v SEMI JOIN existing e ON e.id = v.star_id")
def y9_cascade(spark, sf_dir):
    return sync.cascade(fx.vectors(spark, sf_dir), fx.existing(spark, sf_dir)).select("id", "star_id")


@query("SELECT id FROM vectors WHERE NOT starts_with(id, 'code:')")
def y9_drop_prefix(spark, sf_dir):
    return sync.drop_prefix(fx.vectors(spark, sf_dir), "code:").select("id")


@query("SELECT count(*) AS deleted FROM existing e SEMI JOIN incoming i ON i.user_id = e.user_id AND i.id = e.id WHERE e.id % 4 = 0")
def y10_delete_keys(spark, sf_dir):
    gone = fx.incoming(spark, sf_dir).where("id % 4 = 0").select("user_id", "id")
    return sync.delete_keys(fx.existing(spark, sf_dir), gone)[1]


@query("""SELECT user_id, id, CASE WHEN id % 3 = 0 THEN nullif(substr(trim('  ' || CASE WHEN id % 2 = 0 THEN '' ELSE description END, ' '), 1, 2000), '') ELSE user_note END AS user_note
FROM existing""")
def y11_patch(spark, sf_dir):
    rows = fx.existing(spark, sf_dir)
    note = F.concat(F.lit("  "), F.when(F.col("id") % 2 == 0, "").otherwise(F.col("description")))
    gone = rows.select("user_id", (F.col("id") + 5_000_000).alias("id"), F.lit("lost").alias("user_note"))
    patches = rows.where("id % 3 = 0").select("user_id", "id", sync.clean_note(note).alias("user_note")).unionByName(gone)
    return sync.patch(rows, patches).select("user_id", "id", "user_note")


@query(f"""SELECT user_id, id, CASE WHEN id % 2 = 0 THEN 'new ' || id ELSE desc_zh END AS description_zh, CASE WHEN id % 2 = 0 THEN '2024-01-31 00:00:00' END AS last_translated_at FROM existing""")
def y12_patch_map(spark, sf_dir):
    rows = fx.existing(spark, sf_dir)
    patches = rows.where("id % 2 = 0").select("user_id", "id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("text"))
    done = sync.patch_locale(rows, patches, "description_i18n", "zh-CN", fx.now())
    return done.select("user_id", "id", F.try_element_at("description_i18n", F.lit("zh-CN")).alias("description_zh"), stamp("last_translated_at").alias("last_translated_at"))


@query("SELECT id, model FROM vectors WHERE model = 'm1'")
def y13_model_reset(spark, sf_dir):
    return sync.reset_model(fx.stars(spark, sf_dir), fx.vectors(spark, sf_dir), "m1")[1].select("id", "model")


@query("SELECT id, false AS deep_indexed, array_to_string(ai_tags, '|') AS ai_tags, user_note FROM stars")
def y13_stars_reset(spark, sf_dir):
    cleared, _ = sync.reset_model(fx.stars(spark, sf_dir), fx.vectors(spark, sf_dir), "m1")
    return cleared.select("id", "deep_indexed", F.array_join("ai_tags", "|").alias("ai_tags"), "user_note")


ACTIONS = """--with acted AS (SELECT k.user_id, k.id, CASE WHEN e.id IS NOT NULL AND i.id IS NOT NULL THEN 'update' WHEN i.id IS NOT NULL THEN 'insert'
    WHEN coalesce(m.mode, 'full') = 'full' THEN 'delete' ELSE 'keep' END AS action
  FROM (SELECT user_id, id FROM existing UNION SELECT user_id, id FROM incoming) k
  LEFT JOIN existing e ON e.user_id = k.user_id AND e.id = k.id LEFT JOIN incoming i ON i.user_id = k.user_id AND i.id = k.id LEFT JOIN modes m ON m.user_id = k.user_id),
counts AS (SELECT user_id, count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action = 'update') AS updated, count(*) FILTER (WHERE action = 'delete') AS deleted,
  count(*) FILTER (WHERE action <> 'delete') AS known FROM acted GROUP BY user_id)
"""


def _reconciled(spark, sf_dir):
    modes = sync.sync_mode(fx.cursors(spark, sf_dir), fx.now())
    return sync.reconcile(fx.existing(spark, sf_dir), fx.incoming(spark, sf_dir), modes)


@query(ACTIONS + "SELECT user_id, id, action FROM acted")
def y14_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir).select("user_id", "id", "action")


@query(ACTIONS + """SELECT *, CASE WHEN inserted + updated + deleted = 0 THEN 'Synced · ' || known || ' stars.' ELSE concat_ws(' · ', CASE WHEN inserted > 0 THEN inserted || ' new' END,
  CASE WHEN updated > 0 THEN updated || ' updated' END, CASE WHEN deleted > 0 THEN deleted || ' removed' END) || ' · ' || known || ' total.' END AS summary FROM counts""")
def y14_sync_report(spark, sf_dir):
    return sync.report(_reconciled(spark, sf_dir)).select("user_id", *(n(x).alias(x) for x in ("inserted", "updated", "deleted", "known")), "summary")


@query(ACTIONS + f"""SELECT c.user_id, {STAMP("greatest(c.since, i.newest)")} AS since, k.known AS known_count, {STAMP("CASE WHEN m.mode = 'full' THEN TIMESTAMP '2024-01-31' ELSE m.last_full_sync_at END")} AS last_full_sync_at
FROM cursors c JOIN (SELECT user_id, max(starred_at) AS newest FROM incoming GROUP BY user_id) i USING (user_id) JOIN counts k USING (user_id) JOIN modes m USING (user_id)""")
def y15_cursor(spark, sf_dir):
    modes = sync.sync_mode(fx.cursors(spark, sf_dir), fx.now())
    done = sync.next_cursors(modes, fx.incoming(spark, sf_dir), sync.report(_reconciled(spark, sf_dir)), fx.now())
    return done.select("user_id", stamp("since").alias("since"), n("known_count").alias("known_count"), stamp("last_full_sync_at").alias("last_full_sync_at"))


# Listing


@query(f"SELECT id, {STAMP('pushed_at')} AS pushed_at FROM stars ORDER BY pushed_at ASC NULLS FIRST, id LIMIT 60 OFFSET 20")
def f1_list(spark, sf_dir):
    return listing.list_stars(fx.stars(spark, sf_dir), "pushed_at", descending=False, offset=20, limit=60).select("id", stamp("pushed_at").alias("pushed_at"))


@query("SELECT user_id, id, position FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY starred_at DESC NULLS LAST, id DESC) AS position FROM user_stars) WHERE position > 2 AND position <= 12")
def f1_list_by_user(spark, sf_dir):
    return listing.list_by_user(fx.user_stars(spark, sf_dir), offset=2, limit=10).select("user_id", "id", n("position").alias("position"))


@query("SELECT user_id, id, position FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY pushed_at, id) AS position FROM user_stars WHERE pushed_at IS NOT NULL)")
def f1b_list_nonnull(spark, sf_dir):
    return listing.list_by_user(fx.user_stars(spark, sf_dir), "pushed_at", descending=False, drop_null_keys=True).select("user_id", "id", n("position").alias("position"))


@query("SELECT id FROM stars WHERE NOT archived AND NOT is_fork AND coalesce(language, '(none)') = 'de'")
def f2_filter(spark, sf_dir):
    return listing.manage_filter(fx.stars(spark, sf_dir), only_language="de").select("id")


HAYSTACK = "lower(full_name || ' ' || coalesce(description, '') || ' ' || coalesce(desc_zh, '') || ' ' || array_to_string(ai_tags, ' ') || ' ' || coalesce(tags_zh, ''))"


@query(f"SELECT id, contains({HAYSTACK}, 'token = ') AS had FROM stars WHERE contains(CASE WHEN id % 10 = 0 THEN 'my token = ' || full_name ELSE {HAYSTACK} END, 'token = ')")
def f3_indexed_search(spark, sf_dir):
    # An index over all stars, brought up to date after a tenth of them changed; had: what the search found before.
    tables = tables_source.Snapshots(spark, workspace(spark), text_index.layouts(4))
    rows = fx.stars(spark, sf_dir).select("id", "full_name", listing.haystack("zh-CN").alias("text"))
    text_index.refresh(tables, rows)
    had = text_index.find(tables, "token = ").hits.select(F.col("key").alias("id"), F.lit(True).alias("__had"))
    new = F.concat(F.lit("my token = "), F.col("full_name"))
    text_index.refresh(tables, rows.withColumn("text", F.when(F.col("id") % 10 == 0, new).otherwise(F.col("text"))))
    found = text_index.find(tables, "token = ").hits.select(F.col("key").alias("id"))
    return found.join(had, "id", "left").select("id", F.coalesce("__had", F.lit(False)).alias("had"))


@query("""SELECT id FROM stars WHERE contains(lower(full_name || ' ' || coalesce(description, '') || ' ' || coalesce(desc_zh, '') || ' ' || array_to_string(ai_tags, ' ') || ' ' || coalesce(tags_zh, '')), 'the er')""")
def f3_text_search(spark, sf_dir):
    return listing.text_search(fx.stars(spark, sf_dir), " The ER  ", "zh-CN").select("id")


@query("SELECT id FROM stars WHERE list_contains(list_transform(ai_tags, lambda x: lower(trim(x, E' \\n\\t'))), 'the')")
def f4_tag_filter(spark, sf_dir):
    return listing.tag_filter(fx.stars(spark, sf_dir), [" THE "]).select("id")


@query("""SELECT id, coalesce(nullif(desc_zh, ''), description) AS description, CASE WHEN coalesce(tags_zh, '') <> '' THEN
  array_to_string(list_filter(list_transform(string_split_regex(tags_zh, '[,\\n]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|') ELSE array_to_string(ai_tags, '|') END AS tags FROM stars""")
def f5_localized(spark, sf_dir):
    return fx.stars(spark, sf_dir).select("id", listing.display_text("zh-CN").alias("description"), F.array_join(listing.display_tags("zh-CN"), "|").alias("tags"))


@query("""SELECT user_id, id, position FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY stargazers_count DESC, id) AS position FROM user_stars
WHERE NOT deep_indexed AND NOT archived AND NOT is_fork) WHERE position <= 3""")
def f6_candidates(spark, sf_dir):
    return listing.deep_candidates(fx.user_stars(spark, sf_dir)).select("user_id", "id", n("position").alias("position"))


@query("SELECT id, string_split(full_name, '/')[1] AS owner, string_split(full_name, '/')[2] AS repo FROM stars")
def f7_split_name(spark, sf_dir):
    return listing.split_name(fx.stars(spark, sf_dir))[0].select("id", "owner", "repo")


@query("""SELECT coalesce(language, '(none)') AS language, count(*) AS n FROM stars GROUP BY 1""")
def g1_lang_facets(spark, sf_dir):
    return listing.language_facets(fx.stars(spark, sf_dir))


@query("""--with tags AS (SELECT id, starred_at, i AS pos, trim(ai_tags[i], E' \\n\\t\\r') AS tag FROM stars, unnest(range(1, len(ai_tags) + 1)) AS r(i)),
ranked AS (SELECT lower(tag) AS key, count(*) AS n, arg_min(tag, (-epoch_us(starred_at), id, pos)) AS tag FROM tags WHERE tag <> '' GROUP BY 1 ORDER BY n DESC, key LIMIT 40)
SELECT tag, n FROM ranked""")
def g2_tag_facets(spark, sf_dir):
    return listing.tag_facets(fx.stars(spark, sf_dir))


PROFILE = """--with kept AS (SELECT u.user_id, v.star_id, v.vector FROM user_stars u JOIN star_vectors v ON v.star_id = u.id),
parts AS (SELECT user_id, i, avg(vector[i]) AS x FROM kept, unnest(range(1, len(vector) + 1)) AS r(i) GROUP BY user_id, i),
profile AS (SELECT user_id, list(x ORDER BY i) AS profile FROM parts GROUP BY user_id)
"""


@query(PROFILE + "SELECT user_id, i AS place, round(x, 6) AS mean FROM parts")
def g3_profile(spark, sf_dir):
    found = digest.profiles(fx.user_stars(spark, sf_dir), fx.star_vectors(spark, sf_dir))
    return found.select("user_id", F.posexplode("profile").alias("place", "mean")).select("user_id", (n("place") + 1).alias("place"), F.round("mean", 6).alias("mean"))


@query("""--with need AS (SELECT *, (coalesce(trim(description), '') <> '' AND coalesce(desc_zh, '') = '' AND NOT regexp_matches(description, '[一-鿿]'))
  OR (len(ai_tags) > 0 AND coalesce(tags_zh, '') = '' AND NOT regexp_matches(array_to_string(ai_tags, ' '), '[一-鿿]')) AS needs FROM user_stars)
SELECT user_id, count(*) AS known, count(*) FILTER (WHERE len(ai_tags) = 0) AS untagged, count(*) FILTER (WHERE deep_indexed) AS deep_indexed,
  count(*) FILTER (WHERE needs) AS untranslated, count(v.star_id) AS indexed FROM need LEFT JOIN star_vectors v ON v.star_id = need.id GROUP BY user_id""")
def g4_status(spark, sf_dir):
    # What a star needs does not depend on who keeps it: found once a star, before the join.
    stars = fx.stars(spark, sf_dir).select("id", "ai_tags", "deep_indexed", translate.star_needs("zh-CN").alias("needs"))
    counts = listing.status_counts(fx.user_pairs(spark, sf_dir).join(stars, "id"), fx.vectors(spark, sf_dir), F.col("needs"))
    return counts.select("user_id", *(n(x).alias(x) for x in ("known", "untagged", "deep_indexed", "untranslated", "indexed")))


@query("""SELECT known, indexed, all_rows, floor(indexed * 100 / known + 0.5)::BIGINT AS percent, floor(all_rows * 100 / known + 0.5)::BIGINT AS percent_all_rows, indexed < known AS needs_rebuild
FROM (SELECT (SELECT count(*) FROM stars) AS known, (SELECT count(*) FROM star_vectors) AS indexed, (SELECT count(*) FROM vectors) AS all_rows)""")
def g5_coverage(spark, sf_dir):
    return listing.coverage(fx.stars(spark, sf_dir), fx.vectors(spark, sf_dir))


@query("SELECT kind, count(*) AS n FROM vectors GROUP BY kind UNION ALL SELECT 'all', count(*) FROM vectors")
def g6_kind_counts(spark, sf_dir):
    return listing.kind_counts(fx.vectors(spark, sf_dir))


KIND = """CASE WHEN http_status < 400 THEN NULL WHEN http_status IN (401, 403) THEN 'auth' WHEN http_status = 429 THEN 'rate_limit' WHEN http_status IN (408, 504) THEN 'timeout'
  WHEN http_status IN (400, 404, 413, 422) THEN 'bad_request' WHEN http_status >= 500 THEN 'server' ELSE 'unknown' END"""


@query("""SELECT star_id, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, sum(tokens)::BIGINT AS tokens,
  array_to_string((list(id ORDER BY id) FILTER (WHERE status = 'failed'))[1:100], ',') AS failed_ids
FROM (SELECT ord AS id, star_id, CASE WHEN http_status < 400 THEN 'done' ELSE 'failed' END AS status, http_status AS tokens FROM call_log) GROUP BY star_id""")
def g7_run_report(spark, sf_dir):
    log = fx.call_log(spark, sf_dir)
    results = log.select(F.col("ord").alias("id"), "star_id", F.when(F.col("http_status") < 400, "done").otherwise("failed").alias("status"), F.col("http_status").alias("tokens"))
    lost = failures.failed_rows(results, ["star_id"]).groupBy("star_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("failed_ids"))
    report = failures.run_report(results, ["star_id"]).join(lost, "star_id", "left")
    return report.select("star_id", n("done").alias("done"), n("failed").alias("failed"), n("tokens").alias("tokens"), F.coalesce("failed_ids", F.lit("")).alias("failed_ids"))


@query(f"""--with bad AS (SELECT star_id, ord, CASE WHEN http_status = 400 THEN NULL ELSE {KIND} END AS kind, 'status ' || http_status AS message, http_status = 413 AS weak FROM call_log WHERE http_status >= 400),
tiered AS (SELECT *, CASE WHEN weak THEN 0 WHEN kind IS NULL THEN 1 ELSE 2 END AS tier, CASE WHEN weak THEN NULL ELSE kind END AS typed FROM bad),
placed AS (SELECT *, row_number() OVER (PARTITION BY star_id ORDER BY tier DESC, CASE WHEN tier = 0 THEN -ord ELSE ord END DESC) AS place FROM tiered)
SELECT star_id, typed AS kind, message FROM placed WHERE place = 1""")
def g8_strongest_error(spark, sf_dir):
    log = fx.call_log(spark, sf_dir).where("http_status >= 400")
    status = F.col("http_status")
    kind = F.when(~status.isin(400, 413), failures.model_outcome(status))
    typed = log.select("star_id", "ord", kind.alias("kind"), F.concat(F.lit("status "), status.cast("string")).alias("message"), (status == 413).alias("weak"))
    return failures.strongest(typed, "star_id")


@query("SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY pushed_at DESC NULLS LAST, id) AS place FROM user_stars")
def w3_manage_sort(spark, sf_dir):
    return listing.places(fx.user_stars(spark, sf_dir).select("user_id", "id", "pushed_at"), listing.manage_order("pushed_at")).select("user_id", "id", "place")


@query("SELECT id, row_number() OVER (ORDER BY stargazers_count, id) AS place FROM stars")
def w3_sort_of_all(spark, sf_dir):
    return listing.places(fx.stars(spark, sf_dir).select("id", "stargazers_count"), listing.manage_order("stargazers_count", descending=False), by=()).select("id", "place")


@query(PROFILE + """, near AS (SELECT s.user_id, s.id, CASE WHEN v.star_id IS NULL THEN '-infinity'::DOUBLE ELSE list_cosine_similarity(p.profile, v.vector) END AS rel
  FROM user_stars s LEFT JOIN star_vectors v ON v.star_id = s.id JOIN profile p USING (user_id))
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY rel, id) AS place FROM near""")
def w3_relevance_sort(spark, sf_dir):
    kept = fx.user_stars(spark, sf_dir).select("user_id", "id")
    vectors = fx.star_vectors(spark, sf_dir).select(F.col("star_id").alias("id"), "vector")
    scored = kept.join(vectors, "id", "left").join(digest.profiles(kept, fx.star_vectors(spark, sf_dir)), "user_id")
    relevance = F.when(F.col("vector").isNotNull(), V.cosine(F.col("profile"), F.col("vector")))
    return listing.places(scored.select("user_id", "id", relevance.alias("relevance")), listing.manage_order("relevance", descending=False)).select("user_id", "id", "place")


@query("SELECT id, kind, star_id, path FROM vectors")
def u1_union(spark, sf_dir):
    return search.corpus(fx.star_vectors(spark, sf_dir), fx.code_vectors(spark, sf_dir)).select("id", "kind", "star_id", "path")


@query("SELECT id FROM existing EXCEPT SELECT id FROM incoming")
def u2_difference(spark, sf_dir):
    return fx.existing(spark, sf_dir).select("id").join(fx.incoming(spark, sf_dir).select("id"), "id", "left_anti")


@query("""--with lost AS (SELECT ord, star_id AS id FROM call_log WHERE http_status = 401), first AS (SELECT * FROM lost ORDER BY ord, id LIMIT 3)
SELECT (SELECT string_agg(full_name, ', ' ORDER BY ord) FROM first JOIN stars USING (id)) || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || '…' ELSE '' END AS failed FROM lost""")
def j6_failed_names(spark, sf_dir):
    lost = fx.call_log(spark, sf_dir).where("http_status = 401").select("ord", F.col("star_id").alias("id"))
    return listing.failed_names(lost, fx.stars(spark, sf_dir))


@query("""--with bundles AS (SELECT DISTINCT lang AS locale, unnest(words) AS key FROM base)
SELECT l.locale, k.key FROM (SELECT DISTINCT key FROM bundles WHERE locale = 'en') k, (SELECT DISTINCT locale FROM bundles WHERE locale <> 'en') l
WHERE NOT EXISTS (SELECT 1 FROM bundles b WHERE b.locale = l.locale AND b.key = k.key)""")
def j7_missing_keys(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents")
    return listing.missing_keys(docs.select(F.col("lang").alias("locale"), F.explode(fx.words()).alias("key")).distinct())


# Search

HITS = """--with q AS (SELECT embedding::DOUBLE[] AS query FROM embeddings WHERE vec_id = 0),
scored AS (SELECT v.*, list_cosine_similarity(v.vector, q.query) AS score FROM vectors v, q)
"""


@query(HITS + "SELECT id, round(score, 6) AS score FROM scored")
def v1_cosine(spark, sf_dir):
    return search.score(fx.vectors(spark, sf_dir), fx.first_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query("SELECT id, round(sqrt(list_dot_product(vector, vector)), 6) AS norm FROM vectors")
def v2_norm(spark, sf_dir):
    return search.with_norm(fx.vectors(spark, sf_dir)).select("id", F.round("norm", 6).alias("norm"))


NEAREST = HITS + "SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 10"


@query(NEAREST)
def v3_search(spark, sf_dir):
    return search.search(fx.vectors(spark, sf_dir), fx.first_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(HITS + "SELECT id, round(score, 6) AS score FROM scored WHERE kind = 'code' AND scored.score >= 0.05 ORDER BY scored.score DESC, id LIMIT 20")
def v4_filtered_search(spark, sf_dir):
    found = search.search(fx.vectors(spark, sf_dir), fx.first_vector(spark, sf_dir), 20, F.col("kind") == "code", 0.05)
    return found.select("id", F.round("score", 6).alias("score"))


NEAREST_OF_EACH = """--with ranked AS (SELECT vec_id AS query_id, v.id, list_cosine_similarity(v.vector, e.embedding::DOUBLE[]) AS score FROM vectors v, embeddings e WHERE vec_id % 50 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ranked)
SELECT query_id, id, round(score, 6) AS score, rank FROM placed WHERE rank <= 10"""


@query(NEAREST_OF_EACH)
def v5_batch_search(spark, sf_dir):
    found = search.batch_search(fx.query_vectors(spark, sf_dir), fx.vectors(spark, sf_dir))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), n("rank").alias("rank"))


@query(NEAREST)
def v3_indexed_search(spark, sf_dir):
    # The same hits from an index over the vectors, whose files are read only where a hit can be.
    index = vector_index.build(fx.vectors(spark, sf_dir), workspace(spark))
    asked = fx.load(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.search(spark, index, asked).hits.select("id", F.round("score", 6).alias("score"))


@query(NEAREST_OF_EACH)
def v5_indexed_search(spark, sf_dir):
    index = vector_index.build(fx.vectors(spark, sf_dir), workspace(spark))
    found = vector_index.search(spark, index, fx.query_vectors(spark, sf_dir)).hits
    return found.select("query_id", "id", F.round("score", 6).alias("score"), n("rank").alias("rank"))


@query("SELECT id, kind FROM vectors WHERE kind = 'star' OR path IS NOT NULL")
def v6_typed_hits(spark, sf_dir):
    return search.typed_hits(fx.vectors(spark, sf_dir)).select("id", "kind")


@query("SELECT v.id, html_url || '/blob/main/' || path || '#L' || start_line || '-L' || end_line AS link FROM code_vectors v JOIN stars s ON s.id = v.star_id WHERE path IS NOT NULL")
def v7_permalink(spark, sf_dir):
    hits = search.rehydrate(search.typed_hits(fx.code_vectors(spark, sf_dir)), fx.stars(spark, sf_dir))
    return hits.select("id", search.permalink(*(F.col(x) for x in ("html_url", "default_branch", "path", "start_line", "end_line"))).alias("link"))


@query(HITS + ", top AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 50) SELECT t.id, s.full_name, round(t.score, 6) AS score FROM top t JOIN stars s ON s.id = t.star_id")
def j1_rehydrate(spark, sf_dir):
    hits = search.search(fx.vectors(spark, sf_dir), fx.first_vector(spark, sf_dir), 50)
    return search.rehydrate(hits, fx.stars(spark, sf_dir)).select("id", "full_name", F.round("score", 6).alias("score"))


@query("SELECT id FROM vectors WHERE star_id NOT IN (SELECT id FROM existing)")
def j4_orphans(spark, sf_dir):
    return search.orphans(fx.vectors(spark, sf_dir), fx.existing(spark, sf_dir).select("id").distinct()).select("id")


# Digest

CANDIDATE = "NOT archived AND NOT is_fork AND pushed_at > TIMESTAMP '2024-01-24'"
RECENCY = "CASE WHEN pushed_at >= TIMESTAMP '2024-01-31' THEN 1.0 WHEN pushed_at <= TIMESTAMP '2024-01-24' THEN 0.0 ELSE 1.0 - epoch(TIMESTAMP '2024-01-31' - pushed_at) / 604800.0 END"


@query(f"SELECT id, {STAMP('pushed_at')} AS pushed_at FROM stars WHERE {CANDIDATE}")
def d2_candidates(spark, sf_dir):
    return fx.stars(spark, sf_dir).where(digest.is_candidate(fx.now())).select("id", stamp("pushed_at").alias("pushed_at"))


@query(f"SELECT id, round({RECENCY}, 6)::DOUBLE AS recency FROM stars WHERE pushed_at IS NOT NULL")
def d3_recency(spark, sf_dir):
    return fx.stars(spark, sf_dir).where("pushed_at IS NOT NULL").select("id", F.round(digest.recency(F.col("pushed_at"), fx.now()), 6).alias("recency"))


DIGEST = (PROFILE + f""", near AS (SELECT u.user_id, u.id, pushed_at, list_cosine_similarity(p.profile, v.vector) AS relevance, ({RECENCY})::DOUBLE AS recency
  FROM user_stars u JOIN star_vectors v ON v.star_id = u.id JOIN profile p USING (user_id) WHERE {CANDIDATE}),
placed AS (SELECT *, 0.8::DOUBLE * relevance + 0.2::DOUBLE * recency AS score FROM near),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pushed_at DESC, id) AS rank FROM placed)
SELECT user_id, id, rank, round(score, 6) AS score, round(relevance, 6) AS relevance, round(recency, 6) AS recency FROM ranked WHERE rank <= 10""")


@query(DIGEST)
def d5_digest(spark, sf_dir):
    found = digest.digest(fx.user_stars(spark, sf_dir), fx.star_vectors(spark, sf_dir), fx.now())
    return found.select("user_id", "id", n("rank").alias("rank"), *(F.round(x, 6).alias(x) for x in ("score", "relevance", "recency")))


@query(DIGEST)
def d5_kept_profiles(spark, sf_dir):
    # Profiles from a former state of stars and vectors, changed by what came, went or was embedded anew since.
    pairs, vectors = fx.user_pairs(spark, sf_dir), fx.star_vectors(spark, sf_dir)
    own = vectors.select(F.col("star_id").alias("id"), "vector")
    former = own.where("id % 11 <> 0").withColumn("vector", F.when(F.col("id") % 7 == 0, F.reverse("vector")).otherwise(F.col("vector")))
    lost = pairs.where("id % 5 = 1").withColumn("id", F.col("id") + 1)
    before = pairs.where("id % 3 <> 0").unionByName(lost).distinct(), former
    tables = tables_source.Snapshots(spark, workspace(spark), profile_state.layouts(4))
    profile_state.refresh(tables, None, before)
    profile_state.refresh(tables, before, (pairs, own))
    found = digest.digest_from(fx.user_stars(spark, sf_dir), vectors, profile_state.profiles(tables.read(profile_state.TABLE)), fx.now())
    return found.select("user_id", "id", n("rank").alias("rank"), *(F.round(x, 6).alias(x) for x in ("score", "relevance", "recency")))


@query(f"""SELECT user_id, CASE WHEN count(v.star_id) = 0 THEN 0 ELSE count(*) FILTER (WHERE {CANDIDATE} AND v.star_id IS NOT NULL) END AS ranked,
  CASE WHEN count(v.star_id) = 0 THEN 0 ELSE count(*) FILTER (WHERE {CANDIDATE} AND v.star_id IS NULL) END AS unembedded, count(v.star_id) = 0 AS profile_empty
FROM user_stars u LEFT JOIN star_vectors v ON v.star_id = u.id GROUP BY user_id""")
def d5_digest_stats(spark, sf_dir):
    found = digest.digest_stats(fx.user_stars(spark, sf_dir), fx.vectors(spark, sf_dir), fx.now())
    return found.select("user_id", n("ranked").alias("ranked"), n("unembedded").alias("unembedded"), "profile_empty")


@query("SELECT star_id AS id, round(arg_max(vector[1], id), 6) AS first FROM vectors GROUP BY star_id")
def d6_star_vectors(spark, sf_dir):
    return digest.star_vectors(fx.vectors(spark, sf_dir)).select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


LINES = """concat_ws(chr(10), '{first}' || full_name, CASE WHEN language <> '' THEN '{language}' || language END, CASE WHEN description <> '' THEN '{description}' || description END,
  CASE WHEN len(topics) > 0 THEN '{topics}' || array_to_string(topics, ', ') END{more})""".format
PROMPT = LINES(first="Repo: ", language="Language: ", description="Description: ", topics="GitHub topics: ", more="{more}").format


@query("SELECT id, " + PROMPT(more=f", CASE WHEN len(ai_tags) > 0 THEN 'Tags: ' || array_to_string(ai_tags, ', ') END, 'Relevance to your interest profile: ' || floor({RECENCY} * 100 + 0.5)::BIGINT || '%'") + " AS prompt FROM stars WHERE pushed_at IS NOT NULL")
def n1_prompt(spark, sf_dir):
    rows = fx.stars(spark, sf_dir).where("pushed_at IS NOT NULL")
    return rows.select("id", digest.summary_prompt(digest.recency(F.col("pushed_at"), fx.now())).alias("prompt"))


@query(f"""SELECT s.id, nullif(regexp_replace(r.reply, '^\\s+|\\s+$', '', 'g'), '') AS summary FROM stars s LEFT JOIN (SELECT star_id, arg_max(reply, turn) AS reply FROM replies GROUP BY star_id) r ON r.star_id = s.id WHERE {CANDIDATE}""")
def n2_attach(spark, sf_dir):
    entries = fx.stars(spark, sf_dir).where(digest.is_candidate(fx.now()))
    replies = fx.replies(spark, sf_dir).groupBy(F.col("star_id").alias("id")).agg(F.max_by("reply", "turn").alias("reply"))
    return digest.attach_summaries(entries, replies, ("id",)).select("id", "summary")


# Embedding

INPUT = "substr(" + LINES(first="", language="language: ", description="", topics="topics: ", more="") + ", 1, 2000)"
DJB2 = "lower(to_hex(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: unicode(substr({0}, i, 1))::BIGINT), lambda h, c: xor((h * 33) & 4294967295, c), {1}::BIGINT)))".format


@query(f"SELECT id, {INPUT} AS input FROM stars")
def e1_input(spark, sf_dir):
    return fx.stars(spark, sf_dir).select("id", embedding.embedding_input().alias("input"))


@query(f"SELECT id, {DJB2('input', 5381)} AS content_hash FROM (SELECT id, {INPUT} AS input FROM stars)")
def e2_hash(spark, sf_dir):
    return fx.stars(spark, sf_dir).select("id", embedding.content_hash(embedding.embedding_input(), parity=True).alias("content_hash"))


@query("SELECT s.id AS star_id FROM stars s LEFT JOIN star_vectors v ON v.star_id = s.id WHERE v.star_id IS NULL OR v.model <> 'm1' OR (v.star_id - 1) % 3 = 0")
def e3_worklist(spark, sf_dir):
    return embedding.worklist(embedding.star_inputs(fx.stars(spark, sf_dir)), fx.hashed_vectors(spark, sf_dir), "m1").select("star_id")


def _lengths(texts: list[str]) -> list[list[float]]:
    """A model: the text's length as its only number; refuses a batch with a text whose length is a multiple of 13."""
    if any(len(x) % 13 == 0 for x in texts):
        raise inference.ModelError("bad_request", "length")
    return [[float(len(x))] for x in texts]


def _flaky() -> Callable[[list], list]:
    """A model that answers at the third try if a text's length is odd, and at the first else."""
    tries: dict[str, int] = {}

    def answer(texts: list[str]) -> list[list[float]]:
        for x in texts:
            tries[x] = tries.get(x, 0) + 1
            if len(x) % 2 and tries[x] % 3:
                raise inference.ModelError("rate_limit")
        for x in texts:
            tries.pop(x, None)  # what is answered is not kept
        return [[float(len(x))] for x in texts]

    return answer


@query("SELECT doc_id AS id, CASE WHEN length(text) % 13 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN length(text) % 13 = 0 THEN 'bad_request' END AS error_kind, CASE WHEN length(text) % 13 <> 0 THEN length(text) END AS length FROM documents")
def e4_batches(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("input"))
    made = inference.infer(rows, _lengths, "input", "vector", "array<double>")
    return made.select("id", "status", "error_kind", F.get("vector", F.lit(0)).cast("long").alias("length"))


@query("SELECT doc_id AS id, 'done' AS status, CASE WHEN length(text) % 2 = 1 THEN 3 ELSE 1 END::BIGINT AS tries FROM documents")
def e5_retries(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" "), F.lpad(F.col("doc_id").cast("string"), 11, "0")).alias("input"))
    made = inference.infer(rows, _flaky(), "input", "vector", "array<double>", batch=1, sleep=_no_wait)
    return made.select("id", "status", n("tries").alias("tries"))


def _no_wait(seconds: float) -> None:
    """The registered query tests the tries, not the waiting."""


@query(f"""SELECT 'star:' || (doc_id + 1) AS id, 'star' AS kind, doc_id + 1 AS star_id, 'm2' AS model, '2024-01-31 00:00:00' AS embedded_at, length(text)::DOUBLE AS norm FROM documents WHERE length(text) % 13 <> 0""")
def e7_vector_rows(spark, sf_dir):
    key = (F.col("doc_id") + 1).cast("string")
    rows = fx.load(spark, sf_dir, "documents").select(F.concat(F.lit("star:"), key).alias("id"), (F.col("doc_id") + 1).alias("star_id"), F.col("text").alias("input"))
    made = embedding.vector_rows(inference.infer(rows, _lengths, "input", "vector", "array<float>"), "m2", fx.now())
    return made.select("id", "kind", "star_id", "model", stamp("embedded_at").alias("embedded_at"), "norm")


@query(f"SELECT coalesce({KIND}, 'ok') AS outcome, count(*) AS n FROM call_log GROUP BY 1")
def e6_outcomes(spark, sf_dir):
    kind = F.coalesce(failures.model_outcome(F.col("http_status")), F.lit("ok"))
    return fx.call_log(spark, sf_dir).groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT ord, CASE WHEN http_status < 400 THEN NULL WHEN http_status = 401 THEN 'auth' WHEN http_status = 403 AND ord % 3 = 0 THEN 'rate_limit' WHEN http_status = 403 THEN 'auth' WHEN http_status = 429 THEN 'rate_limit'
  WHEN http_status = 404 THEN 'not_found' WHEN http_status = 422 THEN 'validation' WHEN http_status >= 500 THEN 'server' ELSE 'unknown' END AS outcome
FROM (SELECT ord, CASE http_status WHEN 413 THEN 403 WHEN 400 THEN 404 ELSE http_status END AS http_status FROM call_log)""")
def e6_host_outcomes(spark, sf_dir):
    status = F.when(F.col("http_status") == 413, 403).when(F.col("http_status") == 400, 404).otherwise(F.col("http_status"))
    return fx.call_log(spark, sf_dir).select("ord", failures.host_outcome(status, F.col("ord") % 3).alias("outcome"))


# Code index

KEPT = """--with split AS (SELECT *, string_split(path, '/') AS parts, regexp_extract(path, '\\.([^.]*)$', 1) AS ext FROM tree),
kept AS (SELECT * FROM split WHERE type = 'blob' AND size > 0 AND size <= 8000 AND NOT list_contains(parts, 'node_modules') AND ext IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'py', 'rs', 'go', 'java')),
scored AS (SELECT *, (list_sum(list_transform(parts, lambda p: CASE WHEN p IN ('src', 'lib') THEN 5 WHEN p IN ('test', 'tests', 'spec', '__tests__', '__test__') THEN -3 WHEN p IN ('examples', 'example', 'demo') THEN -2 ELSE 0 END))
  + greatest(0, 5 - len(parts)))::BIGINT AS score FROM kept)
"""


@query(KEPT + "SELECT repo_id, pos, path FROM kept")
def c1_tree_filter(spark, sf_dir):
    return code_index.filter_tree(fx.tree(spark, sf_dir), 8000).select("repo_id", "pos", "path")


@query(KEPT.replace("FROM kept)", "FROM split)") + "SELECT repo_id, path, score FROM scored")
def c2_path_score(spark, sf_dir):
    return fx.tree(spark, sf_dir).select("repo_id", "path", n(code_index.path_score(F.col("path"))).alias("score"))


@query(KEPT + "SELECT repo_id, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, length(path), pos) AS rank FROM scored) WHERE rank <= 3")
def c3_top_files(spark, sf_dir):
    return code_index.top_files(code_index.filter_tree(fx.tree(spark, sf_dir), 8000), 3).select("repo_id", "path", n("rank").alias("rank"))


@query("SELECT pos, CASE regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' END AS language FROM tree")
def c4_language(spark, sf_dir):
    return fx.tree(spark, sf_dir).select("pos", code_index.language_of(F.col("path")).alias("language"))


def _windows(size: int, overlap: int, table: str = "documents", content: str = "text") -> str:
    stride = size - overlap
    return f"""(SELECT doc_id AS repo_id, p AS part, array_to_string(lines[p * {stride} + 1 : p * {stride} + {size}], chr(10)) AS text, p * {stride} + 1 AS start_line, least(p * {stride} + {size}, n) AS end_line
FROM (SELECT doc_id, string_split({content}, chr(10)) AS lines, len(string_split({content}, chr(10))) AS n FROM {table} WHERE {content} <> ''),
  unnest(range(0, CASE WHEN n <= {size} THEN 1 ELSE ceil((n - {size}) / {stride}::DOUBLE)::BIGINT + 1 END)) AS r(p))"""


@query(f"SELECT repo_id, part, text, start_line, end_line FROM {_windows(10, 3)}")
def c5_windows(spark, sf_dir):
    found = code_index.window_chunks(fx.plain_files(spark, sf_dir), 10, 3)
    return found.select("repo_id", n("part").alias("part"), "text", n("start_line").alias("start_line"), n("end_line").alias("end_line"))


def _sections(most: int) -> str:
    return f"""--with code AS (SELECT doc_id, 'def f' || doc_id || '():' || chr(10) || text || chr(10) || 'class C' || doc_id || ':' || chr(10) || text AS content FROM documents),
lined AS (SELECT doc_id, i AS line, string_split(content, chr(10))[i] AS value FROM code, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS r(i)),
kinds AS (SELECT *, CASE WHEN regexp_matches(value, '^class\\s+\\w+') THEN 'class' WHEN regexp_matches(value, '^(?:async\\s+)?def\\s+\\w+') THEN 'function'
  WHEN regexp_matches(value, '^\\s+(?:@\\w+(?:\\([^)]*\\))?\\s*)*(?:async\\s+)?def\\s+\\w+') THEN 'method' END AS kind FROM lined),
numbered AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY line) - 1 AS place FROM numbered WHERE section > 0),
chunked AS (SELECT doc_id AS repo_id, section, place // {most} AS cut, string_agg(value, chr(10) ORDER BY line) AS text, min(line) AS start_line, max(line) AS end_line, max(kind) AS own_kind,
  arg_min(value, line) AS head FROM placed GROUP BY 1, 2, 3),
filled AS (SELECT *, max(own_kind) OVER (PARTITION BY repo_id, section) AS kind, row_number() OVER (PARTITION BY repo_id ORDER BY start_line) - 1 AS part FROM chunked)
"""


@query(_sections(5) + "SELECT repo_id, part, text, start_line, end_line, kind, CASE WHEN cut = 0 THEN trim(head) ELSE '' END AS header_line FROM filled")
def c6_semantic(spark, sf_dir):
    found = code_index.header_chunks(fx.python_files(spark, sf_dir), 5)
    return found.select("repo_id", n("part").alias("part"), "text", n("start_line").alias("start_line"), n("end_line").alias("end_line"), "kind", "header_line")


@query(_sections(80) + f"""SELECT repo_id, 'py' AS form, part, start_line, end_line FROM filled
UNION ALL SELECT repo_id, 'txt', part, start_line, end_line FROM {_windows(40, 10)}""")
def c7_dispatch(spark, sf_dir):
    labelled = fx.python_files(spark, sf_dir).withColumn("language", F.lit(" Python"))  # a label, not a name that is looked up as it is
    found = code_index.chunks(labelled.unionByName(fx.plain_files(spark, sf_dir)))
    form = F.substring_index("path", ".", -1)
    return found.select("repo_id", form.alias("form"), n("part").alias("part"), n("start_line").alias("start_line"), n("end_line").alias("end_line"))


@query(f"SELECT 'code:' || repo_id || ':doc-' || repo_id || '.txt:' || part AS id, substr(text, 1, 240) AS snippet, {DJB2('text', 5382)} AS content_hash FROM {_windows(40, 10)}")
def c8_chunk_rows(spark, sf_dir):
    return code_index.chunk_rows(code_index.window_chunks(fx.plain_files(spark, sf_dir))).select("id", "snippet", "content_hash")


@query(f"SELECT 'code:' || repo_id || ':doc-' || repo_id || '.txt:' || part AS id FROM {_windows(40, 10)} WHERE repo_id % 4 = 0 OR repo_id % 3 = 0")
def c9_worklist(spark, sf_dir):
    rows = code_index.chunk_rows(code_index.window_chunks(fx.plain_files(spark, sf_dir)))
    stored = rows.where("star_id % 4 <> 0").select("id", F.when(F.col("star_id") % 3 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"), F.lit("m1").alias("model"))
    return embedding.worklist(rows, stored, "m1").select("id")


@query("""SELECT r.repo_id, count(w.repo_id) AS n, count(w.repo_id) > 0 AS deep_indexed, CASE WHEN count(w.repo_id) = 0 THEN 'no chunks' END AS reason
FROM (SELECT doc_id AS repo_id FROM documents) r LEFT JOIN (SELECT * FROM """ + _windows(40, 10) + """ WHERE repo_id % 5 <> 0) w USING (repo_id) GROUP BY 1""")
def c10_mark_indexed(spark, sf_dir):
    files = fx.plain_files(spark, sf_dir)
    landed = code_index.window_chunks(files).where("repo_id % 5 <> 0").select("repo_id")
    return code_index.mark_indexed(files.select("repo_id"), landed, fx.now()).select("repo_id", "n", "deep_indexed", "reason")


# Tags and translation


@query("SELECT id FROM stars WHERE len(ai_tags) = 0")
def t1_untagged(spark, sf_dir):
    return tagging.untagged(fx.stars(spark, sf_dir)).select("id")


@query("SELECT id, " + PROMPT(more="") + " AS prompt FROM stars")
def t2_prompt(spark, sf_dir):
    return fx.stars(spark, sf_dir).select("id", tagging.tag_prompt().alias("prompt"))


TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')".format
TAGS = """--with parts AS (SELECT star_id, turn, list_transform(string_split_regex({0}, '[,\\n]'), lambda x: {1}) AS found FROM replies),
fit AS (SELECT star_id, turn, list_filter(found, lambda x: x <> '' AND length(x) <= 40) AS found FROM parts),
kept AS (SELECT star_id, turn, list_filter(found, lambda x, i: list_position(list_transform(found, lambda y: lower(y)), lower(x)) = i)[1:5] AS tags FROM fit)
""".format(
    TRIM("regexp_replace(reply, '^(?i:Tags|Output|Result)\\s*:\\s*', '')"),
    TRIM("regexp_replace(regexp_replace(regexp_replace(" + TRIM("x") + ", '^(?:[-*•]|\\d+[.)])\\s*', ''), '^[\"''`]+|[\"''`]+$', '', 'g'), '[.!?;:]+$', '')"),
)


@query(TAGS + "SELECT star_id, turn, array_to_string(tags, '|') AS tags FROM kept")
def t3_parse_tags(spark, sf_dir):
    return fx.replies(spark, sf_dir).select("star_id", "turn", F.array_join(tagging.parse_tags(F.col("reply")), "|").alias("tags"))


@query(TAGS + "SELECT star_id, turn FROM kept WHERE len(tags) = 0")
def t4_failed_tags(spark, sf_dir):
    return tagging.tag_patches(fx.replies(spark, sf_dir), ("star_id", "turn"))[1].select("star_id", "turn")


SCRIPT = {"zh-CN": "[一-鿿]", "ja": "[぀-ゟ゠-ヿ一-鿿]", "ko": "[가-힯]", "ru": "[Ѐ-ӿ]", "vi": "[À-ỹ]"}


@query("SELECT id, " + ", ".join(f"coalesce(regexp_matches(description, '{p}'), false) AS {k.replace('-', '_').lower()}" for k, p in SCRIPT.items()) + ", false AS de FROM stars")
def l1_script(spark, sf_dir):
    rows = fx.stars(spark, sf_dir)
    return rows.select("id", *(translate.in_script(F.col("description"), k).alias(k.replace("-", "_").lower()) for k in (*SCRIPT, "de")))


NEED = """--with asked AS (SELECT *, coalesce(trim(description), '') <> '' AS has, coalesce(regexp_matches(description, '[一-鿿]'), false) AS in_desc, regexp_matches(array_to_string(ai_tags, ' '), '[一-鿿]') AS in_tags,
  len(ai_tags) > 0 AS tagged, coalesce(desc_zh, '') = '' AS no_desc, coalesce(tags_zh, '') = '' AS no_tags FROM stars),
needs AS (SELECT *, has AND no_desc AND NOT in_desc AS d, tagged AND no_tags AND NOT in_tags AS t, has AND no_desc AND in_desc AS fill_d, tagged AND no_tags AND in_tags AS fill_t FROM asked)
"""


@query(NEED + "SELECT id, d AS description, t AS tags, d OR t AS either FROM needs")
def l2_needs(spark, sf_dir):
    rows = fx.stars(spark, sf_dir)
    return rows.select("id", translate.description_needs("zh-CN").alias("description"), translate.tags_need("zh-CN").alias("tags"), translate.star_needs("zh-CN").alias("either"))


@query(NEED + "SELECT id, CASE WHEN NOT has AND NOT tagged THEN 'no_source' WHEN d OR t THEN 'translate' WHEN fill_d OR fill_t THEN 'backfill' ELSE 'skip' END AS plan FROM needs")
def l3_plan(spark, sf_dir):
    return translate.plan(fx.stars(spark, sf_dir), "zh-CN").select("id", "plan")


@query(NEED + "SELECT id, CASE WHEN fill_d THEN description ELSE desc_zh END AS description_zh, CASE WHEN fill_t THEN array_to_string(ai_tags, ', ') ELSE tags_zh END AS tags_zh FROM needs")
def l4_backfill(spark, sf_dir):
    done = translate.backfill(translate.plan(fx.stars(spark, sf_dir), "zh-CN"), "zh-CN", fx.now())
    cached = lambda m: F.try_element_at(m, F.lit("zh-CN"))
    return done.select("id", cached("description_i18n").alias("description_zh"), cached("ai_tags_i18n").alias("tags_zh"))


@query(f"""SELECT id, '{translate.system_prompt("ja")}' AS description_system, description AS description_user, '{translate.system_prompt("ja", "tags")}' AS tags_system, array_to_string(ai_tags, ', ') AS tags_user FROM stars""")
def l5_prompts(spark, sf_dir):
    return translate.prompts(fx.stars(spark, sf_dir), "ja").select("id", "description_system", "description_user", "tags_system", "tags_user")


PEEL = "regexp_replace({}, '^(?i:Translation|Translated|Result|Output|译文)\\s*[:：]\\s*', '')".format


def _parse_sql(reply: str) -> str:
    peeled = reply
    for _ in range(4):
        peeled = TRIM(PEEL(peeled))
    first = f"regexp_replace({peeled}, '(?s)\\n\\s*\\n.*$', '')"
    note = f"regexp_replace({first}, '(?i)\\s*[(（][^()（）]*(?:kept|left|preserved|untranslated|brand|as in source|original|protected)[^()（）]*[)）]\\s*$', '')"
    plain = note
    for pattern, by in (("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"), ("\\*\\*([^*\\n]+)\\*\\*", "\\1"), ("__([^_\\n]+)__", "\\1"), ("(^|[^\\w*])\\*([^*\\n]+)\\*($|\\W)", "\\1\\2\\3"), ("(^|[^\\w_])_([^_\\n]+)_($|\\W)", "\\1\\2\\3"), ("`([^`\\n]+)`", "\\1")):
        plain = f"regexp_replace({plain}, '{pattern}', '{by}', 'g')"
    return plain


@query(f"""SELECT star_id, turn, CASE WHEN done <> '' AND length(done) <= 1200 THEN done END AS translation FROM (SELECT star_id, turn, {TRIM("CASE WHEN starts_with(plain, chr(34)) AND ends_with(plain, chr(34)) AND length(plain) >= 2 AND NOT contains(plain[2:-2], chr(34)) THEN plain[2:-2] ELSE plain END")} AS done
FROM (SELECT star_id, turn, {_parse_sql("reply")} AS plain FROM (SELECT star_id, turn, {TRIM("shown")} AS reply FROM
  (SELECT star_id, turn, CASE turn % 4 WHEN 0 THEN 'Translation: 译文: ' || reply WHEN 1 THEN chr(34) || reply || chr(34) WHEN 2 THEN '**' || reply || '**' || chr(10) || chr(10) || '(Note)' ELSE reply || ' (I kept it)' END AS shown FROM replies))))""")
def l6_parse_translation(spark, sf_dir):
    turn, quote = F.col("turn") % 4, F.lit('"')
    shown = (
        F.when(turn == 0, F.concat(F.lit("Translation: 译文: "), F.col("reply")))
        .when(turn == 1, F.concat(quote, F.col("reply"), quote))
        .when(turn == 2, F.concat(F.lit("**"), F.col("reply"), F.lit("**\n\n(Note)")))
        .otherwise(F.concat(F.col("reply"), F.lit(" (I kept it)")))
    )
    return fx.replies(spark, sf_dir).select("star_id", "turn", translate.parse_translation(shown).alias("translation"))


@query("""--with run AS (SELECT CASE WHEN id % 31 = 0 THEN 'failed' ELSE 'done' END AS ds, CASE WHEN id % 29 = 0 THEN 'failed' ELSE 'done' END AS ts, id FROM stars)
""" .rstrip() + NEED.replace("--with", ",") + """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT has AND NOT tagged THEN 'no_source' WHEN NOT (d OR t) THEN 'skipped' WHEN ds = 'failed' THEN 'failed' WHEN ts = 'failed' THEN 'tags_failed' ELSE 'translated' END AS outcome
FROM needs JOIN run USING (id)) GROUP BY outcome""")
def l7_run_counts(spark, sf_dir):
    planned = translate.plan(fx.stars(spark, sf_dir), "zh-CN")
    state = lambda k: F.when(F.col("id") % k == 0, "failed").otherwise("done")
    return planned.groupBy(translate.outcome(state(31), state(29), F.col("plan")).alias("outcome")).agg(F.count("*").alias("n"))


# Scalar functions


@query("SELECT id, CASE WHEN length(description) > 120 THEN regexp_replace(substr(description, 1, 119), '\\s+$', '') || '…' ELSE description END AS short FROM stars")
def x_truncate(spark, sf_dir):
    return fx.stars(spark, sf_dir).select("id", text.truncate(F.col("description"), 120).alias("short"))


@query("""--with aged AS (SELECT id, pushed_at, floor(epoch(TIMESTAMP '2024-01-31' - pushed_at) / 60)::BIGINT AS m FROM stars)
SELECT id, CASE WHEN pushed_at IS NULL THEN 'never' WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m < 43200 THEN (m // 1440) || 'd ago' ELSE strftime(pushed_at, '%Y-%m-%d') END AS age FROM aged""")
def x_relative_time(spark, sf_dir):
    return fx.stars(spark, sf_dir).select("id", text.relative_time(F.col("pushed_at"), fx.now(), F.lit("never")).alias("age"))


@query("""SELECT id, CASE id % 6 WHEN 0 THEN CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'es' ELSE 'en' END WHEN 1 THEN 'zh-CN' WHEN 2 THEN 'zh-TW' WHEN 3 THEN 'pt-BR' WHEN 4 THEN 'en' ELSE lang END AS locale
FROM (SELECT doc_id AS id, lang FROM documents)""")
def x_detect_locale(spark, sf_dir):
    d = fx.load(spark, sf_dir, "documents")
    pick = F.get(F.array(F.lit("XX"), F.lit("zh-HK"), F.lit("ZH-tw"), F.lit("pt"), F.lit("xx-YY"), F.concat("lang", F.lit("-AT"))), (F.col("doc_id") % 6).cast("int"))
    tag = F.when(F.col("doc_id") % 6 == 0, F.upper("lang")).otherwise(pick)
    return d.select(F.col("doc_id").alias("id"), text.detect_locale(tag).alias("locale"))


@query("SELECT id, 'Repo ' || full_name || ' has ' || stargazers_count || ' stars, {unknown} {full_name' AS line FROM stars")
def x_fill_template(spark, sf_dir):
    values = F.create_map(F.lit("name"), F.col("full_name"), F.lit("n"), F.col("stargazers_count").cast("string"))
    return fx.stars(spark, sf_dir).select("id", text.fill_template(F.lit("Repo {name} has {n} stars, {unknown} {full_name"), values).alias("line"))


# Tables that change together, jobs and the stream


def _tables(spark, sf_dir, layouts=None):
    """Tables in a folder of their own, with the existing stars and their users' cursors as the first commit, vectors as the second."""
    tables = tables_source.Snapshots(spark, workspace(spark), layouts or WORK_LAYOUTS)

    def first(t):
        t.write("stars", fx.existing(spark, sf_dir))
        t.write("cursors", fx.cursors(spark, sf_dir))

    tables.commit(first)
    tables.write("vectors", fx.vectors(spark, sf_dir))
    return tables


#: Few buckets: the tables that the queries keep for themselves are small.
WORK_LAYOUTS = {name: layout._replace(groups=4) for name, layout in tables_source.LAYOUTS.items()}


def _pulled_some(spark, sf_dir):
    """The tables after a pull of users 0, 1 and 4, the last one's empty, and then one of user 3; user 2 is never pulled."""
    tables, rows = _tables(spark, sf_dir), fx.incoming(spark, sf_dir)
    users = spark.range(5).where("id IN (0, 1, 4)").select(F.col("id").alias("user_id"))
    first = jobs.sync_job(tables, rows.where("user_id IN (0, 1)"), fx.now(), users=users)
    return tables, first.unionByName(jobs.sync_job(tables, rows.where("user_id = 3"), fx.now()))


# Users 0, 1 and 4 are in full mode by their cursors, user 3 is not.
PULLED = """--with after_pull AS (SELECT * FROM existing WHERE user_id = 2 UNION ALL SELECT * FROM incoming WHERE user_id IN (0, 1, 3)
  UNION ALL SELECT e.* FROM existing e ANTI JOIN incoming i ON i.user_id = e.user_id AND i.id = e.id WHERE e.user_id = 3)
"""


@query(PULLED + """SELECT a.user_id, a.id, a.stargazers_count, coalesce(e.user_note, a.user_note) AS user_note FROM after_pull a LEFT JOIN existing e ON e.user_id = a.user_id AND e.id = a.id""")
def y14_partial_pull(spark, sf_dir):
    return _pulled_some(spark, sf_dir)[0].read("stars").select("user_id", "id", "stargazers_count", "user_note")


@query("""--with k AS (SELECT coalesce(e.user_id, i.user_id) AS user_id, e.id AS old, i.id AS new FROM (SELECT * FROM existing WHERE user_id <> 2) e
  FULL JOIN (SELECT * FROM incoming WHERE user_id IN (0, 1, 3)) i ON i.user_id = e.user_id AND i.id = e.id)
SELECT user_id, count(*) FILTER (WHERE old IS NULL) AS inserted, count(*) FILTER (WHERE old IS NOT NULL AND new IS NOT NULL) AS updated,
  count(*) FILTER (WHERE new IS NULL AND user_id <> 3) AS deleted, count(*) FILTER (WHERE new IS NOT NULL OR user_id = 3) AS known FROM k GROUP BY user_id""")
def y14_partial_report(spark, sf_dir):
    return _pulled_some(spark, sf_dir)[1].select("user_id", *(n(x).alias(x) for x in ("inserted", "updated", "deleted", "known")))


@query(PULLED + f"""SELECT c.user_id, {STAMP("CASE WHEN c.user_id IN (0, 1, 3) THEN greatest(c.since, i.newest) ELSE c.since END")} AS since,
  CASE WHEN c.user_id = 2 THEN c.known_count ELSE coalesce(a.known, 0) END AS known_count, {STAMP("CASE WHEN c.user_id IN (0, 1, 4) THEN TIMESTAMP '2024-01-31' ELSE c.last_full_sync_at END")} AS last_full_sync_at
FROM cursors c LEFT JOIN (SELECT user_id, max(starred_at) AS newest FROM incoming GROUP BY user_id) i USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS known FROM after_pull GROUP BY user_id) a USING (user_id)""")
def y15_partial_cursors(spark, sf_dir):
    found = _pulled_some(spark, sf_dir)[0].read("cursors")
    return found.select("user_id", stamp("since").alias("since"), n("known_count").alias("known_count"), stamp("last_full_sync_at").alias("last_full_sync_at"))


@query(PULLED + "SELECT v.id, v.star_id FROM vectors v WHERE star_id NOT IN (SELECT id FROM existing) OR star_id IN (SELECT id FROM after_pull)")
def y9_partial_cascade(spark, sf_dir):
    return _pulled_some(spark, sf_dir)[0].read("vectors").select("id", "star_id")


@query(PULLED + """, sizes AS (SELECT count(*) AS before, (SELECT count(*) FROM after_pull) + (SELECT count(*) FROM existing WHERE user_id = 3) - (SELECT count(*) FROM after_pull WHERE user_id = 3) AS between_pulls,
  (SELECT count(*) FROM after_pull) AS after, (SELECT count(*) FROM vectors) AS v, (SELECT count(*) FROM vectors WHERE star_id NOT IN (SELECT id FROM existing) OR star_id IN (SELECT id FROM after_pull)) AS v_after FROM existing)
SELECT version, name, n FROM (SELECT 1 AS version, 'stars' AS name, before AS n FROM sizes UNION ALL SELECT 2, 'stars', before FROM sizes UNION ALL SELECT 2, 'vectors', v FROM sizes
  UNION ALL SELECT 3, 'stars', between_pulls FROM sizes UNION ALL SELECT 4, 'stars', after FROM sizes UNION ALL SELECT 3, 'vectors', v_after FROM sizes UNION ALL SELECT 4, 'vectors', v_after FROM sizes)""")
def s7_versions(spark, sf_dir):
    # Every commit stays readable, and shows all tables as they were together.
    tables, found = _pulled_some(spark, sf_dir)[0], None
    for version in tables.commits():
        for name in ("stars", "vectors"):
            rows = tables.read(name, version)
            if rows is not None:
                own = rows.agg(F.lit(version).alias("version"), F.lit(name).alias("name"), F.count("*").alias("n"))
                found = own if found is None else found.unionByName(own)
    return found


def _streamed(spark, sf_dir, feed):
    """The tables after the stream has merged the envelopes of the feed, which arrive in several batches."""
    own = tidy(spark, **{"spark.sql.parquet.compression.codec": "zstd"})  # two thirds of the bytes of snappy on these texts
    tables = _tables(own, sf_dir)
    inbox, check = workspace(own), workspace(own)
    files = fx.write_feed(own, sf_dir, feed(own, sf_dir), inbox)
    stream = own.readStream.schema(streaming.SCHEMA).option("maxFilesPerTrigger", files).option("cleanSource", "delete").json(inbox)
    streaming.start(stream, tables, check, fx.now, keep=1).awaitTermination()  # the queries read the newest version alone
    return tables_source.Snapshots(spark, tables.root, tables.layouts)


@query("""--with feed AS (SELECT user_id, id, stargazers_count FROM incoming WHERE id % 40 <> 0 AND id % 41 <> 0 AND id % 43 <> 0)
SELECT user_id, id, f.stargazers_count, e.user_note FROM feed f LEFT JOIN existing e USING (user_id, id)
UNION ALL SELECT user_id, id, stargazers_count, user_note FROM existing ANTI JOIN feed USING (user_id, id)""")
def r1_stream_merge(spark, sf_dir):
    return _streamed(spark, sf_dir, fx.incoming).read("stars").select("user_id", "id", "stargazers_count", "user_note")


@query("""SELECT user_id, CASE WHEN id % 40 <> 0 THEN id END AS id, concat_ws(',', CASE WHEN id % 40 = 0 THEN 'id' END, CASE WHEN id % 41 = 0 THEN 'full_name' END, CASE WHEN id % 43 = 0 THEN 'stargazers_count' END) AS broken
FROM incoming WHERE id % 40 = 0 OR id % 41 = 0 OR id % 43 = 0""")
def r1_stream_quarantine(spark, sf_dir):
    found = _streamed(spark, sf_dir, fx.incoming).read("quarantine")
    return found.select("user_id", "id", F.array_join("violations", ",").alias("broken"))


@query("SELECT e.user_id, e.id FROM existing e JOIN modes m USING (user_id) ANTI JOIN incoming i ON i.user_id = e.user_id AND i.id = e.id WHERE m.mode = 'full'")
def r2_stream_keeps(spark, sf_dir):
    # What a full pull would delete is still there after a stream.
    kept = _streamed(spark, sf_dir, fx.incoming).read("stars")
    return sync.unstarred(kept, fx.incoming(spark, sf_dir), sync.sync_mode(fx.cursors(spark, sf_dir), fx.now())).select("user_id", "id")


@query("""--with marks AS (SELECT user_id, max(starred_at) AS since FROM existing WHERE id % 7 = 0 GROUP BY user_id), cut AS (SELECT i.* FROM incoming i LEFT JOIN marks m USING (user_id) WHERE m.since IS NULL OR i.starred_at >= m.since)
SELECT user_id, id, stargazers_count FROM cut UNION ALL SELECT user_id, id, stargazers_count FROM existing ANTI JOIN cut USING (user_id, id)""")
def r3_same_second(spark, sf_dir):
    # The mark is the time of a star; pulled again with others of its second, it is updated, not doubled or lost.
    old = fx.existing(spark, sf_dir)
    marks = old.where("id % 7 = 0").groupBy("user_id").agg(F.max("starred_at").alias("since"))
    cut = sync.incremental_cut(fx.incoming(spark, sf_dir), marks)
    return sync.upsert(old, cut.withColumn("ord", F.lit(0)), "ord").select("user_id", "id", "stargazers_count")


@query("""SELECT user_id, CASE WHEN window_days <= 0 AND lim < 1 THEN 'window_days,limit' WHEN window_days <= 0 THEN 'window_days' WHEN lim < 1 THEN 'limit' ELSE '' END AS broken
FROM (SELECT c_custkey AS user_id, c_custkey % 9 - 1 AS window_days, c_custkey % 4 AS lim FROM customer)""")
def d1_settings(spark, sf_dir):
    return _settings(spark, sf_dir).select("user_id", F.array_join(star_source.violations(digest.settings_rules()), ",").alias("broken"))


def _settings(spark, sf_dir):
    k = F.col("c_custkey")
    return fx.load(spark, sf_dir, "customer").select(k.cast("long").alias("user_id"), (k % 9 - 1).cast("double").alias("window_days"), (k % 4).cast("long").alias("limit"))


OWN_RECENCY = "CASE WHEN pushed_at >= TIMESTAMP '2024-01-31' THEN 1.0 ELSE 1.0 - epoch(TIMESTAMP '2024-01-31' - pushed_at) / (86400.0 * days) END"


@query(PROFILE + f""", own AS (SELECT u.*, coalesce(s.days, 7) AS days, coalesce(s.lim, 10) AS lim FROM user_stars u
  LEFT JOIN (SELECT c_custkey AS user_id, c_custkey % 9 - 1 AS days, c_custkey % 4 AS lim FROM customer WHERE c_custkey % 9 > 1 AND c_custkey % 4 > 0) s USING (user_id)),
near AS (SELECT u.user_id, u.id, pushed_at, lim, list_cosine_similarity(p.profile, v.vector) AS relevance, ({OWN_RECENCY})::DOUBLE AS recency FROM own u JOIN star_vectors v ON v.star_id = u.id JOIN profile p USING (user_id)
  WHERE NOT archived AND NOT is_fork AND epoch(TIMESTAMP '2024-01-31' - pushed_at) < 86400 * days),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY 0.8::DOUBLE * relevance + 0.2::DOUBLE * recency DESC, pushed_at DESC, id) AS rank FROM near)
SELECT user_id, id, rank, round(0.8::DOUBLE * relevance + 0.2::DOUBLE * recency, 6) AS score FROM ranked WHERE rank <= lim""")
def d1_digest_by_settings(spark, sf_dir):
    good, _ = star_source.validate(_settings(spark, sf_dir), digest.settings_rules())
    found = digest.digest_by_settings(fx.user_stars(spark, sf_dir), fx.star_vectors(spark, sf_dir), good, fx.now())
    return found.select("user_id", "id", n("rank").alias("rank"), F.round("score", 6).alias("score"))


def _answers(pairs):
    """A model: tells the lengths of what it was asked; refuses what is a multiple of 17 long."""
    if any(len(user) % 17 == 0 for _, user in pairs):
        raise inference.ModelError("bad_request", "length")
    return [f"{len(system)} and {len(user)}" for system, user in pairs]


@query("""SELECT conv_id, turn, CASE WHEN length(text) % 17 <> 0 THEN length(role) || ' and ' || length(text) END AS reply, CASE WHEN length(text) % 17 = 0 THEN 'failed' ELSE 'done' END AS status
FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL""")
def e4_chat(spark, sf_dir):
    asked = fx.load(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL").select("conv_id", "turn", "role", "text")
    return inference.chat(asked, _answers, "role", "text", batch=1).select("conv_id", "turn", "reply", "status")


def _first_model(texts):
    return [f"first {len(x)}" for x in texts]


def _second_model(texts):
    return [f"second {len(x)}" for x in texts]


@query("SELECT doc_id, CASE WHEN bool_or(doc_id % 3 = 0) OVER (PARTITION BY text) THEN 'first ' ELSE 'second ' END || length(text) AS answer FROM documents WHERE text IS NOT NULL")
def e4_ledger(spark, sf_dir):
    # A run that ended after a third of its inputs; the next one asks for the rest only.
    docs, ledger = fx.load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), workspace(spark)
    inference.infer(docs.where("doc_id % 3 = 0"), _first_model, "text", "answer", "string", in_flight=8, ledger=ledger).write.format("noop").mode("overwrite").save()
    return inference.infer(docs, _second_model, "text", "answer", "string", in_flight=8, ledger=ledger).select("doc_id", "answer")
