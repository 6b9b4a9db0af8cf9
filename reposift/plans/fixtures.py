"""The library's tables derived from a folder of business and text tables, for the registered queries.

Every derivation is arithmetic on keys, so that SQL can state it too (see VIEWS).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.functions import text
from reposift.functions import vectors as V
from reposift.operators import embedding

NOW = "2024-01-31 00:00:00"
START = 1_704_067_200  # 2024-01-01, in seconds
MONTH = 2_592_000


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words() -> Column:
    """Some of the text's words, whole text through: those of 3, 10, 17 and so on characters."""
    return F.filter(F.split("text", " "), lambda x: F.length(x) % 7 == 3)


def _map(flag: Column, value: Column) -> Column:
    return F.when(flag, F.create_map(F.lit("zh-CN"), value)).otherwise(F.create_map().cast("map<string,string>"))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = docs.join(labels, "doc_id", "left")
    k = F.col("doc_id")
    none, never = F.array().cast("array<string>"), F.lit(None).cast("timestamp")
    empty = F.create_map().cast("map<string,string>")
    at = lambda factor: F.timestamp_seconds(F.lit(START) + (k * factor) % MONTH)
    name = F.concat("source", F.lit("/doc-"), k.cast("string"))
    description = (
        F.when(k % 17 == 0, F.lit(None).cast("string"))
        .when(k % 19 == 1, F.concat(F.lit("异步 "), F.col("text")))
        .when(k % 19 == 2, F.concat(F.lit("Среда "), F.col("text")))
        .otherwise(F.col("text"))
    )
    tags = F.when(k % 4 == 0, none).otherwise(words())
    return d.select(
        F.lit(1).alias("schema_version"), (k + 1).alias("id"), name.alias("full_name"), F.concat(F.lit("https://example.org/"), name).alias("html_url"),
        F.col("source").alias("owner_login"), F.lit(None).cast("string").alias("owner_avatar_url"), description.alias("description"),
        F.when(k % 5 == 0, none).otherwise(F.array("lang", "source")).alias("topics"), F.when(k % 11 != 0, F.col("lang")).alias("language"),
        at(104729).alias("starred_at"), F.when(k % 13 != 0, at(1601939)).alias("pushed_at"), F.col("n_chars").alias("stargazers_count"), F.lit("main").alias("default_branch"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("archived"), (k % 9 == 0).alias("is_fork"), F.lit("2024-01-30").cast("timestamp").alias("last_synced_at"),
        tags.alias("ai_tags"), F.lit(None).cast("string").alias("ai_summary"), F.when(k % 10 == 0, F.concat(F.lit("note "), k.cast("string"))).alias("user_note"),
        never.alias("last_embedded_at"), F.lit(False).alias("subscribed_to_releases"), (k % 8 == 0).alias("deep_indexed"),
        _map(k % 7 == 0, F.concat(F.lit("译 "), F.col("text"))).alias("description_i18n"), empty.alias("ai_summary_i18n"),
        _map(k % 6 == 0, F.concat(F.lit("标签, "), F.array_join(words(), " ,"))).alias("ai_tags_i18n"), never.alias("last_translated_at"),
        F.when(k % 8 == 0, F.lit("2024-01-15").cast("timestamp")).alias("last_deep_indexed_at"),
    )


def user_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, id): who keeps which star."""
    n = load(spark, sf_dir, "documents").count()
    return load(spark, sf_dir, "events").select("user_id", (F.col("event_id") % n + 1).alias("id")).distinct()


def user_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stars as kept by many users, with user_id."""
    return user_pairs(spark, sf_dir).join(stars(spark, sf_dir), "id")


def grouped_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stars dealt to five users, with user_id first."""
    return stars(spark, sf_dir).select(((F.col("id") - 1) % 5).alias("user_id"), "*")


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_stars(spark, sf_dir).where("(id - 1) % 10 <> 7")


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pull: some stars gone, counts up by one, local columns at their defaults, and a few new stars."""
    none, never = F.array().cast("array<string>"), F.lit(None).cast("timestamp")
    empty = F.create_map().cast("map<string,string>")
    fresh = grouped_stars(spark, sf_dir).withColumns({
        "stargazers_count": F.col("stargazers_count") + 1, "ai_tags": F.lit(None).cast("array<string>"), "user_note": F.lit(None).cast("string"), "deep_indexed": F.lit(None).cast("boolean"),
        "description_i18n": F.lit(None).cast("map<string,string>"), "ai_tags_i18n": F.lit(None).cast("map<string,string>"), "last_deep_indexed_at": never,
    })
    fresh = fresh.withColumns({"ai_tags": F.coalesce("ai_tags", none), "deep_indexed": F.lit(False), "description_i18n": F.coalesce("description_i18n", empty), "ai_tags_i18n": F.coalesce("ai_tags_i18n", empty)})
    added = fresh.where("id <= 20").withColumn("id", F.col("id") + 999_999)
    return fresh.where("(id - 1) % 9 <> 3").unionByName(added)


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = existing(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("known_count"))
    u = F.col("user_id")
    stamp = lambda x: F.lit(x).cast("timestamp")
    full = F.when(u == 1, stamp("2024-01-20")).when(u == 2, stamp("2024-01-24")).when(u == 3, stamp("2024-01-30")).when(u == 4, stamp("2024-01-23 23:59:59"))
    return users.select("user_id", F.lit(None).cast("string").alias("etag"), F.when(u != 3, stamp("2024-01-10")).alias("since"), "known_count", stamp("2024-01-30").alias("updated_at"), full.alias("last_full_sync_at"))


def star_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    model = F.when(k % 50 == 0, "m0").otherwise("m1")
    return e.select(F.concat(F.lit("star:"), (k + 1).cast("string")).alias("id"), F.lit("star").alias("kind"), (k + 1).alias("star_id"), model.alias("model"), F.col("embedding").alias("vector"), V.norm(F.col("embedding")).alias("norm"))


def code_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_vectors(spark, sf_dir).where("(star_id - 1) % 7 = 0")
    code = rows.withColumns({"id": F.concat(F.lit("code:"), F.col("star_id").cast("string"), F.lit(":src/a.py:0")), "kind": F.lit("code"), "chunk_index": F.lit(0)})
    lost = F.col("star_id") % 3 == 0
    return code.withColumns({"path": F.when(~lost, "src/a.py"), "start_line": F.when(~lost, 1), "end_line": F.when(~lost, 10)})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_vectors(spark, sf_dir).unionByName(code_vectors(spark, sf_dir), allowMissingColumns=True)


def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star vectors with the content hash of their star's text, stale for every third."""
    inputs = embedding.star_inputs(stars(spark, sf_dir)).select("id", "content_hash")
    stale = (F.col("star_id") - 1) % 3 == 0
    return star_vectors(spark, sf_dir).join(inputs, "id", "left").withColumn("content_hash", F.when(stale, "stale").otherwise(F.col("content_hash")))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector that the single-query searches look for."""
    return load(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages")
    k = F.col("page_id")
    pick = lambda values, n: F.get(F.array(*(F.lit(x) for x in values)), (k % n).cast("int"))
    path = F.concat(pick(("src/", "lib/", "tests/", "node_modules/", "docs/", ""), 6), F.lit("p"), k.cast("string"), pick((".py", ".ts", ".md", ".rs"), 4))
    return p.select((k % 10).alias("repo_id"), k.alias("pos"), path.alias("path"), F.when(k % 25 == 0, "tree").otherwise("blob").alias("type"), F.length("html").cast("long").alias("size"))


def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("repo_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), F.lit(None).cast("string").alias("language"))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    k = F.col("doc_id").cast("string")
    content = F.concat(F.lit("def f"), k, F.lit("():\n"), F.col("text"), F.lit("\nclass C"), k, F.lit(":\n"), F.col("text"))
    return d.select(F.col("doc_id").alias("repo_id"), F.concat(F.lit("doc-"), k, F.lit(".py")).alias("path"), content.alias("content"), F.lit("python").alias("language"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").where("role = 'assistant'")
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Tags: "), F.col("text"))).otherwise(F.col("text"))
    return c.select((F.col("conv_id") + 1).alias("star_id"), "turn", reply.alias("reply"))


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    status = F.get(F.array(*(F.lit(x) for x in (200, 401, 429, 504, 500, 400, 413, 200))), (F.col("event_id") % 8).cast("int"))
    return e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("star_id"), status.alias("http_status"))


def envelopes(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """JSON texts of star envelopes, some without optional fields and some broken. rows: other stars than all; extra: their columns to put in too."""
    s = stars(spark, sf_dir) if rows is None else rows
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    repo = F.struct(
        F.when(F.col("id") % 40 != 0, F.col("id")).alias("id"), F.when(F.col("id") % 41 == 0, "x").otherwise(F.col("full_name")).alias("full_name"),
        "html_url", F.struct(F.col("owner_login").alias("login")).alias("owner"), "description",
        F.when(F.size("topics") > 0, F.col("topics")).alias("topics"), "language", stamp("pushed_at").alias("pushed_at"),
        F.when(F.col("id") % 43 == 0, -1).otherwise(F.col("stargazers_count")).alias("stargazers_count"),
        F.when(F.col("archived"), True).alias("archived"), F.when(F.col("is_fork"), True).alias("fork"),
    )
    return s.select(F.to_json(F.struct(*extra, stamp("starred_at").alias("starred_at"), repo.alias("repo"))).alias("value"))


def source_folders(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """(folder): a source tree below root, a file for each text that is not empty and a folder for each 1,000 documents.

    Tasks write the files; one that runs again writes the same ones.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = set()
            for x in batch.to_pylist():
                store, base = fs.FileSystem.from_uri(x["folder"])
                if base not in made:
                    store.create_dir(base, recursive=True)
                    made.add(base)
                with store.open_output_stream(f"{base}/doc-{x['doc_id']}.txt") as out:
                    out.write(x["text"].encode() + b"\n")
        yield pa.RecordBatch.from_pydict({"none": pa.array([], pa.int64())})

    folder = F.concat(F.lit(f"{root}/docs-"), F.floor(F.col("doc_id") / 1000).cast("string"))
    docs = load(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", folder.alias("folder"))
    docs.mapInArrow(run, "none long").write.format("noop").mode("overwrite").save()
    return docs.select("folder").distinct()


#: Documents whose envelopes make one file of a feed, some 60 MB.
FEED_ROWS = 30_000


def feed_files(spark: SparkSession, sf_dir: str) -> int:
    """Files of a third of the feed; their size does not grow with the tables."""
    return max(1, -(-load(spark, sf_dir, "documents").count() // (3 * FEED_ROWS)))


def write_feed(spark: SparkSession, sf_dir: str, feed: DataFrame, folder: str) -> int:
    """Write the envelopes of star rows as compressed files, by the tasks that have the rows; returns the number of files of a third of them."""
    most = -(-load(spark, sf_dir, "documents").count() // (3 * feed_files(spark, sf_dir)))
    envelopes(spark, sf_dir, feed, ("user_id",)).write.option("maxRecordsPerFile", max(1, most)).option("compression", "gzip").text(folder)
    return max(1, -(-len(spark.read.text(folder).inputFiles()) // 3))


def trimmed(column: str) -> Column:
    return text.trim(F.col(column))


#: The same tables in DuckDB SQL. Maps are one column per locale, vectors lists of doubles.
VIEWS = """
WITH base AS (SELECT d.*, coalesce(l.toxic, 0) AS toxic, list_filter(string_split(d.text, ' '), lambda x: length(x) % 7 = 3) AS words,
    d.source || '/doc-' || d.doc_id AS name FROM documents d LEFT JOIN labels l USING (doc_id)),
stars AS (SELECT doc_id + 1 AS id, name AS full_name, 'https://example.org/' || name AS html_url, source AS owner_login,
    CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 1 THEN '异步 ' || text
      WHEN doc_id % 19 = 2 THEN 'Среда ' || text ELSE text END AS description,
    CASE WHEN doc_id % 5 = 0 THEN []::VARCHAR[] ELSE [lang, source] END AS topics,
    CASE WHEN doc_id % 11 <> 0 THEN lang END AS language,
    TIMESTAMP '2024-01-01' + to_seconds((doc_id * 104729) % 2592000) AS starred_at,
    CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds((doc_id * 1601939) % 2592000) END AS pushed_at,
    n_chars AS stargazers_count, toxic = 1 AS archived, doc_id % 9 = 0 AS is_fork, doc_id % 8 = 0 AS deep_indexed,
    CASE WHEN doc_id % 8 = 0 THEN TIMESTAMP '2024-01-15' END AS last_deep_indexed_at,
    CASE WHEN doc_id % 4 = 0 THEN []::VARCHAR[] ELSE words END AS ai_tags,
    CASE WHEN doc_id % 7 = 0 THEN '译 ' || text END AS desc_zh,
    CASE WHEN doc_id % 6 = 0 THEN '标签, ' || array_to_string(words, ' ,') END AS tags_zh,
    CASE WHEN doc_id % 10 = 0 THEN 'note ' || doc_id END AS user_note FROM base),
user_stars AS (SELECT p.user_id, s.* FROM (SELECT DISTINCT user_id, event_id % (SELECT count(*) FROM documents) + 1 AS id FROM events) p JOIN stars s USING (id)),
existing AS (SELECT (id - 1) % 5 AS user_id, * FROM stars WHERE (id - 1) % 10 <> 7),
fresh AS (SELECT (id - 1) % 5 AS user_id, * REPLACE (stargazers_count + 1 AS stargazers_count, []::VARCHAR[] AS ai_tags, NULL::VARCHAR AS user_note,
    false AS deep_indexed, NULL::VARCHAR AS desc_zh, NULL::VARCHAR AS tags_zh, NULL::TIMESTAMP AS last_deep_indexed_at) FROM stars),
incoming AS (SELECT * FROM fresh WHERE (id - 1) % 9 <> 3 UNION ALL SELECT * REPLACE (id + 999999 AS id) FROM fresh WHERE id <= 20),
cursors AS (SELECT user_id, CASE WHEN user_id <> 3 THEN TIMESTAMP '2024-01-10' END AS since, count(*) AS known_count,
    CASE user_id WHEN 1 THEN TIMESTAMP '2024-01-20' WHEN 2 THEN TIMESTAMP '2024-01-24' WHEN 3 THEN TIMESTAMP '2024-01-30'
      WHEN 4 THEN TIMESTAMP '2024-01-23 23:59:59' END AS last_full_sync_at FROM existing GROUP BY user_id),
modes AS (SELECT *, CASE WHEN last_full_sync_at IS NULL OR TIMESTAMP '2024-01-31' - last_full_sync_at > INTERVAL 7 DAY THEN 'full' ELSE 'incremental' END AS mode FROM cursors),
star_vectors AS (SELECT 'star:' || (vec_id + 1) AS id, 'star' AS kind, vec_id + 1 AS star_id, CASE WHEN vec_id % 50 = 0 THEN 'm0' ELSE 'm1' END AS model,
    embedding::DOUBLE[] AS vector, NULL::VARCHAR AS path, NULL::INTEGER AS start_line, NULL::INTEGER AS end_line FROM embeddings),
code_vectors AS (SELECT 'code:' || star_id || ':src/a.py:0' AS id, 'code' AS kind, star_id, model, vector, CASE WHEN star_id % 3 <> 0 THEN 'src/a.py' END AS path,
    CASE WHEN star_id % 3 <> 0 THEN 1 END AS start_line, CASE WHEN star_id % 3 <> 0 THEN 10 END AS end_line FROM star_vectors WHERE (star_id - 1) % 7 = 0),
vectors AS (SELECT * FROM star_vectors UNION ALL SELECT * FROM code_vectors),
tree AS (SELECT page_id % 10 AS repo_id, page_id AS pos, ['src/', 'lib/', 'tests/', 'node_modules/', 'docs/', ''][page_id % 6 + 1] || 'p' || page_id || ['.py', '.ts', '.md', '.rs'][page_id % 4 + 1] AS path,
    CASE WHEN page_id % 25 = 0 THEN 'tree' ELSE 'blob' END AS type, length(html) AS size FROM pages),
replies AS (SELECT conv_id + 1 AS star_id, turn, CASE WHEN turn % 2 = 0 THEN 'Tags: ' || text ELSE text END AS reply FROM conversations WHERE role = 'assistant'),
call_log AS (SELECT event_id AS ord, user_id AS star_id, [200, 401, 429, 504, 500, 400, 413, 200][event_id % 8 + 1] AS http_status FROM events)
"""
