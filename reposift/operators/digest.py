"""The digest: what changed lately and is close to each user's interests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposift.functions import text
from reposift.functions import vectors as V
from reposift.operators import keys

RELEVANCE_WEIGHT, RECENCY_WEIGHT = 0.8, 0.2
WINDOW_DAYS, LIMIT = 7, 10
DAY_MS = 86_400_000


def check(window_days: float, limit: int) -> None:
    if window_days <= 0:
        raise ValueError("window_days must be over 0")
    if limit < 1:
        raise ValueError("limit must be 1 at least")


def settings_rules() -> dict[str, Column]:
    """The same for a table of settings, one row per user (window_days, limit): each rule's name and whether a row keeps it."""
    return {"window_days": F.col("window_days") > 0, "limit": F.col("limit") >= 1}


def profiles(stars: DataFrame, vectors: DataFrame, scope: str = "star") -> DataFrame:
    """(user_id, profile): the mean vector of each user's stars. scope 'all' lets code vectors count too."""
    rows = vectors if scope == "all" else vectors.where("kind = 'star'")
    joined = stars.select("user_id", "id").join(rows.select(F.col("star_id").alias("id"), "vector"), "id")
    return joined.groupBy("user_id").agg(V.mean_vector(F.col("vector")).alias("profile"))


def star_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vector): one vector per star, its own before those of its code."""
    return vectors.groupBy(F.col("star_id").alias("id")).agg(F.max_by("vector", "id").alias("vector"))


def _window_ms(window_days: float | Column) -> Column:
    return (window_days if isinstance(window_days, Column) else F.lit(float(window_days))) * DAY_MS


def is_candidate(now: Column, window_days: float | Column = WINDOW_DAYS) -> Column:
    """Not archived, no fork, and pushed to strictly after the window's start."""
    age = F.unix_millis(now) - F.unix_millis("pushed_at")
    return ~F.col("archived") & ~F.col("is_fork") & F.coalesce(age < _window_ms(window_days), F.lit(False))


def recency(pushed_at: Column, now: Column, window_days: float | Column = WINDOW_DAYS) -> Column:
    """1 at or after now, 0 from the window's length on, linear between."""
    age = F.unix_millis(now) - F.unix_millis(pushed_at)
    share = F.lit(1.0) - age / _window_ms(window_days)
    return F.when(age <= 0, F.lit(1.0)).when(age >= _window_ms(window_days), F.lit(0.0)).otherwise(share)


def scored(stars: DataFrame, vectors: DataFrame, now: Column, window_days: float | Column = WINDOW_DAYS, scope: str = "star") -> DataFrame:
    """Candidates with vector (null if there is none), relevance, recency and score."""
    rows = vectors if scope == "all" else vectors.where("kind = 'star'")
    candidates = stars.where(is_candidate(now, window_days)).join(star_vectors(rows), "id", "left")
    relevance = V.cosine(F.col("profile"), F.col("vector"))
    both = candidates.join(profiles(stars, vectors, scope), "user_id")
    ranked = both.withColumns({"relevance": F.when(F.col("vector").isNotNull(), relevance), "recency": recency(F.col("pushed_at"), now, window_days)})
    return ranked.withColumn("score", RELEVANCE_WEIGHT * F.col("relevance") + RECENCY_WEIGHT * F.col("recency")).drop("profile")


def digest(stars: DataFrame, vectors: DataFrame, now: Column, window_days: float = WINDOW_DAYS, limit: int = LIMIT, scope: str = "star") -> DataFrame:
    """Each user's best entries with rank: score, then the latest push, then id."""
    check(window_days, limit)
    rows = scored(stars, vectors, now, window_days, scope).where("vector IS NOT NULL").drop("vector")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("pushed_at"), "id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= limit)


def digest_from(stars: DataFrame, vectors: DataFrame, kept: DataFrame, now: Column, window_days: float = WINDOW_DAYS, limit: int = LIMIT, scope: str = "star") -> DataFrame:
    """digest() with profiles that are kept (user_id, profile; see profile_state): vectors of candidates alone are moved."""
    check(window_days, limit)
    rows = vectors if scope == "all" else vectors.where("kind = 'star'")
    candidates = stars.where(is_candidate(now, window_days))
    wanted = keys.keep(rows, candidates.select(F.col("id").alias("star_id")), "star_id")
    both = candidates.join(star_vectors(wanted), "id").join(kept, "user_id")
    ranked = both.withColumns({"relevance": V.cosine(F.col("profile"), F.col("vector")), "recency": recency(F.col("pushed_at"), now, window_days)}).drop("profile", "vector")
    scores = ranked.withColumn("score", RELEVANCE_WEIGHT * F.col("relevance") + RECENCY_WEIGHT * F.col("recency"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("pushed_at"), "id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= limit)


def digest_by_settings(stars: DataFrame, vectors: DataFrame, settings: DataFrame, now: Column, scope: str = "star") -> DataFrame:
    """digest() with each user's own window_days and limit; users without settings get the usual ones. settings: rows that keep settings_rules()."""
    own = settings.select("user_id", F.col("window_days").cast("double").alias("__window"), F.col("limit").alias("__limit"))
    users = stars.join(own, "user_id", "left").withColumns({"__window": F.coalesce("__window", F.lit(float(WINDOW_DAYS))), "__limit": F.coalesce("__limit", F.lit(LIMIT))})
    rows = scored(users, vectors, now, F.col("__window"), scope).where("vector IS NOT NULL").drop("vector")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("pushed_at"), "id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= F.col("__limit")).drop("__window", "__limit")


def digest_stats(stars: DataFrame, vectors: DataFrame, now: Column, window_days: float = WINDOW_DAYS, scope: str = "star") -> DataFrame:
    """One row per user: ranked candidates, candidates without vector, and whether the user has no profile (then both are 0)."""
    rows = vectors if scope == "all" else vectors.where("kind = 'star'")
    known = rows.select(F.col("star_id").alias("id"), F.lit(True).alias("__vector")).distinct()
    joined = stars.withColumn("__candidate", is_candidate(now, window_days)).join(known, "id", "left")
    counts = joined.groupBy("user_id").agg(
        F.count_if(F.col("__candidate") & F.col("__vector")).alias("ranked"),
        F.count_if(F.col("__candidate") & F.col("__vector").isNull()).alias("unembedded"),
        (F.count_if("__vector") == 0).alias("profile_empty"),
    )
    return counts.withColumn("unembedded", F.when(F.col("profile_empty"), 0).otherwise(F.col("unembedded")))


def repo_lines(first: str, topics: str) -> list[Column]:
    """The lines of a prompt that describe a repository; missing parts have none."""
    line = lambda label, value: F.when(text.present(value), F.concat(F.lit(label), value))
    return [
        F.concat(F.lit(first), F.col("full_name")),
        line("Language: ", F.col("language")),
        line("Description: ", F.col("description")),
        F.when(F.size("topics") > 0, F.concat(F.lit(topics), F.array_join("topics", ", "))),
    ]


def summary_prompt(relevance: Column) -> Column:
    tags = F.when(F.size("ai_tags") > 0, F.concat(F.lit("Tags: "), F.array_join("ai_tags", ", ")))
    share = F.concat(F.lit("Relevance to your interest profile: "), F.floor(relevance * 100 + 0.5).cast("long").cast("string"), F.lit("%"))
    return F.concat_ws("\n", *repo_lines("Repo: ", "GitHub topics: "), tags, share)


def summary_system_prompt(locale: str = "en") -> str:
    """Instruction for the model; an unknown locale is treated as English."""
    lines = ["You look at a bookmarked repository that changed lately."]
    if locale != "en" and locale in text.LOCALE_NAMES:
        lines.append(f"Answer in {text.LOCALE_NAMES[locale]} ({locale}); leave technical names as they are.")
    lines.append("Say in one or two sentences why it matters to its reader, with facts about this repository only. Answer with the sentences alone.")
    return "\n".join(lines)


def attach_summaries(entries: DataFrame, replies: DataFrame, keys: tuple[str, ...] = ("user_id", "id")) -> DataFrame:
    """entries with summary, the trimmed reply; blank, failed or missing replies leave null."""
    found = replies.select(*keys, F.nullif(text.trim(F.col("reply")), F.lit("")).alias("summary"))
    return entries.join(found, list(keys), "left")
