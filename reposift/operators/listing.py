"""Listing, filtering, sorting and counting stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposift.functions import text
from reposift.session import workspace

#: Tag chips shown at most.
TAG_FACETS = 40
#: Repositories proposed for deep indexing.
DEEP_CANDIDATES = 3
NO_LANGUAGE = "(none)"
ORDERS = ("starred_at", "pushed_at", "stargazers_count")


def language(column: str = "language") -> Column:
    return F.coalesce(F.col(column), F.lit(NO_LANGUAGE))


def _list_order(by: str, descending: bool) -> list[Column]:
    """Null is the oldest; ties by id in the same direction."""
    if by not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}")
    return [F.desc_nulls_last(by), F.desc("id")] if descending else [F.asc_nulls_first(by), F.asc("id")]


def list_stars(stars: DataFrame, by: str = "starred_at", descending: bool = True, offset: int = 0, limit: int | None = None, drop_null_keys: bool = False) -> DataFrame:
    """One page of all stars in order. drop_null_keys leaves out rows without the order column."""
    rows = stars.where(F.col(by).isNotNull()) if drop_null_keys else stars
    page = rows.orderBy(*_list_order(by, descending)).offset(offset)
    return page if limit is None else page.limit(limit)


def list_by_user(stars: DataFrame, by: str = "starred_at", descending: bool = True, offset: int = 0, limit: int | None = None, drop_null_keys: bool = False) -> DataFrame:
    """The same page for every user, with its position in the user's list from 1 on."""
    rows = stars.where(F.col(by).isNotNull()) if drop_null_keys else stars
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*_list_order(by, descending)))
    ranked = rows.withColumn("position", place)
    return ranked.where((F.col("position") > offset) & (F.lit(True) if limit is None else F.col("position") <= offset + limit))


def manage_filter(stars: DataFrame, hide_archived: bool = True, hide_forks: bool = True, only_language: str | None = None) -> DataFrame:
    keep = F.lit(True)
    if hide_archived:
        keep &= ~F.col("archived")
    if hide_forks:
        keep &= ~F.col("is_fork")
    if only_language:
        keep &= language() == only_language
    return stars.where(keep)


def haystack(locale: str = "en") -> Column:
    """The lower-case text that a search looks in; missing parts are empty, so the spacing is always the same."""
    none = F.lit("")
    cached = lambda m: none if locale == "en" else F.coalesce(F.try_element_at(m, F.lit(locale)), none)
    parts = ["full_name", F.coalesce("description", none), cached(F.col("description_i18n")), F.array_join("ai_tags", " "), cached(F.col("ai_tags_i18n"))]
    return F.lower(F.concat(*(x for k, p in enumerate(parts) for x in ([F.lit(" ")] if k else []) + [F.col(p) if isinstance(p, str) else p])))


def text_search(stars: DataFrame, query: str, locale: str = "en") -> DataFrame:
    """Stars whose names, descriptions or tags contain the trimmed query in any letter case; a blank query finds all."""
    wanted = F.lower(text.trim(F.lit(query)))
    return stars.where((wanted == "") | F.contains(haystack(locale), wanted))


def folded(tag: Column) -> Column:
    return F.lower(text.trim(tag))


def tag_filter(stars: DataFrame, tags: list[str]) -> DataFrame:
    """Stars that have all of the tags, letter case and outer spaces aside."""
    if not tags:
        return stars
    wanted = F.array(*(folded(F.lit(t)) for t in tags))
    return stars.where(F.size(F.array_except(wanted, F.transform("ai_tags", folded))) == 0)


def display_text(locale: str) -> Column:
    return text.localized(F.col("description_i18n"), F.col("description"), locale)


def display_tags(locale: str) -> Column:
    cached = F.try_element_at("ai_tags_i18n", F.lit(locale))
    return F.col("ai_tags") if locale == "en" else F.when(text.present(cached), text.split_list(cached)).otherwise(F.col("ai_tags"))


def deep_candidates(stars: DataFrame, n: int = DEEP_CANDIDATES) -> DataFrame:
    """Each user's most starred repositories that are not indexed, archived or forks."""
    rows = stars.where("NOT deep_indexed AND NOT archived AND NOT is_fork")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("stargazers_count"), "id"))
    return rows.withColumn("position", place).where(F.col("position") <= n)


def split_name(stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with owner and repo, and those whose name is not owner/repo."""
    parts = F.split("full_name", "/")
    good = F.coalesce((F.size(parts) >= 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != ""), F.lit(False))
    named = stars.withColumns({"owner": F.get(parts, F.lit(0)), "repo": F.get(parts, F.lit(1))})
    return named.where(good), stars.where(~good)


def language_facets(stars: DataFrame) -> DataFrame:
    """(language, n) in order: most stars, then the newest star, then the name."""
    counts = stars.groupBy(language().alias("language")).agg(F.count("*").alias("n"), F.max("starred_at").alias("newest"))
    return counts.orderBy(F.desc("n"), F.desc("newest"), "language").select("language", "n")


def tag_facets(stars: DataFrame, n: int = TAG_FACETS) -> DataFrame:
    """(tag, n) of the n most frequent tags: occurrences, spelt as in the newest star; ties by the folded tag.

    Counts and the time of the newest star are kept for all tags, as they are spelt, and each spelling
    is folded once; only rows of the newest stars of the n that are shown are compared with each other.
    """
    age = F.coalesce(-F.unix_micros("starred_at"), F.lit(-(1 << 63)))  # without a time: as if newest
    spelt = stars.select(age.alias("age"), F.explode("ai_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.min("age").alias("age"))
    spelt = spelt.withColumn("key", folded(F.col("tag"))).where("key <> ''")
    shown = spelt.groupBy("key").agg(F.sum("n").alias("n"), F.min("age").alias("age")).orderBy(F.desc("n"), "key").limit(n)
    # Spellings of the shown tags' newest stars alone: about n rows are sent.
    wanted = spelt.select("tag", "key", "age").join(F.broadcast(shown), ["key", "age"])
    tags = stars.select("id", age.alias("age"), F.posexplode("ai_tags").alias("pos", "tag")).join(F.broadcast(wanted), ["tag", "age"])
    first = F.min_by(text.trim(F.col("tag")), F.struct("id", "pos"))
    return tags.groupBy("key").agg(F.first("n").alias("n"), first.alias("tag")).orderBy(F.desc("n"), "key").select("tag", "n")


def status_counts(stars: DataFrame, vectors: DataFrame, needs: Column, by: str = "user_id") -> DataFrame:
    """Per user: known, untagged, deep_indexed, untranslated (by the needs column) and indexed, the stars with a vector of their own."""
    own = vectors.where("kind = 'star'").select(F.col("star_id").alias("id"), F.lit(True).alias("__vector")).distinct()
    return stars.join(own, "id", "left").groupBy(by).agg(
        F.count("*").alias("known"),
        F.count_if(F.size("ai_tags") == 0).alias("untagged"),
        F.count_if("deep_indexed").alias("deep_indexed"),
        F.count_if(needs).alias("untranslated"),
        F.count_if("__vector").alias("indexed"),
    )


def coverage(stars: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: known, indexed and all_rows (star vectors, and code vectors too), the percentages of both, and whether the index lacks stars."""
    counts = stars.agg(F.count("*").alias("known")).crossJoin(vectors.agg(F.count_if(F.col("kind") == "star").alias("indexed"), F.count("*").alias("all_rows")))
    share = lambda n: F.when(F.col("known") > 0, F.floor(F.col(n) * 100 / F.col("known") + 0.5).cast("long"))
    return counts.select("*", share("indexed").alias("percent"), share("all_rows").alias("percent_all_rows"), ((F.col("known") > 0) & (F.col("indexed") < F.col("known"))).alias("needs_rebuild"))


def kind_counts(hits: DataFrame) -> DataFrame:
    """(kind, n) with a row for all hits together."""
    return hits.rollup("kind").count().select(F.coalesce("kind", F.lit("all")).alias("kind"), F.col("count").alias("n"))


def manage_order(by: str, descending: bool = True, relevance: str = "relevance", unscored_last: bool = False) -> list[Column]:
    """Sort keys: null dates always last; rows without relevance are lowest, so first in ascending order, unless unscored_last."""
    if by == "relevance":
        score = F.coalesce(relevance, F.lit(float("-inf")))
        keys = [F.col(relevance).isNull()] if unscored_last else []
        return [*keys, F.desc(score) if descending else F.asc(score), F.asc("id")]
    return [F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), F.asc("id")]


def places(rows: DataFrame, order: list[Column], by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """rows with place, from 1 on, in the order within each group of by (all rows together if by is empty). The order must be total.

    Rows are dealt by ranges of (by, order), so that a user with very many
    stars is shared out too; a table of one row per range and user then gives
    the place of each range's first row.
    """
    keys = [F.col(x) for x in by]
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # Written, so that counting and numbering see the same ranges, lost executors or not.
    numbered = ordered.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    folder = workspace(rows.sparkSession)
    numbered.write.parquet(folder)
    held = rows.sparkSession.read.schema(numbered.schema).parquet(folder)
    spans = held.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select("__part", *by, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    return held.join(starts, ["__part", *by]).withColumn("place", F.col("__at") + F.col("__shift") + 1).drop("__part", "__at", "__shift")


def failed_names(failed: DataFrame, stars: DataFrame, shown: int = 3) -> DataFrame:
    """One row: names of the first failed stars (by ord) and how many more there are."""
    first = failed.orderBy("ord", "id").limit(shown).join(stars.select("id", "full_name"), "id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "full_name"))).alias("names"))
    names = F.array_join(F.transform("names", lambda x: x["full_name"]), ", ")
    more = F.greatest(F.col("n") - shown, F.lit(0))
    tail = F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit("…"))).otherwise("")
    return first.crossJoin(failed.agg(F.count("*").alias("n"))).select(F.concat(names, tail).alias("failed"))


def missing_keys(bundles: DataFrame, base: str = "en") -> DataFrame:
    """(locale, key) of the base locale's keys that another locale lacks. bundles: locale, key."""
    locales = bundles.select("locale").where(F.col("locale") != base).distinct()
    wanted = bundles.where(F.col("locale") == base).select("key").distinct()
    return wanted.crossJoin(locales).select("locale", "key").join(bundles, ["locale", "key"], "left_anti")
