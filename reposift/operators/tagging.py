"""Tags from model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift.functions import text
from reposift.operators import digest

MAX_TAGS, MAX_TAG_LENGTH = 5, 40
SYSTEM_PROMPT = "Give three to five short tags for the repository below: its purpose, field and techniques. Answer with the tags alone, separated by commas."


def untagged(stars: DataFrame, force: bool = False) -> DataFrame:
    return stars if force else stars.where(F.size("ai_tags") == 0)


def tag_prompt() -> Column:
    return F.concat_ws("\n", *digest.repo_lines("Repo: ", "GitHub topics: "))


def clean_tag(part: Column) -> Column:
    """A part of a reply without bullet or number, quotes and end punctuation."""
    bare = F.regexp_replace(text.trim(part), rf"^(?:[-*•]|\d+[.)]){text.WS}*", "")
    unquoted = F.regexp_replace(bare, "^[\"'`]+|[\"'`]+\\z", "")
    return text.trim(F.regexp_replace(unquoted, r"[.!?;:]+\z", ""))


def distinct_tags(tags: Column) -> Column:
    """Tags without repetitions, letter case aside; the first spelling stays."""
    none = F.array().cast("array<string>")
    fold = lambda a: F.transform(a, lambda x: F.lower(x))
    return F.aggregate(tags, none, lambda kept, t: F.when(F.array_contains(fold(kept), F.lower(t)), kept).otherwise(F.concat(kept, F.array(t))))


def parse_tags(reply: Column) -> Column:
    """At most MAX_TAGS tags of a reply; empty for null or blank ones. A label counts only at the very first character."""
    body = text.trim(F.regexp_replace(reply, rf"(?i)^(?:Tags|Output|Result){text.WS}*:{text.WS}*", ""))
    parts = F.transform(F.split(body, r"[,\n]"), clean_tag)
    fit = F.filter(parts, lambda x: (x != "") & (F.length(x) <= MAX_TAG_LENGTH))
    return F.coalesce(F.slice(distinct_tags(fit), 1, MAX_TAGS), F.array().cast("array<string>"))


def tag_patches(replies: DataFrame, keys: tuple[str, ...] = ("user_id", "id")) -> tuple[DataFrame, DataFrame]:
    """(keys, ai_tags) to be patched in, and the replies that gave no tag."""
    parsed = replies.withColumn("ai_tags", parse_tags(F.col("reply")))
    return parsed.where(F.size("ai_tags") > 0).select(*keys, "ai_tags"), parsed.where(F.size("ai_tags") == 0).drop("ai_tags")
