"""Table schemas, column owners and default values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_text, _long, _time, _flag = T.StringType(), T.LongType(), T.TimestampType(), T.BooleanType()
_texts, _by_locale = T.ArrayType(_text), T.MapType(_text, _text)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Columns that a pull overwrites.
UPSTREAM = (
    "id", "full_name", "html_url", "owner_login", "owner_avatar_url", "description", "topics", "language",
    "starred_at", "pushed_at", "stargazers_count", "default_branch", "archived", "is_fork", "last_synced_at",
)
#: Columns that a pull never touches.
LOCAL = (
    "ai_tags", "ai_summary", "user_note", "last_embedded_at", "subscribed_to_releases", "deep_indexed",
    "description_i18n", "ai_summary_i18n", "ai_tags_i18n", "last_translated_at", "last_deep_indexed_at",
)

STAR = _struct(
    schema_version=T.IntegerType(), id=_long, full_name=_text, html_url=_text, owner_login=_text, owner_avatar_url=_text,
    description=_text, topics=_texts, language=_text, starred_at=_time, pushed_at=_time, stargazers_count=_long,
    default_branch=_text, archived=_flag, is_fork=_flag, last_synced_at=_time,
    ai_tags=_texts, ai_summary=_text, user_note=_text, last_embedded_at=_time, subscribed_to_releases=_flag,
    deep_indexed=_flag, description_i18n=_by_locale, ai_summary_i18n=_by_locale, ai_tags_i18n=_by_locale,
    last_translated_at=_time, last_deep_indexed_at=_time,
)

CURSOR = _struct(etag=_text, since=_time, known_count=_long, updated_at=_time, last_full_sync_at=_time)

VECTOR = _struct(
    id=_text, kind=_text, star_id=_long, path=_text, chunk_index=T.IntegerType(), start_line=T.IntegerType(),
    end_line=T.IntegerType(), chunk_kind=_text, header_line=_text, snippet=_text, content_hash=_text, model=_text,
    embedded_at=_time, vector=T.ArrayType(T.FloatType()), norm=T.DoubleType(),
)

ENVELOPE = _struct(
    starred_at=_text,
    repo=_struct(
        id=_long, full_name=_text, name=_text, html_url=_text, owner=_struct(login=_text, avatar_url=_text),
        description=_text, topics=_texts, language=_text, pushed_at=_text, stargazers_count=_long,
        default_branch=_text, archived=_flag, fork=_flag,
    ),
)

TREE = _struct(
    sha=_text, url=_text, truncated=_flag,
    tree=T.ArrayType(_struct(path=_text, mode=_text, type=_text, sha=_text, size=_long, url=_text)),
)

CONTENTS = _struct(type=_text, encoding=_text, size=_long, path=_text, content=_text)


def defaults() -> dict[str, Column]:
    """Value of each column that a row may lack."""
    no_text, no_texts = F.lit(None).cast("string"), F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,string>")
    false, never = F.lit(False), F.lit(None).cast("timestamp")
    return {
        "schema_version": F.lit(1), "owner_avatar_url": no_text, "topics": no_texts, "default_branch": F.lit("main"),
        "archived": false, "is_fork": false, "subscribed_to_releases": false, "deep_indexed": false,
        "last_deep_indexed_at": never, "ai_tags": no_texts, "ai_summary": no_text, "user_note": no_text,
        "last_embedded_at": never, "description_i18n": empty, "ai_summary_i18n": empty, "ai_tags_i18n": empty,
        "last_translated_at": never,
    }


def with_defaults(stars: DataFrame) -> DataFrame:
    """Fill defaults: old files may lack columns, and rows values."""
    have = set(stars.columns)
    return stars.withColumns({k: F.coalesce(F.col(k), v) if k in have else v for k, v in defaults().items()})
