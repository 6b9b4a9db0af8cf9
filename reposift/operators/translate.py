"""Which texts need translation, and translations from model replies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift.functions import text

MAX_LENGTH = 1200
# Code points that show a text to be in the locale's script already.
SCRIPTS = {
    "zh-CN": r"[一-鿿]", "zh-TW": r"[一-鿿]", "ja": r"[぀-ゟ゠-ヿ一-鿿]",
    "ko": r"[가-힯]", "ru": r"[Ѐ-ӿ]", "vi": r"[À-ỹ]",
}
# What models put before a translation.
PREFIXES = (
    r"Sure[,]?\s*here(?:'s| is)\s*(?:the\s*)?(?:translation|translated\s*text)",
    r"Here(?:'s| is)\s*(?:the\s*)?(?:translation|translated\s*text)",
    "Translation", "Translated", "Result", "Output",
    "翻译(?:结果|内容|后(?:的)?(?:内容|文本)?)?", "翻譯(?:結果|內容)?", "译文", "譯文", "翻訳(?:結果)?",
    "Traduction", "Übersetzung", "Перевод", "Traducción", "번역", "Bản dịch",
)
# Words of a note that models add in brackets.
NOTE_WORDS = ("kept", "left", "preserved", "untranslated", "brand", "as in source", "original", "protected", "保留", "因为", "不译", "原文")
# Marks of emphasis, links and code, each with what stays of it.
MARKS = (
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"__([^_\n]+)__", "$1"),
    (r"(?<![\w*])\*([^*\n]+)\*(?!\w)", "$1"),
    (r"(?<![\w_])_([^_\n]+)_(?!\w)", "$1"),
    (r"`([^`\n]+)`", "$1"),
)
# Quotes that may wrap a whole reply.
QUOTES = (('"', '"'), ("'", "'"), ("`", "`"), ("「", "」"), ("『", "』"), ("《", "》"))


def in_script(value: Column, locale: str) -> Column:
    """Whether the text holds a letter of the locale's script; false for locales without one, null and empty texts."""
    return F.coalesce(F.regexp_like(value, F.lit(SCRIPTS[locale])), F.lit(False)) if locale in SCRIPTS else F.lit(False)


def _needs(has_text: Column, by_locale: Column, value: Column, locale: str) -> Column:
    cached = text.present(F.try_element_at(by_locale, F.lit(locale)))
    return F.lit(False) if locale == "en" else has_text & ~cached & ~in_script(value, locale)


def has_description() -> Column:
    return text.has_ink(F.col("description"))


def description_needs(locale: str) -> Column:
    return _needs(has_description(), F.col("description_i18n"), F.col("description"), locale)


def tags_need(locale: str) -> Column:
    return _needs(F.size("ai_tags") > 0, F.col("ai_tags_i18n"), F.array_join("ai_tags", " "), locale)


def star_needs(locale: str) -> Column:
    return description_needs(locale) | tags_need(locale)


def plan(stars: DataFrame, locale: str, also_tags: bool = True, force: bool = False) -> DataFrame:
    """stars with plan (no_source, translate, backfill or skip) and what may be filled in without a model: backfill_description, backfill_tags."""
    tags = (F.size("ai_tags") > 0) & F.lit(also_tags)
    empty = lambda m: ~text.present(F.try_element_at(m, F.lit(locale)))
    fill = F.lit(locale != "en" and not force)
    fill_description = fill & has_description() & empty(F.col("description_i18n")) & in_script(F.col("description"), locale)
    fill_tags = fill & tags & empty(F.col("ai_tags_i18n")) & in_script(F.array_join("ai_tags", " "), locale)
    wanted = F.lit(True) if force else description_needs(locale) | (tags_need(locale) & F.lit(also_tags))
    step = F.when(~has_description() & ~tags, "no_source").when(wanted, "translate").when(fill_description | fill_tags, "backfill").otherwise("skip")
    return stars.withColumns({"plan": step, "backfill_description": fill_description, "backfill_tags": fill_tags})


def backfill(planned: DataFrame, locale: str, at: Column) -> DataFrame:
    """The planned stars with the source texts in the locale's cache where the plan says so."""
    put = lambda flag, column, value: F.when(F.col(flag), text.put_key(F.col(column), locale, value)).otherwise(F.col(column))
    any_fill = F.col("backfill_description") | F.col("backfill_tags")
    return planned.withColumns({
        "description_i18n": put("backfill_description", "description_i18n", F.col("description")),
        "ai_tags_i18n": put("backfill_tags", "ai_tags_i18n", F.array_join("ai_tags", ", ")),
        "last_translated_at": F.when(any_fill, at).otherwise(F.col("last_translated_at")),
    })


def system_prompt(locale: str, what: str = "description") -> str:
    if locale not in text.LOCALE_NAMES:
        raise ValueError(f"unknown locale {locale}")
    task = "the description of a code repository" if what == "description" else "the comma-separated tags of a code repository, in their order,"
    return f"Translate {task} into {text.LOCALE_NAMES[locale]} ({locale}). Leave technical names as they are. Answer with the translation alone."


def prompts(stars: DataFrame, locale: str) -> DataFrame:
    """stars with the system and user prompts of description and tags."""
    return stars.withColumns({
        "description_system": F.lit(system_prompt(locale)), "description_user": F.col("description"),
        "tags_system": F.lit(system_prompt(locale, "tags")), "tags_user": F.array_join("ai_tags", ", "),
    })


def _unquoted(value: Column) -> Column:
    """The text without a pair of quotes around it; a quote of the same kind inside means they are no pair."""
    inner = F.substr(value, F.lit(2), F.length(value) - 2)
    first, last = F.substring(value, 1, 1), F.substr(value, F.length(value), F.lit(1))
    out = value
    for a, b in reversed(QUOTES):
        wraps = (F.length(value) >= 2) & (first == a) & (last == b)
        out = F.when(wraps & ~F.contains(inner, F.lit(a)) if a == b else wraps, inner).otherwise(out)
    return out


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_translation(reply: Column) -> Column:
    """The translation in a reply: no label before it, first paragraph only, no note in brackets after it, no marks, no outer quotes; null if nothing or over MAX_LENGTH is left."""
    space = text.WS
    label = "(?iu)^(?:" + "|".join(x.replace(r"\s", space) for x in PREFIXES) + f"){space}*[:：]{space}*"
    peeled = reduce(lambda x, _: text.trim(F.regexp_replace(x, label, "")), range(4), text.trim(reply))
    paragraph = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, rf"(?s)^(.+?)\n{space}*\n", 1), F.lit("")), x)
    first = _bound(peeled, paragraph)
    note = rf"(?iu){space}*[(（][^()（）]*(?:{'|'.join(NOTE_WORDS)})[^()（）]*[)）]{space}*\z"
    plain = reduce(lambda x, m: F.regexp_replace(x, *m), MARKS, F.regexp_replace(first, note, ""))
    done = text.trim(_bound(plain, _unquoted))
    return _bound(done, lambda x: F.when((x != "") & (F.length(x) <= MAX_LENGTH), x))


def outcome(description_status: Column, tags_status: Column, planned: Column) -> Column:
    """What a run's report counts a star as; tags are only tried where the description is done or was cached."""
    return (
        F.when(planned == "no_source", "no_source")
        .when(planned != "translate", "skipped")
        .when(description_status == "failed", "failed")
        .when(tags_status == "failed", "tags_failed")
        .otherwise("translated")
    )
