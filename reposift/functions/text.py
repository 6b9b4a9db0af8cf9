"""Column helpers for text. Lengths count code points."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers trim it: ASCII, no-break, byte-order mark and the Unicode spaces and line ends.
WS = r"[\s\x0B ﻿  -     　]"
#: A character that is none of these.
INK = WS.replace("[", "[^", 1)

# Interface locales in order of preference.
LOCALES = ("en", "zh-CN", "zh-TW", "ja", "ko", "de", "fr", "es", "pt-BR", "ru", "vi")
# How prompts name a locale.
LOCALE_NAMES = {
    "en": "English", "zh-CN": "简体中文", "zh-TW": "繁體中文", "ja": "日本語", "ko": "한국어", "de": "Deutsch",
    "fr": "Français", "es": "Español", "pt-BR": "Português brasileiro", "ru": "Русский", "vi": "Tiếng Việt",
}

#: Code units of a text that is hashed together with others, and of such a group.
LONG_UNITS, MATRIX_UNITS = 8192, 1 << 21
#: Bytes of the texts that a task unpacks at a time.
SLICE_BYTES = 4 << 20


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+\z", "")


def has_ink(text: Column) -> Column:
    """Whether anything is left when the text is trimmed; looks no further than the first such character."""
    return F.coalesce(F.regexp_like(text, F.lit(INK)), F.lit(False))


def present(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def truncate(text: Column, n: int) -> Column:
    """At most n code points; a cut text ends in an ellipsis."""
    return F.when(F.length(text) > n, F.concat(trim_end(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def relative_time(then: Column, now: Column, unparsed: Column) -> Column:
    """Compact age: just now, minutes, hours, days, and from 30 days on the date; unparsed where then is null."""
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(F.floor(minutes / 60) / 24)
    aged = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(then.isNull(), unparsed)
        .when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, aged(minutes, "m"))
        .when(hours < 24, aged(hours, "h"))
        .when(days < 30, aged(days, "d"))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def detect_locale(tag: Column) -> Column:
    """The locale of a language tag: the exact one, else the first of the same language, else en."""
    low = F.lower(tag)
    out = F.when(~present(tag), F.lit("en"))
    for locale in LOCALES:
        out = out.when(low == locale.lower(), F.lit(locale))
    language = F.substring_index(low, "-", 1)
    for locale in LOCALES:
        out = out.when(language == locale.lower().split("-")[0], F.lit(locale))
    return out.otherwise(F.lit("en"))


def fill_template(template: Column, values: Column) -> Column:
    """{name} replaced by values[name] (a map); unknown names stay as they are, and values are not filled again."""
    parts = F.split(template, r"(?=\{\w+\})")

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"^\{(\w+)\}", 1)
        value = F.try_element_at(values, name)
        return F.when((name != "") & value.isNotNull(), F.concat(value, F.substr(part, F.length(name) + 3))).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def djb2_units(texts: list[str | None], seed: int) -> list[str | None]:
    """The hash of djb2() of many texts: a step a column of their code units over all texts that are so long; very long texts one by one."""
    units = [None if t is None else np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    size = np.array([-1 if u is None else len(u) for u in units])
    state = np.full(len(texts), seed & 0xFFFFFFFF, np.uint32)
    for k in np.flatnonzero(size > LONG_UNITS).tolist():
        h = seed
        for u in units[k].tolist():
            h = (h * 33 & 0xFFFFFFFF) ^ u
        state[k] = h
    order = np.flatnonzero((size >= 0) & (size <= LONG_UNITS))
    order = order[np.argsort(-size[order], kind="stable")]
    # Texts of like length share a matrix, a column of which is one step; it is padded to the longest.
    lo = 0
    while lo < len(order):
        width = max(1, int(size[order[lo]]))
        own = order[lo : lo + max(1, MATRIX_UNITS // width)]
        matrix = np.zeros((width, len(own)), np.uint32)
        for c, k in enumerate(own.tolist()):
            matrix[: size[k], c] = units[k]
        h, falling = state[own], -size[own]
        for row in range(width):
            n = int(np.searchsorted(falling, -row, "left"))
            if not n:
                break
            h[:n] = (h[:n] * np.uint32(33)) ^ matrix[row, :n]
        state[own] = h
        lo += len(own)
    return [None if n < 0 else f"{h:x}" for h, n in zip(state.tolist(), size.tolist(), strict=True)]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in stretches of about SLICE_BYTES, so that few are Python values at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for lo, hi in pairwise(cuts):
        yield texts.slice(lo, hi - lo)


def djb2(text: Column, seed: int = 5381) -> Column:
    """32-bit xor variant of the djb2 hash over UTF-16 units, in lower-case hexadecimal.

    For equality with hashes that are stored already; new jobs use xxhash64,
    as 32 bits are too few for large tables.
    """

    @F.arrow_udf("string")
    def hashed(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(texts):
            out += djb2_units(part.to_pylist(), seed)
        return pa.array(out, pa.string())

    return hashed(text)


def localized(by_locale: Column, original: Column, locale: str) -> Column:
    """The cached text of the locale if there is one and the locale is not English, else the original."""
    if locale == "en":
        return original
    cached = F.try_element_at(by_locale, F.lit(locale))
    return F.when(present(cached), cached).otherwise(original)


def split_list(text: Column) -> Column:
    """Parts of a text between commas and line ends, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, r"[,\n]"), trim), lambda x: x != "")


def put_key(by_locale: Column, key: str | Column, value: Column) -> Column:
    """The map with one key set."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.map_concat(F.map_filter(by_locale, lambda k, _: k != key), F.create_map(key, value))
