import datetime as dt

import pytest
from pyspark.sql import functions as F

from reposift.functions import text
from reposift.functions import vectors as V


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("__")).select(column).first()[0]


def test_trim_covers_unicode_spaces(spark):
    assert one(spark, text.trim(F.lit("﻿　 a b\t "))) == "a b"
    assert one(spark, text.truncate(F.lit("abcd   efgh"), 8)) == "abcd…"
    assert one(spark, text.truncate(F.lit("abcd"), 4)) == "abcd"


@pytest.mark.parametrize(("minutes", "want"), [(0, "just now"), (-5, "just now"), (1, "1m ago"), (59, "59m ago"), (60, "1h ago"), (1439, "23h ago"), (1440, "1d ago"), (30 * 1440 - 1, "29d ago"), (30 * 1440, "2024-01-01")])
def test_relative_time(spark, minutes, want):
    now = dt.datetime(2024, 1, 31)
    then = now - dt.timedelta(minutes=minutes)
    assert one(spark, text.relative_time(F.lit(str(then)).cast("timestamp"), F.lit(str(now)).cast("timestamp"), F.lit("?"))) == want


@pytest.mark.parametrize(("tag", "want"), [(None, "en"), ("", "en"), ("zh-HK", "zh-CN"), ("ZH-tw", "zh-TW"), ("pt", "pt-BR"), ("de-AT", "de"), ("xx", "en")])
def test_detect_locale(spark, tag, want):
    assert one(spark, text.detect_locale(F.lit(tag).cast("string"))) == want


def djb2(value, seed):
    h = seed
    units = value.encode("utf-16-le")
    for k in range(0, len(units), 2):
        h = ((h * 33) & 0xFFFFFFFF) ^ int.from_bytes(units[k : k + 2], "little")
    return format(h, "x")


@pytest.mark.parametrize("value", ["", "a", "Hello, world", "日本語", "emoji 😀 and 𝒳", "x" * 3000])
def test_djb2_over_utf16_units(spark, value):
    assert one(spark, text.djb2(F.lit(value))) == djb2(value, 5381)
    assert one(spark, text.djb2(F.lit(value), 5382)) == djb2(value, 5382)


def test_fill_template_does_not_fill_values_again(spark):
    values = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("2"))
    assert one(spark, text.fill_template(F.lit("{a} {b}{c} {"), values)) == "{b} 2{c} {"


def test_put_key_replaces(spark):
    old = F.create_map(F.lit("de"), F.lit("x"), F.lit("fr"), F.lit("y"))
    assert one(spark, text.put_key(old, "de", F.lit("z"))) == {"de": "z", "fr": "y"}


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0))
    assert one(spark, V.cosine(a, b)) == pytest.approx(1)
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    empty = F.array().cast("array<double>")
    assert one(spark, V.cosine(empty, empty)) == 0
    with pytest.raises(Exception, match="lengths 2 and 1"):
        one(spark, V.cosine(a, F.array(F.lit(1.0))))


def test_mean_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 3.0])], "u int, v array<double>")
    assert {r.u: r.m for r in df.groupBy("u").agg(V.mean_vector(F.col("v")).alias("m")).collect()} == {1: [0.5, 0.5], 2: [3.0, 3.0]}
    with pytest.raises(Exception, match="(?i)dimension|unequal"):
        df.union(spark.createDataFrame([(1, [1.0])], df.schema)).groupBy("u").agg(V.mean_vector(F.col("v"))).collect()


def test_djb2_of_many_texts_at_once(monkeypatch):
    monkeypatch.setattr(text, "LONG_UNITS", 300)
    monkeypatch.setattr(text, "MATRIX_UNITS", 700)
    values = [None, "", "a", "中🎉é" * 20, "x" * 299, "y" * 5000, *(chr(97 + k % 26) * k for k in range(60))]
    assert text.djb2_units(values, 5381) == [None if v is None else djb2(v, 5381) for v in values]
    assert text.djb2_units([], 1) == []
