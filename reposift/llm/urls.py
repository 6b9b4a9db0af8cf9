"""URL filter: host and path rules first, then a weighted vocabulary.

The vocabulary is searched with an Aho-Corasick automaton, once over all urls of
a batch. A term counts only where no letter or digit stands directly before or
after it (beyond ASCII everything counts as a letter); percent-encoded letters, digits and hyphens count as themselves. One
strict term, or SOFT_LIMIT distinct soft terms, blocks the url.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import unused

# The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Terms of which one hit blocks.
STRICT = (
    "adult", "bestiality", "blowjob", "camgirl", "camgirls", "casino", "casinos", "cheap-pills", "cialis", "cryptojacking", "cumshot", "darknet", "deepfake-porn", "doorway",
    "dildo", "erotic", "erotica", "erotik", "escort", "escorts", "exploit-kit", "fetish", "free-bets", "fuck", "hardcore-sex", "hentai", "hookup", "incest", "keygen", "keylogger",
    "levitra", "link-farm", "livesex", "malware", "masturbation", "milf", "naked", "nude", "nudes", "nsfw", "onlyfans", "orgasm", "payday-loans", "phentermine", "phishing",
    "playboy", "poker", "porn", "porno", "pornhub", "pornstar", "pussy", "ransomware", "replica-watches", "roulette", "scam", "sex", "sexcam", "sexo", "sexshop", "sexy", "slots",
    "slut", "spam", "spam-farm", "sportsbook", "spyware", "strip-club", "striptease", "swingers", "torrent-crack", "tramadol", "trojan", "viagra", "vibrator", "warez", "webcam-sex",
    "whore", "xanax", "xvideos", "xxx",
)
# Terms that block when SOFT_LIMIT of them occur.
SOFT = (
    "ads", "affiliate", "amateur", "babes", "banner", "bet", "bets", "betting", "bingo", "bitcoin", "blackjack", "bonus", "cam", "cash", "cheap", "click", "clickbait", "coupon",
    "coupons", "crack", "credit", "dating", "deal", "deals", "diet", "discount", "download", "earn", "fake", "farm", "followers", "forex", "free", "gamble", "gambling", "girls",
    "hack", "hot", "jackpot", "kiss", "lingerie", "loan", "loans", "lottery", "lotto", "lucky", "mature", "miracle", "money", "offer", "offers", "paid", "partner", "payday", "pharmacy",
    "pill", "pills", "popup", "popunder", "prize", "prizes", "promo", "redirect", "replica", "rich", "sale", "serial", "singles", "slot", "sponsored", "spin", "sweepstakes", "teen",
    "toplist", "torrent", "track", "tracker", "traffic", "unlimited", "vip", "voucher", "wager", "weight-loss", "win", "winner", "x",
)
SOFT_LIMIT = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path as text; both empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


@lru_cache(4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    """Finds the number (soft terms first) and length of each term."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for number, term in enumerate((*soft, *strict)):
        found.add_word(term, (number, len(term)))
    found.make_automaton()
    return found


ENCODED = re.compile(r"%(2d|3[0-9]|[46][1-9a-f]|[57][0-9a])")


def plain(urls: str) -> str:
    """Urls with A-Z lowered and percent-encoded letters, digits and hyphens decoded once."""
    low = urls.translate(str.maketrans(UPPER, LOWER))
    return ENCODED.sub(lambda m: chr(int(m[1], 16)).lower(), low) if "%" in low else low


def count_hits(urls: list[str], strict: tuple[str, ...], soft: tuple[str, ...]) -> np.ndarray:
    """Numbers of distinct strict and soft terms that stand alone in each url (urls x 2); one pass of the automaton over all of them."""
    text = plain("\n".join(x.replace("\n", " ") for x in urls))
    found = [(end, number, size) for end, (number, size) in automaton(strict, soft).iter(text)]
    if not found:
        return np.zeros((len(urls), 2), np.int32)
    end, number, size = np.array(found, np.int64).T
    chars = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    word = ((chars >= 48) & (chars <= 57)) | ((chars >= 97) & (chars <= 122)) | (chars >= 128)
    alone = ~word[end + 2] & ~word[end - size + 1]
    row = np.searchsorted(np.flatnonzero(chars == 10), end + 1)  # line breaks before the hit
    once = np.unique(np.stack((row, number), 1)[alone], axis=0)
    return np.stack([np.bincount(once[(once[:, 1] < len(soft)) == is_soft, 0], minlength=len(urls)) for is_soft in (False, True)], 1).astype(np.int32)


def score_urls(df: DataFrame, url: str = "url", strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> DataFrame:
    """Add n_strict and n_soft, the distinct terms of either list that stand alone in the url.

    A null or empty url has none. Terms are lower-case; A-Z of the url are
    lowered. Input columns of the new names are replaced, all rows and other
    columns stay; an empty table gives an empty table.
    """
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("n_strict int, n_soft int")
    def count(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in urls:
            yield pd.DataFrame(count_hits(part.fillna("").tolist(), strict, soft), columns=["n_strict", "n_soft"])

    hits = unused(df, "hits")
    return df.withColumn(hits, count(F.col(url))).withColumns({"n_strict": F.col(f"{hits}.n_strict"), "n_soft": F.col(f"{hits}.n_soft")}).drop(hits)


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Add host, path, rule, n_strict, n_soft and verdict (allow or block).

    A rule fits its host and all subdomains if the url's path starts with the
    rule's path. The longest fitting rule decides; without one, the vocabulary
    does. Null urls and urls without :// have empty host and path, fit no rule
    and are judged by the vocabulary. Input columns of the new names are replaced.
    """
    host, path = split_url(F.col(url))
    scored = score_urls(df.drop("host", "path", "rule", "verdict"), url, strict, soft).withColumns({"host": host, "path": path})
    rule, decision = F.lit(None).cast("string"), F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(start)
        rule, decision = F.when(fits, at + start).otherwise(rule), F.when(fits, verdict).otherwise(decision)
    return scored.withColumns({"rule": rule, "verdict": decision})


def oracle() -> str:
    terms = lambda words: "[" + ", ".join(f"'{x}'" for x in words) + "]"
    count = lambda words: f"len(list_filter({terms(words)}, lambda t: regexp_matches(low, '(^|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])' || t || '($|[^a-z0-9\\x{{80}}-\\x{{10FFFF}}])')))"
    fits = lambda at, start: f"((host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{start}'))"
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(a, p)} THEN '{a}{p}'" for _, a, p in ranked)
    verdict = " ".join(f"WHEN {fits(a, p)} THEN '{v}'" for v, a, p in ranked)
    # Letters before digits, so that nothing is decoded twice.
    codes = "[" + ", ".join(f"'{x:02x}'" for x in (*range(0x7A, 0x60, -1), *range(0x5A, 0x40, -1), 0x2D, *range(0x30, 0x3A))) + "]"
    return f"""
WITH cut AS (
  SELECT page_id, list_reduce({codes}, lambda x, c: replace(x, '%' || c, lower(chr(('0x' || c)::INTEGER))), translate(coalesce(url, ''), '{UPPER}', '{LOWER}')) AS low,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
counted AS (SELECT *, {count(STRICT)} AS n_strict, {count(SOFT)} AS n_soft FROM parts)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM counted"""

