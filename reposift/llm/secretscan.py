"""Secrets in texts: patterns, and character Markov models of random strings and ordinary identifiers.

Spark expressions only. Three patterns give the base spans; strings of value
characters that no pattern takes are scored by the model: the log-likelihood
ratio of each pair of neighbouring characters under a Markov model of random
strings and one of ordinary identifiers. The stretch of the string with the
largest sum is a secret where that reaches THRESHOLD.

Both models are trained from labelled samples. Random: RANDOM digests in each
of five notations, and the keys that the patterns find in the sampled texts.
Ordinary: the other strings of the sampled texts (those of the SAMPLE smallest
hashes of ids), each character repeated, and the alphabet in order. What is
collected is one whole number for each pair of characters.

Spans are found without positions from the engine: a text is split at all
matches, and running sums of the lengths of pieces and matches give the places.

Defined results: null and empty texts have no spans; each row is judged on its
own; an empty table is trained on the made strings alone and gives no rows; of
the given columns the id, the text and the kept ones are read. Texts that
repeat a sampled id are all in the sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of values, in the order of their numbers in the model.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?({VALUE}+)"""
#: Runs of these characters are maximal, so a least length in the pattern drops the same matches as a test afterwards.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 8
#: Characters of a string, and of its likely stretch, that the model judges.
LEAST_TOKEN, LEAST_STRETCH = 20, 16
TOKEN = f"{VALUE}{{{LEAST_TOKEN},}}"
#: Thousandths of the natural logarithm of the ratio.
THRESHOLD = 20_000
#: Texts that the ordinary strings come from at most, and random strings of each notation.
SAMPLE, RANDOM = 4096, 2000
#: Running sums are taken in groups of so many.
GROUP = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _short_sums(numbers: Column) -> Column:
    zero = F.array().cast("array<int>")
    step = lambda done, x: F.concat(done, F.array((F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x).cast("int")))
    return F.aggregate(numbers, zero, step)


def running_sums(numbers: Column) -> Column:
    """The sums of an array's first 1, 2, ... numbers: within groups, then over the groups, so that long arrays stay cheap."""

    def grouped(all_of: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(all_of), F.lit(1)), F.lit(GROUP))
        groups = F.transform(firsts, lambda k: _short_sums(F.slice(all_of, k, F.lit(GROUP))))
        return _let(groups, lambda g: _let(_short_sums(F.transform(g, lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(0)))), lambda t: F.flatten(F.transform(g, lambda x, k: F.transform(x, lambda y: (y + F.coalesce(F.get(t, k - 1), F.lit(0))).cast("int"))))))

    return _let(numbers, grouped)


def matches(text: Column, pattern: str, value: int = 0) -> Column:
    """Array of (start, end, value) of the pattern's matches, in code points from 0, end exclusive; value is the group."""
    regex = F.lit(pattern)

    def placed(found: Column) -> Column:
        # The piece before each match, and the match, in turn; what follows the last match is not needed.
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda piece, x: F.length(piece) + F.length(x))
        spans = F.zip_with(running_sums(steps), found, lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("value")))
        if not value:
            return spans
        return F.zip_with(spans, F.regexp_extract_all(text, regex, F.lit(value)), lambda s, x: F.struct(s["start"].alias("start"), s["end"].alias("end"), x.alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.rlike(text, regex), _let(F.regexp_extract_all(text, regex, F.lit(0)), placed)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, end, value) by kind: assignments to secret names, access keys, long hexadecimal strings."""
    return {
        "assign": F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= LEAST_VALUE),
        "access": matches(text, ACCESS),
        "hex": matches(text, HEX),
    }


def _samples(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(value, random, n): labelled strings and how often they occur."""
    spark = docs.sparkSession
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    last = docs.select(order.alias("__order")).orderBy("__order").limit(SAMPLE).agg(F.max("__order")).first()[0]
    chosen = docs.where(order <= F.lit(last)).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    ordinary = chosen.select(F.explode(F.regexp_extract_all(plain, F.lit(f"{VALUE}{{2,}}"), F.lit(0))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    keys = chosen.select(F.explode(F.concat(*(F.regexp_extract_all("text", F.lit(x), F.lit(0)) for x in (ACCESS, HEX)))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    short = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    made = spark.range(RANDOM).select(F.explode(F.array(F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)), short, F.upper(short), F.lower(short))).alias("value"))
    rulers = spark.range(len(ALPHABET)).select(F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") + 1).cast("int"), F.lit(1)), F.lit(400)).alias("value"))
    ordered = spark.range(1).select(F.repeat(F.lit(ALPHABET[:62]), F.lit(20)).alias("value"))
    label = lambda rows, random: rows.select("value", F.lit(random).alias("random"), "n")
    once = lambda rows: rows.withColumn("n", F.lit(1).cast("long"))
    return label(ordinary, False).unionByName(label(keys, True)).unionByName(label(once(made), True)).unionByName(label(once(rulers.unionByName(ordered)), False))


def _numbers(value: Column) -> Column:
    """The characters' numbers in ALPHABET, from 0."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _pairs(value: Column) -> Column:
    """The number of each pair of neighbouring characters."""
    return _let(_numbers(value), lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a * len(ALPHABET) + b))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[int]:
    """For each pair of characters, by its number, the log-likelihood ratio of the two models in thousandths."""
    width = len(ALPHABET)
    counted = _samples(docs, key, text).where(F.length("value") >= 2).select("random", "n", F.explode(_pairs(F.col("value"))).alias("pair"))
    counts = counted.groupBy("pair").agg(*(F.sum(F.when(F.col("random") == flag, F.col("n"))).alias(name) for name, flag in (("r", True), ("o", False))))
    every = docs.sparkSession.range(width * width).select(F.col("id").cast("int").alias("pair"))
    cells = every.join(counts, "pair", "left").select("pair", F.floor(F.col("pair") / width).alias("first"), *(F.coalesce(x, F.lit(0)).alias(x) for x in "ro"))
    totals = cells.groupBy("first").agg(*(F.sum(x).alias(f"{x}_all") for x in "ro"))
    chance = lambda x: (F.col(x) + 0.5) / (F.col(f"{x}_all") + 0.5 * width)
    ratio = F.round((F.log(chance("r")) - F.log(chance("o"))) * 1000).cast("int")
    rows = cells.join(totals, "first").select("pair", ratio.alias("ratio")).collect()
    return [r.ratio for r in sorted(rows, key=lambda r: r.pair)]


def likely_stretch(value: Column, ratios: list[int]) -> Column:
    """(score, lo, hi) of the string's stretch with the largest sum of ratios; of equal ones the first to end, then the shortest."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")  # folded to one literal
    zero = F.struct(*(F.lit(0).alias(x) for x in ("at", "sum", "begin", "score", "lo", "hi")))

    def step(done: Column, pair: Column) -> Column:
        fresh = done["sum"] <= 0
        begin = F.when(fresh, done["at"]).otherwise(done["begin"])
        total = (F.when(fresh, F.lit(0)).otherwise(done["sum"]) + F.get(table, pair)).cast("int")
        return _let(
            F.struct((done["at"] + 1).alias("at"), total.alias("sum"), begin.alias("begin")),
            lambda x: F.struct(
                x["at"].alias("at"), x["sum"].alias("sum"), x["begin"].alias("begin"), F.greatest(x["sum"], done["score"]).alias("score"),
                *(F.when(x["sum"] > done["score"], now).otherwise(done[name]).alias(name) for name, now in (("lo", x["begin"]), ("hi", x["at"] + 1))),
            ),
        )

    return F.aggregate(_pairs(value), zero, step, lambda x: F.struct(x["score"].alias("score"), x["lo"].alias("lo"), x["hi"].alias("hi")))


def find_secrets(docs: DataFrame, ratios: list[int], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with assign, access, hex and markov: arrays of (start, end, value).

    The model judges strings of LEAST_TOKEN value characters that hold no key of
    the patterns and do not end a match of the first one.
    """
    given = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    spans = base_spans(F.col("__text"))
    base = given.select(*keep, "__text", *(x.alias(f"__{kind}") for kind, x in spans.items()))
    taken = F.transform("__assign", lambda x: x["end"])
    free = F.filter(matches(F.col("__text"), TOKEN), lambda x: ~F.rlike(x["value"], F.lit(f"{ACCESS}|{HEX}")))
    tokens = base.select(*keep, *(f"__{kind}" for kind in spans), _let(taken, lambda ends: F.filter(free, lambda x: ~F.array_contains(ends, x["end"]))).alias("__tokens"))

    def judged(x: Column) -> Column:
        found = lambda s: F.struct(s["score"].alias("score"), (x["start"] + s["lo"]).alias("start"), (x["start"] + s["hi"]).alias("end"), F.substring(x["value"], s["lo"] + 1, s["hi"] - s["lo"]).alias("value"))
        return _let(likely_stretch(x["value"], ratios), found)

    likely = F.filter(F.transform("__tokens", judged), lambda x: (x["score"] >= THRESHOLD) & (x["end"] - x["start"] >= LEAST_STRETCH))
    secret = F.transform(likely, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return tokens.select(*keep, *(F.col(f"__{kind}").alias(kind) for kind in spans), secret.alias("markov"))


def listed(kinds: tuple[str, ...]) -> Column:
    """All spans of the kinds as kind:start:end by start, then kind, joined by commas."""
    mark = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    marked = [F.transform(kind, mark(k)) for k, kind in enumerate(kinds)]
    names = F.array(*(F.lit(x) for x in kinds))
    text = lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.concat(*marked)), text), ",")


def digests(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs, train(docs))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans"), counts[3])


def oracle() -> str:
    quote = lambda x: x.replace("'", "''")
    high = 1 << 40  # keeps sums positive, as // rounds towards zero
    width, keys = len(ALPHABET), quote(f"{ACCESS}|{HEX}")

    def spans(name: str, pattern: str, value: int = 0) -> str:
        pattern = quote(pattern)
        return f"""{name}_found AS (SELECT doc_id, k, length(pieces[k]) AS before, whole[k] AS whole, found[k] AS value FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS pieces,
  regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {value}) AS found FROM texts) t, unnest(range(1, len(whole) + 1)) AS r(k)),
{name} AS (SELECT doc_id, k, "end" - length(whole) AS start, "end", value FROM (SELECT *, sum(before + length(whole)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS "end" FROM {name}_found))"""

    number = lambda c: f"instr('{ALPHABET}', {c}) - 1"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{spans("assigns", ASSIGN, 2)},
assign AS (SELECT * FROM assigns WHERE length(value) >= {LEAST_VALUE}),
{spans("access", ACCESS)},
{spans("hex", HEX)},
{spans("token", TOKEN)},
chosen AS (SELECT text FROM texts WHERE md5(doc_id::VARCHAR) <= (SELECT max(m) FROM (SELECT md5(doc_id::VARCHAR) AS m FROM documents ORDER BY m LIMIT {SAMPLE}))),
digest AS (SELECT sha256('random ' || i) AS d, replace(to_base64(unhex(sha256('random ' || i))), '=', '') AS b FROM range({RANDOM}) AS r(i)),
samples AS (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '{quote(ASSIGN)}', ' ', 'g'), '{keys}', ' ', 'g'), '{VALUE}{{2,}}')) AS value, false AS random FROM chosen
  UNION ALL SELECT unnest(regexp_extract_all(text, '{ACCESS}')), true FROM chosen UNION ALL SELECT unnest(regexp_extract_all(text, '{HEX}')), true FROM chosen
  UNION ALL SELECT unnest([d[1:40], upper(d[1:40]), b, upper(b), lower(b)]), true FROM digest
  UNION ALL SELECT repeat('{ALPHABET}'[i + 1], 400), false FROM range({width}) AS r(i) UNION ALL SELECT repeat('{ALPHABET[:62]}', 20), false),
grouped AS (SELECT value, random, count(*) AS n FROM samples GROUP BY ALL),
paired AS (SELECT random, n, ({number("value[i]")}) * {width} + {number("value[i + 1]")} AS pair FROM grouped, unnest(range(1, length(value))) AS r(i)),
counts AS (SELECT pair, sum(n) FILTER (WHERE random) AS r, sum(n) FILTER (WHERE NOT random) AS o FROM paired GROUP BY pair),
cells AS (SELECT p AS pair, p // {width} AS first, coalesce(r, 0) AS r, coalesce(o, 0) AS o FROM range({width * width}) AS x(p) LEFT JOIN counts ON pair = p),
ratios AS (SELECT pair, round((ln((r + 0.5::DOUBLE) / (sum(r) OVER w + {0.5 * width}::DOUBLE)) - ln((o + 0.5::DOUBLE) / (sum(o) OVER w + {0.5 * width}::DOUBLE))) * 1000)::BIGINT AS ratio FROM cells WINDOW w AS (PARTITION BY first)),
free AS (SELECT t.* FROM token t ANTI JOIN assign a ON a.doc_id = t.doc_id AND a."end" = t."end" WHERE NOT regexp_matches(value, '{keys}')),
steps AS (SELECT doc_id, k, start, 0 AS i, 0 AS ratio FROM free UNION ALL
  SELECT doc_id, k, start, i, ratio FROM (SELECT *, ({number("value[i]")}) * {width} + {number("value[i + 1]")} AS pair FROM free, unnest(range(1, length(value))) AS r(i)) JOIN ratios USING (pair)),
sums AS (SELECT doc_id, k, start, i, sum(ratio) OVER (PARTITION BY doc_id, k ORDER BY i)::BIGINT AS s FROM steps),
lows AS (SELECT *, min((s + {high}) * 1048576 - i) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS low FROM sums),
scored AS (SELECT doc_id, start, i, s + {high} - (low + 1048575) // 1048576 AS score, (low + 1048575) // 1048576 * 1048576 - low AS lo, k FROM lows WHERE i > 0),
best AS (SELECT doc_id, k, arg_min({{'a': start + lo, 'b': start + i + 1, 'n': i + 1 - lo, 'score': score}}, (-score, i)) AS x FROM scored GROUP BY doc_id, k),
markov AS (SELECT doc_id, x.a AS start, x.b AS "end" FROM best WHERE x.score >= {THRESHOLD} AND x.n >= {LEAST_STRETCH}),
spans AS (SELECT doc_id, 0 AS kind, 'assign' AS name, start, "end" FROM assign UNION ALL SELECT doc_id, 1, 'access', start, "end" FROM access
  UNION ALL SELECT doc_id, 2, 'hex', start, "end" FROM hex UNION ALL SELECT doc_id, 3, 'markov', start, "end" FROM markov),
told AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind = 3) AS n_markov,
  string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_markov, 0) AS n_markov, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN told USING (doc_id)"""
