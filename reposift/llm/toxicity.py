"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into classes: insult, threat, target, negation,
reported speech. Insults are words and word stems learned from labelled
documents beside a short fixed list, the other classes are fixed lists. Four small
transducers read the classes of a clause: insult, threat and target give
each insult and threat a weight, more where it is aimed at somebody; negation and
reported speech scale what they cover down. They are composed into one machine, a
table of states by classes, whose arcs carry the product of the weights. Running
it over a clause sums the weights of its path: the clause's score. A document's
score is a logistic function of its clauses' scores, fitted on the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposift.llm.common import checkpointed, prefix_hash, span_hash, text_blocks, unused

#: Labelled rows, by hash order, from which lexicon and weights are learned.
LEARN_ROWS = 24_000
#: Toxic sample documents, and different words before it in them, that an insult needs.
SUPPORT, CONTEXTS = 12, 8
#: Times likelier in toxic documents than in others.
LIFT = 10.0
#: Times likelier that give an insult its full strength.
SURE = 60.0
#: Units that a task counts before it passes them on.
HELD_UNITS = 60_000
#: Letters (as UTF-8 bytes) of a stem.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

# Insults known without labels.
INSULTS = (
    "idiot", "idiots", "idiotic", "imbecile", "moron", "morons", "moronic", "stupid", "dimwit", "halfwit", "cretin", "bastard", "scumbag", "dumbass", "asshole",
    "dummkopf", "trottel", "vollidiot", "schwachkopf", "arschloch", "connard", "imbécile", "crétin", "abruti", "salaud", "enculé",
    "idiota", "estupido", "estúpido", "imbécil", "gilipollas", "cabrón", "pendejo",
)
# Verbs of threats.
THREATS = (
    "kill", "hurt", "destroy", "beat", "burn", "shoot", "murder", "strangle", "stab", "töten", "schlagen", "ermorden", "umbringen", "erschießen", "verprügeln",
    "tuer", "frapper", "tuerai", "assassiner", "matar", "golpear", "mataré", "asesinar",
)
# Whom a clause is aimed at.
TARGETS = ("you", "your", "yours", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "vous", "votre", "ton", "usted", "ti", "te", "vosotros")
# Negations.
NEGATIONS = ("not", "no", "never", "nobody", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "ningún")
# Words that bring in the speech of others.
REPORTS = ("said", "says", "called", "quoted", "wrote", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASSES = 6
#: Weight of an insult or threat: plain, aimed at somebody, and what a negation or a reporting verb before it leaves.
PLAIN, AIMED, NEGATED, REPORTED = (1.0, 0.4), (1.6, 1.6), 0.25, 0.25
#: Words after a negation that it still covers.
SCOPE = 3
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
BREAK = np.zeros(256, bool)
BREAK[[ord(x) for x in ".!?;:\n"]] = True


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Model:
    """Hashes of insult words and stems with their strengths (up to 1), and the weights of the features."""

    words: dict[int, float]
    stems: dict[int, float]
    weights: tuple[float, ...]


def text_hash(text: str) -> int:
    return _bytes_hash(text.encode())


def _bytes_hash(data: bytes) -> int:
    raw = np.frombuffer(data, np.uint8)
    return int(span_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of letters and digits; a run ends with its row."""
    own = WORD[raw]
    begins, stops = own.copy(), own.copy()
    begins[1:] &= ~own[:-1]
    stops[:-1] &= ~own[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner], stops[inner - 1] = own[inner], own[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


class Lexicon:
    """Strengths of hashes."""

    def __init__(self, strengths: dict[int, float]):
        self.known = np.array(sorted(strengths), np.uint64)
        self.strength = np.array([strengths[x] for x in sorted(strengths)] or [0.0])

    def __getitem__(self, values: np.ndarray) -> np.ndarray:
        """Strength of each value, 0 if unknown."""
        at = np.minimum(np.searchsorted(self.known, values), len(self.strength) - 1)
        return np.where(member(values, self.known), self.strength[at], 0.0)


@dataclass(frozen=True)
class Transducer:
    """A weighted machine: next[state, class], and what the arc weighs for insults and threats (states x classes x 2). It starts each clause in state 0."""

    next: np.ndarray
    weight: np.ndarray

    def __mul__(self, other: Transducer) -> Transducer:
        """Composition: both read the clause in step, and an arc weighs the product of both arcs."""
        n, m = len(self.next), len(other.next)
        follow = self.next[:, None] * m + other.next[None, :]
        weight = self.weight[:, None] * other.weight[None, :]
        return Transducer(follow.reshape(n * m, CLASSES), weight.reshape(n * m, CLASSES, 2))


def target_transducer() -> Transducer:
    """Insults and threats and whom they are aimed at. States: nothing yet, a target, an insult waiting for one, a threat waiting for one."""
    follow = np.tile(np.arange(4)[:, None], CLASSES)
    weight = np.zeros((4, CLASSES, 2))
    for k, kind in enumerate((INSULT, THREAT)):
        follow[[0, 2, 3], kind] = 2 + k
        weight[[0, 2, 3], kind, k] = PLAIN[k]
        weight[1, kind, k] = AIMED[k]
        weight[2 + k, TARGET, k] = AIMED[k] - PLAIN[k]  # the target comes after it
    follow[:, TARGET] = 1
    return Transducer(follow, weight)


def negation_transducer(left: float = NEGATED) -> Transducer:
    """States: how many of the next words a negation covers."""
    follow = np.tile(np.maximum(np.arange(SCOPE + 1) - 1, 0)[:, None], CLASSES)
    follow[:, NEGATION] = SCOPE
    return Transducer(follow, np.where(np.arange(SCOPE + 1) > 0, left, 1.0)[:, None, None] * np.ones((1, CLASSES, 2)))


def report_transducer(left: float = REPORTED) -> Transducer:
    """States: own words, and those after a reporting verb, up to the clause's end."""
    follow = np.tile(np.arange(2)[:, None], CLASSES)
    follow[:, REPORT] = 1
    return Transducer(follow, np.array([1.0, left])[:, None, None] * np.ones((1, CLASSES, 2)))


def composed(negated: float = NEGATED, reported: float = REPORTED) -> Transducer:
    return target_transducer() * negation_transducer(negated) * report_transducer(reported)


class Grammar:
    """The lexical transducer for one lexicon, and the composed machine."""

    def __init__(self, words: dict[int, float], stems: dict[int, float], machine: Transducer | None = None):
        known = lambda found: np.array(sorted(set(found)), np.uint64)
        self.lists = [(kind, known(map(text_hash, x))) for kind, x in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))]
        self.words, self.stems = Lexicon(words), Lexicon(stems)
        self.machine = machine or composed()

    def classes(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and how much the machine's weights count there: an insult's strength, else 1."""
        whole = span_hash(prefix, start, end)
        kinds, bad = np.zeros(len(start), np.int8), self.words[whole]
        for kind, known in self.lists:
            kinds[member(whole, known)] = kind
        if len(self.stems.known):
            for n in STEMS:
                long = np.flatnonzero(end - start >= n)
                bad[long] = np.maximum(bad[long], self.stems[span_hash(prefix, start[long], start[long] + n)])
        kinds[bad > 0] = INSULT
        return kinds, np.where(bad > 0, bad, 1.0)

    def clauses(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, scores) of the clauses that hold an insult or threat, scores being one column for each of the two, and the words of each row."""
        start, end, row = runs(raw, offsets)
        words = np.bincount(row, minlength=len(offsets) - 1)
        if not len(start):
            return row, np.zeros((0, 2)), words
        kinds, strength = self.classes(prefix_hash(raw), start, end)
        clause = np.concatenate(([0], np.cumsum(BREAK[raw])))[start] + row * np.int64(1 << 32)
        first = np.flatnonzero(np.diff(clause, prepend=-1))
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(clause))))
        hot = np.zeros(len(first), bool)
        hot[number[(kinds == INSULT) | (kinds == THREAT)]] = True
        # Words without a class only move the negation's scope on: those beyond it change nothing and are left out.
        at = np.arange(len(kinds))
        since = at - np.maximum.accumulate(np.where(kinds == NEGATION, at, -SCOPE - 1))
        read = np.flatnonzero(hot[number] & ((kinds != OTHER) | (since <= SCOPE)))
        return row[first[hot]], self.run(kinds[read], strength[read], np.searchsorted(number[read], np.flatnonzero(hot))), words

    def run(self, kinds: np.ndarray, strength: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Summed weights (insults, threats) of the machine's paths over the clauses that begin there; all clauses take each step together."""
        size = np.diff(np.append(begin, len(kinds)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state, total = np.zeros(len(begin), np.int64), np.zeros((len(begin), 2))
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, "left"))  # clauses longer than k
            at = begin[:n] + k
            kind = kinds[at]
            total[:n] += self.machine.weight[state[:n], kind] * strength[at, None]
            state[:n] = self.machine.next[state[:n], kind]
        out = np.zeros_like(total)
        out[order] = total
        return out


def features(row: np.ndarray, scores: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a document's score depends on: its strongest clause (up to 1), the sums of its clauses' scores for insults and threats, and their share of its words."""
    rows = len(words)
    best, sums = np.zeros(rows), np.zeros((rows, 2))
    np.maximum.at(best, row, np.minimum(scores.sum(1), 1))
    np.add.at(sums, row, scores)
    return np.column_stack((np.ones(rows), best, np.log1p(sums), np.sqrt(sums.sum(1) / np.maximum(words, 1))))


#: Weights of the features before any label is seen; the fit shrinks towards them, so that what the sample lacks keeps its weight.
PRIOR = (-3.0, 3.0, 1.0, 1.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton's method, shrunk towards PRIOR; the first one, the constant, hardly."""
    prior = np.array(PRIOR)
    w, shrink = prior.copy(), np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


TOKEN = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def _units(word: str) -> list[str]:
    """A word, and its stems marked with an asterisk, cut between characters."""
    raw = word.encode()
    stems = [raw[:n] for n in STEMS if len(raw) > n]
    return [word, *(x.decode() + "*" for x in stems if (x[-1] < 128 or len(x.decode("utf-8", "ignore").encode()) == len(x)))]


def sample(docs: DataFrame, labels: DataFrame, most: int = LEARN_ROWS) -> DataFrame:
    """(text, toxic) of at most that many labelled documents outside the held-out quarter, chosen by hash of their id."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    """(text, toxic) of all rows, a few hundred of them as Python values at a time."""
    for batch in batches:
        for lo in range(0, len(batch), 500):
            cut = batch.slice(lo, 500)
            yield from zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True)


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN_ROWS) -> Model:
    """Learn the insults and weights from a bounded sample of labelled rows (most of them).

    The driver gets one small row per sampled document, and the units that SUPPORT or more toxic documents
    of the sample hold and others hardly, however many these are. Labels without id, with an id that no
    document has, and null labels teach nothing; without toxic and other labels the weights are PRIOR.
    """
    rows = checkpointed(sample(docs, labels, most))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            counts = [pa.array([seen[k][x] for x in names], pa.int64()) for k in (1, 0)]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["unit", "bad", "good"])

        for text, toxic in _pairs(batches):
            seen[int(toxic == 1)].update({u for w in set(TOKEN.findall(text.lower())) for u in _units(w)})
            if len(seen[0]) + len(seen[1]) > HELD_UNITS:  # Spark adds up the parts
                yield flush()
        yield flush()

    total = {r["toxic"] == 1: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(True, 0), total.get(False, 0)
    lift = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    units = rows.mapInArrow(count, "unit string, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    likely = units.where((F.col("bad") >= SUPPORT) & (lift >= LIFT)).select("unit", lift.alias("lift"))
    likely = {r["unit"]: min(1.0, float(np.log(r["lift"]) / np.log(SURE))) for r in likely.collect()}

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()

        def flush() -> pa.RecordBatch:
            found = sorted(met)
            met.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["unit", "before"])

        for text, toxic in _pairs(batches):
            if toxic == 1:
                before = ""
                for word in TOKEN.findall(text.lower()):
                    met.update((u, before) for u in _units(word) if u in likely)
                    before = word
            if len(met) > HELD_UNITS:
                yield flush()
        yield flush()

    # Copies of one document repeat its words in one context; insults stand in many.
    varied = rows.mapInArrow(contexts, "unit string, before string").groupBy("unit").agg(F.count_distinct("before").alias("n")).where(F.col("n") >= CONTEXTS)
    found = {r["unit"]: likely[r["unit"]] for r in varied.collect()}
    stems = {text_hash(x[:-1]): y for x, y in found.items() if x.endswith("*")}
    words = {text_hash(x): y for x, y in found.items() if not x.endswith("*")} | {text_hash(x): 1.0 for x in INSULTS}
    model = Model(words, stems, PRIOR)
    table = _featured(rows, model).toPandas()
    if table.empty or not 0 < (table["toxic"] == 1).sum() < len(table):
        return model
    return Model(model.words, model.stems, tuple(fit(np.array(table["x"].tolist()), (table["toxic"] == 1).to_numpy(float)).tolist()))


def _featured(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, x): the features of each row of a sample."""
    words, stems = model.words, model.stems

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(words, stems)
        for batch in batches:
            for lo, hi, raw, offsets in text_blocks(batch.column(0), lower=True):
                x = features(*grammar.clauses(raw, offsets))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), lists], names=["toxic", "x"])

    return rows.select("text", "toxic").mapInArrow(run, f"toxic {rows.schema['toxic'].dataType.simpleString()}, x array<double>")


def score(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """df with the toxicity of each whole text, 0 to 1.

    Only the text is read. Null and empty texts get the score of a text without
    a match. All rows and columns stay, an input column named like score is
    replaced; an empty table gives an empty table.
    """
    kept = [f for f in df.schema.fields if f.name != score]
    schema = T.StructType([*kept, T.StructField(score, T.DoubleType())])
    names = [f.name for f in kept]
    weights = np.array(model.weights)
    words, stems = model.words, model.stems

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(words, stems)
        for batch in batches:
            for lo, hi, raw, offsets in text_blocks(batch.column(batch.schema.get_field_index(text)), lower=True):
                x = features(*grammar.clauses(raw, offsets)) @ weights
                cut = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(cut.column(cut.schema.get_field_index(k)) for k in names), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], names=[*names, score])

    return df.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic.

    Each row is judged by its own text: null and empty texts stay, repeated rows
    and rows without id stay or go like any other. All columns stay; an empty
    table stays empty.
    """
    column = unused(docs, "score")
    return score(docs, learn(docs, labels), score=column).where(F.col(column) < THRESHOLD).select(*docs.columns)


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    own = documents.select("doc_id", "text")
    scored = score(own, learn(own, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
