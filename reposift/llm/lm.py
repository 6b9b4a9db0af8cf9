"""Masked pseudo-likelihood scoring with a bidirectional window network.

Every word is predicted from the words on both sides of it, itself masked. Words
are counted over the whole corpus. The most frequent ones have a number of their
own, all others the number of their ending, which tells the network what kind of
word stands there. The network adds one table row per context place, applies
tanh, and predicts first a class of numbers, then the number in its class. Words
that share a number are told apart by their counts: a word's probability is its
number's by the network times the word's counted share of the number. The counts
are of single words, grow with the corpus and stay sharded in Spark.

Training is synchronous: documents are dealt into ROUNDS rounds by a hash, and in
each step tasks add up the gradient of all words of a round at the same weights,
Spark adds up the tasks, and the driver takes one Adam step. So what is learned
does not depend on how the input is partitioned. PASSES passes take every word of
every document as often.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposift.llm.common import prefix_hash, span_hash, stored, text_blocks, unused
from reposift.llm.toxicity import runs

#: Words with a number of their own, and numbers that words share by their ending.
FREQUENT, TAIL = 768, 256
WORDS = FREQUENT + TAIL
#: Bytes of a word's ending.
ENDING = 3
#: Numbers of one class; classes are cut by frequency.
CLASS = 32
CLASSES = WORDS // CLASS
#: Context places on each side, and hidden units.
SIDE, HIDDEN = 2, 24
#: Number that stands outside a document.
EDGE = WORDS
#: Steps of one pass, passes, and the size of the first steps (it falls to a tenth).
ROUNDS, PASSES, RATE = 16, 2, 0.1
#: Words that one numpy pass takes, and different words that a task counts before it passes them on.
CHUNK, HELD_WORDS = 1 << 13, 500_000
#: What a counted word is more than its count, and a word that was never counted in all.
UNSEEN = 0.5
#: Words after the frequent ones whose counts are sent to all tasks, so that no word of the join for the others is a hot key.
NEAR = 1 << 12
#: Weights in one row of what tasks send.
ROW = 1024


@dataclass(frozen=True)
class Shape:
    places: tuple[int, ...] = (*range(-SIDE, 0), *range(1, SIDE + 1))

    def parts(self) -> dict[str, tuple[int, ...]]:
        return {
            "table": (len(self.places), WORDS + 1, HIDDEN), "bias": (HIDDEN,),
            "class_w": (HIDDEN, CLASSES), "class_b": (CLASSES,),
            "word_w": (CLASSES, HIDDEN, CLASS), "word_b": (CLASSES, CLASS),
        }


SHAPE = Shape()


def packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPE.parts()]).astype(np.float32)


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPE.parts().items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).astype(np.float32).copy()
        at += n
    return out


def first_weights(counts: np.ndarray) -> np.ndarray:
    """Small random tables, and biases with which the untrained network gives the words' frequencies."""
    rnd = np.random.default_rng(17)
    weights = {k: (rnd.normal(0, 0.1, shape)).astype(np.float32) for k, shape in SHAPE.parts().items()}
    share = (counts + 0.5).reshape(CLASSES, CLASS)
    weights["bias"][:] = 0
    weights["class_b"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    weights["word_b"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return packed(weights)


def contexts(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Number at each context place of each word (places x words); EDGE outside the word's row."""
    n = len(words)
    out = np.full((len(SHAPE.places), n), EDGE, np.int16)
    for k, shift in enumerate(SHAPE.places):
        out[k, max(-shift, 0) : max(n - max(shift, 0), 0)] = words[max(shift, 0) : max(n + min(shift, 0), 0)]
        for step in range(abs(shift)):  # the row's first or last words look beyond it
            at = rows[:-1] + step if shift < 0 else rows[1:] - 1 - step
            out[k, at[(at >= rows[:-1]) & (at < rows[1:])]] = EDGE
    return out


def _log_shares(logits: np.ndarray) -> np.ndarray:
    """Log-probabilities of each column, in place of the logits."""
    logits -= logits.max(0)
    logits -= np.log(np.exp(logits).sum(0))
    return logits


def _shares(logits: np.ndarray) -> np.ndarray:
    """Probabilities of each column, in place of the logits."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def _hidden(w: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    """Hidden units (rows) of each word (columns)."""
    total = w["table"][0].take(around[0], axis=0)
    for k in range(1, len(around)):
        total += w["table"][k].take(around[k], axis=0)
    total += w["bias"]
    # tanh by exp, which numpy has for whole vectors.
    h = np.ascontiguousarray(total.T)
    h *= 2
    np.exp(np.minimum(h, 80, out=h), out=h)
    h += 1
    np.divide(-2, h, out=h)
    h += 1
    return h


def _by_class(own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the words by class, and (class, begin, end) of each class in it."""
    kind = (own // CLASS).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, edges[c], edges[c + 1]) for c in range(CLASSES) if edges[c + 1] > edges[c]]


def log_probs(w: dict[str, np.ndarray], words: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each word given the words around it."""
    out = np.zeros(len(words))
    for lo in range(0, len(words), CHUNK):
        own, near = words[lo : lo + CHUNK], around[:, lo : lo + CHUNK]
        order, classes = _by_class(own)
        own, h, n = own[order], _hidden(w, near.take(order, axis=1)), np.arange(len(own))
        found = _log_shares(w["class_w"].T @ h + w["class_b"][:, None])[own // CLASS, n].astype(float)
        for c, a, b in classes:
            found[a:b] += _log_shares(w["word_w"][c].T @ h[:, a:b] + w["word_b"][c][:, None])[own[a:b] % CLASS, n[: b - a]]
        out[lo + order] = found
    return out


def gradient(w: dict[str, np.ndarray], own: np.ndarray, near: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the summed negative log-probabilities of the words."""
    out = {k: np.zeros(v.shape) for k, v in w.items()}
    for lo in range(0, len(own), CHUNK):
        _add_gradient(out, w, own[lo : lo + CHUNK], near[:, lo : lo + CHUNK])
    return out


def _add_gradient(out: dict[str, np.ndarray], w: dict[str, np.ndarray], own: np.ndarray, near: np.ndarray) -> None:
    order, classes = _by_class(own)
    own, near, k = own[order], near.take(order, axis=1), np.arange(len(own))
    kind, place = np.divmod(own, CLASS)
    h = _hidden(w, near)
    miss = _shares(w["class_w"].T @ h + w["class_b"][:, None])
    miss[kind, k] -= 1
    back = w["class_w"] @ miss
    out["class_w"] += h @ miss.T
    out["class_b"] += miss.sum(1)
    for c, a, b in classes:
        part = _shares(w["word_w"][c].T @ h[:, a:b] + w["word_b"][c][:, None])
        part[place[a:b], k[: b - a]] -= 1
        back[:, a:b] += w["word_w"][c] @ part
        out["word_w"][c] += h[:, a:b] @ part.T
        out["word_b"][c] += part.sum(1)
    back *= 1 - h * h
    out["bias"] += back.sum(1)
    back = np.ascontiguousarray(back.T)
    for at, names in enumerate(near):
        by_word = np.argsort(names, kind="stable")
        sorted_names = names[by_word]
        first = np.flatnonzero(np.diff(sorted_names, prepend=-1))
        out["table"][at, sorted_names[first]] += np.add.reduceat(back.take(by_word, axis=0), first, axis=0)


class Adam:
    """Steps from mean gradients; the rate falls along a half cosine from RATE to a tenth of it."""

    def __init__(self, flat: np.ndarray, steps: int):
        self.flat, self.steps, self.done = flat.astype(np.float64), steps, 0
        self.mean, self.square = np.zeros(len(flat)), np.zeros(len(flat))

    def step(self, gradient: np.ndarray) -> None:
        rate = RATE * (0.55 + 0.45 * np.cos(np.pi * self.done / self.steps))
        self.done += 1
        self.mean = 0.8 * self.mean + 0.2 * gradient
        self.square = 0.95 * self.square + 0.05 * gradient * gradient
        self.flat -= rate * (self.mean / (1 - 0.8**self.done)) / (np.sqrt(self.square / (1 - 0.95**self.done)) + 1e-6)


@dataclass(frozen=True)
class Vocabulary:
    """Hashes of the frequent words in order and their numbers; how often each number and how many different words of it were counted; the counts (word, n) of all words.

    near and shares: hashes of the next NEAR words in order, and the logarithms of their shares before division.
    """

    words: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    table: DataFrame
    near: np.ndarray
    shares: np.ndarray


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray


def hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every word, number of its ending, and the first word of each row (rows + 1)."""
    start, end, row = runs(raw, offsets)
    prefix = prefix_hash(raw)
    ending = FREQUENT + (span_hash(prefix, np.maximum(start, end - ENDING), end) % np.uint64(TAIL)).astype(np.int64)
    return span_hash(prefix, start, end), ending, np.searchsorted(row, np.arange(len(offsets)))


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """Count the words of all documents. The driver gets one count for each of FREQUENT + NEAR words and TAIL endings; all counts are written as a table."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, number, n = (np.concatenate(x) for x in zip(*held, strict=True))
            word, first, which = np.unique(word, return_index=True, return_inverse=True)
            return word, number[first], np.bincount(which, n, len(word)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            word, number, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(number, pa.int32()), pa.array(n)], names=["word", "number", "n"])

        for batch in batches:
            for _, _, raw, offsets in text_blocks(batch.column(0), lower=True):
                h, ending, _ = hashes(raw, offsets)
                held.append((h, ending, np.ones(len(h), np.int64)))
                if sum(len(x[0]) for x in held) > HELD_WORDS:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD_WORDS // 2:
                        yield rows()
        if held:
            yield rows()

    table = docs.select(text).mapInArrow(count, "word long, number int, n long").groupBy("word").agg(F.min("number").alias("number"), F.sum("n").alias("n"))
    table = stored(table)
    tail = table.groupBy("number").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    most = table.orderBy(F.desc("n"), "word").limit(FREQUENT + NEAR).toArrow()
    top = most.slice(0, FREQUENT).to_pylist()
    counts, kinds = np.zeros(WORDS), np.zeros(WORDS)
    for r in tail:
        counts[r["number"]], kinds[r["number"]] = r["n"], r["kinds"]
    for k, r in enumerate(top):
        counts[r["number"]] -= r["n"]
        kinds[r["number"]] -= 1
        counts[k], kinds[k] = r["n"], 1
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    near, n = (most.slice(FREQUENT).column(x).to_numpy() for x in ("word", "n"))
    by_hash = np.argsort(near.view(np.uint64))
    return Vocabulary(words[order], order, counts, kinds, table.select("word", "n"), near.view(np.uint64)[by_hash], np.log(n[by_hash] + UNSEEN))


def numbered(h: np.ndarray, ending: np.ndarray, words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Number of each word."""
    out = ending.astype(np.int16)
    if len(words):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        own = words[at] == h
        out[own] = numbers[at[own]]
    return out


def _tail_words(h: np.ndarray, words: np.ndarray, rows: np.ndarray, near: np.ndarray, shares: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Of the words that share a number: the different ones of each row that are not near, with how often they occur in the row, and each row's sum of shares of the near ones."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.flatnonzero(words >= FREQUENT)
    total = np.zeros(len(rows) - 1)
    if len(near):
        place = np.minimum(np.searchsorted(near, h[at]), len(near) - 1)
        own = near[place] == h[at]
        total = np.bincount(row[at[own]], shares[place[own]], len(rows) - 1)
        at = at[~own]
    at = at[np.lexsort((h[at], row[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (h[at][1:] != h[at][:-1]) | (row[at][1:] != row[at][:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    parts = [pa.array(h[at[first]].view(np.int64)), pa.array(n.astype(np.int32))]
    ends = np.searchsorted(row[at[first]], np.arange(len(rows))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=["word", "n"])), total


TOKENS = T.StructType([
    T.StructField("__numbers", T.BinaryType()), T.StructField("__turn", T.IntegerType()), T.StructField("__row", T.LongType()),
    T.StructField("__tail", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.IntegerType())]))), T.StructField("__near", T.DoubleType()),
])


def tokens(df: DataFrame, known: Vocabulary, text: str = "text", rounds: int = ROUNDS, keep_text: bool = True) -> DataFrame:
    """df with the numbers of its words (two bytes each), its round, a number of its row, its words that share a number and the shares of the near ones; written as a table in the order of rounds."""
    words, numbers = known.words, known.numbers
    sent = df.sparkSession.sparkContext.broadcast((known.near, known.shares))
    turn = F.pmod(F.xxhash64(text), F.lit(rounds)).cast("int")
    given = df.withColumns({"__turn": turn, "__row": F.monotonically_increasing_id()})
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_blocks(batch.column(names.index(text)), lower=True):
                h, ending, rows = hashes(raw, offsets)
                own = numbered(h, ending, words, numbers)
                packed = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((2 * rows).astype(np.int32)), pa.py_buffer(own)])
                cut = batch.slice(lo, hi - lo)
                kept = [cut.column(k) for k in range(len(names))]
                tail, near = _tail_words(h, own, rows, *sent.value)
                yield pa.RecordBatch.from_arrays([*kept, packed, cut.column(len(names)), cut.column(len(names) + 1), tail, pa.array(near)], names=[*names, *TOKENS.names])

    made = given.mapInArrow(run, T.StructType([*df.schema.fields, *TOKENS.fields]))
    return stored((made if keep_text else made.drop(text)).sortWithinPartitions("__turn"))


def _unpacked_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, numbers, first number of each row) of bounded blocks of packed numbers."""
    for lo, hi, raw, offsets in text_blocks(column):
        yield lo, hi, np.frombuffer(raw.tobytes(), np.int16).astype(np.int64), offsets // 2


def train(table: DataFrame, known: Vocabulary, rounds: int = ROUNDS, passes: int = PASSES) -> Model:
    """Train on all words of a table of tokens. What tasks send grows with their number, what the driver gets is one gradient a step."""
    flat = first_weights(known.counts)
    state = Adam(flat, rounds * passes)
    context = table.sparkSession.sparkContext
    for step in range(rounds * passes):
        sent = context.broadcast(state.flat.astype(np.float32))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, total, n = unpacked(sent.value), None, 0  # noqa: B023
            for batch in batches:
                for _, _, own, rows in _unpacked_rows(batch.column(0)):
                    if len(own):
                        found = np.concatenate([x.ravel() for x in gradient(w, own, contexts(own, rows)).values()])
                        total, n = found if total is None else total + found, n + len(own)
            if n:
                lists = pa.array([total[k : k + ROW] for k in range(0, len(total), ROW)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(lists)), pa.int32()), pa.array([n] * len(lists), pa.int64()), lists], names=["row", "n", "gradient"])

        # A round is a fraction of the corpus: no more tasks than can run at once, as each sends a whole gradient.
        part = table.where(F.col("__turn") == step % rounds).select("__numbers").coalesce(context.defaultParallelism)
        sums = part.mapInArrow(run, "row int, n long, gradient array<double>").groupBy("row")
        got = sums.agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("gradient"))).alias("gradient")).orderBy("row").collect()
        if got:
            state.step(np.concatenate([r["gradient"] for r in got]) / got[0]["n"])
        sent.unpersist()
    return Model(known, state.flat.astype(np.float32))


def learn(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, passes: int = PASSES) -> Model:
    known = vocabulary(docs, text)
    return train(tokens(docs.select(text), known, text, rounds, keep_text=False), known, rounds, passes)


def score_tokens(table: DataFrame, model: Model, n_words: str, log_prob: str) -> DataFrame:
    """The table's own columns with the number of words and the sum of their conditional log-probabilities."""
    names = [x for x in table.columns if x not in (n_words, log_prob) and x not in TOKENS.names]
    known = model.vocabulary
    sent = table.sparkSession.sparkContext.broadcast((model.weights, known.counts, known.kinds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, counts, kinds = sent.value
        w = unpacked(flat)
        # Of words that share a number, the share is (n + UNSEEN) / base; n is joined later.
        base = np.log(counts + UNSEEN * (kinds + 1))
        base[:FREQUENT] = 0
        for batch in batches:
            for lo, hi, own, rows in _unpacked_rows(batch.column(batch.schema.get_field_index("__numbers"))):
                total = np.append(0, np.cumsum(log_probs(w, own, contexts(own, rows)) - base[own]))
                cut = batch.slice(lo, hi - lo)
                sums = np.where(np.diff(rows) > 0, np.diff(total[rows]), 0.0) + cut.column(cut.schema.get_field_index("__near")).to_numpy()
                yield pa.RecordBatch.from_arrays([*(cut.column(cut.schema.get_field_index(x)) for x in [*names, "__row"]), pa.array(np.diff(rows)), pa.array(sums)], names=[*names, "__row", n_words, log_prob])

    fields = [table.schema[x] for x in [*names, "__row"]]
    scored = table.drop("__tail", "__turn").mapInArrow(run, T.StructType([*fields, T.StructField(n_words, T.LongType()), T.StructField(log_prob, T.DoubleType())]))
    # The words of this join are rarer than all NEAR ones, whose shares are added already: no key of it is hot.
    found = table.select("__row", F.explode("__tail").alias("t")).select("__row", "t.word", "t.n")
    shares = known.table.select("word", F.log(F.col("n") + UNSEEN).alias("share"))
    sums = found.join(shares, "word", "left").groupBy("__row").agg(F.sum(F.col("n") * F.coalesce("share", F.lit(float(np.log(UNSEEN))))).alias("__shares"))
    done = scored.join(sums, "__row", "left").withColumn(log_prob, F.col(log_prob) + F.coalesce("__shares", F.lit(0.0)))
    return done.select(*names, n_words, log_prob)


def score(df: DataFrame, model: Model, text: str = "text", n_words: str = "n_words", log_prob: str = "log_prob") -> DataFrame:
    """df with the number of words of each whole text and the sum of their conditional log-probabilities.

    A word that shares its number and was never counted has the share of half a
    count. Null and empty texts have no words and the sum 0. All rows and
    columns stay, input columns of the new names are replaced; an empty table
    gives an empty table. Columns named like those of a table of tokens
    (__numbers, __turn, __row, __tail, __near) are renamed for the while.
    """
    plain = df.drop(n_words, log_prob)
    clash = {x: unused(df, f"own{k}") for k, x in enumerate(plain.columns) if x.lower() in TOKENS.names}
    done = score_tokens(tokens(plain.withColumnsRenamed(clash), model.vocabulary, clash.get(text, text)), model, n_words, log_prob)
    return done.withColumnsRenamed({v: k for k, v in clash.items()})


def scores(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, log_prob (their sum) and mean_log_prob (null without words) of each document."""
    own = documents.select("doc_id", "text")
    known = vocabulary(own)
    table = tokens(own, known, keep_text=False)
    done = score_tokens(table, train(table, known), "n_words", "log_prob")
    return done.select("doc_id", "n_words", "log_prob", (F.col("log_prob") / F.nullif("n_words", F.lit(0))).alias("mean_log_prob"))
