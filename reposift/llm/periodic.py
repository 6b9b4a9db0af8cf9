"""Periodic runs of words: a suffix automaton per stretch, read with link-cut accesses.

A run is a stretch of consecutive words with smallest period q and length of at
least max(least, 2 * q) that no neighbouring word extends keeping period q.

Each task works on its own documents; nothing is shuffled. A run holds two
copies of its period, so each of its words stands in a gram of least // 2 words
that stands twice in the run. Grams that occur once in a document, then once in
what is left of it, and so on, cut it into the few stretches that can hold runs.
Over such a stretch a suffix automaton is built. Its words are then appended one
after the other: the access of a word's state recolours the path from it to the
root with the word's place. The path falls into segments of one colour, each the
last end of all the strings of its states; a former end nearer than the longest
of them is a square, and its string is the run's left part, as far as it goes.
If the next word does not continue it, the run is complete, and this happens
once for each run.

Accesses recolour an upper part of each heavy path of the tree of suffix links,
so a stack of segments for each heavy path holds the colours.

Defined results: null and empty texts have no runs and a collapsed text that is
empty; every row is judged on its own, so repeated rows and ids give repeated
rows; other columns stay, an input column of an output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposift.llm.checksum import CRC_TABLE, crc
from reposift.llm.common import mix, prefix_hash, ragged, span_hash, text_blocks, unused, word_spans

LEAST = 12
_GRAM = np.random.default_rng(13).integers(1, 1 << 63, 65, dtype=np.uint64) | np.uint64(1)


def automaton(seq: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, longest lengths, and the state of each prefix, of the suffix automaton of seq."""
    step: list[dict] = [{}]
    link, size, at, last = [-1], [0], [], 0
    for c in seq:
        new = len(size)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(size)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        at.append(new)
        last = new
    return link, size, at


def heads(link: list[int], size: list[int]) -> list[int]:
    """The top state of each state's heavy path in the tree of suffix links."""
    deep_first = sorted(range(1, len(size)), key=size.__getitem__, reverse=True)
    weight, heavy, head = [1] * len(size), [-1] * len(size), [0] * len(size)
    for v in deep_first:
        weight[link[v]] += weight[v]
    for v in deep_first:
        p = link[v]
        if heavy[p] < 0 or weight[v] > weight[heavy[p]]:
            heavy[p] = v
    for v in reversed(deep_first):
        head[v] = head[link[v]] if heavy[link[v]] == v else v
    return head


def runs(seq: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of seq, by start, then period."""
    link, size, at = automaton(seq)
    head = heads(link, size)
    paths: dict[int, list[tuple[int, int]]] = {}  # by head: (depth, colour) of segments, the shallowest last
    found, n = [], len(seq)
    for end, state in enumerate(at):
        met, v = -1, state
        while v > 0:
            path, depth, passed = paths.setdefault(head[v], []), size[v], []
            while path and path[-1][0] <= depth:
                passed.append(path.pop())
            if path and not (passed and passed[-1][0] == depth):
                passed.append((depth, path[-1][1]))  # the upper part of a segment that goes deeper
            path.append((depth, end))
            for common, former in reversed(passed):
                if former == met:
                    continue  # a deeper state has this colour too
                met, period = former, end - former
                if period <= common and common + period >= least and (end + 1 == n or seq[end + 1] != seq[end + 1 - period]):
                    found.append((former - common + 1, common + period, period))
            v = link[head[v]]
    return sorted(found, key=lambda x: (x[0], x[2]))


def stretches(words: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each stretch that can hold a run. words: hashes, owner: non-decreasing number of the document."""
    gram = least // 2
    place = np.arange(len(words))
    while len(words) >= least:
        mixed = np.zeros(len(words) - gram + 1, np.uint64)
        for k in range(gram):
            mixed += words[k : len(words) - gram + 1 + k] * _GRAM[k % 64]
        ok = owner[gram - 1 :] == owner[: len(mixed)]
        mixed = mix(mixed + owner[: len(mixed)].astype(np.uint64) * _GRAM[64])[ok]
        order = np.argsort(mixed, kind="stable")
        ranked = mixed[order]
        same = np.zeros(len(ranked), bool)
        same[1:] = ranked[1:] == ranked[:-1]
        same[:-1] |= same[1:]
        begins = np.flatnonzero(ok)[order[same]]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + gram, -1)
        alive = np.cumsum(edge[:-1]) > 0
        # New stretches: consecutive places of one owner.
        kept = np.flatnonzero(alive)
        fresh = np.ones(len(kept), bool)
        fresh[1:] = (np.diff(place[kept]) != 1) | (np.diff(owner[kept]) != 0)
        number = np.cumsum(fresh) - 1
        long = np.bincount(number, minlength=1)[number] >= least if len(kept) else np.zeros(0, bool)
        kept, number = kept[long], number[long]
        done = len(kept) == len(words) and len(np.unique(owner)) == len(np.unique(number))
        words, place, owner = words[kept], place[kept], number
        if done:
            break
    else:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(owner) != 0)))
    return place[first], place[np.concatenate((first[1:], [len(owner)])) - 1] + 1


def _block(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, np.ndarray]:
    """Runs of each text of a block, and the texts' collapsed bytes with their offsets."""
    start, end, first = word_spans(raw, offsets)
    n = len(offsets) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    dropped = np.zeros(len(start) + 1, np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    if len(start):
        text, prefix = raw.tobytes(), prefix_hash(raw)
        for lo, hi in zip(*(x.tolist() for x in stretches(span_hash(prefix, start, end), owner, least)), strict=True):
            row = int(owner[lo])
            for at, length, period in runs([text[a:b] for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)], least):
                found[row].append((lo - int(first[row]) + at, length, period))
                dropped[lo + at + period] += 1
                dropped[lo + at + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    start, length, owner = start[kept], (end - start)[kept], owner[kept]
    # Each kept word but the last of its text with one blank behind it.
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    room = length + ~last
    stop = np.cumsum(room)
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    out[ragged(stop - room, length)] = raw[ragged(start, length)]
    ends = np.concatenate(([0], stop))[np.searchsorted(owner, np.arange(n + 1))]
    return found, out, ends


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST) -> DataFrame:
    """docs with runs, an array of (start, length, period) by start, then period, and collapsed.

    Starts are numbers of words from 0. collapsed is the text's words joined by
    one space, without those that a run contains after its first period words.
    """
    if least < 4:
        raise ValueError("a run needs four words at least")
    plain = docs.drop(*(x for x in docs.columns if x.lower() in (runs.lower(), collapsed.lower())))
    own, names = unused(plain, "text"), [*plain.columns, runs, collapsed]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_blocks(batch.column(batch.num_columns - 1)):
                found, data, ends = _block(raw, offsets, least)
                counts = np.fromiter((len(x) for x in found), np.int64, len(found))
                flat = np.array([x for own in found for x in own], np.int64).reshape(-1, 3)
                cells = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), cells).cast(kind)
                texts = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], lists, texts], names=names)

    cell = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType([*plain.schema.fields, T.StructField(runs, T.ArrayType(cell)), T.StructField(collapsed, T.StringType())])
    return plain.withColumn(own, F.col(text)).mapInArrow(run, schema)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents; where 10 divides the id's CRC-32, the text's words with a periodic end, joined by one space.

    A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    n = F.size("__words").cast("long")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("__words"), g.alias("__g"))
    placed = chosen.select("doc_id", "text", "__words", n.alias("__n"), F.when(n > 0, F.pmod("__g", F.greatest(n, F.lit(1)))).alias("__a"), "__g")
    period = F.lit(1) + F.floor((F.col("__n") - F.col("__a")) / (F.lit(3) + F.col("__g") % 8))
    dealt = placed.withColumn("__p", period.cast("int"))
    a, rest = F.col("__a").cast("int"), (F.col("__n") - F.col("__a")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("__words", a + 1, F.col("__p")), F.ceil(rest / F.col("__p")).cast("int")))
    made = F.concat(F.slice("__words", F.lit(1), a), F.slice(again, F.lit(1), rest))
    return dealt.select("doc_id", F.when(F.col("__n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document the longest run, and digests of all runs and of the collapsed text."""
    found = find_runs(with_planted_periods(docs))
    best = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("order"), x["start"].alias("start"), x["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    every = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.order")
    exponent = F.floor(length * 1000 / F.col("best.period")).cast("long")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def oracle() -> str:
    return f"""WITH {CRC_TABLE},
given AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words, {crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc_table),
sized AS (SELECT *, len(words) AS n, h // 10 AS g FROM given),
dealt AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM sized),
w AS (SELECT doc_id, i, words[1 + CASE WHEN h % 10 <> 0 OR i < a THEN i ELSE a + (i - a) % p END] AS word FROM dealt, unnest(range(n)) AS r(i)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i),
joined AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
periods AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM joined GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= {LEAST}),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM periods GROUP BY doc_id, start, length),
told AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS every FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, best.l * 1000 // best.p AS exponent_milli,
  sha256(coalesce(every, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told t USING (doc_id) LEFT JOIN collapsed c USING (doc_id)"""
