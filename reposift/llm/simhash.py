"""SimHash near-duplicates with a generalised pigeonhole search.

Fingerprints are 64 bits over word shingles. Bits are grouped so that
correlated ones stand together; each group gets a threshold (-1: not probed)
such that a pair within the whole distance is within the threshold of a group
at least. A dynamic programme picks the thresholds by the candidates expected
from bit counts over all fingerprints. Equal fingerprints are one node.

A sketch may have several fingerprints, from hashes made anew out of one hash of
each shingle. Then every fingerprint is searched for itself, and a pair found in
one of them is verified over the bits of all: this finds pairs that one
fingerprint happens to set apart, and leaves out those it happens to join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.llm.common import checkpointed, mix, stored, text_blocks, unused
from reposift.llm.components import connected_components, forest

BITS = 64
#: Cost of a probe row, without and for each fingerprint it carries, against that of a verified candidate pair.
PROBE_COST, CARRY_COST = 100.0, 100.0
#: Fingerprints that one block of a bucket holds; a larger bucket is compared block by block.
BLOCK = 8192


def names(parts: int) -> list[str]:
    """Columns of the fingerprints of a sketch."""
    return ["fp", *(f"fp{k}" for k in range(1, parts))]


def bits_at(similarity: float, parts: int) -> int:
    """Differing bits expected of two sketches whose texts, equal in length, have this Jaccard similarity of shingles."""
    return round(BITS * parts * acos(2 * similarity / (1 + similarity)) / pi)


def block_fingerprints(data: bytes, offsets: list[int], shingle: int, seed: int, parts: int = 1, repeats: bool = True) -> np.ndarray:
    """Fingerprints (parts x texts) of the texts data[offsets[i]:offsets[i + 1]]; without repeats each different shingle of a text counts once."""
    words: list[bytes] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    for k in range(len(counts)):
        own = data[offsets[k] : offsets[k + 1]].lower().split()
        counts[k] = len(own)
        words += own
    out = np.zeros((parts, len(counts)), np.uint64)
    made = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    if not made.sum():
        return out
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    first = np.cumsum(counts) - counts
    shift = np.cumsum(made) - made
    at = np.repeat(first - shift, made) + np.arange(made.sum())
    last = np.minimum(at + shingle - 1, np.repeat(first + counts - 1, made))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
    if not repeats:
        row = np.repeat(np.arange(len(made)), made)
        order = np.lexsort((h, row))
        new = np.append(True, (np.diff(row[order]) > 0) | (h[order][1:] != h[order][:-1]))
        h, made = h[order][new], np.bincount(row[order][new], minlength=len(made))
        shift = np.cumsum(made) - made
    some = np.flatnonzero(made)
    for k in range(parts):
        own = h if k == 0 else mix(h + np.uint64(k))
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, shift[some], axis=0, dtype=np.int32)
        out[k, some] = np.packbits(2 * ones > made[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, parts: int = 1, repeats: bool = True) -> DataFrame:
    """(doc_id, fp, fp1, ..): the 64-bit fingerprints, as signed longs, of each row's whole text.

    A-Z are lowered, words are runs without ASCII white space. Fewer words than
    a shingle: the whole sequence is the one shingle; none (or null): zero.
    Repeated rows stay; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_blocks(batch.column(1)):
                found = block_fingerprints(raw.tobytes(), offsets.tolist(), shingle, seed, parts, repeats)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x.view(np.int64)) for x in found)], names=["doc_id", *names(parts)])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{x} long" for x in names(parts))]))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each two bits are set together, over all of them (64 x 64 at most reach the driver)."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for part in parts:
            raw = np.ascontiguousarray(part["fp"].to_numpy()).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        i, j = np.triu_indices(BITS)
        if n:
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both[i, j], n).astype(np.int64)})

    both, n = np.zeros((BITS, BITS)), 0
    for i, j, count in fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if i < 0:
            n = count
        else:
            both[i, j] = both[j, i] = count
    return n, both


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Cut the bits into groups of nearly one size, correlated bits together."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    near = np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    left, out = list(range(BITS)), []
    for k in range(groups):
        size = len(left) // (groups - k)
        own = [left[int(near[np.ix_(left, left)].sum(1).argmax())]]
        while len(own) < size:
            rest = [x for x in left if x not in own]
            own.append(rest[int(near[np.ix_(rest, own)].mean(1).argmax())])
        out.append(sorted(own))
        left = [x for x in left if x not in own]
    return out


def within(mean: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0 .. most of these bits, from how often each is set."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for p in 2 * mean * (1 - mean):
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return np.cumsum(chance)[: most + 1]


def allocate(n: int, both: np.ndarray, distance: int, parts: int = 1) -> list[tuple[list[int], int]]:
    """Groups of bits with thresholds that sum to distance - groups + 1, at least expected cost."""
    mean = np.diag(both) / max(n, 1)
    best: tuple[float, list] = (np.inf, [])
    for m in range(1, distance + 2):
        groups = group_bits(n, both, m)
        # table[s]: least cost and thresholds with which the groups so far use s in all, a group that is not probed counting as -1.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for own in groups:
            found = within(mean[own], distance)
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for t in range(-1, distance + 1):
                    more = 0.0 if t < 0 else (PROBE_COST + CARRY_COST * parts) * n * sum(comb(len(own), r) for r in range(t + 1)) + n * n / 2 * found[t]
                    if used + t not in new or cost + more < new[used + t][0]:
                        new[used + t] = (cost + more, [*chosen, t])
            table = new
        if (need := distance - m + 1) in table and table[need][0] < best[0]:
            best = (table[need][0], list(zip(groups, table[need][1], strict=True)))
    return best[1]


def _keys(fp: np.ndarray, plan: list[tuple[list[int], int]]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(group, key, whether the key is the fingerprint's own) for all probes of the plan."""
    for g, (own, most) in enumerate(plan):
        if most < 0:
            continue
        mask = np.uint64(sum(1 << b for b in own))
        base = fp & mask
        yield g, base, True
        for r in range(1, most + 1):
            for flips in combinations(own, r):
                yield g, base ^ np.uint64(sum(1 << b for b in flips)), False


def near_links(reps: DataFrame, distance: int = 3, parts: int = 1, whole: int | None = None) -> DataFrame:
    """Links (a, b) that connect the nodes (fp, fp1, .., rep) as all pairs would that are within the distance in a fingerprint, and within whole bits over all.

    One row per sketch is expected. Every pair within the distance in a
    fingerprint meets in a bucket and is compared; a block of a bucket returns a
    spanning forest of the pairs it found, so rows stay in proportion to the nodes.
    """
    columns = names(parts)
    whole = distance if whole is None else whole
    plans = [allocate(*bit_statistics(reps.select(F.col(x).alias("fp"))), distance, parts) for x in columns]

    def probe(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, (name, plan) in enumerate(zip(columns, plans, strict=True)):
                fp = np.ascontiguousarray(part[name].to_numpy()).view(np.uint64)
                for g, key, own in _keys(fp, plan):
                    yield part.assign(g=np.int32(BITS * k + g), key=key.view(np.int64), own=own)

    def count(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, (name, plan) in enumerate(zip(columns, plans, strict=True)):
                fp = np.ascontiguousarray(part[name].to_numpy()).view(np.uint64)
                for g, key, _ in _keys(fp, plan):
                    key, n = np.unique(key, return_counts=True)
                    yield pd.DataFrame({"g": np.int32(BITS * k + g), "key": key.view(np.int64), "size": n})

    longs = ", ".join(f"{x} long" for x in [*columns, "rep", "key"])
    probes = reps.select(*columns, "rep").mapInPandas(probe, f"{longs}, g int, own boolean")
    # Buckets of over BLOCK rows are dealt out as pairs of blocks. There are few of them: written, so that Spark knows their size and broadcasts them only if they are small.
    large = reps.select(*columns).mapInPandas(count, "g int, key long, size long").groupBy("g", "key").agg(F.sum("size").alias("size")).where(F.col("size") > BLOCK)
    large = stored(large.select("g", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    dealt = probes.join(large, ["g", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64(*columns), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), *columns, "rep", "own")
    cells = dealt.repartition("g", "key", "x", "y").sortWithinPartitions("g", "key", "x", "y")

    def compare(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            held = part if held is None else pd.concat((held, part), ignore_index=True)
            where = held[["g", "key", "x", "y"]].to_numpy()
            cut = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            if len(cut):
                yield _linked(held.iloc[: cut[-1]], np.concatenate(([0], cut)), columns, distance, whole)
                held = held.iloc[cut[-1] :]
        if held is not None and len(held):
            where = held[["g", "key", "x", "y"]].to_numpy()
            yield _linked(held, np.concatenate(([0], np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, [len(held)])), columns, distance, whole)

    return cells.mapInPandas(compare, "a long, b long")


def _linked(rows: pd.DataFrame, cut: np.ndarray, columns: list[str], distance: int, whole: int) -> pd.DataFrame:
    """A spanning forest of the pairs that meet inside each cell cut[i]:cut[i + 1], are within the distance in its fingerprint and within whole bits over all."""
    fps = [np.ascontiguousarray(rows[x].to_numpy()).view(np.uint64) for x in columns]
    rep, own, part = rows["rep"].to_numpy(), rows["own"].to_numpy(), rows["g"].to_numpy() // BITS

    def verified(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(fps) > 1 and len(p):
            near = sum(np.bitwise_count(x[p] ^ x[q]).astype(np.int64) for x in fps) <= whole
            p, q = p[near], q[near]
        return rep[p], rep[q]

    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    size = np.diff(cut)
    for s in np.unique(size[size <= 8]):  # small cells of one size go together
        first = cut[:-1][size == s]
        for k in np.unique(part[first]):
            some, fp = first[part[first] == k], fps[k]
            for i, j in combinations(range(int(s)), 2):
                p, q = some + i, some + j
                near = (np.bitwise_count(fp[p] ^ fp[q]) <= distance) & (own[p] | own[q])
                found.append(verified(p[near], q[near]))
    for lo, hi in zip(cut[:-1][size > 8], cut[1:][size > 8], strict=True):
        fp, trees = fps[part[lo]][lo:hi], []
        for k in range(0, hi - lo, 256):
            near = np.bitwise_count(fp[k : k + 256, None] ^ fp[None, k:]) <= distance
            if not own[lo:hi].all():
                near &= own[lo + k : min(lo + k + 256, hi), None] | own[None, lo + k : hi]
            i, j = np.nonzero(near)
            after = j > i  # each pair once
            trees.append(forest(*verified(lo + k + i[after], lo + k + j[after])))
        found += trees
    return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([x for _, x in found])})


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42, parts: int = 1, whole: int | None = None, repeats: bool = True
) -> DataFrame:
    """(doc_id, fp, .., component_id): component_id is the smallest doc_id reachable over links.

    A link differs in at most distance bits of one of the parts fingerprints,
    and in at most whole bits over all of them (as many as distance by default).
    All rows take part: those without words share the fingerprint zero. Equal
    sketches are one node, so copies add no pairs. A null doc_id has a component
    only through its sketch's smallest other id, else null. Rows in, rows out;
    an empty table gives no rows.
    """
    columns = names(parts)
    prints = checkpointed(fingerprints(df, doc_id, text, shingle, seed, parts, repeats))
    reps = prints.groupBy(*columns).agg(F.min("doc_id").cast("long").alias("rep"))
    reps = checkpointed(reps)
    found = connected_components(near_links(reps.where("rep IS NOT NULL"), distance, parts, whole))
    named = reps.join(found, reps["rep"] == found["node"], "left").select(*columns, F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, columns).select("doc_id", *columns, "component_id")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row; null and empty texts have the fingerprint zero, repeated rows stay."""
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose doc_id is the smallest of its group of near-duplicates.

    Rows with one doc_id stand or fall together; rows without doc_id stay, as
    no other row can name them. Null and empty texts have the fingerprint zero
    and are one group. All columns stay; an empty table stays empty.
    """
    found = near_duplicates(df.where(F.col(doc_id).isNotNull()), doc_id, text, **options)
    name = unused(df, "gone")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone.hint("shuffle_hash"), F.col(doc_id) == F.col(name), "left_anti").select(*df.columns)
