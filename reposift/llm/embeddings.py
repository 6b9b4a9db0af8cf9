"""Near-duplicate embeddings by an epsilon grid order join.

Equal vectors are one node. Unit vectors are rotated to principal axes, given
grid cells as wide as the join distance on the leading ones, and sorted by cell.
Stretches of that sequence are boxes in the leading principal coordinates and
the length of what lies outside them; a tree of boxes is joined with itself
level by level, leaving out pairs of boxes that are provably farther apart than
the distance. The pairs of stretches that are left go to tasks by square tiles,
so that a stretch is sent once to a tile and not once to a pair. There they are
joined by splitting them further in the same way, down to small blocks. In a
block the leading coordinates bound every cosine from above; what the bound does
not rule out is multiplied in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposift.llm.common import checkpointed
from reposift.llm.components import connected_components, forest

#: Leading principal dimensions with grid cells, and those that boxes have.
CELLS, AXES = 6, 16
#: Vectors of one stretch and of one multiplied block.
STRETCH, SMALL = 4096, 256
#: Most stretches on a side of a tile; a task holds those of one side.
TILE = 32
#: Tree nodes under one parent: 2 ** FANOUT_BITS.
FANOUT_BITS = 4
#: Numbers kept for the stretches of one partition.
PART = 1 << 20
SLACK = 1e-9
#: What single precision may take from the bound of a cosine.
BOUND_SLACK = 1e-5


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(vector: str):
    """Whether a vector can link: no null or non-finite component, and not zero."""
    x = F.col(vector)
    inf = float("inf")
    good = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < inf), F.lit(False))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(x.isNotNull() & good, F.lit(False))


def principal_axes(reps: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of vectors and the orthogonal matrix of principal axes over all of them, leading first (dims x dims numbers reach the driver)."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims + 1, dims)), 0
        for batch in batches:
            x = unit(matrix(batch.column(0), dims))
            total[:dims] += x.T @ x
            total[dims] += x.sum(0)
            n += len(x)
        if n:
            lists = pa.array(total.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([n] * (dims + 1), pa.int64()), lists], names=["i", "n", "row"])

    parts = reps.select("embedding").mapInArrow(sums, "i int, n long, row array<double>")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).orderBy("i").collect()
    if not rows:
        return 0, np.eye(dims)
    n, total = rows[0]["n"], np.array([r["row"] for r in rows])
    mean = total[dims] / n
    _, axes = np.linalg.eigh(total[:dims] / n - np.outer(mean, mean))
    return n, axes[:, ::-1]


def box_gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    return float(gap @ gap)


def leading(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors on the axes, and the length of the rest: distances and products of these bound those of the vectors."""
    lead = x @ axes
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", lead, lead)))
    return np.column_stack((lead, rest))


class Side:
    """The vectors of a stretch in grid order, with what bounds them and the boxes of all dyadic intervals that join() asks for."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.x, points = x, leading(x, axes)
        self.points, self.bound, self.known = points, points.astype(np.float32), {}

    def __getitem__(self, interval: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        if interval not in self.known:
            own = self.points[interval[0] : interval[1]]
            self.known[interval] = own.min(0), own.max(0)
        return self.known[interval]


def join(a: Side, b: Side | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of vectors of a and b with cosine of least or more; with b None pairs i < j of a."""
    same = b is None
    b = a if same else b
    near = 2 - 2 * least + SLACK
    todo = [(0, len(a.x), 0, len(b.x))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 == i1 or j0 == j1 or same and j1 <= i0 + 1 or box_gap(*a[i0, i1], *b[j0, j1]) > near:
            continue
        if i1 - i0 <= SMALL and j1 - j0 <= SMALL:
            maybe = np.flatnonzero((a.bound[i0:i1] @ b.bound[j0:j1].T).ravel() >= least - BOUND_SLACK)
            i, j = maybe // (j1 - j0) + i0, maybe % (j1 - j0) + j0
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                good = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= least
                if good.any():
                    yield i[good], j[good]
            continue
        cut_i = [i0, i1] if i1 - i0 <= SMALL else [i0, (i0 + i1) // 2, i1]
        cut_j = [j0, j1] if j1 - j0 <= SMALL else [j0, (j0 + j1) // 2, j1]
        for p, q in zip(cut_i, cut_i[1:], strict=False):
            for r, s in zip(cut_j, cut_j[1:], strict=False):
                if not same or s > p:
                    todo.append((p, q, r, s))


def stretches(reps: DataFrame, n: int, axes: np.ndarray, least: float) -> DataFrame:
    """One row per stretch of the grid order: node, box (lo, hi arrays), and the packed vectors (as given), ids and multiplicities."""
    dims, width = len(axes), float(np.sqrt(2 - 2 * least))
    lead, wide = axes[:, :CELLS], axes[:, :AXES]
    cells = min(CELLS, dims)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.floor(unit(matrix(batch.column(0), dims)) @ lead / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(cell[:, k])) for k in range(cells))], names=[*batch.schema.names, *(f"c{k}" for k in range(cells))])

    order = [f"c{k}" for k in range(cells)] + ["rep"]
    kind = reps.schema["embedding"].dataType.simpleString()
    placed = reps.select("embedding", "rep", "copies").mapInArrow(place, f"embedding {kind}, rep long, copies long, " + ", ".join(f"c{k} int" for k in range(cells)))
    parts = max(1, ceil(n / (8 * STRETCH)))  # several stretches a partition, whose borders cut groups apart
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("embedding", "rep", "copies", F.spark_partition_id().alias("part"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made = 0

        def out(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            """The first stretch of the rows, and the rest. A stretch ends at the widest step between neighbours of its second half, so that groups stay together."""
            nonlocal made
            table = table.combine_chunks()
            plain = table.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)[:STRETCH]
            points, n = leading(unit(plain.astype(np.float64)), wide), len(plain)
            if not (last and len(table) == n):
                half = max(1, n // 2)
                n = half + int(np.square(points[half:] - points[half - 1 : -1]).sum(1).argmax())
            points = points[:n]
            node = table.column(3)[0].as_py() * PART + made
            made += 1
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([node]), pa.array([points.min(0).tolist()], pa.list_(pa.float64())), pa.array([points.max(0).tolist()], pa.list_(pa.float64())),
                    pa.array([plain[:n].tobytes()]), pa.array([table.column(1)[:n].to_numpy().tobytes()]), pa.array([table.column(2)[:n].to_numpy().tobytes()]),
                ],
                names=["node", "lo", "hi", "x", "rep", "copies"],
            )
            return batch, table.slice(n)

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) > STRETCH:
                made_now, rest = out(pa.Table.from_batches(held), False)
                yield made_now
                held = rest.to_batches()
        while sum(map(len, held)):
            made_now, rest = out(pa.Table.from_batches(held), True)
            yield made_now
            held = rest.to_batches()

    return ordered.mapInArrow(pack, "node long, lo array<double>, hi array<double>, x binary, rep binary, copies binary")


def near_pairs(boxes: DataFrame, least: float) -> DataFrame:
    """(a, b) with a <= b: the stretches whose boxes are not provably too far apart, by a self-join of the tree of boxes from its root down."""
    axes = len(boxes.select("lo").first()[0])
    # Nodes are (part, stretch in it); the tree's numbers leave no gap between the two.
    bits = int(boxes.agg(F.max(F.col("node").bitwiseAND(PART - 1))).first()[0]).bit_length()
    compact = F.shiftright("node", PART.bit_length() - 1 - bits).bitwiseAND(F.lit(-1 << bits)).bitwiseOR(F.col("node").bitwiseAND(PART - 1))
    flat = boxes.select(compact.alias("node"), *(F.col("lo")[k].alias(f"lo{k}") for k in range(axes)), *(F.col("hi")[k].alias(f"hi{k}") for k in range(axes)))
    levels = [flat]
    while levels[-1].agg(F.max("node")).first()[0] > 0:
        up = levels[-1].groupBy(F.shiftright("node", FANOUT_BITS).alias("node"))
        levels.append(checkpointed(up.agg(*(F.min(f"lo{k}").alias(f"lo{k}") for k in range(axes)), *(F.max(f"hi{k}").alias(f"hi{k}") for k in range(axes)))))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in levels[-2::-1]:
        side = lambda s: level.select(F.shiftright("node", FANOUT_BITS).alias(s), *(F.col(x).alias(f"{s}_{x}") for x in level.columns))  # noqa: E731, B023
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"), F.col(f"a_lo{k}") - F.col(f"b_hi{k}")), 2) for k in range(axes)), F.lit(0.0))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a_node") <= F.col("b_node")) & (gap <= 2 - 2 * least + SLACK))
        pairs = pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    plain = lambda x: (F.shiftright(x, bits) * PART + F.col(x).bitwiseAND(F.lit((1 << bits) - 1))).alias(x)
    return pairs.select(plain("a"), plain("b"))


def tiles(pairs: DataFrame, count: int) -> DataFrame:
    """(x, y, side, node, partners): the stretches that each tile of pairs needs; those of side 1 name their partners of side 0. At most TILE stretches a side and tile."""
    # Stretches in grid order, numbered without gaps; fewer on a side while there are few, so that there are tiles to share.
    wide = min(TILE, max(1, ceil(count / 6)))
    placed = pairs.select(F.floor(F.col("na") / wide).alias("x"), F.floor(F.col("nb") / wide).alias("y"), "a", "b")
    right = placed.groupBy("x", "y", F.col("b").alias("node")).agg(F.collect_list("a").alias("partners"))
    left = placed.groupBy("x", "y", F.col("a").alias("node")).agg(F.lit(None).cast("array<bigint>").alias("partners"))
    return left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))


def _joined(reps: DataFrame, dims: int, least: float) -> DataFrame:
    """(a, b, n): a forest of links (n null), and the number of vectors linked to a (b null)."""
    n, axes = principal_axes(reps, dims)
    packed = checkpointed(stretches(reps, n, axes, least))
    wide = axes[:, :AXES]
    kind = np.float32 if reps.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    # Stretches of one partition are numbered from its number * PART on; ranks need only the order.
    nodes = packed.select("node").withColumn("part", F.shiftright("node", PART.bit_length() - 1))
    before = nodes.groupBy("part").agg(F.count("*").alias("n"))
    count = packed.count()
    pairs = near_pairs(packed.select("node", "lo", "hi"), least)
    start = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    ranks = nodes.join(F.broadcast(start), "part").select("node", (F.col("start") + F.col("node").bitwiseAND(PART - 1)).alias("rank"))
    rank = lambda s: ranks.select(F.col("node").alias(s), F.col("rank").alias(f"n{s}"))
    needed = tiles(pairs.join(rank("a"), "a").join(rank("b"), "b"), count)
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = needed.join(packed.select("node", "x", "rep", "copies").toDF("node", "vectors", "rep", "copies"), "node").select("x", "y", "side", "node", "partners", "vectors", "rep", "copies")
    dealt = sent.repartition(parts, "x", "y").sortWithinPartitions("x", "y", "side", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            for k in range(len(batch)):
                row = {x: batch.column(batch.schema.get_field_index(x))[k].as_py() for x in batch.schema.names}
                if (row["x"], row["y"]) != tile:
                    tile, held = (row["x"], row["y"]), {}
                rep, copies = (np.frombuffer(row[c], np.int64) for c in ("rep", "copies"))
                own = None
                if row["side"] == 0 or row["node"] not in held:
                    own = Side(unit(np.frombuffer(row["vectors"], kind).astype(np.float64).reshape(-1, dims)), wide), rep, copies
                if row["side"] == 0:
                    held[row["node"]] = own
                    continue
                count_b, named, numbers = np.zeros(len(rep), np.int64), [], []
                tree = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                for partner in row["partners"]:
                    side, rep_a, copies_a = held[partner]
                    count_a = np.zeros(len(rep_a), np.int64)
                    for i, j in join(side, None if partner == row["node"] else own[0] if own else held[row["node"]][0], least):
                        np.add.at(count_a, i, copies[j])
                        np.add.at(count_b, j, copies_a[i])
                        tree = forest(np.concatenate((tree[0], rep_a[i])), np.concatenate((tree[1], rep[j])))
                    named.append(rep_a[count_a > 0])
                    numbers.append(count_a[count_a > 0])
                named, number = np.concatenate((*named, rep[count_b > 0])), np.concatenate((*numbers, count_b[count_b > 0]))
                blank = pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((tree[0], named))), pa.concat_arrays([pa.array(tree[1]), blank(len(named), pa.int64())]), pa.concat_arrays([blank(len(tree[0]), pa.int64()), pa.array(number)])],
                    names=["a", "b", "n"],
                )

    return dealt.mapInArrow(run, "a long, b long, n long")


def link_embeddings(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link if the cosine of their vectors, in double precision, is least or
    more. n_links counts the other rows linked directly, copies included;
    component_id is the smallest vec_id reachable, itself included; kept says
    whether that is the row's own. Vectors that are null, zero, or hold a null
    or non-finite component link with nothing, nor do vectors of unequal
    lengths. A row without vec_id links like any other but names no component:
    alone, its component_id is null and kept is false. Repeated rows are
    copies. An empty table gives no rows.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable(embedding), F.col(embedding)).alias("embedding"))
    # rep: a negative stand-in where no copy has an id, so that nodes always have one.
    good = rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = checkpointed(good.withColumn("rep", F.coalesce("low", F.lit(1 << 62) + F.abs(F.xxhash64("embedding") % (1 << 40)))))
    found = None
    for (dims,) in reps.select(F.size("embedding")).distinct().collect():
        own = checkpointed(_joined(reps.where(F.size("embedding") == dims), dims, least))
        found = own if found is None else found.union(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    members = connected_components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("rep"), "component")
    nodes = reps.join(counts, "rep", "left").join(members, "rep", "left")
    component = F.coalesce("component", "rep")
    nodes = nodes.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(component < 1 << 62, component).alias("component_id"))
    linked = rows.join(nodes, "embedding", "left")
    named = linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle(least: float = 0.95) -> str:
    """The links of the embeddings table in DuckDB SQL, for tables of a size at which all pairs can be compared."""
    return f"""
WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {least}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, least(vec_id, coalesce(low.b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""
