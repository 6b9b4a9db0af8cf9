"""Interest profiles kept as sums and counts, changed by what changed.

A profile is the mean of the vectors of a user's stars. The table holds the sum
and the number, so a star that came or went, or a vector that was made anew,
adds or takes away its own share, and neither the other stars nor their vectors
are read. Sums are doubles: a long series of changes drifts by rounding alone
(some 1e-16 of the sum each), and refresh() from nothing starts anew.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.functions import vectors as V
from reposift.operators import keys
from reposift.sources.tables import Change, Layout, Snapshots

TABLE = "profiles"
#: Users from which a star counts as popular; bytes of popular stars' vectors that are sent to all tasks; parts that they are dealt to beyond that.
POPULAR, SENT_BYTES, SALTS = 100_000, 64 << 20, 64


def layouts(groups: int = 16) -> dict[str, Layout]:
    return {TABLE: Layout(("user_id",), groups)}


def with_vectors(pairs: DataFrame, vectors: DataFrame, popular: int = POPULAR, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(user_id, id, vector) of the pairs (user_id, id) whose star has a vector. vectors: (id, vector), one for each star.

    Popular stars, of which there are few by their definition, would bring all
    their users to one task: their vectors go to all tasks if they fit, else
    their users are dealt to SALTS parts.
    """
    hot = pairs.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= popular).select("id")
    size = keys.keep(vectors, hot, "id").agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    if not size["n"]:
        return pairs.join(vectors, "id").select("user_id", "id", "vector")
    of_hot, cold = keys.keep(vectors, hot, "id"), keys.drop(pairs, hot, "id").join(vectors, "id").select("user_id", "id", "vector")
    users = keys.keep(pairs, hot, "id")
    if size["n"] * size["width"] * 8 <= sent_bytes:
        warm = users.join(F.broadcast(of_hot), "id")
    else:
        dealt = of_hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        warm = users.withColumn("__salt", F.pmod(F.xxhash64("user_id"), F.lit(SALTS)).cast("int")).join(dealt, ["id", "__salt"])
    return cold.unionByName(warm.select("user_id", "id", "vector"))


def sums(pairs: DataFrame, vectors: DataFrame, sign: int = 1, **options) -> DataFrame:
    """(user_id, n, sums): number and sum of the vectors of each user's pairs, by partial aggregation; negative with sign -1."""
    rows = with_vectors(pairs, vectors, **options).select("user_id", F.transform(V.doubles(F.col("vector")), lambda x: x * sign).alias("vector"))
    total = vector_to_array(Summarizer.sum(array_to_vector("vector")))
    return rows.groupBy("user_id").agg((F.count("*") * sign).alias("n"), total.alias("sums"))


def added(deltas: DataFrame) -> DataFrame:
    """The sums of several rows of each user; users without stars left have none."""
    total = vector_to_array(Summarizer.sum(array_to_vector("sums")))
    return deltas.groupBy("user_id").agg(F.sum("n").alias("n"), total.alias("sums")).where("n > 0")


def refresh(tables: Snapshots, before: tuple[DataFrame, DataFrame] | None, after: tuple[DataFrame, DataFrame], **options) -> int:
    """Bring the table from the state before to the state after, each (user_id, id) and (id, vector); returns the buckets rewritten.

    Without before, the table is made from nothing. Pairs and keys of vectors are
    compared; vectors themselves are read for what changed.
    """
    return tables.commit(lambda t: _refresh(t, before, after, options))


def _refresh(t: Change, before: tuple[DataFrame, DataFrame] | None, after: tuple[DataFrame, DataFrame], options: dict) -> int:
    pairs, vectors = after[0].select("user_id", "id"), after[1].select("id", "vector")
    if before is None:
        t.write(TABLE, added(sums(pairs, vectors, **options)))
        return t.layout(TABLE).groups
    old_pairs, old_vectors = before[0].select("user_id", "id"), before[1].select("id", "vector")
    came, went = t.stage(pairs.exceptAll(old_pairs)), t.stage(old_pairs.exceptAll(pairs))
    marks = lambda rows: rows.select("id", F.xxhash64("vector").alias("hash"))
    new, gone = marks(vectors).exceptAll(marks(old_vectors)), marks(old_vectors).exceptAll(marks(vectors))
    changed = t.stage(new.select("id").unionByName(gone.select("id")).distinct())
    # Of users who kept a star whose vector changed: its new share comes, its old one goes.
    stayed = t.stage(keys.keep(pairs, changed, "id").exceptAll(keys.keep(came, changed, "id")))
    parts = [(came.unionByName(stayed), vectors, 1), (went.unionByName(stayed), old_vectors, -1)]
    deltas = [sums(own, keys.keep(of, own, "id"), sign, **options) for own, of, sign in parts]
    delta = t.stage(deltas[0].unionByName(deltas[1]))
    buckets = t.buckets(TABLE, delta)
    if buckets:
        kept = t.read(TABLE, buckets)
        t.rewrite(TABLE, added(kept.unionByName(delta)), buckets)
    return len(buckets)


def profiles(kept: DataFrame) -> DataFrame:
    """(user_id, profile) of the table's rows."""
    return kept.select("user_id", F.transform("sums", lambda x: x / F.col("n")).alias("profile"))
