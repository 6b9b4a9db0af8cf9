"""Feeding pulled stars into the stars table as a stream.

Each micro-batch is a keyed merge of the buckets it touches, in one commit with
its number and its broken rows, so a replayed batch changes nothing. A stream never deletes: a pull that
was cut at a mark proves nothing about older stars, so removed stars are found by
the batch job on a full pull only.

What a batch needs on disk besides the table's old and new files is bounded: it
is merged some buckets at a time, and rows that it does not change are not joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reposift import schemas
from reposift.operators import keys, sync
from reposift.sources import stars as source
from reposift.sources.tables import Change


#: Envelopes with the user who pulled them.
SCHEMA = T.StructType([T.StructField("user_id", T.LongType()), *schemas.ENVELOPE.fields])
#: Bytes of the table and the batch that are merged at a time, for each core. A step shuffles about twice as many.
STEP = 32 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes with user_id from JSON files as they arrive."""
    return spark.readStream.schema(SCHEMA).json(path)


def merge_batch(existing: DataFrame | None, envelopes: DataFrame, fetched_at: Column) -> tuple[DataFrame, DataFrame]:
    """The stars table after one batch of envelopes (user_id, starred_at, repo), and the rows that broke a rule."""
    batch, bad = checked_batch(envelopes, fetched_at)
    return merged(existing, batch), bad


def checked_batch(envelopes: DataFrame, fetched_at: Column) -> tuple[DataFrame, DataFrame]:
    """The newest good row of each star in a batch, and the rows that broke a rule."""
    good, bad = source.validate(source.flatten(envelopes, fetched_at, ("user_id",)), source.star_rules())
    return sync.last_of_batch(good.withColumn("__at", F.struct("starred_at", "stargazers_count")), "__at").drop("__repeats", "__at"), bad


def merged(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The existing rows with those of the batch put in place; local columns stay. batch is read several times, so it should be a stored table or cheap."""
    if existing is None:
        return batch
    own = batch.select(*sync.KEY)
    rows = sync.merge_local(batch, keys.keep(existing, own, list(sync.KEY)))
    return keys.drop(existing, own, list(sync.KEY)).unionByName(rows, allowMissingColumns=True)


def merge_into(t: Change, envelopes: DataFrame, batch_id: int, fetched_at: Column) -> bool:
    """One micro-batch: stars, quarantine and the batch's number change together; False if the batch was merged before.

    Only the buckets that the batch's keys fall into are rewritten, a step of them at a time.
    """
    done = t.read("batches")
    if done is not None and not done.where(F.col("batch_id") == batch_id).isEmpty():
        return False
    good, bad = checked_batch(envelopes, fetched_at)
    batch, bad = t.stage_buckets("stars", good), t.stage(bad)
    first = [[]] if t.read("stars") is None else []  # the table is there after an empty batch, too
    for buckets in t.steps("stars", batch, STEP * envelopes.sparkSession.sparkContext.defaultParallelism) or first:
        t.rewrite("stars", merged(t.read("stars", buckets), batch.read(buckets)), buckets)
    if not bad.isEmpty():
        t.append("quarantine", bad.select("user_id", "id", "violations"))
    t.append("batches", envelopes.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")))
    return True


def start(stream: DataFrame, snapshots: source.Snapshots, checkpoint: str, fetched_at: Callable[[], Column] = F.current_timestamp, keep: int | None = None) -> StreamingQuery:
    """Merge all that has arrived into the table stars, then stop.

    keep: the commits that stay readable; what older ones alone name, and what a batch wrote for itself, is deleted
    after each batch. Only for tables that nothing else writes to meanwhile. Without it, all versions stay until vacuum().
    """

    def merge(envelopes: DataFrame, batch_id: int) -> None:
        snapshots.commit(lambda t: merge_into(t, envelopes, batch_id, fetched_at()))
        if keep is not None:
            snapshots.vacuum(keep)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
