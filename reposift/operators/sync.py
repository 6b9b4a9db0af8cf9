"""Merging a pull into the stars table. Keys are (user_id, id); a single user is a table with one user_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposift import schemas
from reposift.functions import text
from reposift.operators import keys as key_joins

KEY = ("user_id", "id")
#: Days after which a pull must be a full one again.
FULL_EVERY_DAYS = 7
NOTE_LENGTH = 2000


def incremental_cut(incoming: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows starred at or after their user's mark. Equal times stay, so that stars of the same second are not lost."""
    marks = cursors.select("user_id", F.col("since").alias("__since"))
    return incoming.join(marks, "user_id", "left").where("__since IS NULL OR starred_at >= __since").drop("__since")


def high_water(incoming: DataFrame, cursors: DataFrame) -> DataFrame:
    """(user_id, since): the larger of the old mark and the newest pulled star; null if there is neither."""
    newest = incoming.groupBy("user_id").agg(F.max("starred_at").alias("__newest"))
    both = cursors.select("user_id", "since").join(newest, "user_id", "full_outer")
    return both.select("user_id", F.greatest("since", "__newest").alias("since"))


def sync_mode(cursors: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """cursors with mode: full if forced, never done, or more than FULL_EVERY_DAYS ago."""
    age = F.unix_millis(now) - F.unix_millis("last_full_sync_at")
    full = F.lit(force) | F.col("last_full_sync_at").isNull() | (age > FULL_EVERY_DAYS * 86_400_000)
    return cursors.withColumn("mode", F.when(full, F.lit("full")).otherwise(F.lit("incremental")))


def fingerprints(stars: DataFrame) -> DataFrame:
    """(user_id, fingerprint, n) over the upstream columns; keys are unique, so the xor of row hashes cannot cancel out."""
    columns = [x for x in schemas.UPSTREAM if x in stars.columns and x != "last_synced_at"]
    return stars.groupBy("user_id").agg(F.bit_xor(F.xxhash64(*columns)).alias("fingerprint"), F.count("*").alias("n"))


def changed_only(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of users whose pull differs from the stored fingerprints."""
    same = fingerprints(incoming).join(stored, ["user_id", "fingerprint", "n"], "left_semi").select("user_id")
    return incoming.join(same, "user_id", "left_anti")


def unchanged_cursors(cursors: DataFrame, now: Column) -> DataFrame:
    """Cursors after a pull without changes: checked now, and a due full pull counts as done. cursors: with mode."""
    done = F.when(F.col("mode") == "full", now).otherwise(F.col("last_full_sync_at"))
    return cursors.withColumns({"updated_at": now, "last_full_sync_at": done})


def last_of_batch(batch: DataFrame, order: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The last row of each key by the batch order, with __repeats, the number of its rows."""
    by_key = Window.partitionBy(*keys)
    ranked = batch.withColumns({"__rank": F.row_number().over(by_key.orderBy(F.desc(order))), "__repeats": F.count("*").over(by_key)})
    return ranked.where("__rank = 1").drop("__rank")


def merge_local(incoming: DataFrame, existing: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """incoming with the local columns of the existing rows, where those are not null.

    A repository pushed to after it was indexed loses its deep_indexed flag; the time of indexing stays.
    """
    local = [x for x in schemas.LOCAL if x in existing.columns and x in incoming.columns]
    old = existing.select(*keys, *(F.col(x).alias(f"__{x}") for x in local))
    merged = incoming.join(old, list(keys), "left").withColumns({x: F.coalesce(f"__{x}", x) for x in local})
    return mark_stale(merged).select(*incoming.columns)


def mark_stale(stars: DataFrame) -> DataFrame:
    stale = F.coalesce(F.col("pushed_at") > F.col("last_deep_indexed_at"), F.lit(False))
    return stars.withColumn("deep_indexed", F.col("deep_indexed") & ~stale)


def upsert(existing: DataFrame, batch: DataFrame, order: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """existing with the batch's rows put in place of those of the same key; of a repeated key the last one counts."""
    rows = last_of_batch(batch, order, keys).drop("__repeats", order)
    return existing.join(rows, list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def upsert_counts(existing: DataFrame, batch: DataFrame, order: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """One row: inserted and updated. A key repeated in the batch is inserted once at most and updated each further time."""
    known = existing.select(*keys, F.lit(True).alias("__known")).distinct()
    rows = last_of_batch(batch.select(*keys, order), order, keys).join(known, list(keys), "left")
    new = F.col("__known").isNull()
    return rows.agg(
        F.count_if(new).alias("inserted"),
        F.coalesce(F.sum(F.col("__repeats") - F.when(new, 1).otherwise(0)), F.lit(0)).alias("updated"),
    )


def reconcile(existing: DataFrame, incoming: DataFrame, modes: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """All rows after a pull with their action: insert, update, keep, or delete (users in full mode only; users without a cursor count as full).

    One full outer join decides all four, so both sides are shuffled once. An
    incoming row keeps the local columns of the existing one.
    """
    local = [x for x in schemas.LOCAL if x in existing.columns]
    both = existing.withColumn("__old", F.lit(True)).alias("e").join(incoming.withColumn("__new", F.lit(True)).alias("i"), list(keys), "full_outer")
    value = {x: F.coalesce(f"e.{x}", f"i.{x}") if x in local else F.when(F.col("i.__new"), F.col(f"i.{x}")).otherwise(F.col(f"e.{x}")) for x in incoming.columns if x not in keys}
    rows = both.select(*keys, F.col("e.__old").alias("__old"), F.col("i.__new").alias("__new"), *(v.alias(x) for x, v in value.items()))
    full = modes.select("user_id", (F.col("mode") == "full").alias("__full"))
    action = (
        F.when(F.col("__old") & F.col("__new"), "update")
        .when(F.col("__new"), "insert")
        .when(F.coalesce("__full", F.lit(True)), "delete")
        .otherwise("keep")
    )
    done = rows.join(full, "user_id", "left").withColumn("action", action)
    return mark_stale(done).drop("__old", "__new", "__full")


def unstarred(existing: DataFrame, pulled: DataFrame, modes: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Existing rows of users in full mode that the pull lacks; an empty pull lacks all."""
    full = modes.where("mode = 'full'").select("user_id")
    return existing.join(full, "user_id", "left_semi").join(pulled.select(*keys), list(keys), "left_anti")


def cascade(vectors: DataFrame, remaining: DataFrame) -> DataFrame:
    """Vectors of repositories that some user still keeps; vectors are shared by users. Only keys are shuffled, to find what is gone."""
    gone = key_joins.missing(vectors, remaining.select(F.col("id").alias("star_id")), "star_id")
    return key_joins.drop(vectors.where("star_id IS NOT NULL"), gone, "star_id")


def gone_for_all(deleted: DataFrame, remaining: DataFrame) -> DataFrame:
    """(id) of the deleted stars that no remaining row has: those that their last user gave up. deleted: a stored table."""
    given_up = deleted.select("id").distinct()
    return given_up.join(key_joins.keep(remaining.select("id"), given_up, "id").distinct(), "id", "left_anti")


def drop_prefix(vectors: DataFrame, prefix: str) -> DataFrame:
    if not prefix:
        raise ValueError("an empty prefix would drop every vector")
    return vectors.where(~F.col("id").startswith(prefix))


def delete_keys(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without those keys, and one row with the number of keys that were present."""
    names = keys.columns
    return rows.join(keys, names, "left_anti"), rows.select(*names).distinct().join(keys, names, "left_semi").agg(F.count("*").alias("deleted"))


def clean_note(note: Column) -> Column:
    """Trimmed, at most NOTE_LENGTH long; blank is null."""
    return F.nullif(F.substring(text.trim(note), 1, NOTE_LENGTH), F.lit(""))


def patch(stars: DataFrame, patches: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """stars with the columns of patches set on the rows of the same key, nulls too; keys that no row has are ignored."""
    columns = [x for x in patches.columns if x not in keys]
    found = patches.select(*keys, *(F.col(x).alias(f"__{x}") for x in columns), F.lit(True).alias("__hit"))
    return stars.join(found, list(keys), "left").withColumns({x: F.when(F.col("__hit"), F.col(f"__{x}")).otherwise(F.col(x)) for x in columns}).select(*stars.columns)


def patch_locale(stars: DataFrame, patches: DataFrame, column: str, locale: str, at: Column, keys: tuple[str, ...] = KEY) -> DataFrame:
    """stars with patches.text put under the locale in the map column, and the time of translation set."""
    found = patches.select(*keys, F.col("text").alias("__text"))
    hit = F.col("__text").isNotNull()
    joined = stars.join(found, list(keys), "left")
    set_to = {column: F.when(hit, text.put_key(F.col(column), locale, F.col("__text"))).otherwise(F.col(column)), "last_translated_at": F.when(hit, at).otherwise(F.col("last_translated_at"))}
    return joined.withColumns(set_to).select(*stars.columns)


def reset_model(stars: DataFrame, vectors: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """After a change of the embedding model: only its vectors stay, and no repository counts as indexed; tags, notes and translations stay."""
    cleared = stars.withColumns({"deep_indexed": F.lit(False), "last_deep_indexed_at": F.lit(None).cast("timestamp")})
    return cleared, vectors.where(F.coalesce(F.col("model") == model, F.lit(False)))


def summary(inserted: Column, updated: Column, deleted: Column, known: Column, unchanged: Column | None = None) -> Column:
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    changes = F.concat_ws(" · ", part(inserted, "new"), part(updated, "updated"), part(deleted, "removed"))
    count = known.cast("string")
    out = F.when(F.lit(False) if unchanged is None else unchanged, F.concat(F.lit("Up to date · "), count, F.lit(" stars.")))
    return out.when(changes == "", F.concat(F.lit("Synced · "), count, F.lit(" stars."))).otherwise(F.concat(changes, F.lit(" · "), count, F.lit(" total.")))


def report(reconciled: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """One row per user: inserted, updated, deleted, known (after the pull) and the one-line text. users: those who have a row at any rate."""
    n = lambda *x: F.count_if(F.col("action").isin(*x))
    counts = reconciled.groupBy("user_id").agg(n("insert").alias("inserted"), n("update").alias("updated"), n("delete").alias("deleted"), n("insert", "update", "keep").alias("known"))
    if users is not None:
        counts = users.select("user_id").join(counts, "user_id", "left").na.fill(0)
    return counts.withColumn("summary", summary(*(F.col(x) for x in ("inserted", "updated", "deleted", "known"))))


def next_cursors(cursors: DataFrame, incoming: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """The cursor rows after a pull. cursors: with mode; counts: report()."""
    marks = high_water(incoming, cursors).withColumnRenamed("since", "__since")
    known = counts.select("user_id", "known")
    done = F.when(F.coalesce(F.col("mode") == "full", F.lit(True)), now).otherwise(F.col("last_full_sync_at"))
    joined = marks.join(cursors, "user_id", "left").join(known, "user_id", "left")
    return joined.select("user_id", "etag", F.col("__since").alias("since"), F.coalesce("known", F.lit(0)).alias("known_count"), now.alias("updated_at"), done.alias("last_full_sync_at"))
