"""What must be embedded anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift import schemas
from reposift.functions import text
from reposift.operators import keys, search

INPUT_LENGTH = 2000


def embedding_input() -> Column:
    """One text per star: name, language, description and topics on lines of their own, missing ones left out."""
    lines = [
        F.col("full_name"),
        F.when(text.present(F.col("language")), F.concat(F.lit("language: "), F.col("language"))),
        F.when(text.present(F.col("description")), F.col("description")),
        F.when(F.size("topics") > 0, F.concat(F.lit("topics: "), F.array_join("topics", ", "))),
    ]
    return F.substring(F.concat_ws("\n", *lines), 1, INPUT_LENGTH)


def content_hash(value: Column, parity: bool = False, seed: int = 5381) -> Column:
    """Hash that tells changed texts: 64 bits, or with parity the 32-bit one of older tables."""
    return text.djb2(value, seed) if parity else F.lower(F.hex(F.xxhash64(value)))


def star_inputs(stars: DataFrame, parity: bool = False) -> DataFrame:
    """(id, star_id, input, content_hash), once per repository however many users keep it."""
    rows = stars.select(F.col("id").alias("star_id"), embedding_input().alias("input")).dropDuplicates(["star_id"])
    return rows.select(F.concat(F.lit("star:"), F.col("star_id").cast("string")).alias("id"), "star_id", "input", content_hash(F.col("input"), parity).alias("content_hash"))


def worklist(inputs: DataFrame, vectors: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Inputs without a vector of the same content and model; only keys take part in the join."""
    if force:
        return inputs
    done = vectors.where(F.col("model") == model).select("id", "content_hash")
    return inputs.join(done, ["id", "content_hash"], "left_anti")


def star_worklist(stars: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """star_inputs() of the stars whose newest copy has no vector of its content and model.

    Hashes decide first, so that only the texts which must be embedded are shuffled.
    """
    texts = stars.select(F.concat(F.lit("star:"), F.col("id").cast("string")).alias("id"), F.col("id").alias("star_id"), "last_synced_at", embedding_input().alias("input"))
    hashed = texts.withColumn("content_hash", content_hash(F.col("input")))
    newest = hashed.groupBy("id").agg(F.max(F.struct("last_synced_at", "content_hash")).alias("newest")).select("id", F.col("newest.content_hash").alias("content_hash"))
    need = keys.missing(newest, vectors.where(F.col("model") == model), ["id", "content_hash"])
    return keys.keep(hashed, need, ["id", "content_hash"]).drop("last_synced_at").dropDuplicates(["id"])


def vector_rows(embedded: DataFrame, model: str, at: Column) -> DataFrame:
    """Rows for the vector table from the successful results of inference."""
    rows = embedded.where("status = 'done'").withColumns({"kind": F.split_part("id", F.lit(":"), F.lit(1)), "model": F.lit(model), "embedded_at": at})
    rows = search.with_norm(rows)
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.VECTOR.fields))
