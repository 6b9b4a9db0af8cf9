"""Preparation of a training corpus in five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of docs; the last one adds the ids. Stages only drop documents or edit texts:

- toxicity: documents predicted toxic go;
- line_dedup: repeated runs of lines go from the texts, n_chars follows;
- simhash: of each group of near-duplicates the smallest doc_id stays. Sketches
  of PARTS fingerprints are over the different runs of five words; pairs within NEAR_BITS in one of
  them link if they are within WHOLE_BITS over all;
- decontamination: documents with a verified overlap with a benchmark item go;
- bpe: ids are added, and text is what decoding the ids gives.

Null texts and ids pass through every stage as its operator states; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.llm import bpe, decontam, lines, simhash, toxicity
from reposift.llm.common import checkpointed, load, unused
from reposift.llm.registry import vocabulary

#: SQL cannot express the learned and the hashed stages; the tests hold each against brute force.
ORACLE_SQL = None


#: Words of a shingle, fingerprints of a sketch, and differing bits at which a pair is found in one of them.
SHINGLE, PARTS, NEAR_BITS = 5, 4, 7
#: Differing bits over the whole sketch of a near copy: what is expected at a similarity of 0.8, and two more.
WHOLE_BITS = simhash.bits_at(0.8, PARTS) + 2


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents not predicted toxic; null and empty texts and rows without id stay."""
    return toxicity.clean(docs, load(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that stand earlier too; n_chars is the new length where lines went."""
    removed = unused(docs, "removed")
    done = lines.dedup_lines(docs, removed=removed)
    return done.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates; rows without id stay, null and empty texts are one group."""
    return simhash.first_of_groups(docs, shingle=SHINGLE, distance=NEAR_BITS, parts=PARTS, whole=WHOLE_BITS, repeats=False)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a verified overlap with a benchmark item, each row judged by its text."""
    return decontam.clean(docs, load(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens and ids; text is what decoding the ids gives (null stays null, with no ids). Columns of the new names are replaced."""
    plain = docs.drop("ids", "n_tokens")
    decoded = unused(plain, "decoded")
    done = bpe.encode(plain, *vocabulary(), ids="ids", decoded=decoded)
    text = F.when(F.col("text").isNotNull(), F.decode(decoded, "UTF-8"))
    return done.withColumn("text", text).withColumn("n_tokens", F.size("ids").cast("long")).select(*plain.columns, "n_tokens", "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is checkpointed as the next one's input."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
