"""A training corpus from `documents`: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into
the shared folder and reads it back as the next stage's documents.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import mixing, packing, secrets, simhash, toxicity
from vellumine.llm.common import documents, materialize, ready
from vellumine.llm.queries import BYTE_TOKENS, labels, vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored as empty, very long ones
    whole; repeated rows go or stay together; every column stays as it is."""
    return toxicity.drop_toxic(docs, labels(spark, sf_dir))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays: the one with the smallest doc_id (null last), of
    equal ids the one whose text has the smallest hash, of equal texts any one. Rows are told apart by a
    number of their own, so repeated and null ids lose no text. Null and empty texts form one group."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("row")), "numbered")
    text, own = F.col("row.text").cast("string"), F.col("row.doc_id")
    place = F.struct(own.isNull().alias("last"), own.alias("id"), F.xxhash64(text).alias("hash"), "n")
    slim = numbered.select(place.alias("doc_id"), text.alias("text"))
    found = simhash.near_duplicates(slim, kind=slim.schema["doc_id"].dataType)
    # what goes is a written table: Spark broadcasts it only where it is small
    gone = materialize(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id.n"), "gone")
    return numbered.join(gone, "n", "left_anti").select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null, empty and repeated ones as well."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null sources are one source; null ids are drawn by text."""
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 2048 tokens. Null and empty texts are one end
    token; longer texts are cut; copies are pieces of their own."""
    return packing.pack_documents(docs, vocabulary(BYTE_TOKENS), end_id=0)


STAGES = [("toxicity", without_toxic), ("simhash_near_dedup", without_near_duplicates), ("secret_scans", without_secrets), ("mixing", mixed), ("packing", packed)]
#: A trained classifier, a tokenizer and a least-squares plan have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        spark._jvm.System.gc()  # a stage's plans and broadcasts are done with: the driver gives their memory back
    return docs
