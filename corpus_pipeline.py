"""A cleaning pipeline over ``documents``: toxicity, exact dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as
Parquet and read again before the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import exact_dedup, mixing, packing, simhash, toxicity
from lexmill.llm.store import BROADCAST_IDS, drop, save, without


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def row_key(doc_id: Column, sha256: Column) -> list[Column]:
    """What tells a row: its id (the last one for null) and the SHA-256 of its normalised text."""
    return [F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), F.unhex(sha256).alias("sha")]


def apart(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined (left_anti or left_semi) with the keys, which every task gets where they are few."""
    keys, _ = save(keys.distinct(), "keys")
    return docs.join(F.broadcast(keys) if keys.count() * 4 <= BROADCAST_IDS else keys, keys.columns, how).select(*columns(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity operator rejects; those without doc_id are judged like any other.

    Null and empty texts stay, as does everything where labels teach nothing. Other columns are handed on.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out())
    return toxicity.keep_clean(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, that with the smallest doc_id; null comes last.

    Rows go by their id and text, never by the id alone: one that shares an id with a copy but has a text of its own
    stays. Of rows with equal id and text one stays, whichever Spark meets first.
    """
    found, path = save(exact_dedup.exact_duplicates(docs).select("doc_id", "kept", "text_sha256"), "exact")
    keys = found.select("kept", *row_key(F.col("doc_id"), F.col("text_sha256")))
    id_, text = fresh("id", docs), fresh("sha", docs)
    named = docs.withColumns(dict(zip((id_, text), row_key(F.col("doc_id"), F.sha2(exact_dedup.normalised().cast("binary"), 256)), strict=True)))
    pair = lambda df: df.select(F.col("id").alias(id_), F.col("sha").alias(text))
    left = apart(named, pair(keys.where("not kept")), "left_anti")
    again, again_path = save(pair(keys.where("kept").groupBy("id", "sha").count().where("count > 1")), "repeated")
    if not again.isEmpty():
        left = apart(left, again, "left_anti").unionByName(apart(left, again, "left_semi").dropDuplicates([id_, text]))
    out, _ = save(left.select(*columns(docs)), "exact-kept")
    drop(spark, path, again_path)
    return out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near copies.

    Groups come from covering hashing of SimHash fingerprints, held against whole shingle sets, and for copies beyond
    its radius from a prefix filter over those sets.
    Rows with a null id, or with one that other rows share, are known by a hash of id and text here, which comes
    after all ids; so a row never goes for what another one with its id holds. An empty table stays empty.
    """
    shared, path = save(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "shared-ids")
    if shared.isEmpty():
        drop(spark, path)
        return without(docs, simhash.near_copies(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    known, id_ = fresh("known", docs), fresh("row", docs)
    marks = shared.where("doc_id is not null").withColumn(known, F.lit(True))
    hashed = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    own = docs.join(marks, "doc_id", "left").withColumn(id_, F.when(F.col(known).isNull() & F.col("doc_id").isNotNull(), F.col("doc_id").cast("long")).otherwise(hashed))
    own, _ = save(own.select(*columns(docs), id_), "rows")
    gone = simhash.near_copies(own.select(F.col(id_).alias("doc_id"), "text")).where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    rest = without(own.select(F.col(id_).alias("doc_id"), F.struct(*columns(docs)).alias("row")), gone)
    return rest.select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by calibrated probabilities; rows of one id stay or go together. An empty table stays empty."""
    return mixing.sample(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins; a document without words is one piece of 0 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("near-dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Trained scores, near copies and packing can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = save(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
