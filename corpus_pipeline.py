"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.

Defined cases: documents with null or empty texts, or without a letter, are rejected by language identification; very long
texts pass through whole; of rows with equal id and text one stays, of near-duplicates the one of least id (null ids last);
rows that share an id with different texts are documents of their own; empty tables pass through as such; other columns
stay as they are, whatever their names, but ``n_chars``, which follows a shortened text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.cluster import ship
from maskwright.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from maskwright.llm.common import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated line runs; documents of which nothing is left go."""
    ship(spark)
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]  # so that no name clashes with the operator's figures
    at = {n: plain[i] for i, n in enumerate(names)}
    done = line_dedup.dedup_lines(docs.toDF(*plain), at["doc_id"], at["text"]).filter("n_left != 0")
    if "n_chars" in at:
        n_chars = F.when(F.col("n_removed") > 0, F.length(at["text"]).cast("long")).otherwise(F.col(at["n_chars"]))
        done = done.withColumn(at["n_chars"], n_chars)
    return done.select(*plain).toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates (five words, similarity 0.8).

    Null ids come last; null and empty texts are nobody's duplicates.
    """
    ship(spark)
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    doc_id, text = (F.col(plain[names.index(n)]) for n in ("doc_id", "text"))
    # rows of one id and one text are one document; other rows stand for themselves, whatever their ids
    own = docs.toDF(*plain).withColumn("_key", F.xxhash64(doc_id.cast("string"), text))
    groups = jaccard_join.near_duplicates(own.select("_key", text.alias("text")), doc_id="_key").select(F.col("doc_id").alias("_k"), "component_id")
    placed = groups.distinct().join(own.select("_key", doc_id.alias("_id")).distinct(), F.col("_k") == F.col("_key")).select("_k", "component_id", F.struct(F.col("_id").isNull(), "_id", "_key").alias("_place"))
    placed = materialise(placed, "placed")
    stay = placed.groupBy(F.col("component_id").alias("_g")).agg(F.min("_place").alias("_first"))
    gone = placed.join(materialise(stay, "stay"), F.col("component_id") == F.col("_g")).filter("_place != _first").select("_k").distinct()
    left = own.join(gone, F.col("_key") == F.col("_k"), "left_anti")
    return left.dropDuplicates(["_key"]).select(*plain).toDF(*names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark."""
    ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048."""
    import public_tokenizers

    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Language models and packing are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
