"""The test tables in the shape of review data, and the small word lists that fit their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.text import letter_runs, text_of
from voxtally.operators.embed import hash_embed_once
from voxtally.operators.skew import fits_broadcast
from voxtally.session import materialize, scratch
from voxtally.sources.lexicons import BOILERPLATE, Lexicon

SPREAD_BYTES = 256 << 20
DIMS = 64  # of the stored vectors, and so of those made from texts

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

LEXICON = Lexicon(
    user_dict=("the", "with", "and", "for", "that", "token"),
    stop_words=("of", "de", "to", "en", "in", "and"),
    neg_stopwords=("that", "was"),
    synonyms={"la": "le", "das": "die", "is": "of", "y": "and"},
    seeds=(("the", "and"), ("la", "de"), ("der", "die"), ("que", "ue")),
    clean_patterns=(*BOILERPLATE, r"[#%&$!]{2,}"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def spread_small(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """``df`` dealt out over all cores if it comes from fewer files than there are cores, and small
    ones: such a table may be a single row group, which one task reads. Only the files are listed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place)
    cores = spark.sparkContext.defaultParallelism
    if found.getFileCount() < cores and found.getLength() < SPREAD_BYTES:
        return df.repartition(cores)
    return df


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """``(review_id, brand, rating, content_clean)`` out of the documents."""
    docs = spread_small(spark, table(spark, folder, "documents"), f"{folder}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("brand"),
        F.expr("cast((doc_id div 20) % 6 AS int)").alias("rating"),
        F.col("text").alias("content_clean"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(review_id, embedding)`` of the stored vectors."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding")


def with_vectors(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """``docs`` with ``embedding``: the stored vector of a review, else one made from its text."""
    stored = vectors(spark, folder)
    known = stored.select("review_id")
    known = F.broadcast(known) if fits_broadcast(known) else known  # so that the texts are not moved
    lacking = reviews(spark, folder).select("review_id", "content_clean").join(known, "review_id", "left_anti")
    with scratch(spark) as keep:
        made = hash_embed_once(lacking, "review_id", letter_runs(text_of("content_clean")), DIMS)
        # Written once, as callers read the vectors several times.
        every = keep(materialize(stored.unionByName(made), "vectors"))
    return docs.join(every, "review_id")


def reviews_topic(spark: SparkSession, folder: str, embed: bool = False) -> DataFrame:
    """All reviews with the topic that the stored vector's label stands for.

    Label 9 is noise, and so is a review without a stored vector. ``embed`` adds ``embedding``.
    """
    labelled = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("review_id"),
        F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).alias("topic"),
    )
    # The texts are not sorted for the join, and not moved either while the labels are few.
    labelled = F.broadcast(labelled) if fits_broadcast(labelled) else labelled.hint("shuffle_hash")
    docs = (
        reviews(spark, folder)
        .join(labelled, "review_id", "left")
        .withColumn("topic", F.coalesce("topic", F.lit(-1)))
    )
    return with_vectors(spark, folder, docs) if embed else docs
