"""The vector cache as a bucketed table, filled batch by batch.

Vectors lie in buckets by the hash of their text, so texts that are dealt out the same way meet them
without a shuffle of the cache. A fill is a batch with a name of its own. It overwrites that batch and
no other, so a fill that is repeated, after a failure or by mistake, leaves one row per text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.session import materialize
from voxtally.sources.vector_cache import BATCH_SIZE, Encoder, cache_misses, encode, text_key

BUCKETS = 64


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def open_vector_table(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The table ``name`` at ``path``, made if it is not there, else with the batches found there.

    ``buckets`` must be the number the table was made with.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (text_hash STRING, embedding ARRAY<FLOAT>, model_id STRING, batch STRING)"
        f" USING parquet PARTITIONED BY (model_id, batch) CLUSTERED BY (text_hash) INTO {buckets} BUCKETS"
        f" LOCATION {_quoted(path)}"
    )
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def _buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0].data_type)


def fill_batch(
    reviews: DataFrame,
    name: str,
    model_id: str,
    batch: str,
    encoder: Callable[[], Encoder],
    text: str = "content_clean",
    batch_size: int = BATCH_SIZE,
) -> None:
    """Work out the vectors of all texts that no other batch of the model has, as the batch ``batch``.

    Texts of the batch itself count as missing, so a repeated fill writes the same rows again. A text
    that two batches are filled with at the same time is in both; :func:`cached_vectors` gives one.
    """
    spark = reviews.sparkSession
    others = spark.table(name).where(F.col("batch") != batch)
    misses = cache_misses(reviews, others, model_id, text)
    # Written before the table changes, which the misses are read from.
    vectors = materialize(encode(misses, encoder, batch_size), "new-vectors")
    # Dealt out as the buckets are, so that a bucket gets one file.
    vectors.repartition(_buckets(spark, name), "text_hash").createOrReplaceTempView("_new_vectors")
    spark.sql(
        f"INSERT OVERWRITE TABLE {name} PARTITION (model_id = {_quoted(model_id)}, batch = {_quoted(batch)})"
        " SELECT text_hash, embedding FROM _new_vectors"
    )
    spark.catalog.dropTempView("_new_vectors")


def cached_vectors(spark: SparkSession, name: str, model_id: str) -> DataFrame:
    """``(text_hash, embedding, batch)``: one vector per text, that of the first batch by name.

    The buckets hold all rows of a text, so this takes no shuffle.
    """
    rows = spark.table(name).where(F.col("model_id") == model_id)
    return rows.groupBy("text_hash").agg(F.min(F.struct("batch", "embedding")).alias("_first")).select(
        "text_hash", F.col("_first.embedding").alias("embedding"), F.col("_first.batch").alias("batch")
    )


def with_cached_vectors(
    reviews: DataFrame, name: str, model_id: str, text: str = "content_clean"
) -> DataFrame:
    """Reviews with ``embedding`` and its ``batch``, null where the cache has none.

    The texts' hashes are dealt out into the table's buckets; the cache stays where it is.
    """
    cached = cached_vectors(reviews.sparkSession, name, model_id)
    hashed = reviews.withColumn("text_hash", text_key(text))
    return hashed.join(cached.hint("merge"), "text_hash", "left").drop("text_hash")
