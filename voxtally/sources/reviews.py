"""Review and vector tables in, result tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("brand", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("content_clean", T.StringType()),
    ]
)

BOM = "\ufeff"


def read_reviews(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet review table; any further columns pass through when the schema is left out."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def attach_vectors(
    reviews: DataFrame, vectors: DataFrame, key: str = "review_id", vector: str = "embedding"
) -> DataFrame:
    """Reviews with their vector, matched by key and never by position."""
    return reviews.join(vectors.select(key, vector), key)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header and a byte order mark, as spreadsheet programs expect.

    Every part file is complete in itself, so nothing is funnelled through one task. Leading and
    trailing blanks are kept.
    """
    first, *rest = df.columns
    df.select(F.col(first).alias(BOM + first), *rest).write.mode(mode).options(
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        encoding="UTF-8",
    ).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The counterpart of :func:`write_csv`; tells an empty text from a missing one."""
    return spark.read.options(
        header=True,
        nullValue="\0",  # what the parser puts for an unquoted empty field
        escape='"',
        multiLine=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        encoding="UTF-8",
        enforceSchema=True,
    ).schema(schema).csv(path)


def stack_scopes(scopes: dict[str, DataFrame], label: str = "scope") -> DataFrame:
    """All scopes' rows under each other, each marked with its name."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in scopes.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
