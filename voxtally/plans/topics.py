"""The two analyses end to end: all reviews, and the low-rated ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.text import Analyzer, clean_text, letter_runs, tokenize
from voxtally.operators import keywords, report
from voxtally.operators.clusters import density_topics
from voxtally.operators.ingest import SAMPLE_PER_BRAND, low_rated, rated, sample_per_group, with_text
from voxtally.operators.membership import membership, reassign_outliers, topic_centroids
from voxtally.operators.reduce import reduce_pca
from voxtally.operators.seeds import guide_vectors, seed_vectors
from voxtally.session import materialize, scratch
from voxtally.sources.lexicons import NOISE_LABEL, Lexicon

MODEL_TABLES = ("assignments", "topic_info", "topic_terms", "topic_names", "topic_centroids")


@dataclass(frozen=True)
class TopicParams:
    """Settings of one scope. The defaults are those of the all-reviews scope."""

    min_cluster_size: int = 50
    min_samples: int = 10
    n_neighbors: int = 15
    components: int = 5
    eps: float | None = None
    eps_quantile: float = 0.9
    min_df: int = 5
    max_df: float = 0.9
    tf_mode: str = "binary"
    top_n_words: int = 10
    outlier_threshold: float = 0.40
    low: bool = False
    sample_cap: int | None = SAMPLE_PER_BRAND
    drop_empty: bool = False
    guided: bool = True
    analyzer: Analyzer = letter_runs
    reducer: Callable[..., DataFrame] = reduce_pca
    options: dict = field(default_factory=dict)


ALL_REVIEWS = TopicParams()
LOW_RATED = replace(
    ALL_REVIEWS,
    min_cluster_size=40,
    min_samples=5,
    min_df=3,
    outlier_threshold=0.30,
    low=True,
    sample_cap=None,
    drop_empty=True,
)


@dataclass(frozen=True)
class TopicModel:
    """A fitted model as tables; see ``MODEL_TABLES``."""

    assignments: DataFrame
    topic_info: DataFrame
    topic_terms: DataFrame
    topic_names: DataFrame
    topic_centroids: DataFrame

    def probabilities(self, docs: DataFrame, **options) -> DataFrame:
        """Long table of soft memberships, worked out only when asked for."""
        return membership(docs, self.topic_centroids, **options)


def prepare(reviews: DataFrame, lexicon: Lexicon, params: TopicParams) -> DataFrame:
    """The rows of the scope with cleaned text."""
    rows = low_rated(reviews) if params.low else rated(reviews)
    if params.sample_cap is not None:
        rows = sample_per_group(rows, cap=params.sample_cap)
    rows = rows.withColumn("content_clean", clean_text("content_clean", lexicon.clean_patterns))
    return with_text(rows) if params.drop_empty else rows


def fit_topics(docs: DataFrame, lexicon: Lexicon, params: TopicParams = ALL_REVIEWS) -> TopicModel:
    """Group reviews with vectors into topics and describe the topics.

    ``docs`` needs ``review_id``, ``content_clean`` and ``embedding``; it is read again for the
    assignments, where its other columns pass through, so the texts are never copied. Token lists
    are written once and then read by every later step. Tables that the model does not need are deleted.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        # Of the tables with tokens and vectors only the last one is on disk when terms are counted.
        with scratch(spark) as keep_final:
            with scratch(spark) as keep_first:
                first = keep_first(materialize(_grouped(docs, lexicon, params), "first-topics"))
            centroids = keep(keep_final(materialize(topic_centroids(first), "centroids")))
            moved = reassign_outliers(first, params.outlier_threshold, centroids)
            final = keep_final(materialize(moved.drop("embedding"), "final-topics"))
            share = first.agg(F.avg((F.col("topic") == -1).cast("double"))).first()[0] or 0.0
        # Keywords are made anew whenever the share asks for it, whether or not a review then moved.
        describe = keywords.refresh_keywords if share > params.outlier_threshold else keywords.class_tfidf
        weights = describe(
            final,
            tf_mode=params.tf_mode,
            min_df=params.min_df,
            max_df=params.max_df,
            seed_words=lexicon.seed_words(),
        )
        terms = keep(materialize(keywords.top_terms(weights, params.top_n_words), "top-terms"))
        names = keep(materialize(keywords.topic_names(final, terms), "names"))
        info = keep(materialize(report.topic_info(final, names, NOISE_LABEL), "topic-info"))
        topics = keep(materialize(final.select("review_id", "topic"), "topics"))
    assignments = docs.join(topics, "review_id")
    return TopicModel(assignments, info, terms, names, centroids)


def _grouped(docs: DataFrame, lexicon: Lexicon, params: TopicParams) -> DataFrame:
    """Reviews with tokens, vector and the topic of their density group."""
    work = materialize(
        tokenize(docs, lexicon, low=params.low, analyzer=params.analyzer).select(
            "review_id", "tokens", "embedding"
        ),
        "tokens",
    )
    space, vector = work, "embedding"
    if params.guided and lexicon.seeds:
        seeds = seed_vectors(work, lexicon.seeds)
        space = guide_vectors(work, seeds, output="_guided").drop("seed_id")
        vector = "_guided"
    reduced = materialize(
        params.reducer(
            space.select("review_id", vector), vector, "reduced", components=params.components
        ).select("review_id", "reduced"),
        "reduced",
    )
    groups = density_topics(
        reduced,
        min_cluster_size=params.min_cluster_size,
        min_samples=params.min_samples,
        n_neighbors=params.n_neighbors,
        eps=params.eps,
        eps_quantile=params.eps_quantile,
        **params.options,
    )
    return work.join(groups, "review_id")


def compare_brands(model: TopicModel) -> DataFrame:
    """``(brand, topic_name, count, ratio, rank)``: every brand's five largest topics."""
    labelled = keywords.label_reviews(model.assignments, model.topic_names)
    counts = report.brand_topic_counts(labelled)
    return report.top_topics(report.brand_topic_share(counts))


def save_model(model: TopicModel, path: str, mode: str = "errorifexists") -> None:
    """Write the model's tables below ``path``."""
    for name in MODEL_TABLES:
        getattr(model, name).write.mode(mode).parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> TopicModel:
    return TopicModel(*[spark.read.parquet(f"{path}/{name}") for name in MODEL_TABLES])
