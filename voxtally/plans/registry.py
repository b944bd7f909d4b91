"""Every query by name: a function of the session and the folder of the tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.text import clean_text, is_blank, letter_runs, ngrams, normalize, tokenize
from voxtally.operators import assign, block_index, keywords, report
from voxtally.operators.clusters import density_topics as cluster_by_density
from voxtally.operators.clusters import kmeans_topics as cluster_by_centre
from voxtally.operators.dictionary import dictionary_matches as find_words
from voxtally.operators.dictionary import dictionary_matches_table as find_table_words
from voxtally.operators.dictionary import keyword_coverage
from voxtally.operators.embed import hash_embed as embed_by_hash
from voxtally.operators.hierarchy import density_hierarchy
from voxtally.operators.quantile import exact_quantile
from voxtally.operators.run_report import RunReport
from voxtally.operators import ingest
from voxtally.operators import membership as soft
from voxtally.operators import neighbors
from voxtally.operators import reduce as reducing
from voxtally.operators import seeds as seeding
from voxtally.operators import spectral
from voxtally.plans.estimators import DensityTopics, HashedVectors, ReviewTokenizer
from voxtally.plans.topics import LOW_RATED, TopicModel, TopicParams, compare_brands, prepare
from voxtally.plans.topics import fit_topics as fit
from voxtally.plans.views import DIMS, LEXICON, SCHEMAS, reviews, reviews_topic, vectors, with_vectors
from voxtally.session import materialize, new_folder
from voxtally.sources.lexicons import NOISE_LABEL
from voxtally.sources.model_store import load_version, save_version
from voxtally.sources.reviews import read_csv, stack_scopes, write_csv
from voxtally.sources.row_ids import read_with_row_ids, renumber
from voxtally.sources.vector_cache import cache_misses, text_key
from voxtally.sources.vector_table import fill_batch, open_vector_table, with_cached_vectors

SAMPLE_CAP = 25
MIN_DF = 2
TRIGGER = 0.05  # the tables have about a tenth of outliers
NEAR = 5
CORE_SAMPLES = 5
QUANTILES = (0.0, 0.001, 0.05, 0.5, 0.9, 0.999, 1.0)
HIERARCHY = {"min_cluster_size": 8, "min_samples": 3, "n_neighbors": 5}
CLUSTER = {"min_cluster_size": 5, "min_samples": 2, "n_neighbors": 2, "eps_quantile": 0.45}


# --- reviews and scopes -------------------------------------------------------------------------


def rated_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.rated(reviews(spark, folder))


def low_rated_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.low_rated(reviews(spark, folder))


def valid_reviews(spark: SparkSession, folder: str) -> DataFrame:
    low = ingest.low_rated(reviews(spark, folder))
    cleaned = low.withColumn(
        "content_clean", clean_text("content_clean", LEXICON.clean_patterns)
    )
    return with_vectors(spark, folder, ingest.with_text(cleaned)).select(
        "review_id", "brand", "content_clean", F.size("embedding").alias("dims")
    )


def sample_per_brand(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.rated(reviews(spark, folder)).select("review_id", "brand", "rating")
    return ingest.sample_per_group(rows, cap=SAMPLE_CAP)


def clean_review_text(spark: SparkSession, folder: str) -> DataFrame:
    return reviews(spark, folder).select(
        "review_id", clean_text("content_clean", LEXICON.clean_patterns).alias("content_clean")
    )


def brand_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.group_counts(ingest.rated(reviews(spark, folder)))


def brands_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.groups_first_seen(ingest.rated(reviews(spark, folder)))


def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.dataset_summary(reviews(spark, folder), cap=SAMPLE_CAP)


def _by_position(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as a table without a key, numbered by their place in its files."""
    table = f"{folder}/documents.parquet"
    columns = F.expr("cast((doc_id div 20) % 6 AS int)").alias("rating")
    return read_with_row_ids(spark, table, schema=SCHEMAS["documents"]).select(
        "review_id", F.col("source").alias("brand"), columns, F.length("text").alias("n_chars")
    )


def reviews_by_position(spark: SparkSession, folder: str) -> DataFrame:
    return _by_position(spark, folder)


def renumbered_low_reviews(spark: SparkSession, folder: str) -> DataFrame:
    low = ingest.low_rated(_by_position(spark, folder))
    return renumber(low.withColumn("position", F.col("review_id")), "position")


def brands_first_position(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.groups_first_seen(ingest.rated(_by_position(spark, folder)))


def run_report(spark: SparkSession, folder: str) -> DataFrame:
    report = RunReport()
    narrow = reviews(spark, folder)
    rows = report.written(ingest.rated(narrow), "rated", text_bytes=F.sum(F.octet_length("content_clean")))
    sample = ingest.sample_per_group(rows.select("review_id", "brand", "rating"), cap=SAMPLE_CAP)
    report.written(sample, "sample")
    cleaned = ingest.low_rated(rows).withColumn("content_clean", clean_text("content_clean", LEXICON.clean_patterns))
    blank = F.count_if(is_blank("content_clean"))
    low = report.written(cleaned, "low", blank=blank)
    report.written(ingest.with_text(low).select("review_id"), "low valid")
    topics = reviews_topic(spark, folder, embed=True).select("review_id", "topic", "embedding")
    outliers = F.count_if(F.col("topic") == -1)
    first = report.written(topics, "topics", outliers=outliers, last_topic=F.max("topic"))
    moved = soft.reassign_outliers(first, TRIGGER).select("review_id", "old_topic", "topic")
    report.written(moved, "after reassignment", outliers=outliers, moved=F.count_if(F.col("topic") != F.col("old_topic")))
    return report.table(spark)


# --- tokens -------------------------------------------------------------------------------------


def _tokens(df: DataFrame, low: bool = False) -> DataFrame:
    return tokenize(df, LEXICON, low=low)


def dictionary_matches(spark: SparkSession, folder: str) -> DataFrame:
    return find_words(reviews(spark, folder), LEXICON)


def dictionary_matches_table(spark: SparkSession, folder: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in LEXICON.user_dict], "word string")
    return find_table_words(reviews(spark, folder), words)


def normalize_tokens(spark: SparkSession, folder: str) -> DataFrame:
    forms = reviews(spark, folder).withColumn("forms", letter_runs(F.col("content_clean")))
    return forms.select(
        "review_id",
        F.array_join(normalize(F.col("forms"), LEXICON.synonyms), " ").alias("tokens"),
        F.size("forms").alias("n_tokens"),
    )


def _token_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "review_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens")
    )


def tokenize_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return _token_rows(_tokens(reviews(spark, folder)))


def tokenize_low_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return _token_rows(_tokens(ingest.low_rated(reviews(spark, folder)), low=True))


def review_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    grams = _tokens(reviews(spark, folder)).select("review_id", ngrams("tokens").alias("grams"))
    return grams.select(
        "review_id", F.array_join("grams", "|").alias("terms"), F.size("grams").alias("n_terms")
    )


def seed_topic_summary(spark: SparkSession, folder: str) -> DataFrame:
    return seeding.seed_summary(_tokens(reviews(spark, folder)), LEXICON)


# --- keywords -----------------------------------------------------------------------------------


def _topic_tokens(spark: SparkSession, folder: str, embed: bool = False) -> DataFrame:
    return _tokens(reviews_topic(spark, folder, embed))


def _weights(spark: SparkSession, folder: str, **options) -> DataFrame:
    options = {"tf_mode": "count", "min_df": MIN_DF, **options}
    return keywords.class_tfidf(_topic_tokens(spark, folder), **options)


def _rounded(weights: DataFrame) -> DataFrame:
    return weights.withColumn("weight", F.round("weight", 6))


def topic_term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.topic_term_frequency(_topic_tokens(spark, folder))


def class_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_weights(spark, folder))


def class_tfidf_binary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_weights(spark, folder, tf_mode="binary"))


def class_tfidf_seeded(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_weights(spark, folder, seed_words=LEXICON.seed_words()))


def topic_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(keywords.top_terms(_weights(spark, folder)))


def refresh_topic_keywords(spark: SparkSession, folder: str) -> DataFrame:
    moved = soft.reassign_outliers(_topic_tokens(spark, folder, embed=True), TRIGGER)
    weights = keywords.refresh_keywords(
        moved, tf_mode="count", min_df=MIN_DF, seed_words=LEXICON.seed_words()
    )
    return _rounded(keywords.top_terms(weights))


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(keywords.top_terms(_weights(spark, folder)), "top-terms")


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return _written_names(spark, folder, _terms(spark, folder))


def _written_names(spark: SparkSession, folder: str, terms: DataFrame) -> DataFrame:
    return materialize(keywords.topic_names(reviews_topic(spark, folder), terms), "names")


def topic_names(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.topic_names(reviews_topic(spark, folder), _terms(spark, folder))


# --- reports ------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    docs = reviews_topic(spark, folder).select("review_id", "brand", "rating", "topic")
    return keywords.label_reviews(docs, _names(spark, folder))


def label_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder)


def outlier_ratio(spark: SparkSession, folder: str) -> DataFrame:
    ratio = report.outlier_ratio(reviews_topic(spark, folder))
    return ratio.withColumn("outlier_ratio", F.round("outlier_ratio", 6))


def topic_info(spark: SparkSession, folder: str) -> DataFrame:
    info = report.topic_info(reviews_topic(spark, folder), _names(spark, folder), NOISE_LABEL)
    return report.topic_head(info)


def dictionary_coverage(spark: SparkSession, folder: str) -> DataFrame:
    found = keyword_coverage(_terms(spark, folder), LEXICON, label="all")
    return found.withColumn("coverage", F.round("coverage", 6))


def topic_examples(spark: SparkSession, folder: str) -> DataFrame:
    return report.topic_examples(reviews_topic(spark, folder), _terms(spark, folder))


def brand_topic_counts(spark: SparkSession, folder: str) -> DataFrame:
    return report.brand_topic_counts(_labelled(spark, folder))


def brand_topic_share(spark: SparkSession, folder: str) -> DataFrame:
    return report.brand_topic_share(brand_topic_counts(spark, folder))


def top_topics_per_brand(spark: SparkSession, folder: str) -> DataFrame:
    return report.top_topics(brand_topic_share(spark, folder))


def brand_topic_share_by_scope(spark: SparkSession, folder: str) -> DataFrame:
    docs = _labelled(spark, folder)
    stacked = stack_scopes({"all": ingest.rated(docs), "low": ingest.low_rated(docs)})
    counts = report.brand_topic_counts(stacked, by=("scope",))
    return report.brand_topic_share(counts, by=("scope",))


# --- vectors and topics -------------------------------------------------------------------------


def reduce_random_projection(spark: SparkSession, folder: str) -> DataFrame:
    reduced = reducing.reduce_random(vectors(spark, folder))
    return reduced.select("review_id", *[F.get("reduced", F.lit(c)).alias(f"c{c}") for c in range(5)])


def reduce_pca(spark: SparkSession, folder: str) -> DataFrame:
    reduced = reducing.reduce_pca(vectors(spark, folder))
    return reduced.select("review_id", *[F.get("reduced", F.lit(c)).alias(f"c{c}") for c in range(5)])


def _reduced(spark: SparkSession, folder: str) -> DataFrame:
    reduced = reducing.reduce_random(vectors(spark, folder))
    return materialize(reduced.select("review_id", "reduced"), "reduced")


def knn(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbors.knn(_reduced(spark, folder), "review_id", "reduced", NEAR)
    return near.withColumn("distance", F.round("distance", 6))


def core_distance(spark: SparkSession, folder: str) -> DataFrame:
    core = neighbors.core_distance(_reduced(spark, folder), "review_id", "reduced", CORE_SAMPLES)
    return core.withColumn("core_distance", F.round("core_distance", 6))


def density_topics(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_by_density(_reduced(spark, folder), **CLUSTER)


def kmeans_topics(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_by_centre(_reduced(spark, folder), k=10)


def hierarchy_topics(spark: SparkSession, folder: str) -> DataFrame:
    return density_hierarchy(_reduced(spark, folder), **HIERARCHY).topics


def hierarchy_clusters(spark: SparkSession, folder: str) -> DataFrame:
    clusters = density_hierarchy(_reduced(spark, folder), **HIERARCHY).clusters
    return clusters.select("n", *[F.round(c, 4).alias(c) for c in ("birth", "stability")], "selected")


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows a model is fitted on, and those that come later."""
    rows = _reduced(spark, folder)
    return rows.where("review_id % 2 = 0"), rows.where("review_id % 2 = 1")


def knn_new_reviews(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _halves(spark, folder)
    path = new_folder(spark, "block-index")
    block_index.save_index(block_index.build_index(old, "review_id", "reduced", NEAR), path)
    near = block_index.knn_join(new, block_index.load_index(spark, path), "review_id", "reduced", NEAR)
    return near.withColumn("distance", F.round("distance", 6))


def assign_new_reviews(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _halves(spark, folder)
    fitted = {k: CLUSTER[k] for k in ("min_samples", "n_neighbors", "eps_quantile")}
    path = new_folder(spark, "fitted-space")
    assign.save_space(assign.fitted_space(old, cluster_by_density(old, **CLUSTER), **fitted), path)
    found = assign.assign_topics(new, assign.load_space(spark, path))
    return found.withColumn("distance", F.round("distance", 6))


def distance_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbors.knn(_reduced(spark, folder), "review_id", "reduced", NEAR)
    near = materialize(near.select("distance"), "distances")
    found = [(q, exact_quantile(near, "distance", q)) for q in QUANTILES]
    return spark.createDataFrame(found, "q double, distance double")


def topic_membership(spark: SparkSession, folder: str) -> DataFrame:
    docs = reviews_topic(spark, folder, embed=True).select("review_id", "topic", "embedding")
    centroids = materialize(soft.topic_centroids(docs), "centroids")
    return soft.membership(docs, centroids).withColumn("prob", F.round("prob", 4))


def reassign_outliers(spark: SparkSession, folder: str) -> DataFrame:
    docs = reviews_topic(spark, folder, embed=True).select("review_id", "brand", "topic", "embedding")
    moved = soft.reassign_outliers(docs, TRIGGER)
    return moved.select("review_id", "brand", "old_topic", "topic")


def _seed_vectors(docs: DataFrame) -> DataFrame:
    return materialize(seeding.seed_vectors(docs, LEXICON.seeds), "seed-vectors")


def seed_label_topics(spark: SparkSession, folder: str) -> DataFrame:
    docs = _topic_tokens(spark, folder, embed=True).select("review_id", "topic", "tokens", "embedding")
    centroids = materialize(soft.topic_centroids(docs), "centroids")
    labels = seeding.label_topics(centroids, _seed_vectors(docs))
    return labels.withColumn("similarity", F.round("similarity", 4))


def seed_guided_vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs = _topic_tokens(spark, folder, embed=True).select("review_id", "tokens", "embedding")
    guided = seeding.guide_vectors(docs, _seed_vectors(docs), output="guided")
    parts = [F.round(F.get("guided", F.lit(i)), 4).alias(f"g{i}") for i in range(4)]
    length = F.sqrt(F.aggregate("guided", F.lit(0.0), lambda a, x: a + x * x))
    return guided.select("review_id", "seed_id", *parts, F.round(length, 4).alias("length"))


def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    docs = embed_by_hash(_tokens(reviews(spark, folder)).select("review_id", "tokens"))
    nonzero = F.size(F.filter("embedding", lambda x: x != 0))
    peak = F.round(F.array_max("embedding").cast("double"), 4)
    return docs.select(
        "review_id", F.size("embedding").alias("dims"), nonzero.alias("nonzero"), peak.alias("peak")
    )


def _fitted(spark: SparkSession, folder: str) -> TopicModel:
    docs = with_vectors(spark, folder, ingest.rated(reviews(spark, folder)))
    params = TopicParams(**CLUSTER, min_df=1, tf_mode="count", reducer=reducing.reduce_random)
    return fit(docs, LEXICON, params)


def fit_topics(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder).topic_info


def fitted_brand_topics(spark: SparkSession, folder: str) -> DataFrame:
    return compare_brands(_fitted(spark, folder))


def _analysis(spark: SparkSession, folder: str, low: bool, cap: int | None = None) -> TopicModel:
    """An analysis from the review table on: its rows, cleaned, with vectors, fitted."""
    params = TopicParams(**CLUSTER, min_df=1, tf_mode="count", reducer=reducing.reduce_random, sample_cap=cap)
    if low:
        params = replace(params, low=True, drop_empty=True, outlier_threshold=LOW_RATED.outlier_threshold)
    docs = prepare(reviews(spark, folder), LEXICON, params)
    return fit(with_vectors(spark, folder, docs), LEXICON, params)


def fit_topics_all(spark: SparkSession, folder: str) -> DataFrame:
    return _analysis(spark, folder, low=False, cap=SAMPLE_CAP).topic_info


def fit_topics_low(spark: SparkSession, folder: str) -> DataFrame:
    return _analysis(spark, folder, low=True).topic_info


def coverage_by_scope(spark: SparkSession, folder: str) -> DataFrame:
    found = [
        keyword_coverage(_analysis(spark, folder, low).topic_terms, LEXICON, label)
        for label, low in (("all", False), ("low", True))
    ]
    return found[0].unionByName(found[1]).withColumn("coverage", F.round("coverage", 6))


def examples_by_scope(spark: SparkSession, folder: str) -> DataFrame:
    models = {label: _analysis(spark, folder, low) for label, low in (("all", False), ("low", True))}
    return stack_scopes({k: report.topic_examples(m.assignments, m.topic_terms) for k, m in models.items()})


# --- sinks --------------------------------------------------------------------------------------


def embedding_cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    docs = reviews(spark, folder)
    cache = docs.join(vectors(spark, folder), "review_id").select(
        text_key().alias("text_hash"), "embedding", F.lit("fixture").alias("model_id")
    )
    return cache_misses(docs, cache, "fixture").select(
        "text_hash", F.length("text").alias("n_chars")
    )


def _letter_counts():
    """A stand-in for an embedding model: the length of a text and its letters e."""
    return lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]


def embedding_cache_fill(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "vector-table")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    docs = reviews(spark, folder)
    open_vector_table(spark, name, path, buckets=8)
    fill_batch(docs.where("review_id % 2 = 0"), name, "letters", "a", _letter_counts)
    for _ in range(2):  # the second time changes nothing
        fill_batch(docs, name, "letters", "b", _letter_counts)
    found = with_cached_vectors(docs, name, "letters")
    stored = F.broadcast(spark.table(name).agg(F.count("*").alias("n_stored")))
    values = [F.get("embedding", F.lit(i)).alias(f"v{i}") for i in range(2)]
    return found.select("review_id", "batch", *values).crossJoin(stored)  # one row, one number


def reduce_spectral(spark: SparkSession, folder: str) -> DataFrame:
    reduced = spectral.reduce_spectral(_reduced(spark, folder), vector="reduced", n_neighbors=NEAR, components=3, rounds=4)
    return reduced.select("review_id", *[F.round(F.abs(F.get("reduced", F.lit(c))), 2).alias(f"c{c}") for c in range(3)])


def pipeline_topics(spark: SparkSession, folder: str) -> DataFrame:
    docs = reviews(spark, folder).select("review_id", "content_clean")
    topics = DensityTopics(minClusterSize=5, minSamples=2, neighbors=2, epsQuantile=0.45)
    stages = [ReviewTokenizer.of(LEXICON), HashedVectors(features=DIMS), topics]
    path = new_folder(spark, "pipeline")
    Pipeline(stages=stages).fit(docs.where("review_id % 2 = 0")).save(path)
    return PipelineModel.load(path).transform(docs.where("review_id % 2 = 1")).select("review_id", "topic")


def model_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "model-store")
    terms = _terms(spark, folder)  # written once; both versions and the names are made from it
    save_version(spark, path, {"topic_terms": terms.where("rank = 1")}, "an older version")
    tables = {"topic_terms": terms, "topic_names": _written_names(spark, folder, terms)}
    save_version(spark, path, tables, "the last one")
    # A version whose writer stopped before its manifest is not read.
    tables["topic_terms"].limit(0).write.parquet(f"{path}/versions/unfinished/topic_terms")
    model = load_version(spark, path)
    return _rounded(model["topic_terms"].join(model["topic_names"], "topic", "left"))


def export_csv(spark: SparkSession, folder: str) -> DataFrame:
    docs = reviews_topic(spark, folder).select("review_id", "brand", "rating", "content_clean", "topic")
    path = new_folder(spark, "csv")
    write_csv(docs, path)
    return read_csv(spark, path, docs.schema)


QUERIES = {
    function.__name__: function
    for function in (
        top_topics_per_brand,
        brand_topic_counts,
        brand_topic_share,
        brand_topic_share_by_scope,
        rated_reviews,
        low_rated_reviews,
        valid_reviews,
        sample_per_brand,
        clean_review_text,
        brand_counts,
        brands_first_seen,
        dataset_summary,
        dictionary_matches,
        dictionary_matches_table,
        normalize_tokens,
        tokenize_reviews,
        tokenize_low_reviews,
        review_ngrams,
        seed_topic_summary,
        topic_term_frequency,
        class_tfidf,
        class_tfidf_binary,
        class_tfidf_seeded,
        refresh_topic_keywords,
        topic_keywords,
        topic_names,
        outlier_ratio,
        topic_info,
        dictionary_coverage,
        label_reviews,
        topic_examples,
        knn,
        core_distance,
        topic_membership,
        reassign_outliers,
        seed_label_topics,
        seed_guided_vectors,
        hash_embed,
        reduce_pca,
        reduce_random_projection,
        density_topics,
        kmeans_topics,
        hierarchy_topics,
        hierarchy_clusters,
        knn_new_reviews,
        assign_new_reviews,
        distance_quantiles,
        fit_topics,
        fitted_brand_topics,
        fit_topics_all,
        fit_topics_low,
        coverage_by_scope,
        examples_by_scope,
        embedding_cache_misses,
        export_csv,
        reviews_by_position,
        renumbered_low_reviews,
        brands_first_position,
        run_report,
        embedding_cache_fill,
        reduce_spectral,
        pipeline_topics,
        model_round_trip,
    )
}
