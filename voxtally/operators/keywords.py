"""Keywords per topic: term counts, class-based TF-IDF, top terms and topic names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.operators.skew import lookup_join
from voxtally.session import materialize, scratch
from voxtally.sources.lexicons import NOISE_LABEL, TOPIC_PREFIX

TOP_WORDS = 10
MAX_DF = 0.9
SEED_BOOST = 1.2
# Weights are ranked at this many decimals, so that ties fall to the term and not to float noise.
RANK_DECIMALS = 9
# Tokens that a task counts at once; more of them give fewer rows to the shuffle.
COUNT_TOKENS = 1_000_000
# Parts of a topic's terms for each word asked for; more of them leave fewer terms to sort.
PARTS_PER_WORD = 8
# Counts of topics and terms that a task joins at once.
TERM_ROWS = 500_000


def _grams(codes: np.ndarray, docs: np.ndarray, words: int, low: int, high: int) -> Iterator[tuple]:
    """For each length, the distinct n-grams within a document as rows of word codes, and the n-gram
    and the place of every occurrence."""
    forms, which, place = np.arange(words)[:, None], codes, np.arange(len(codes))
    for n in range(1, high + 1):
        if n > 1:
            whole = place + n - 1 < len(codes)
            whole[whole] = docs[place[whole]] == docs[place[whole] + n - 1]
            place = place[whole]
            pairs, which = np.unique(which[whole] * words + codes[place + n - 1], return_inverse=True)
            forms = np.column_stack([forms[pairs // words], pairs % words])
        if n >= low:
            yield forms, which, place


def _joined(left: str | None, right: str | None) -> str:
    return " ".join(w for w in (left, right) if w is not None)


def _counted(topics: pa.Array, lists: pa.Array, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """``(topic, term, n)`` of some reviews, one row per topic and term (two if tokens have blanks)."""
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    words = coded.dictionary
    if not len(words):
        return
    docs = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    coded_topics = topics.dictionary_encode(null_encoding="encode")
    topic_of = coded_topics.indices.to_numpy().astype("int64")[docs]
    codes = coded.indices.to_numpy().astype("int64")
    for forms, which, place in _grams(codes, docs, len(words), low, high):
        pairs, n = np.unique(topic_of[place] * len(forms) + which, return_counts=True)
        parts = [words.take(pa.array(part)) for part in forms[pairs % len(forms)].T]
        if len(parts) == 1:
            term = parts[0]
        elif words.null_count:  # missing tokens are passed over, as by ``ngrams``
            rows = zip(*[part.to_pylist() for part in parts])
            term = pa.array([reduce(_joined, row) for row in rows], pa.string())
        else:
            term = pc.binary_join_element_wise(*parts, " ")
        topic = coded_topics.dictionary.take(pa.array(pairs // len(forms)))
        yield pa.RecordBatch.from_arrays([topic, term, pa.array(n, pa.int64())], ["topic", "term", "n"])


def _count_in_task(low: int, high: int, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            start = 0
            ends = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy().cumsum()
            while start < len(ends):  # a batch of long texts is counted in parts
                used = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, used + limit - size, side="right")))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - used)
                start = stop
                if size >= limit or start < len(ends):
                    yield from _flushed(held, low, high)
                    held, size = [], 0
        if held:
            yield from _flushed(held, low, high)

    return run


def _flushed(held: list[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    if len(rows):
        topics, tokens = (rows.column(c).chunk(0) for c in ("topic", "tokens"))
        yield from _counted(topics, tokens, low, high)


def topic_term_frequency(
    docs: DataFrame, tokens: str = "tokens", low: int = 1, high: int = 2, limit: int = COUNT_TOKENS
) -> DataFrame:
    """``(topic, term, n)`` over the n-grams of each review's tokens.

    Tasks count ``limit`` tokens at a time as numbers and only distinct terms become rows. These are
    dealt by topic and term before they are added up, so that no task holds a map of all its terms.
    """
    kind = docs.schema["topic"].dataType.simpleString()
    rows = docs.select("topic", F.col(tokens).alias("tokens"))
    counted = rows.mapInArrow(_count_in_task(low, high, limit), f"topic {kind}, term string, n bigint")
    dealt = counted.repartition("topic", "term")
    return dealt.groupBy("topic", "term").agg(F.sum("n").alias("n"))


def with_totals(counts: DataFrame, min_df: int, max_df: Column) -> DataFrame:
    """The written ``counts`` of terms in ``min_df`` to ``max_df`` topics, with the total ``_f`` of the term.

    The counts are dealt by term once, which both the totals and the join read. A partition holds
    about ``TERM_ROWS`` rows whatever the size of the table, so neither side has to be sorted.
    """
    by_term = counts.repartition(max(1, -(-counts.count() // TERM_ROWS)), "term")
    # Together all rows; they name every column, so that Spark reads the same shuffle again.
    df = F.count("topic") + F.count_if(F.col("topic").isNull())
    terms = by_term.groupBy("term").agg(df.alias("_df"), F.sum("n").alias("_f"))
    used = terms.where((F.col("_df") >= min_df) & (F.col("_df") <= max_df)).drop("_df")
    # A join and no window by term: a common term has a row in every topic, and topics may be many.
    return by_term.join(used.hint("shuffle_hash"), "term")


def class_tfidf(
    docs: DataFrame,
    tokens: str = "tokens",
    tf_mode: str = "binary",
    min_df: int = 1,
    max_df: float = MAX_DF,
    reduce_frequent_words: bool = True,
    seed_words: Sequence[str] = (),
    boost: float = SEED_BOOST,
    low: int = 1,
    high: int = 2,
) -> DataFrame:
    """``(topic, term, n, weight)``: each topic taken as one document.

    The weight is the term's share of its topic, square-rooted when ``reduce_frequent_words``,
    times ``ln(1 + A / f)``. A is the mean number of terms per topic as a whole number and f the
    term's total over all topics. ``min_df`` (topics) and ``max_df`` (share of topics) prune the
    vocabulary first. Seed words weigh ``boost`` times as much. With ``tf_mode='binary'`` a term
    counts once per topic, with ``'count'`` once per occurrence.
    """
    if tf_mode not in ("binary", "count"):
        raise ValueError(f"unknown tf_mode {tf_mode!r}")
    topics = docs.select("topic").distinct().agg(F.count("*").alias("_topics")).scalar()
    counts = topic_term_frequency(docs, tokens, low, high)
    if tf_mode == "binary":
        counts = counts.withColumn("n", F.lit(1).cast("long"))
    with scratch(docs.sparkSession) as keep:
        counts = materialize(counts, "topic-counts")
        joined = with_totals(counts, min_df, F.lit(max_df) * topics)
        kept = keep(materialize(joined.withColumn("_topics", topics), "topic-terms"))
    totals = kept.groupBy("topic").agg(F.sum("n").alias("_total"))
    mean = kept.agg(F.floor(F.sum("n") / F.max("_topics")).alias("_mean")).scalar()
    share = F.col("n") / F.col("_total")
    if reduce_frequent_words:
        share = F.sqrt(share)
    weight = share * F.log(1 + mean / F.col("_f"))
    if seed_words:
        weight = weight * F.when(F.col("term").isin(list(seed_words)), F.lit(boost)).otherwise(1.0)
    return lookup_join(kept, totals, ["topic"], by=["term"]).select(
        "topic", "term", "n", weight.alias("weight")
    )


def refresh_keywords(docs: DataFrame, **options) -> DataFrame:
    """Weights for changed topics, by default without the square root."""
    return class_tfidf(docs, **{"reduce_frequent_words": False, **options})


def top_terms(weights: DataFrame, top_n: int = TOP_WORDS) -> DataFrame:
    """``(topic, rank, term, weight)``: the heaviest terms of each topic.

    Terms fall into more parts than ``top_n``, and the ``top_n``-th of a topic's highest weights per
    part is a weight that none of its heaviest terms is below. Only terms that reach it are sorted.
    """
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS_PER_WORD * max(top_n, 1)))
    highest = weights.groupBy("topic", part.alias("_part")).agg(F.max("weight").alias("_high"))
    last = F.get(F.sort_array(F.collect_list("_high"), asc=False), F.lit(top_n - 1))
    # Weights that are equal once rounded differ by less than this.
    bound = last - 10.0 ** (1 - RANK_DECIMALS)
    bounds = materialize(highest.groupBy("topic").agg(bound.alias("_bound")), "term-bounds")
    near = lookup_join(weights, bounds, ["topic"], by=["term"], how="left").where(
        F.col("_bound").isNull() | (F.col("weight") >= F.col("_bound"))
    )
    order = Window.partitionBy("topic").orderBy(F.desc(F.round("weight", RANK_DECIMALS)), "term")
    return (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select("topic", "rank", "term", "weight")
    )


def terms_of_topic(terms: DataFrame, topic: int) -> DataFrame:
    """One topic's keywords, best first."""
    return terms.where(F.col("topic") == topic).orderBy("rank")


def topic_names(
    topics: DataFrame, terms: DataFrame, top_n: int = 3, prefix: str = TOPIC_PREFIX
) -> DataFrame:
    """``(topic, topic_name)`` for each topic in ``topics``: its first keywords joined by ``_``.

    A topic without keywords, or whose first keyword is empty, is named by its number.
    """
    words = (
        terms.where(F.col("rank") <= top_n)
        .groupBy("topic")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_ranked"))
        .select("topic", F.col("_ranked.term").alias("_words"))
    )
    first = F.get("_words", F.lit(0))
    name = F.when(
        first.isNull() | (first == ""), F.concat(F.lit(prefix), F.col("topic").cast("string"))
    ).otherwise(F.array_join(F.filter("_words", lambda w: w != ""), "_"))
    return (
        topics.where(F.col("topic") != -1)
        .select("topic")
        .distinct()
        .join(words, "topic", "left")
        .select("topic", name.alias("topic_name"))
    )


def label_reviews(
    docs: DataFrame, names: DataFrame, key: str = "review_id", noise: str = NOISE_LABEL
) -> DataFrame:
    """Add ``topic_name`` to each review; outliers get the noise label.

    Names are worked out once per topic. ``names`` should be a written table.
    """
    joined = lookup_join(docs, names, ["topic"], by=[key], how="left")
    return joined.withColumn(
        "topic_name", F.when(F.col("topic") == -1, F.lit(noise)).otherwise(F.col("topic_name"))
    )
