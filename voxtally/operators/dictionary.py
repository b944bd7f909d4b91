"""Dictionary words inside review texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.text import dictionary_hits, text_of
from voxtally.operators.skew import lookup_join
from voxtally.operators.word_scan import word_scan
from voxtally.session import materialize
from voxtally.sources.lexicons import Lexicon


def dictionary_matches(
    df: DataFrame,
    lexicon: Lexicon,
    text: str = "content_clean",
    key: str = "review_id",
    longest_only: bool = False,
) -> DataFrame:
    """``(key, word)`` for every dictionary word that is a substring of the text. Narrow; a lexicon
    past the inline bound is scanned for by an automaton of its words."""
    if lexicon.fits_inline():
        hits = dictionary_hits(text_of(text), lexicon.user_dict, longest_only)
    else:
        hits = word_scan(df.sparkSession, lexicon.user_dict, longest_only)(text_of(text))
    return df.select(key, F.explode(hits).alias("word"))


def dictionary_matches_table(
    df: DataFrame, words: DataFrame, text: str = "content_clean", key: str = "review_id"
) -> DataFrame:
    """The same result for a dictionary table (column ``word``) of any length that the driver can hold.

    Every text is scanned once, whatever the number of words; no text is cut, exploded or shuffled.
    """
    listed = dict.fromkeys(r.word for r in words.select("word").toLocalIterator() if r.word is not None)
    hits = word_scan(df.sparkSession, list(listed))(text_of(text))
    return df.select(key, F.explode(hits).alias("word"))


def keyword_coverage(
    terms: DataFrame, lexicon: Lexicon, label: str = "", top_n: int = 10
) -> DataFrame:
    """Share of the topics' first ``top_n`` keywords that are dictionary words, in percent.

    ``(label, matched, total, coverage)``; the coverage is 0 when there are no keywords.
    """
    first = terms.where((F.col("topic") != -1) & (F.col("rank") <= top_n))
    if not lexicon.fits_inline():
        listed = terms.sparkSession.createDataFrame([(w, True) for w in lexicon.user_dict], "term string, _known boolean")
        flags = materialize(listed, "words")
        first = lookup_join(first, flags, ["term"], by=["topic", "rank"], how="left")
        known = F.coalesce("_known", F.lit(False))
    else:
        known = F.col("term").isin(list(lexicon.user_dict)) if lexicon.user_dict else F.lit(False)
    return (
        first.agg(
            F.coalesce(F.sum(known.cast("long")), F.lit(0)).alias("matched"),
            F.count("*").alias("total"),
        )
        .select(
            F.lit(label).alias("label"),
            "matched",
            "total",
            F.when(F.col("total") > 0, F.col("matched") / F.col("total") * 100)
            .otherwise(F.lit(0.0))
            .alias("coverage"),
        )
    )
