"""Text as column expressions: cleaning, tokens, dictionary hits, n-grams.

Everything here stays in the JVM and is narrow: no shuffle, no Python worker, unless the caller
plugs in an analyzer of their own or word lists too long to inline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.sources.lexicons import TARGET_TAGS, Lexicon

# The characters that Unicode counts as white space for str.strip (fixed values).
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

Analyzer = Callable[[Column], Column]


def text_of(column: str | Column) -> Column:
    """The text, or an empty string for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def strip(column: str | Column) -> Column:
    """Both ends freed of Unicode white space; Spark's plain trim knows only U+0020."""
    return F.trim(column, F.lit(WHITESPACE))


def is_blank(column: str | Column) -> Column:
    return strip(text_of(column)) == ""


def clean_text(column: str | Column, patterns: Sequence[str]) -> Column:
    """Delete every match of each pattern in turn, then strip. Null becomes an empty string.

    ``(?U)`` makes ``\\d`` and ``\\s`` cover all of Unicode.
    """
    cleaned = reduce(
        lambda col, pattern: F.regexp_replace(col, "(?U)" + pattern, ""), patterns, text_of(column)
    )
    return strip(cleaned)


def letter_runs(column: Column) -> Column:
    """The default analyzer: lower-cased runs of two or more letters."""
    return F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}]{2,}"), F.lit(0))


def tagged_analyzer(
    analyse: Callable[[str], Iterable[tuple[str, str]]],
    tags: Sequence[str] = TARGET_TAGS,
    errors: Accumulator | None = None,
) -> Analyzer:
    """Turn a morphological analyser into an analyzer column function.

    ``analyse`` yields ``(form, tag)`` pairs; only the given tags are kept. A text on which it
    raises gives null, which the tokenizer turns into an empty list; ``errors``, an accumulator of
    the Spark context, counts such texts (those of repeated tasks again).
    """
    keep = frozenset(tags)

    def forms(text: str | None) -> list[str] | None:
        try:
            return [form for form, tag in analyse(text or "") if tag in keep]
        except Exception:
            if errors is not None:
                errors.add(1)
            return None

    @F.pandas_udf("array<string>")
    def analyzer(texts: pd.Series) -> pd.Series:
        return texts.map(forms)

    return analyzer


def dictionary_hits(column: Column, words: Sequence[str], longest_only: bool = False) -> Column:
    """The words that occur anywhere in the text, in dictionary order.

    ``longest_only`` drops a hit that is part of another hit.
    """
    if not words:
        return F.array().cast("array<string>")
    hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(column, w))
    if longest_only:
        inside = {w: [o for o in words if o != w and w in o] for w in words}
        longer = {w: o for w, o in inside.items() if o}
        for word, others in longer.items():
            hits = F.when(
                F.arrays_overlap(hits, F.array(*[F.lit(o) for o in others])),
                F.array_remove(hits, word),
            ).otherwise(hits)
    return hits


def normalize(tokens: Column, synonyms: dict[str, str]) -> Column:
    """Each token replaced by its normal form where it has one."""
    if not synonyms:
        return tokens
    pairs = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(pairs, t), t))


def without(tokens: Column, words: Sequence[str]) -> Column:
    """Tokens that are not among ``words``; repeats stay."""
    return F.filter(tokens, lambda t: ~t.isin(list(words))) if words else tokens


def tokenize(
    df: DataFrame,
    lexicon: Lexicon,
    text: str = "content_clean",
    output: str = "tokens",
    low: bool = False,
    analyzer: Analyzer = letter_runs,
    strict_stops: bool = False,
    longest_only: bool = False,
) -> DataFrame:
    """Add the dictionary-first token list of each text.

    The length test and the stop words see the raw form, then synonyms apply, then only the first
    occurrence stays. Dictionary words found as substrings come first and are not stop-filtered.
    ``low`` also drops the extra stop words of the low-rating scope, dictionary words included.
    ``strict_stops`` applies the stop words once more after the synonyms.

    Lists past the inline bound become files on the executors that Python workers scan texts with;
    that form has the same rows as result and is as narrow.
    """
    if not lexicon.fits_inline():
        # Imported late: the operators are built on this module.
        from voxtally.operators.word_scan import tokenize_scan

        return tokenize_scan(df, lexicon, text, output, low, analyzer, strict_stops, longest_only)
    forms = F.filter(analyzer(text_of(text)), lambda t: F.length(t) > 1)
    rest = normalize(without(forms, lexicon.stop_words), lexicon.synonyms)
    if strict_stops:
        rest = without(rest, lexicon.stop_words)
    hits = dictionary_hits(text_of(text), lexicon.user_dict, longest_only)
    staged = df.withColumn("_rest", F.array_distinct(rest)).withColumn("_hits", hits)
    tokens = F.concat(F.array_except("_hits", "_rest"), F.col("_rest"))
    if low:
        tokens = without(tokens, lexicon.neg_stopwords)
    empty = F.array().cast("array<string>")
    tokens = F.when(is_blank(text) | F.col("_rest").isNull(), empty).otherwise(tokens)
    return staged.withColumn(output, tokens).drop("_rest", "_hits")


def ngrams(tokens: str | Column, low: int = 1, high: int = 2) -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens, joined by a space."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens

    def runs(n: int) -> Column:
        if n == 1:
            return tokens
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        shifted = [F.slice(tokens, F.lit(i + 1), count) for i in range(n)]
        return reduce(
            lambda left, right: F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b)), shifted
        )

    parts = [runs(n) for n in range(low, high + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]
