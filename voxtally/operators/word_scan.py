"""Word lists too long to inline: one scan of each text, with the list as a file on every executor.

The driver builds an automaton of the words once and adds it to the application as a file; a Python
worker reads it on first use and keeps it. Texts stay where they are: nothing is exploded or shuffled.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.automaton import WordAutomaton
from voxtally.functions.text import Analyzer, is_blank, letter_runs, text_of
from voxtally.sources.lexicons import Lexicon

PART_CHARS = 16 << 20  # characters of words in one automaton; longer lists make several
BATCH_CHARS = 4 << 20  # characters of texts that are scanned at a time, or one longer text

_added: dict[tuple[str, str], str] = {}


def _add_file(spark: SparkSession, kind: str, key: bytes, make: Callable[[], bytes]) -> str:
    """Give a file to all executors, once per application and content; the name to find it by."""
    context = spark.sparkContext
    name = f"{kind}-{hashlib.sha256(key).hexdigest()}"
    if (context.applicationId, name) not in _added:
        path = Path(tempfile.mkdtemp(prefix="voxtally-")) / name
        path.write_bytes(make())
        context.addFile(str(path))
        _added[context.applicationId, name] = name
    return name


def _read(name: str) -> bytes:
    return Path(SparkFiles.get(name)).read_bytes()


def _as_json(value) -> bytes:
    return json.dumps(value, ensure_ascii=False).encode("utf-8", "surrogatepass")


def _parts(words: Sequence[str], limit: int) -> Iterator[list[str]]:
    part, held = [], 0
    for word in words:
        if part and held + len(word) > limit:
            yield part
            part, held = [], 0
        part.append(word)
        held += len(word)
    if part:
        yield part


@lru_cache(maxsize=4)
def _automaton(name: str, listed: str) -> tuple[WordAutomaton, list[str]]:
    return WordAutomaton.from_bytes(_read(name)), json.loads(_read(listed))


@lru_cache(maxsize=4)
def _rules(name: str) -> tuple[frozenset, frozenset, dict]:
    stop, neg, synonyms = json.loads(_read(name))
    return frozenset(stop), frozenset(neg), synonyms


def _batches(texts: Sequence[str]) -> Iterator[list[str]]:
    batch, held = [], 0
    for text in texts:
        if batch and held + len(text) > BATCH_CHARS:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += len(text)
    if batch:
        yield batch


def _longest(hits: list[str]) -> list[str]:
    """The hits that are in no other hit; words are distinct, so a longer one."""
    return [w for w in hits if not any(len(o) > len(w) and w in o for o in hits)]


def word_scan(
    spark: SparkSession, words: Sequence[str], longest_only: bool = False, part_chars: int = PART_CHARS
) -> Callable[[Column], Column]:
    """A column function from a text to the words that occur anywhere in it, in the list's order.

    ``longest_only`` drops a hit that is part of another hit. A null text has none. The words must be
    distinct; the driver holds the list, and no more than its memory bounds it.
    """
    files = []
    for part in _parts(words, part_chars):
        key = _as_json(part)
        name = _add_file(spark, "words", key, lambda part=part: WordAutomaton.build(part).to_bytes())
        files.append((name, _add_file(spark, "list", key, lambda key=key: key)))
    if not files:
        return lambda text: F.array().cast("array<string>")

    @F.pandas_udf("array<string>")
    def scan(texts: pd.Series) -> pd.Series:
        out: list[list[str]] = []
        for batch in _batches(texts.fillna("").tolist()):
            hits: list[list[str]] = [[] for _ in batch]
            for file in files:
                automaton, listed = _automaton(*file)
                for own, numbers in zip(hits, automaton.find(batch)):
                    own.extend(listed[i] for i in numbers)
            out.extend(map(_longest, hits) if longest_only else hits)
        return pd.Series(out, index=texts.index, dtype="object")

    return scan


def tokenize_scan(
    df: DataFrame,
    lexicon: Lexicon,
    text: str = "content_clean",
    output: str = "tokens",
    low: bool = False,
    analyzer: Analyzer = letter_runs,
    strict_stops: bool = False,
    longest_only: bool = False,
) -> DataFrame:
    """The rows of :func:`voxtally.functions.text.tokenize` for lists of any length; narrow as well."""
    spark = df.sparkSession
    lists = _as_json([list(lexicon.stop_words), list(lexicon.neg_stopwords) if low else [], dict(lexicon.synonyms)])
    rules = _add_file(spark, "rules", lists, lambda: lists)

    @F.pandas_udf("array<string>")
    def tokens(forms: pd.Series, hits: pd.Series) -> pd.Series:
        stop, neg, synonyms = _rules(rules)

        def listed(own, words) -> list[str]:
            if own is None:  # the analyzer failed on the text
                return []
            rest = dict.fromkeys(synonyms.get(f, f) for f in own if f not in stop)
            if strict_stops:
                rest = {w: None for w in rest if w not in stop}
            return [w for w in (*(h for h in words if h not in rest), *rest) if w not in neg]

        return pd.Series([listed(f, h) for f, h in zip(forms, hits)], index=forms.index, dtype="object")

    body = text_of(text)
    forms = F.filter(analyzer(body), lambda t: F.length(t) > 1)
    hits = word_scan(spark, lexicon.user_dict, longest_only)(body)
    empty = F.array().cast("array<string>")
    # Written as columns of their own so that each is worked out once.
    staged = df.withColumn("_forms", forms).withColumn("_hits", hits)
    staged = staged.withColumn("_tokens", tokens("_forms", "_hits"))
    done = F.when(is_blank(text), empty).otherwise(F.col("_tokens"))
    return staged.withColumn(output, done).drop("_forms", "_hits", "_tokens")
