"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are estimated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.tables import table
from voxtally.session import materialize

ROUNDS = 25
PRIOR = 0.5
FIRST_ACCURACY = 0.8
# Accuracies stay within these bounds, so that no vote is certain or turns into its opposite.
LEAST, MOST = 0.55, 0.99

_BLANK = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """How many words lie in windows of five that the text has at least twice."""
    last = F.size(words) - WINDOW
    windows = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
    )

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("i"))))
        return _let(
            placed,
            lambda rows: F.aggregate(
                F.array_sort(
                    F.filter(
                        F.transform(
                            rows,
                            lambda row, i: F.when(
                                (row["key"] == F.get(rows, i - 1)["key"])
                                | (row["key"] == F.get(rows, i + 1)["key"]),
                                row["i"],
                            ),
                        ),
                        lambda i: i.isNotNull(),
                    )
                ),
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                lambda seen, i: F.struct(
                    i.alias("last"), (seen["n"] + F.least(F.lit(WINDOW), i - seen["last"])).alias("n")
                ),
                lambda seen: seen["n"],
            ),
        )

    found = _let(
        windows,
        lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), covered(keys)).otherwise(0),
    )
    return F.when(last >= 1, found).otherwise(F.lit(0))


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts over each whole text: one row per row of ``docs``; a null text has no words."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, _BLANK + "+")
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_different"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def line_counts(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    def count(pattern: str) -> Column:
        return F.regexp_count("text", F.lit(pattern)).cast("long")

    return source.select(
        "doc_id",
        _let(words, counts).alias("w"),
        _let(lines, line_counts).alias("l"),
        (F.length("text") - count(_BLANK)).alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        count(r"[\p{Lu}]{2,}").alias("n_capitals"),
        count(r"[\p{L}][.!?](?=\s|$)").alias("n_stops"),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_capitals", "n_stops")


def _vote(good: Column, bad: Column) -> Column:
    """1 for good, 0 for bad, 2 for no vote."""
    return F.when(bad, 0).when(good, 1).otherwise(2)


def votes() -> list[Column]:
    """Each rule's vote from the counts of :func:`features`."""
    n, no = F.col("n_words"), F.lit(False)
    plain = (F.col("n_symbols") * 50 <= n) & (F.col("n_capitals") * 10 <= n)
    # A stop after a word of letters, at least once in eighty words and at most every second word.
    prose = (F.col("n_stops") * 80 >= n) & (F.col("n_stops") * 2 <= n)
    long_words, short_words = F.col("word_chars") > n * 9, F.col("word_chars") < n * 3
    return [
        _vote(no, F.col("n_symbols") * 10 > n),
        _vote(no, F.col("n_capitals") * 4 > n),
        _vote(no, F.col("n_repeat_words") * 10 > n),
        _vote(no, (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3) & (F.col("n_dup_lines") > 1)),
        _vote(no, (F.col("n_different") * 4 < n) & (n < 400)),
        _vote(no, long_words | short_words),
        _vote(plain & prose & ~long_words & ~short_words, ~plain | (F.col("n_stops") * 2 > n)),
        _vote((F.col("n_repeat_words") * 100 <= n * 5) & plain, F.col("n_repeat_words") * 5 > n),
    ]


def posterior(accuracies: list[float], prior: float = PRIOR) -> Column:
    """The probability that a document is good, given the votes ``v0``, ``v1`` …"""
    odds = F.log(F.lit(prior / (1 - prior)))
    for k, accuracy in enumerate(accuracies):
        weight = F.log(F.lit(accuracy / (1 - accuracy)))
        vote = F.col(f"v{k}")
        odds = odds + F.when(vote == 1, weight).when(vote == 0, -weight).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-odds))


def estimate_accuracies(
    patterns: DataFrame, n_rules: int, rounds: int = ROUNDS, prior: float = PRIOR
) -> list[float]:
    """Expectation-maximisation of the rules' accuracies.

    ``patterns`` has the votes ``v0`` … and the number ``n`` of documents that vote so: at most
    three to the power of the number of rules rows, whatever the size of the corpus. Each round is
    one aggregate over that table and brings one row of sums to the driver.
    """
    accuracies = [FIRST_ACCURACY] * n_rules
    for _ in range(rounds):
        scored = patterns.withColumn("p", posterior(accuracies, prior))
        sums = scored.agg(
            *(
                F.sum(
                    F.col("n")
                    * F.when(F.col(f"v{k}") == 1, F.col("p"))
                    .when(F.col(f"v{k}") == 0, 1 - F.col("p"))
                    .otherwise(0.0)
                ).alias(f"right{k}")
                for k in range(n_rules)
            ),
            *(F.sum(F.when(F.col(f"v{k}") < 2, F.col("n")).otherwise(0)).alias(f"cast{k}") for k in range(n_rules)),
        ).first()
        # One vote more on either side of the first guess keeps rules that hardly vote near it.
        accuracies = [
            min(MOST, max(LEAST, ((sums[f"right{k}"] or 0.0) + 2 * FIRST_ACCURACY) / ((sums[f"cast{k}"] or 0) + 2)))
            for k in range(n_rules)
        ]
    return accuracies


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``quality`` (the posterior) and ``kept`` for every row of ``docs``.

    Base: fewer than ten words, or more than a fifth of the words in repeated windows, fails. The
    rules' accuracies are estimated over all documents that pass the base, and of these the ones
    with a posterior of at least one half are kept. Null and empty texts fail the base; repeated
    rows are judged one by one; an empty table gives no rows.
    """
    n = F.col("n_words")
    failed = (n < 10) | (F.col("n_repeat_words") * 100 > n * 20)
    ballots = votes()
    judged = features(docs, doc_id, text).select(
        "*", failed.alias("base_failed"), *(v.alias(f"v{k}") for k, v in enumerate(ballots))
    )
    judged = materialize(judged, "votes")
    cast = [f"v{k}" for k in range(len(ballots))]
    patterns = materialize(
        judged.where("NOT base_failed").groupBy(*cast).agg(F.count("*").alias("n")).coalesce(1), "patterns"
    )
    accuracies = estimate_accuracies(patterns, len(ballots))
    quality = posterior(accuracies)
    return judged.withColumn("quality", quality).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"),
        "quality",
    )


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(table(spark, folder, "documents")).drop("quality")
