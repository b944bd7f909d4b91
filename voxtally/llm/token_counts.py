"""Token counts under a unigram model, computed once per shared prefix of distinct words."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.batches import binary, slices
from voxtally.llm.byte_bpe import vocabulary
from voxtally.llm.tables import table

CACHE_WORDS = 400_000
SLICE = 4 << 20
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


class UnigramModel:
    """A vocabulary of byte strings with log probabilities.

    They are those of ``scores``, whose keys are then the vocabulary; without it they fall with the
    rank (Zipf's law), which is a stand-in for a trained model's. The vocabulary has every single byte, so each word has a segmentation. Its automaton maps a
    state and a byte to the next state; ``ends`` has the log probability of the states that are
    whole pieces.
    """

    def __init__(self, pieces: Mapping[bytes, int], scores: Mapping[bytes, float] | None = None):
        if scores is None:
            total = math.log(sum(1 / (rank + 1) for rank in pieces.values()))
            scores = {piece: -math.log(rank + 1) - total for piece, rank in pieces.items()}
        elif any(bytes([byte]) not in scores for byte in range(256)):
            raise ValueError("the scores must have every single byte, or some words have no segmentation")
        self.steps: dict[int, int] = {}
        self.ends: dict[int, float] = {}
        states = 1
        for piece, score in scores.items():
            state = 0
            for byte in piece:
                key = state << 8 | byte
                if key not in self.steps:
                    self.steps[key] = states
                    states += 1
                state = self.steps[key]
            self.ends[state] = score

    def count_words(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """The number of pieces in each word's most probable segmentation (of ties, the shortest).

        A word is segmented with a space in front. The words are walked in sorted order, which
        visits the nodes of their trie depth first: for every node on the path the best score, its
        number of pieces, and the pieces that may still grow are kept, so a prefix that words share
        is computed once. A word's count is what its last node holds.
        """
        steps, ends = self.steps, self.ends
        scores, counts, growing = [0.0], [0], [[]]
        self._extend(0x20, scores, counts, growing)
        found, previous = {}, b""
        for word in sorted(words):
            shared = _common(previous, word)
            del scores[shared + 2 :], counts[shared + 2 :], growing[shared + 2 :]
            for byte in word[shared:]:
                self._extend(byte, scores, counts, growing)
            found[word] = counts[-1]
            previous = word
        return found

    def _extend(self, byte: int, scores: list, counts: list, growing: list) -> None:
        """Go down to the child ``byte`` of the node at the end of the path."""
        steps, ends = self.steps, self.ends
        best, fewest, alive = -math.inf, 0, []
        at = len(scores) - 1
        for start, state in (*growing[-1], (at, 0)):
            state = steps.get(state << 8 | byte)
            if state is None:
                continue
            alive.append((start, state))
            end = ends.get(state)
            if end is not None:
                score, n = scores[start] + end, counts[start] + 1
                if score > best or score == best and n < fewest:
                    best, fewest = score, n
        scores.append(best)
        counts.append(fewest)
        growing.append(alive)


def _common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while a[low] == b[low]:
        low += 1
    return low


@lru_cache(maxsize=2)
def _model(path: str) -> UnigramModel:
    return UnigramModel(vocabulary(path))


def count_tokens(
    docs: DataFrame,
    vocabulary_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    scores: Mapping[bytes, float] | None = None,
) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` for every row of ``docs``, over its whole text.

    Words are what blanks (``\\x20``, ``\\x09`` to ``\\x0D``) separate. Each task looks up words it has
    counted before, in a dictionary of bounded size, and counts the other distinct words of a slice
    of texts in one walk over their trie. Nothing is shuffled. Null and empty texts have no words;
    repeated rows are counted one by one.

    ``scores``, the log probability of each piece of a unigram model, takes the place of the file; it
    must have every single byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = UnigramModel({}, scores) if scores is not None else _model(vocabulary_path), {}
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                words = [text.split() for text in binary(batch["text"])]
                new = set().union(*words).difference(known) if words else set()
                if len(known) + len(new) > CACHE_WORDS:
                    known.clear()
                    new = set().union(*words)
                known.update(model.count_words(new))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"],
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([sum(map(known.__getitem__, w)) for w in words], pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_tokens"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
