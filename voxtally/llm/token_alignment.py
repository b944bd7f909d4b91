"""Alignment of two tokenizers over the same texts: shared cuts, links and how common links are."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.batches import binary, slices
from voxtally.llm.byte_bpe import encoder, vocabulary
from voxtally.llm.tables import table
from voxtally.llm.token_planes import from_planes, to_planes
from voxtally.operators.skew import skew_join
from voxtally.session import materialize

KNOWN_WORDS, KNOWN_CHARS = 1 << 18, 256  # words that a task keeps with their ids, and their length
LOOKUP_PAIRS = 2_000_000  # pairs whose counts may travel to every task, at 17 bytes each
_WORD = re.compile(" +[^ ]*")
_HELD = 1 << 20  # pairs that a task counts up before it gives them on

_ALIGNED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, links binary"
)
_ALIGNED_NAMES = "row doc_id n_a n_b n_groups n_links groups_sha256 links".split()
_SCORED = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, byte_bpe: str, pieces: str):
        self.encode_a = encoder(byte_bpe).encode
        entries = vocabulary(byte_bpe)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            self.bytes_a[number] = entry
        model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self._model, self.size_b, self._blank = model, model.get_piece_size(), model.piece_to_id("▁")
        self._known: dict[str, list[int] | None] = {}
        self.bytes_b = [self._bytes(i) for i in range(self.size_b)]
        self.sizes_a, self.sizes_b = (
            np.fromiter(map(len, b), dtype=np.int64, count=len(b)) for b in (self.bytes_a, self.bytes_b)
        )
        # Ids as text with what may follow them.
        self.text_a, self.text_b = (
            {s: np.array([f"{i}{s}" for i in range(n)], dtype=object) for s in signs}
            for n, signs in ((len(self.bytes_a), ",|"), (self.size_b, ",;"))
        )

    def _bytes(self, number: int) -> bytes:
        piece = self._model.id_to_piece(number)
        if self._model.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode_b(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts, to each of which the model adds a blank; None if they do not give the text back.

        No piece has a blank after another character, so a text with its blank is encoded word by
        word, each with the blanks before it; words that are new are encoded together. The model
        reads the sign for a blank as one, so texts with that sign are never given back.
        """
        words = [_WORD.findall(" " + text) if text and "▁" not in text else [] for text in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self._known]
        for word, ids in zip(new, self._model.encode([w[1:] for w in new], num_threads=1)):
            ids = ids or [self._blank]  # the word is the blank itself
            given = b"".join([self.bytes_b[i] for i in ids])
            self._known[word] = ids if given == word.encode("utf-8", "replace") else None
        out = []
        for own in words:
            found = [self._known[w] for w in own]
            lost = not found or None in found
            out.append(None if lost else np.fromiter(chain.from_iterable(found), dtype=np.int64))
        if len(self._known) > KNOWN_WORDS:
            self._known = {}
        for word in new:
            if len(word) > KNOWN_CHARS:
                self._known.pop(word, None)
        return out


@lru_cache(maxsize=1)
def _tokenizers(byte_bpe: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_bpe, pieces)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def shared_groups(
    ends_a: np.ndarray, ends_b: np.ndarray, intervals: np.ndarray
) -> np.ndarray:
    """The smallest groups between ends that A and B share, as rows ``(a0, a1, b0, b1)`` in order.

    ``intervals`` has such rows of tokens that end together, one per text, in order. Each is cut at
    the shared end nearest to the middle of its A tokens: the end of A there is looked up by bisection
    among those of B, and if it is none of them, those further out on both sides. Both halves go the
    same way, and an interval in which no end is shared is a group. All intervals of a depth go
    together.
    """
    groups, active = [], tuple(c[intervals[:, 1] > intervals[:, 0]] for c in intervals.T)
    while len(active[0]):
        a0, a1, b0, b1 = active
        single = (a1 - a0 == 1) | (b1 - b0 == 1)
        groups.append(tuple(c[single] for c in active))
        a0, a1, b0, b1 = (c[~single] for c in active)
        cut = (a0 + a1 - 2) >> 1
        place = np.searchsorted(ends_b, ends_a[cut])
        lost = np.flatnonzero(ends_b[np.minimum(place, len(ends_b) - 1)] != ends_a[cut])
        if len(lost):
            cut[lost], place[lost] = _widen(ends_a, ends_b, a0[lost], a1[lost], cut[lost])
            whole = cut < 0
            groups.append(tuple(c[whole] for c in (a0, a1, b0, b1)))
            a0, a1, b0, b1, cut, place = (c[~whole] for c in (a0, a1, b0, b1, cut, place))
        # Halves side by side, so that lookups go on in order.
        cut, place = cut + 1, place + 1
        active = tuple(np.stack(c, axis=1).ravel() for c in ((a0, cut), (cut, a1), (b0, place), (place, b1)))
    out = np.stack([np.concatenate(c) for c in zip(*groups)], axis=1) if groups else np.zeros((0, 4), np.int64)
    return out[np.argsort(out[:, 0], kind="stable")]


def _widen(
    ends_a: np.ndarray, ends_b: np.ndarray, a0: np.ndarray, a1: np.ndarray, middle: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The shared end nearest to each middle, the middle itself left out, and its place in B; -1 where
    an interval has none. Of two as near the earlier one is taken. Steps double from look to look."""
    cut, place = np.full(len(a0), -1), np.full(len(a0), -1)
    asking, reach, inner = np.arange(len(a0)), 1, 0
    while len(asking):
        m = middle[asking]
        low, high = np.maximum(a0[asking], m - reach), np.minimum(a1[asking] - 2, m + reach)
        sizes = np.concatenate((np.maximum(m - inner - low, 0), np.maximum(high - m - inner, 0)))
        at, of = _ragged(np.concatenate((low, m + inner + 1)), sizes)
        of %= len(asking)
        found = np.searchsorted(ends_b, ends_a[at])
        hit = ends_b[np.minimum(found, len(ends_b) - 1)] == ends_a[at]
        at, of, found = at[hit], of[hit], found[hit]
        # From far to near, and from right to left, so that what is written last is the one to take.
        order = np.lexsort((-at, -np.abs(at - m[of])))
        cut[asking[of[order]]], place[asking[of[order]]] = at[order], found[order]
        on = (cut[asking] < 0) & ((low > a0[asking]) | (high < a1[asking] - 2))
        asking, inner, reach = asking[on], reach, 2 * reach
    return cut, place


def _pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Distinct pairs in order and how often each is linked, small."""
    steps = np.diff(pairs, prepend=0)
    if len(steps) and steps.max() >= 1 << 32:
        raise ValueError("the vocabularies have too many pairs")
    planes = b"".join([*to_planes(steps), *to_planes(times)])
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    n = len(data) // 8
    planes = [data[p * n : (p + 1) * n] for p in range(8)]
    return np.cumsum(from_planes(planes[:4], n).astype(np.int64)), from_planes(planes[4:], n).astype(np.int64)


def _align_texts(texts: list[bytes], both: Tokenizers) -> list[tuple]:
    """``(n_a, n_b, n_groups, n_links, groups_sha256, links)`` of each text."""
    words = [t.decode("utf-8", "replace") for t in texts]
    none = np.zeros(0, dtype=np.int64)
    ids_b = [none if ids is None else ids for ids in both.encode_b(words)]
    # A byte-level tokenizer gives back all bytes of what it reads, so a text is lost if it is no UTF-8.
    ids_a = [
        np.frombuffer(both.encode_a(b" " + t), dtype="<u4").astype(np.int64) if len(b) and w.encode() == t else none
        for t, w, b in zip(texts, words, ids_b)
    ]
    ids_b = [b if len(a) else none for a, b in zip(ids_a, ids_b)]
    n_a, n_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (ids_a, ids_b))
    all_a, all_b = np.concatenate(ids_a), np.concatenate(ids_b)
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    # A text has as many bytes in A as in B, so offsets may run on from text to text.
    ends_a, ends_b = np.cumsum(both.sizes_a[all_a]), np.cumsum(both.sizes_b[all_b])
    groups = shared_groups(ends_a, ends_b, np.stack((to_a - n_a, to_a, to_b - n_b, to_b), axis=1))
    a0, a1, b0, b1 = groups.T
    per_text = np.searchsorted(a0, to_a) - np.searchsorted(a0, to_a - n_a)

    # Tokens that overlap are in one group: no token reaches over a shared end.
    low = np.searchsorted(ends_b, ends_a - both.sizes_a[all_a], side="right")
    high = np.searchsorted(ends_b - both.sizes_b[all_b], ends_a, side="left")
    to, of = _ragged(low, high - low)
    text_of = np.repeat(np.arange(len(texts)), n_a)[of]
    span = len(both.bytes_a) * both.size_b
    keys, times = np.unique(text_of * span + all_a[of] * both.size_b + all_b[to], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
    n_links = np.bincount(text_of, minlength=len(texts))

    # Written out, a group's A tokens stand before its B tokens.
    written = np.empty(len(all_a) + len(all_b), dtype=object)
    group_of_a, group_of_b = np.repeat(np.arange(len(a0)), a1 - a0), np.repeat(np.arange(len(a0)), b1 - b0)
    written[np.arange(len(all_a)) + b0[group_of_a]] = both.text_a[","][all_a]
    written[np.arange(len(all_b)) + a1[group_of_b]] = both.text_b[","][all_b]
    written[a1 - 1 + b0] = both.text_a["|"][all_a[a1 - 1]]
    written[b1 - 1 + a1] = both.text_b[";"][all_b[b1 - 1]]
    out = []
    for row in range(len(texts)):
        start, end = to_a[row] - n_a[row] + to_b[row] - n_b[row], to_a[row] + to_b[row]
        line = "".join(written[start:end].tolist())[:-1]
        own = slice(cuts[row], cuts[row + 1])
        out.append(
            (
                int(n_a[row]),
                int(n_b[row]),
                int(per_text[row]),
                int(n_links[row]),
                hashlib.sha256(line.encode()).hexdigest() if line else "",
                _pack(keys[own] - row * span, times[own]),
            )
        )
    return out


def _align(byte_bpe: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = _tokenizers(byte_bpe, pieces), TaskContext.get().partitionId() << 40
        kinds = [*[pa.int64()] * 6, pa.string(), pa.binary()]
        for whole in batches:
            for batch in slices(whole, "text"):
                found = _align_texts(binary(batch["text"]), both)
                rows = [(row + i, d, *f) for i, (d, f) in enumerate(zip(batch["doc_id"].to_pylist(), found))]
                row += len(rows)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=_ALIGNED_NAMES)

    return run


def align_tokenizers(
    docs: DataFrame, byte_bpe: str, pieces: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every document's alignment, as a written table with the columns of ``_ALIGNED``.

    ``byte_bpe`` (A) and ``pieces`` (B) are the paths of a byte-level BPE file and of a piece model
    that adds a blank; A gets that blank before the text. ``groups_sha256`` hashes the groups as
    ``a1,a2|b1;a3|b2,b3``. ``links`` packs the distinct linked id pairs and how often each occurs;
    :func:`pair_counts` and :func:`score_links` read it. ``row`` is a number of the row.

    Special tokens inside texts are plain text. Texts that are null or empty, or whose bytes one of
    the tokenizers does not give back, have no tokens: zeros, and an empty ``groups_sha256``.
    Repeated rows are documents of their own, and no rows give no rows. A task takes texts of about
    1 MB at a time, or one longer text.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(_align(byte_bpe, pieces), _ALIGNED), "aligned")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and in how many documents each is, counted up within the task."""
    held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        own = [_unpack(x)[0] for x in batch["links"].to_pylist()]
        pairs, n = np.unique(np.concatenate(own), return_counts=True) if own else held
        both = np.concatenate((held[0], pairs))
        pairs, at = np.unique(both, return_inverse=True)
        n = np.bincount(at, weights=np.concatenate((held[1], n)), minlength=len(pairs)).astype(np.int64)
        held = pairs, n
        if len(pairs) > _HELD:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["pair", "n"])
            held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["pair", "n"])


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``(pair, a, b, n, best)``: in how many documents each pair of ids is linked, and whether no
    other pair of the A id is in more. ``pair`` is ``a * size_b + b``.

    Tasks count up before the shuffle; an A id has at most ``size_b`` pairs, so its window is bounded.
    """
    counts = aligned.select("links").mapInArrow(_count, "pair bigint, n bigint").groupBy("pair").agg(
        F.sum("n").alias("n")
    )
    a = F.expr(f"pair div {size_b}").alias("a")
    found = counts.select("pair", a, (F.col("pair") % size_b).alias("b"), "n")
    best = F.col("n") == F.max("n").over(Window.partitionBy("a"))
    return materialize(found.withColumn("best", best), "pair-counts")


def _score(held, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = held.value
        for batch in batches:
            links = [_unpack(x) for x in batch["links"].to_pylist()]
            if not links:
                continue
            sizes = np.fromiter((len(p) for p, _ in links), dtype=np.int64, count=len(links))
            at = np.searchsorted(pairs, np.concatenate([p for p, _ in links]))
            times, of = np.concatenate([t for _, t in links]), np.repeat(np.arange(len(links)), sizes)
            found = {"count_sum": np.zeros(len(links), np.int64), "n_best": np.zeros(len(links), np.int64)}
            np.add.at(found["count_sum"], of, times * n[at])
            np.add.at(found["n_best"], of, times * best[at])
            columns = [pa.array(found[c]) if c in found else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' pairs as rows."""
    for whole in batches:
        for start in range(0, whole.num_rows, 64):
            batch = whole.slice(start, 64)
            links = [_unpack(x) for x in batch["links"].to_pylist()]
            sizes = [len(p) for p, _ in links]
            rows = np.repeat(batch["row"].to_numpy(), sizes)
            pairs, times = (np.concatenate([x[i] for x in links]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rows, pairs, times)], names=["row", "pair", "times"])


def score_links(aligned: DataFrame, counts: DataFrame, limit: int = LOOKUP_PAIRS) -> DataFrame:
    """The documents with ``n_best``, links whose pair is a best one of its A id, and ``count_sum``,
    the counts of all links.

    While there are at most ``limit`` pairs their counts travel to the tasks and documents stay where
    they are. Beyond that the documents' pairs are rows that meet the counts in a join which splits
    common pairs, and are added up by document.
    """
    spark = aligned.sparkSession
    kept = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
    schema = f"{kept}, n_best bigint, count_sum bigint, groups_sha256 string"
    if counts.limit(limit + 1).count() <= limit:
        rows = counts.select("pair", "n", "best").toArrow().sort_by("pair")
        held = tuple(rows[c].to_numpy().astype(np.int64) for c in ("pair", "n", "best"))
        return aligned.mapInArrow(_score(spark.sparkContext.broadcast(held), _SCORED), schema)
    links = aligned.select("row", "links").mapInArrow(_split, "row bigint, pair bigint, times bigint")
    links = materialize(links, "links")
    met = skew_join(links, counts.select("pair", "n", "best"), ["pair"], by=["row"])
    sums = met.groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        F.sum(F.col("times") * F.col("best").cast("int")).alias("n_best"),
    )
    zero = F.lit(0).cast("bigint")
    return aligned.drop("links").join(sums, "row", "left").select(
        *[F.coalesce(c, zero).alias(c) if c in ("count_sum", "n_best") else c for c in _SCORED]
    )


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    size_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    docs = table(spark, folder, "documents")
    aligned = align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), pieces)
    return score_links(aligned, pair_counts(aligned, size_b))
