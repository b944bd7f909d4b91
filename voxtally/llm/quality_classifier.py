"""Text quality by a small convolutional network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.batches import binary, documents, slices
from voxtally.llm.tables import table

WIDTH = 8  # bytes under a filter
CHUNK = 256  # bytes of a chunk; neighbours overlap by WIDTH - 1, so no window is missed
STEP = CHUNK - WIDTH + 1
DIMS, FILTERS, HIDDEN = 4, 16, 16
PAD = 256  # the symbol after the end of a text
BLOCK = 512  # chunks worked on at once, which bounds memory for texts of any length

# Bounds of what the network is fitted on: labelled documents, and chunks of each.
TRAIN_DOCS = 4_000
TRAIN_CHUNKS = 12
EPOCHS = 8
LEAST_STEPS = 400  # small samples are gone over more often


def chunk_starts(size: int) -> np.ndarray:
    """Where the chunks of a text of ``size`` bytes start; an empty text has one chunk."""
    return np.arange(max(1, -(-(size - WIDTH + 1) // STEP))) * STEP


def chunk_matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunks as rows of symbols; what lies at or after a row's end in ``ends`` is padding."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    symbols = data[np.minimum(at, len(data) - 1)].astype(np.int16)
    return np.where(inside, symbols, PAD)


@dataclass
class Network:
    """Embedding, filters, and two layers that turn a chunk's largest responses into one number."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        def normal(*shape, scale):
            return rng.normal(scale=scale, size=shape).astype(np.float32)

        return cls(
            normal(PAD + 1, DIMS, scale=0.5),
            normal(WIDTH * DIMS, FILTERS, scale=0.25),
            np.zeros(FILTERS, np.float32),
            normal(FILTERS, HIDDEN, scale=0.35),
            np.zeros(HIDDEN, np.float32),
            normal(HIDDEN, scale=0.35),
            np.zeros(1, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """Every filter's response at every place: chunks x places x filters."""
        vectors = self.embed[chunks].reshape(len(chunks), CHUNK * DIMS)
        windows = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH * DIMS, axis=1)[:, ::DIMS]
        flat = np.ascontiguousarray(windows).reshape(-1, WIDTH * DIMS)
        return (flat @ self.filters).reshape(len(chunks), STEP, FILTERS)

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return inner, inner @ self.out + self.out_bias[0]

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        """One number per chunk."""
        return self.head(np.maximum(self.responses(chunks).max(axis=1) + self.bias, 0))[1]

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss of documents, where chunk ``i`` belongs to document ``owner[i]``."""
        raw = self.responses(chunks)
        peak = raw.argmax(axis=1)
        top = np.take_along_axis(raw, peak[:, None], axis=1)[:, 0] + self.bias
        pooled = np.maximum(top, 0)
        inner, logit = self.head(pooled)
        n = np.bincount(owner, minlength=len(labels))
        score = _sigmoid(np.bincount(owner, weights=logit, minlength=len(labels)) / n)
        d_logit = (((score - labels) / n)[owner] / len(labels)).astype(np.float32)
        d_inner = np.outer(d_logit, self.out) * (inner > 0)
        d_top = (d_inner @ self.hidden.T) * (top > 0)
        # Only the window under a filter's largest response moves that filter.
        at = peak[:, :, None] + np.arange(WIDTH)
        symbols = np.take_along_axis(chunks[:, None, :], at, axis=2)
        under = self.embed[symbols].reshape(len(chunks), FILTERS, WIDTH * DIMS)
        d_filters = np.einsum("cf,cfw->wf", d_top, under)
        d_under = (d_top[:, :, None] * self.filters.T[None]).reshape(-1, DIMS)
        d_embed = np.stack(
            [np.bincount(symbols.ravel(), weights=d_under[:, k], minlength=PAD + 1) for k in range(DIMS)], axis=1
        )
        return [
            d_embed, d_filters, d_top.sum(0), pooled.T @ d_inner, d_inner.sum(0), inner.T @ d_logit,
            d_logit.sum(keepdims=True),
        ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(samples: list[tuple[bytes, int]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01) -> Network:
    """Fit a network to ``(chunks as bytes with their lengths in front, label)`` by Adam."""
    rng = np.random.default_rng(9)
    net = Network.fresh(rng)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    per_epoch = -(-len(samples) // batch)
    epochs = max(epochs, -(-LEAST_STEPS // per_epoch)) if samples else 0
    step, steps = 0, epochs * per_epoch
    matrices = [unpack_chunks(blob) for blob, _ in samples]
    labels = np.array([label for _, label in samples], dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            owner = np.repeat(np.arange(len(rows)), [len(matrices[r]) for r in rows])
            grads = net.gradients(np.concatenate([matrices[r] for r in rows]), owner, labels[rows])
            step += 1
            now = rate * (1 - (step - 1) / steps)
            for p, g, (m, v) in zip(net.parameters(), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def pack_chunks(text: bytes, most: int) -> bytes:
    """At most ``most`` chunks of a text, spread evenly over it: per chunk its length and bytes."""
    starts = chunk_starts(len(text))
    if len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).round().astype(int)]
    parts = [text[s : s + CHUNK] for s in starts.tolist()]
    return b"".join(len(p).to_bytes(2, "little") + p.ljust(CHUNK, b"\0") for p in parts)


def unpack_chunks(blob: bytes) -> np.ndarray:
    rows = np.frombuffer(blob, dtype=np.uint8).reshape(-1, CHUNK + 2)
    sizes = rows[:, 0].astype(int) + 256 * rows[:, 1].astype(int)
    return np.where(np.arange(CHUNK) < sizes[:, None], rows[:, 2:].astype(np.int16), PAD)


def score_texts(net: Network, texts: list[bytes]) -> list[float]:
    """The probability of each whole text: the mean of its chunks' numbers, squashed."""
    data = np.frombuffer(b"".join(texts) or b"\0", dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    per_text = [chunk_starts(n) for n in sizes.tolist()]
    counts = np.array([len(x) for x in per_text])
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = np.concatenate(per_text) + offsets[owner]
    ends = (offsets + sizes)[owner]
    totals = np.zeros(len(texts))
    for at in range(0, len(owner), BLOCK):
        part = slice(at, at + BLOCK)
        logits = net.logits(chunk_matrix(data, starts[part], ends[part]))
        totals += np.bincount(owner[part], weights=logits, minlength=len(texts))
    return _sigmoid(totals / counts).tolist()


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; one without an id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit_classifier(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_docs: int = TRAIN_DOCS,
    max_chunks: int = TRAIN_CHUNKS,
) -> Network:
    """A network fitted on a sample of the labelled documents that are not held out.

    The sample is bounded: at most ``max_docs`` labelled ids, by the hash of the id, and at most
    ``max_chunks`` chunks of each document, spread evenly over its whole text, reach the driver.
    Labels other than 0 and 1, null ids and null labels are left out. Without any usable label the
    network stays untrained and every score is near one half.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [pack_chunks(t, max_chunks) for t in binary(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array(blobs, pa.binary())], names=["doc_id", "label", "chunks"]
            )

    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most max_docs ids
        .select("doc_id", "label", "text")
        .mapInArrow(chunks, "doc_id bigint, label int, chunks binary")
        .groupBy("doc_id")
        .agg(F.min(F.struct("chunks", "label")).alias("row"))
        .select("doc_id", "row.*")
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return train([(bytes(r["chunks"]), r["label"]) for r in rows])


def score_quality(
    docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` and the columns of ``carry`` for every row.

    A score comes from the whole text alone, cut into overlapping chunks that cover every byte and
    worked on in blocks of bounded size. A null text scores as an empty one; repeated rows are
    scored one by one.
    """
    rows, rest = documents(docs, doc_id, text, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                scores = score_texts(net, binary(batch["text"]))
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in names), pa.array(scores, pa.float64())], names=[*names, "score"]
                )

    return rows.mapInArrow(run, f"doc_id bigint{rest}, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        *(["rest.*"] if carry else []),
    )


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_quality(docs, fit_classifier(docs, table(spark, folder, "labels")))
