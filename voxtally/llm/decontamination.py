"""Benchmark passages in documents, found by one Aho-Corasick automaton over words."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.batches import binary, documents, runs, slices
from voxtally.llm.tables import table
from voxtally.session import materialize

WINDOW = 10
# Bytes of benchmark text that one automaton is built from; a larger benchmark takes more of them.
AUTOMATON_BYTES = 8 << 20


def _word_table() -> bytes:
    """Word bytes (0-9, a-z and those of non-ASCII characters) stay, A-Z fall, others are blanks."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    fall = {c: c + 32 for c in range(0x41, 0x5B)}
    return bytes(fall.get(c, c if c in keep else 0x20) for c in range(256))


# One byte for one byte, so that places in the normalised text are places in the original.
WORD_TABLE = _word_table()


class Passages:
    """The automaton over the windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self._codes: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, text in items:
            words = [
                self._codes.setdefault(w, len(self._codes) + 1)
                for w in text.translate(WORD_TABLE).split()
            ]
            for start in range(max(len(words) - window, 0) + 1 if words else 0):
                owners[tuple(words[start : start + window])].add(name)
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, names in owners.items():
            self._automaton.add_word(words, (len(words), frozenset(names)))
        self._automaton.make_automaton()
        self._empty = not owners

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all occurrences, in order of their ends, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if not self._empty and words:
            for last, (size, owners) in self._automaton.iter(
                tuple(map(self._codes.get, words, repeat(0)))
            ):
                spans.append((last + 1 - size, last + 1))
                names |= owners
        return spans, names


STATE = "n_words bigint, hits array<bigint>, items array<string>"


def _scan(items: list[tuple[str, bytes]], window: int):
    """Add the words and items that one automaton finds to those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(items, window)
        for whole in batches:
            for batch in slices(whole, "text"):
                hits, names, counts = [], [], []
                old_hits, old_names = batch["hits"].to_pylist(), batch["items"].to_pylist()
                for text, before, known in zip(binary(batch["text"]), old_hits, old_names):
                    words = text.translate(WORD_TABLE).split()
                    spans, found = passages.find(words)
                    counts.append(len(words))
                    hits.append(sorted({*before, *(i for a, b in spans for i in range(a, b))}))
                    names.append(sorted({*known, *found}))
                found = {
                    "n_words": pa.array(counts, pa.int64()),
                    "hits": pa.array(hits, pa.list_(pa.int64())),
                    "items": pa.array(names, pa.list_(pa.string())),
                }
                columns = [c for c in batch.schema.names if c not in found]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in columns), *found.values()], names=[*columns, *found]
                )

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit words as byte ranges of the original text, and the digest of the items."""
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = []
            for text, hits, items in zip(
                binary(batch["text"]), batch["hits"].to_pylist(), batch["items"].to_pylist()
            ):
                spans = []
                if hits:
                    data = np.frombuffer(text.translate(WORD_TABLE), dtype=np.uint8)
                    starts, ends = runs(data != 0x20)
                    inside = np.zeros(len(starts), dtype=bool)
                    inside[hits] = True
                    spans = [
                        {"start": int(starts[a]), "end": int(ends[b - 1])}
                        for a, b in zip(*runs(inside))
                    ]
                digest = hashlib.sha256(",".join(items).encode()).hexdigest()
                rows.append((len(hits), items, digest, bool(hits), spans))
            columns = list(zip(*rows)) if rows else [[]] * 5
            found = {
                "n_hit": pa.array(columns[0], pa.int64()),
                "n_items": pa.array([len(x) for x in columns[1]], pa.int64()),
                "items_sha256": pa.array(columns[2], pa.string()),
                "contaminated": pa.array(columns[3], pa.bool_()),
                "items": pa.array(columns[1], pa.list_(pa.string())),
                "spans": pa.array(columns[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
            before = [c for c in batch.schema.names if c not in ("hits", "items")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in before), *found.values()], names=[*before, *found])


REPORT = (
    "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start: bigint, end: bigint>>"
)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    automaton_bytes: int = AUTOMATON_BYTES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id``, ``text``, what each row shares with the benchmark as in ``REPORT``, and ``carry``.

    Words are runs of digits, letters and non-ASCII characters, with A-Z lower-cased. Every
    ``window`` consecutive words of an item are a passage, and so are all words of a shorter item.
    ``spans`` are the byte ranges of the hit words in the UTF-8 of the original text.

    Documents are never shuffled: every task scans its texts once with the automaton of the whole
    benchmark. A benchmark above ``automaton_bytes`` is dealt into parts of about that size by the
    hash of its rows, and the documents pass one part after the other; the result is the same.
    Null and empty texts have no words and hit nothing, a null ``item_id`` counts as an item with an
    empty name, items with one id count as one, and an empty benchmark leaves all clean. Repeated
    documents are judged one by one.
    """
    rows = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"),
        F.col(item_text).cast("binary").alias("text"),
    ).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-size // automaton_bytes) or 1
    state, rest = documents(docs, doc_id, text, carry)
    own = f"doc_id bigint, text string{rest}, "
    state = state.select(
        "*",
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<bigint>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    for part in range(parts):
        chosen = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        items = [(r["item_id"], bytes(r["text"])) for r in chosen]
        state = state.mapInArrow(_scan(items, window), own + STATE)
        if part < parts - 1:
            state = materialize(state, "scanned")
    found = state.mapInArrow(_report, own + REPORT)
    return found.select("*", "rest.*").drop("rest") if carry else found


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP8_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
),
items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
passages AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS passage
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
),
places AS (
    SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS passage
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM docs, (SELECT DISTINCT n FROM passages) WHERE len(w) >= n)
),
hits AS (SELECT rid, item_id, i, n FROM places JOIN passages USING (n, passage)),
words AS (
    SELECT rid, count(DISTINCT word) AS n_hit
    FROM (SELECT rid, unnest(range(i, i + n)) AS word FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid
),
owners AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN owners USING (rid)
"""
