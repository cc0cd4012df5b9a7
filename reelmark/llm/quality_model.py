"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed in one pass over Arrow batches and written, so training and
scoring read numbers only. Trees are grown on a bounded sample of labelled rows with 8-bit histograms and
flattened into arrays of complete binary trees, which a task walks for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.tables import settle
from .arrays import Block, Words, blocks, words
from .texts import nested

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "points", "exclaims", "pipes", "newlines", "not_ascii",
    "distinct_words", "top_word", "same_as_before", "distinct_triples", "capital_words", "shout_words", "symbol_words",
    "exclaim_words", "lone_symbols", "long_words", "words_a_point",
)
# Largest number of labelled rows that training reads; beyond it, rows with the smallest id hashes count.
SAMPLE = 60_000
BINS = 64

_UPPER, _LOWER, _DIGIT, _SYMBOL, _POINT, _EXCLAIM, _PIPE, _NEWLINE, _LEAD, _OTHER = range(10)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
_CLASS[[ord(c) for c in "#*$%&<>@~^_=+/\\{}[]`"]] = _SYMBOL
_CLASS[[ord(c) for c in ".,;:?"]] = _POINT
_CLASS[ord("!")], _CLASS[ord("|")], _CLASS[10], _CLASS[0xC0:] = _EXCLAIM, _PIPE, _NEWLINE, _LEAD


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of distinct values, and the count of the most frequent one."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    own = (key[at] >> np.uint64(40)).astype(int)
    size = np.diff(np.r_[at, len(key)])
    most = np.zeros(n, int)
    np.maximum.at(most, own, size)
    return np.bincount(own, minlength=n), most


def block_statistics(block: Block) -> np.ndarray:
    """One row of ``FEATURES`` for each document of a block."""
    n, w = block.n, words(block, lower=False)
    counts = w.count()
    nw = np.maximum(counts, 1)
    size = np.diff(block.offsets)
    nb = np.maximum(size, 1)
    doc = np.repeat(np.arange(n), size)
    kinds = _CLASS[block.data]
    c = np.bincount(doc * 10 + kinds, minlength=n * 10).reshape(n, 10)
    letters = np.maximum(c[:, _UPPER] + c[:, _LOWER] + c[:, _LEAD], 1)
    each = lambda mask: np.bincount(w.doc[mask], minlength=n)
    head, tail = kinds[w.start] if len(w.start) else kinds[:0], kinds[w.end - 1] if len(w.end) else kinds[:0]
    width = w.end - w.start
    loud = np.r_[0, np.cumsum(kinds == _UPPER)]
    quiet = np.r_[0, np.cumsum(kinds == _LOWER)]
    n_loud, n_quiet = loud[w.end] - loud[w.start], quiet[w.end] - quiet[w.start]
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    distinct, top = _distinct(w.doc, w.hash, n)
    m = max(0, len(w.hash) - 2)
    whole = w.doc[:m] == w.doc[2:]
    triple = w.hash[:m] * np.uint64(3) + w.hash[1 : m + 1] * np.uint64(5) + w.hash[2:] * np.uint64(7) if m else w.hash[:0]
    triples, _ = _distinct(w.doc[:m][whole], triple[whole], n)
    sentences = each((tail == _POINT) | (tail == _EXCLAIM))
    columns = [
        np.log1p(counts), np.bincount(w.doc, weights=width, minlength=n) / nw, c[:, _UPPER] / letters, c[:, _DIGIT] / nb,
        c[:, _SYMBOL] / nb, c[:, _POINT] / nb, c[:, _EXCLAIM] / nb, c[:, _PIPE] / nb, c[:, _NEWLINE] / nb, c[:, _LEAD] / nb,
        distinct / nw, top / nw, each(again) / nw, triples / np.maximum(counts - 2, 1), each(head == _UPPER) / nw,
        each((n_loud > 1) & (n_quiet == 0)) / nw, each(tail == _SYMBOL) / nw, each(tail == _EXCLAIM) / nw,
        each((width == 1) & ((head == _SYMBOL) | (head == _PIPE))) / nw, each(width > 20) / nw,
        counts / np.maximum(sentences, 1),
    ]
    return np.column_stack(columns).astype(np.float32)


def _statistics_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [block_statistics(b) for b in blocks(batch.column("text"))]
        x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)
        columns = [batch.column("doc"), *[pa.array(x[:, i]) for i in range(x.shape[1])]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", *FEATURES])


def statistics(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` as ``doc``, with ``FEATURES``. Null and empty texts have zeros."""
    rows = nested(docs).select("doc", "text")
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, " + ", ".join(f"{f} float" for f in FEATURES)
    return rows.mapInArrow(_statistics_job, schema)


@dataclass
class Trees:
    """Complete binary trees of one depth: inner nodes in level order, then leaf values."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: int = 20) -> Trees:
    """Boosted trees for log loss. With no rows or one class only, a constant score near that class."""
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = (np.zeros((n_trees, k), t) for k, t in ((inner, int), (inner, np.float32), (leaves, float)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, feature[:0], threshold[:0], value[:0])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    raw = np.full(len(y), base)
    for t in range(n_trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), int)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            best = np.zeros(k)
            cut_at, cut_of = np.full(k, BINS), np.zeros(k, int)
            for j in range(x.shape[1]):
                at = node * BINS + binned[:, j]
                sums = [np.bincount(at, w, k * BINS).reshape(k, BINS).cumsum(1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                b = gain.argmax(1)
                better = gain[np.arange(k), b] > best + 1e-12
                best[better], cut_at[better], cut_of[better] = gain[better, b[better]], b[better], j
            for q in range(k):
                feature[t, first + q] = cut_of[q]
                threshold[t, first + q] = cuts[cut_of[q]][cut_at[q]] if cut_at[q] < BINS else np.inf
            node = 2 * node + (binned[np.arange(len(y)), cut_of[node]] > cut_at[node])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value[t] = rate * gs / (hs + l2)
        raw += value[t][node]
    return Trees(base, feature, threshold, value)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from labelled rows outside the held-out fold; ``sample`` bounds what the driver reads."""
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    x = stats.select(F.col("doc.doc_id").alias("doc_id"), *FEATURES)
    rows = x.join(own, "doc_id").orderBy(F.xxhash64("doc_id"), *FEATURES).limit(sample).toPandas()
    return grow(rows[list(FEATURES)].to_numpy(np.float32), rows["quality"].to_numpy(float))


def with_scores(stats: DataFrame, trees: Trees) -> DataFrame:
    """``doc`` and ``score``, the chance of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(trees.score(x))], names=["doc", "score"])

    return stats.mapInArrow(run, f"doc {stats.schema['doc'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All rows and columns of ``docs`` as ``doc``, with ``score``.

    Rows are scored one by one from their text alone: repeated texts get equal scores, empty and null texts
    the score of a text without words. Without labels, or with labels of one kind, all get one score. An empty
    table gives an empty result. ``labels`` has ``doc_id, quality``; rows with nulls there are left out.
    """
    stats = settle(statistics(docs))
    return with_scores(stats, train(stats, labels, sample))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", "text")
    stats = settle(statistics(rows).withColumn("doc", F.struct("doc.doc_id")))
    scored = with_scores(stats, train(stats, labels)).select("doc.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
