"""Spelling variants: words one edit apart, found by search schemes over full-text indexes of the vocabulary.

One edit lies in one half of a word, so the other half is met as it stands: a near word begins with the word's first
half, or ends with its second. The vocabulary is dealt twice, by its first and by its last two letters, so that a word
is searched only among words that can hold that half. A hot pair of letters is dealt in several parts, and words that
search there visit each.

A part's words, parted by a delimiter, are one text. Its suffixes are sorted, and an interval of suffix ranks stands
for all places of a string; ranks in the last column (the letters before the suffixes) prolong the string by a letter
to the left. The search takes the delimiter and the half exactly, then goes on through the other half with one error
allowed, up to the next delimiter. The other direction does the same over the reversed words. As the delimiter is the
smallest letter, the rank of ``delimiter + word`` is the word's number in order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tables import settle

# The letters of a word, and the rule that deletes a letter of some occurrences.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
EVERY = 97
MIN_LENGTH, MIN_COUNT = 5, 3
KEY = 2
# Words of one index, and queries searched at a time; distinct words held while counting; code points looked at once.
PART, CHUNK, HELD, STRETCH = 20_000, 2048, 200_000, 1 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}


# ---- vocabulary -----------------------------------------------------------------


def _stretches(text: str) -> Iterator[str]:
    """The text in parts that cut no run of letters."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and LETTERS.match(text, end - 1, end + 1):
            end += 1
        yield text[at:end]
        at = end


def spelled(doc_id: str, run: str) -> str:
    """A run of letters as it is counted: A-Z lower-cased, in some documents with a letter deleted."""
    run = run.lower() if run.isascii() else run.translate(_LOWER)
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
            own: Counter = Counter()
            for part in _stretches(text.as_py() or ""):
                own.update(LETTERS.findall(part))
            doc_id = key.as_py() or ""
            for run, n in own.items():
                word = spelled(doc_id, run)
                if len(word) >= MIN_LENGTH:
                    total[word] += n
            if len(total) > HELD:
                yield flushed()
                total.clear()
    yield flushed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts that occur ``MIN_COUNT`` times or more."""
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


# ---- index ----------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by doubling the length that ranks compare."""
    n, width = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        later = np.zeros(n, np.int64)
        later[: n - width] = rank[width:] + 1 if width < n else 0
        order = np.argsort(key := rank * (n + 1) + later, kind="stable")
        key = key[order]
        new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        rank[order] = new
        if new[-1] == n - 1 or width >= n:
            return order
        width *= 2


class Index:
    """A full-text index of distinct words; strings grow to the left."""

    def __init__(self, words: list[str]):
        self.order = sorted(range(len(words)), key=words.__getitem__)
        joined = "\0" + "".join(words[i] + "\0" for i in self.order)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)
        text = np.searchsorted(self.alphabet, points)
        self.n = len(text)
        suffixes = suffix_order(text)
        self.before = text[suffixes - 1]
        # Sorted by letter and rank, a place in this list is the rank of the longer string.
        self.occurrences = np.sort(self.before * self.n + np.arange(self.n))

    def letters(self, words: list[str], longest: int) -> np.ndarray:
        """Letters of words from right to left; letters that the index lacks stand beyond its alphabet."""
        out = np.zeros((len(words), longest + 1), np.int64)
        for i, w in enumerate(words):
            points = np.frombuffer(w[::-1].encode("utf-32-le"), np.uint32)
            at = np.searchsorted(self.alphabet, points)
            known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points
            out[i, : len(points)] = np.where(known, at, len(self.alphabet))
        return out

    def grown(self, letter, low, high):
        """Intervals of the strings with a letter put before."""
        return np.searchsorted(self.occurrences, letter * self.n + low), np.searchsorted(self.occurrences, letter * self.n + high)

    def letters_before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the interval, letter) of the letters, other than the delimiter, that stand before."""
        size, many = high - low, len(self.alphabet)
        wide = np.flatnonzero(size > many)
        at_wide, letter_wide = np.repeat(wide, many - 1), np.tile(np.arange(1, many), len(wide))
        slim = np.flatnonzero(size <= many)
        each = np.repeat(slim, size[slim])
        within = np.arange(len(each)) - np.repeat(np.cumsum(size[slim]) - size[slim], size[slim])
        both = np.unique(each * many + self.before[low[each] + within])
        at, letter = np.r_[at_wide, both // many], np.r_[letter_wide, both % many]
        return at[letter > 0], letter[letter > 0]

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, place of the word) of words one edit from ``words``, the last ``exact`` letters equal."""
        size = np.array([len(w) for w in words])
        letters = self.letters(words, int(size.max(initial=0)))
        query = np.arange(len(words))
        low, high = self.grown(np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), self.n))
        found: list[tuple] = []
        for at in range(letters.shape[1]):
            # One error here: a letter left out, another one in its place, or one more before it.
            may = np.flatnonzero(exact[query] <= at)
            if len(may):
                q, lo, hi = query[may], low[may], high[may]
                inner = at < size[q]
                found.append((q[inner], np.full(int(inner.sum()), at + 1), lo[inner], hi[inner]))
                own, letter = self.letters_before(lo, hi)
                grown = self.grown(letter, lo[own], hi[own])
                other = inner[own] & (letter != letters[q[own], at])
                found.append((q[own], np.full(len(own), at), *grown))
                found.append((q[own][other], np.full(int(other.sum()), at + 1), grown[0][other], grown[1][other]))
            go = at < size[query]
            query, low, high = query[go], low[go], high[go]
            low, high = self.grown(letters[query, at], low, high)
            alive = low < high
            query, low, high = query[alive], low[alive], high[alive]
            if not len(query):
                break
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        query, at, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        hits = []
        while len(query):
            alive = low < high
            query, at, low, high = query[alive], at[alive], low[alive], high[alive]
            ends = at == size[query]
            # The places beyond a word hold 0, the delimiter.
            low, high = self.grown(letters[query, at], low, high)
            done = ends & (low < high)
            hits.append(np.unique(query[done] * self.n + low[done]))
            query, at, low, high = query[~ends], at[~ends] + 1, low[~ends], high[~ends]
        pair = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        # Rank 0 is the delimiter at the end of the text.
        return pair // self.n, np.array(self.order, np.int64)[pair % self.n - 1]


class Part:
    """The words of one part with their counts, and the search for what is near to others among them.

    Forward, near words begin with the query's first half; backward, they end with its second and do not begin with the first.
    """

    def __init__(self, words: list[str], counts: list[int], backward: bool):
        self.words, self.counts, self.backward = words, np.array(counts, np.int64), backward
        self.rank = np.empty(len(words), np.int64)
        self.rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        self.index = Index(words if backward else [w[::-1] for w in words])

    def near(self, queries: list[str]) -> list[tuple[str, int, int, str]]:
        """(query, number of near words, largest count, its word) for queries with a near word here."""
        size = np.array([len(w) for w in queries])
        half = size // 2
        exact = size - half if self.backward else half
        query, near = self.index.one_error(queries if self.backward else [w[::-1] for w in queries], exact)
        if self.backward:
            pairs = zip(query.tolist(), near.tolist(), strict=True)
            keep = np.array([not self.words[v].startswith(queries[q][: half[q]]) for q, v in pairs], bool)
            query, near = query[keep], near[keep]
        best = np.lexsort((self.rank[near], -self.counts[near], query))
        query, near = query[best], near[best]
        first = np.flatnonzero(np.r_[np.ones(min(1, len(query)), bool), query[1:] != query[:-1]])
        size = np.diff(np.r_[first, len(query)])
        out = zip(query[first].tolist(), size.tolist(), near[first].tolist(), strict=True)
        return [(queries[q], n, int(self.counts[v]), self.words[v]) for q, n, v in out]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words part by part; rows come sorted by part, a part's words before its queries."""
    number: int | None = None
    part: Part | None = None
    words, counts, queries = [], [], []
    last = None

    def found() -> pa.RecordBatch:
        nonlocal part
        if part is None:
            part = Part(words, counts, bool(number & 1))
        cols = list(zip(*part.near(queries), strict=True)) if queries and words else []
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        cols = [pa.array(c, t) for c, t in zip(cols or [[]] * 4, types, strict=True)]
        queries.clear()
        return pa.RecordBatch.from_arrays(cols, names=["word", "n_near", "form_n", "form"])

    for batch in batches:
        for mine, asks, word, n in zip(*[batch.column(c).to_pylist() for c in ("part", "asks", "word", "n")], strict=True):
            if mine != number:
                if queries:
                    yield found()
                number, part, last = mine, None, None
                words, counts, queries = [], [], []
            if not asks:
                words.append(word)
                counts.append(n)
            elif word != last:
                last = word
                queries.append(word)
                if len(queries) >= CHUNK:
                    yield found()
    if queries:
        yield found()


def near_forms(words: DataFrame, part_size: int = PART) -> DataFrame:
    """``word, n_near, form, form_n``: the number of near words, and of these the one of largest ``n``."""
    n = words.count()
    parts = max(16, -(-2 * n // part_size))
    keyed = words.select(
        "word", "n", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.substring("word", 1, KEY).alias("key")),
            F.struct(F.lit(1).alias("side"), F.expr(f"right(word, {KEY})").alias("key")),
        )).alias("k"),
    ).select("word", "n", "k.side", "k.key")
    hot = keyed.groupBy("side", "key").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_size)).cast("int").alias("shares"))
    keyed = keyed.join(hot, ["side", "key"])
    share = F.pmod(F.xxhash64("word"), F.col("shares")).cast("int")

    def part_of(share: Column) -> Column:
        return (F.pmod(F.xxhash64("key", share), F.lit(parts)) * 2 + F.col("side")).cast("bigint").alias("part")

    held = keyed.select(part_of(share), F.lit(0).alias("asks"), "word", "n")
    each = keyed.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    asked = each.select(part_of(F.col("share")), F.lit(1).alias("asks"), "word", "n")
    rows = held.union(asked).repartition("part").sortWithinPartitions("part", "asks", "word")
    found = rows.mapInArrow(_searched, "word string, n_near bigint, form_n bigint, form string")
    # The larger count first, then the smaller word: both are one order of (-n, word).
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.order")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the forms that follow each other (``word, form``), by doubling the steps."""
    step = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = F.col("far").isNotNull().alias("moved")
        step = settle(step.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), moved))
        if not step.filter("moved").count():
            return step.select("word", "root")
        step = step.select("word", "root")


def spelling_variants(docs: DataFrame, part_size: int = PART) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of the vocabulary; other columns of ``docs`` are ignored.

    A word's form is its near word (one code point inserted, deleted or replaced) of largest ``n``, ties to the smallest,
    if that is twice the word's own ``n`` or more. Null texts have no words; a row without id counts its runs as if its
    id were the empty string; repeated rows count each time. Without words the result is empty.
    """
    words = settle(vocabulary(docs))
    near = words.join(near_forms(words, part_size), "word", "left")
    has = F.col("form_n") >= 2 * F.col("n")
    forms = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"),
    )
    forms = settle(forms)
    out = forms.join(_roots(forms.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
