"""Near-duplicate documents with DartMinHash signatures.

Each element of a weighted set owns a strip of the plane, its weight wide and endless upwards (the rank).
Darts hit a strip as a Poisson process that only the element's hash decides, so sets that share an element
share its darts below the smaller weight. A set keeps the darts of its strips up to a rank that brings about
``K ln K + 2 K`` of them, whatever its size; a dart's hash names a coordinate, and the earliest dart of each
coordinate is the signature. Two sets agree in a coordinate with the chance of their weighted Jaccard
similarity. Darts come in rank order within a strip, so only those that count are ever drawn.

Copies (equal words) fall into one class first. Signatures are cut into bands; classes that share a band meet
in a bucket. Pairs are never formed within a bucket of one group: each class is held against the first class
of the bucket, links are verified by exact similarity, and connected classes become groups. Classes whose
bucket holds several groups, as a passage common to unlike documents makes them, go through an exact prefix
filter over their shingles: first against the first class of each prefix bucket, then all pairs of members of
groups that are still different, so no link between two groups is lost there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tables import settle
from .arrays import MASK, MIX_1, MIX_2, SHINGLE, Words, blocks, mixed, shingles, words
from .texts import nested, unnested

SIMILARITY = 0.8
WIDTH = 5
COORDINATES, ROWS = 96, 4
# Groups of a bucket that meet in one cell, from each side.
BLOCK = 256


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, rank_limit: np.ndarray):
    """(doc, id, rank) of the darts in the weighted regions, up to each document's rank limit.

    Strips are [0, 1), [1, 2), [2, 4), [4, 8) ... of the weight axis, so a region is a few whole strips and
    part of one; in that one a dart counts if its place is below the weight.
    """
    out, low, width, strip = [], 0.0, 1.0, 0
    while True:
        own = np.flatnonzero(weight > low)
        if not len(own):
            break
        rank = np.zeros(len(own))
        nth = 0
        while len(own):
            h = mixed(element[own] + np.uint64(((strip << 32) + nth) * MIX_1 & MASK))
            rank = rank - np.log(_unit(h)) / width
            alive = rank < rank_limit[doc[own]]
            own, rank, h = own[alive], rank[alive], h[alive]
            inside = low + width * _unit(mixed(h + np.uint64(MIX_2))) < weight[own]
            out.append((doc[own[inside]], mixed(h[inside] ^ np.uint64(MIX_2)), rank[inside]))
            nth += 1
        low, width, strip = low + width, max(1.0, low + width), strip + 1
    if not out:
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """(n, k) earliest dart ids; documents without elements have zeros.

    A document that leaves a coordinate empty throws again up to twice the rank, until none is empty.
    """
    sig = np.zeros((n, k), np.uint64)
    mass = np.bincount(doc, weights=weight, minlength=n)
    limit = (k * math.log(k) + 2 * k) / np.maximum(mass, 1e-300)
    todo = mass > 0
    while todo.any():
        mine = todo[doc]
        d, ids, rank = throw(doc[mine], element[mine], weight[mine], limit)
        slot = d * k + (ids % np.uint64(k)).astype(int)
        best = np.full(n * k, np.inf)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        flat = np.zeros(n * k, np.uint64)
        flat[slot[won]] = ids[won]
        full = todo & np.isfinite(best.reshape(n, k)).all(1)
        sig[full] = flat.reshape(n, k)[full]
        todo &= ~full
        limit = limit * 2
    return sig


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = sig.shape
    cut = sig.reshape(n, k // rows, rows)
    h = np.arange(k // rows, dtype=np.uint64)[None, :] * np.uint64(MIX_1)
    for r in range(rows):
        h = mixed(h + cut[:, :, r] * np.uint64(SHINGLE[r % len(SHINGLE)]))
    return h.view(np.int64)


def word_sequence_keys(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's words in order; documents without words are equal."""
    place = np.arange(len(w.hash)) - w.first[w.doc]
    keys = []
    for seed in (SHINGLE[0], SHINGLE[1]):
        part = mixed(w.hash ^ mixed(place.astype(np.uint64) * np.uint64(seed) + np.uint64(seed)))
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(part)]
        keys.append((sums[w.first[1:]] - sums[w.first[:-1]]).view(np.int64))
    return keys[0], keys[1]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "k1", "k2", "n", "bands"]
    for batch in batches:
        ids = batch.column("doc_id")
        for b in blocks(batch.column("text")):
            w = words(b)
            doc, element = shingles(w, WIDTH)
            bands = band_hashes(signatures(doc, element, np.ones(len(doc)), b.n))
            n = np.bincount(doc, minlength=b.n)
            has = n > 0
            ends = np.cumsum(np.where(has, bands.shape[1], 0))
            k1, k2 = word_sequence_keys(w, b.n)
            cols = [ids.slice(b.first, b.n), pa.array(k1), pa.array(k2), pa.array(n), _lists(bands[has].ravel(), ends)]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for b in blocks(batch.column("text")):
            doc, element = shingles(words(b), WIDTH)
            ends = np.cumsum(np.bincount(doc, minlength=b.n))
            cols = [ids.slice(b.first, b.n), _lists(element.view(np.int64), ends)]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "own"])


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that edges (``a, b``) connect a node with.

    Each round takes the smallest label around a node and then follows labels of labels, so rounds grow with
    the logarithm of a chain. The driver sees one count a round.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(nodes.select("node", F.col("node").alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(around, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        least = settle(least)
        jump = least.select(F.col("node").alias("j"), F.col("label").alias("far"))
        moved = settle(
            least.join(jump, F.col("label") == F.col("j"), "left")
            .select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        )
        labels = moved.select("node", "label")
        if not moved.filter("label <> old").count():
            return labels


def _near_in_length(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least) - 1e-9


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (``a, b``) whose exact Jaccard similarity is at least ``least``."""
    left = sets.select(F.col("rep").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("own").alias("own_b"))
    both = F.size(F.array_intersect("own_a", "own_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.filter(both >= (F.size("own_a") + F.size("own_b") - both) * F.lit(least) - 1e-9).select("a", "b")


def _room(n: str, at: str, least: float) -> Column:
    """What is left of a class's shingles from place ``at`` on, less its part of what a pair must have in common.

    ``at`` is the place of the bucket's shingle in the class's prefix. Two sets of ``n`` and ``m`` shingles need
    ``t = least / (1 + least) * (n + m)`` in common, so their first common shingle has ``at + t <= n`` in each.
    """
    return F.col(n) - F.col(at) - F.col(n) * F.lit(least / (1 + least))


def _pair_bounds(least: float) -> Column:
    share = F.lit(least / (1 + least))
    fits = (F.col("r_n") * share <= _room("l_n", "l_at", least) + 1e-6) & (F.col("l_n") * share <= _room("r_n", "r_at", least) + 1e-6)
    return fits & _near_in_length("l_n", "r_n", least)


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("l_rep", "r_rep").alias("a"), F.greatest("l_rep", "r_rep").alias("b")).distinct()


def _side(members: DataFrame, side: str) -> DataFrame:
    return members.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in ("label", "rep", "n", "at")])


def _in_mixed_buckets(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several groups."""
    mixed_buckets = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return members.join(mixed_buckets.select("bucket"), "bucket")


def _with_first(members: DataFrame, least: float) -> DataFrame:
    """Pairs of a bucket's first class and the bucket's members of other groups: one for each member at most."""
    first = members.groupBy("bucket").agg(F.min(F.struct("rep", "label", "n", "at")).alias("l"))
    first = first.select("bucket", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("rep", "label", "n", "at")])
    met = first.join(_side(members, "r"), "bucket")
    return _ordered(met.filter((F.col("l_label") != F.col("r_label")) & _pair_bounds(least)))


def _between_groups(members: DataFrame, least: float) -> DataFrame:
    """All pairs of members (``bucket, rep, n, at, label``) of different groups of a bucket that the bounds allow.

    Groups meet first, each two of a bucket once, so pairs within a group are never formed. A bucket of many groups
    is dealt in cells of two blocks of its groups. Groups that no pair of members can link do not meet.
    """
    share = F.lit(least / (1 + least))
    groups = members.groupBy("bucket", "label").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(_room("n", "at", least)).alias("room")
    )
    parts = groups.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    own = settle(groups.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("label"), F.col("parts")).cast("int")))

    def dealt(side: str, start: Column, stop: Column) -> DataFrame:
        named = [F.col(c).alias(f"{side}_{c}") for c in ("label", "low", "high", "room", "part")]
        return own.select("bucket", *named, F.explode(F.sequence(start, stop)).alias("other"))

    # The block of the left group is never after that of the right one.
    left = dealt("l", F.col("part"), F.col("parts") - 1).withColumnRenamed("other", "r_part")
    right = dealt("r", F.lit(0), F.col("part")).withColumnRenamed("other", "l_part")
    near = (F.col("l_high") >= F.col("r_low") * F.lit(least) - 1e-6) & (F.col("r_high") >= F.col("l_low") * F.lit(least) - 1e-6)
    fits = (F.col("r_low") * share <= F.col("l_room") + 1e-6) & (F.col("l_low") * share <= F.col("r_room") + 1e-6)
    once = (F.col("l_part") < F.col("r_part")) | (F.col("l_label") < F.col("r_label"))
    two = left.join(right, ["bucket", "l_part", "r_part"]).filter(once & near & fits).select("bucket", "l_label", "r_label")
    met = two.join(_side(members, "l"), ["bucket", "l_label"]).join(_side(members, "r"), ["bucket", "r_label"])
    return _ordered(met.filter(_pair_bounds(least)))


def _prefix_buckets(reps: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``bucket, rep, n, at``: classes that share a shingle of their prefixes, and its place there from 0.

    Shingles are ordered by their number of classes, rarest first. Two sets of similarity ``least`` or more share
    one of the first ``n - ceil(least * n) + 1`` of each, so nothing is lost.
    """
    own = sets.join(reps, "rep", "left_semi").select("rep", F.size("own").alias("n"), F.explode("own").alias("bucket"))
    # Counted before the shuffle, and joined back: a window would put all classes of a frequent shingle into one task.
    several = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    counted = own.join(several, "bucket", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = counted.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "bucket"))).alias("order"))
    length = (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int")
    prefix = ranked.select("rep", "n", F.posexplode(F.slice("order", F.lit(1), length)).alias("at", "p"))
    return prefix.filter("p.df > 1").select(F.col("p.bucket").alias("bucket"), "rep", "n", "at")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, copy_id, class_id`` for each row of ``docs`` with an id.

    ``copy_id`` is the smallest id with the same words in order (A-Z lower-cased), ``class_id`` the smallest
    id connected through pairs of similarity ``least`` or more over distinct five-word shingles. Texts of fewer words
    have one shingle of all of them. Null, empty and blank texts are copies of each other and near nothing else.
    Rows that repeat an id belong together; rows without id are left out. An empty table gives an empty result.
    """
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    signed = settle(rows.mapInArrow(_signed, "doc_id bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>"))
    classes = settle(
        signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    )
    copies = signed.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", F.col("rep").alias("copy_id")), ["k1", "k2"])
    copies = settle(copies.select("doc_id", "copy_id"))

    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    firsts = banded.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("f"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    # Buckets of two or more, with their first class.
    met = settle(banded.join(firsts, "bucket").select("bucket", "rep", "n", F.col("f.rep").alias("first"), F.col("f.n").alias("first_n")))
    nodes = settle(met.select(F.col("rep").alias("node")).distinct())
    texts = rows.join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    sets = settle(texts.mapInArrow(_shingled, "rep bigint, own array<bigint>").dropDuplicates(["rep"]))

    pairs = settle(
        met.filter(F.col("rep") != F.col("first")).filter(_near_in_length("n", "first_n", least))
        .select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    )
    links = settle(_linked(pairs, sets, least))
    # Classes whose bucket holds several groups: a link between groups is still possible there. Their prefix buckets'
    # first classes link most of them; what then are still different groups is held against each other whole.
    labels = connected(links, nodes).withColumnRenamed("node", "rep")
    open_reps = settle(_in_mixed_buckets(met.select("bucket", "rep").join(labels, "rep")).select("rep").distinct())
    prefixed = settle(_prefix_buckets(open_reps, sets, least))
    first = settle(_with_first(_in_mixed_buckets(prefixed.join(labels, "rep")), least).join(pairs, ["a", "b"], "left_anti"))
    links = settle(links.union(_linked(first, sets, least)))
    labels = connected(links, nodes).withColumnRenamed("node", "rep")
    members = settle(_in_mixed_buckets(prefixed.join(labels, "rep")))
    tested = pairs.union(first)
    new = settle(_between_groups(members, least).join(tested, ["a", "b"], "left_anti"))
    labels = connected(links.union(_linked(new, sets, least)), nodes).withColumnRenamed("node", "copy_id")
    out = copies.join(labels, "copy_id", "left")
    return out.select("doc_id", "copy_id", F.coalesce("label", "copy_id").alias("class_id"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, all columns as they are; rows without id stay."""
    gone = near_duplicates(docs, least).filter("class_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return unnested(nested(docs).join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti"), docs)


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
