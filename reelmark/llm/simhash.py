"""Near-duplicate documents by SimHash, compared bit-sliced.

A fingerprint holds one majority bit per bit of the XXH64 (seed 42) of a document's word shingles. Two fingerprints
that differ in at most ``radius`` of 64 bits agree in all but ``radius`` of any ``parts`` stretches of these bits, so
each pair meets in a bucket: one for each choice of ``parts - radius`` stretches, keyed by their bits.

Within a bucket fingerprints lie as bit planes: word ``w`` of plane ``k`` holds bit ``k`` of 64 fingerprints. One XOR
gives 64 differences of a bit, and carry-save adders count them for all 64 at once in four planes. Blocks of 64 whose
distances all exceed the radius are given up. Pairs that are connected already are not compared again, so a bucket
gives at most one link per member; no component loses a member by that. Buckets of many fingerprints are dealt in
cells of two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.tables import settle
from .near_dup import connected

WIDTH, SEED = 4, 42
BITS, RADIUS, PARTS = 64, 4, 6
# Fingerprints of a bucket that meet in one cell, from each side.
BLOCK = 8192
# Shingles hashed at a time; groups of a bucket that are compared by lags of their rows; rows held for these.
STRETCH, SMALL, HELD = 1 << 16, 64, 1 << 15
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints ---------------------------------------------------------------


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The majority bits of the hashes of a text's word shingles (A-Z lower-cased, repeats counted); 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    last = end[min(width, len(words)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), STRETCH):
        cut = zip(start[at : at + STRETCH].tolist(), last[at : at + STRETCH].tolist(), strict=False)
        h = np.array([digest(joined[a:b], SEED) for a, b in cut], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(last), bitorder="little").tobytes(), "little")


def _fingerprinted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            values = [fingerprint(t.as_py(), width) for t in part.column("text").cast(pa.large_binary())]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), fp], names=["doc_id", "fp"])


# ---- bit-sliced comparison ------------------------------------------------------


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """(64, words) planes: bit ``i`` of word ``w`` of plane ``k`` is bit ``k`` of ``fp[64 w + i]``."""
    n = len(fp)
    bits = np.zeros((-(-n // 64) * 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (ones, twos, fours, and eights that stay set) is above ``radius``, at most 7."""
    ones, twos, fours, over = counter
    equal = np.full(len(ones), ONES)
    for bit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal = equal & plane
        else:
            over = over | (equal & plane)
            equal = equal & ~plane
    return over


def near_lanes(differs: Callable, valid: np.ndarray, planes: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that hold near lanes, and a bit for each near lane.

    ``differs(k, places)`` gives the differences in plane ``k``, ``valid`` a bit for each lane that counts.
    """
    places = np.flatnonzero(valid)
    mask = valid[places]
    counter = [np.zeros(len(places), np.uint64) for _ in range(4)]
    for at in range(0, len(planes), 8):
        x = [differs(k, places) for k in planes[at : at + 8]]
        x += [np.zeros(len(places), np.uint64)] * (8 - len(x))
        ones, twos, fours, over = counter
        fours_in = []
        for j in (0, 4):
            ones, two_a = _added(ones, x[j], x[j + 1])
            ones, two_b = _added(ones, x[j + 2], x[j + 3])
            twos, four = _added(twos, two_a, two_b)
            fours_in.append(four)
        fours, eights = _added(fours, *fours_in)
        counter = [ones, twos, fours, over | eights]
        mask = mask & ~_beyond(counter, radius)
        alive = mask != 0
        if not alive.all():
            places, mask, counter = places[alive], mask[alive], [c[alive] for c in counter]
        if not len(places):
            break
    return places, mask


def _lanes(places: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and lane of each set bit."""
    bits = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(bits)
    return places[word], lane


def _packed(lanes: np.ndarray) -> np.ndarray:
    """Booleans as words of 64 lanes, along the last axis."""
    n = lanes.shape[-1]
    room = np.zeros((*lanes.shape[:-1], -(-n // 64) * 64), bool)
    room[..., :n] = lanes
    return np.ascontiguousarray(np.packbits(room, axis=-1, bitorder="little")).view(np.uint64)


class Forest:
    """Components of the rows at hand; keeps the links that join two of them."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self._root(i), self._root(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((i, j))

    def labels(self) -> np.ndarray:
        label = self.parent
        while (label != self.parent[label]).any():
            label = self.parent[label]
        self.parent = label.copy()
        return label


def links_within(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (places in ``fp``) that connect what is near within each of the small groups of neighbouring rows."""
    n = len(fp)
    planes, forest = bit_planes(fp), Forest(n)
    words = planes.shape[1]
    wide = np.concatenate([planes, np.zeros((BITS, 2), np.uint64)], axis=1)
    lag = 1
    while lag < n:
        label = forest.labels()
        same = group[:-lag] == group[lag:]
        if not same.any():
            break
        valid = _packed(same & (label[:-lag] != label[lag:]))
        valid = np.r_[valid, np.zeros(words - len(valid), np.uint64)]
        skip, shift = lag // 64, np.uint64(lag % 64)
        moved = np.concatenate([wide, np.zeros((BITS, skip), np.uint64)], axis=1)[:, skip : skip + words + 1]
        other = moved[:, :-1] >> shift
        if shift:
            other = other | (moved[:, 1:] << (np.uint64(64) - shift))
        found = near_lanes(lambda k, w: planes[k][w] ^ other[k][w], valid, list(range(BITS)), radius)  # noqa: B023
        word, lane = _lanes(*found)
        row = word * 64 + lane
        forest.link(row, row + lag)
        lag += 1
    return forest.links


def links_of_cell(fp: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what is near in one cell: all pairs of one side, or where there are two, those across."""
    n, two = len(fp), bool(side.any())
    planes, forest = bit_planes(fp), Forest(n)
    words = planes.shape[1]
    split = np.bitwise_or.reduce(fp ^ fp[0])
    open_planes = [k for k in range(BITS) if int(split) >> k & 1]  # the others are equal for all
    queries = np.flatnonzero(side == 0) if two else np.arange(n)
    at, step = 0, 1
    while at < len(queries):
        q = queries[at : at + step]
        label = forest.labels()
        if (label == label[0]).all():
            break
        after = side[None, :] > 0 if two else np.arange(n)[None, :] > q[:, None]
        valid = _packed(after & (label[None, :] != label[q][:, None])).ravel()
        own = {k: np.where((fp[q] >> np.uint64(k)) & np.uint64(1), ONES, np.uint64(0)) for k in open_planes}
        found = near_lanes(lambda k, p: planes[k][p % words] ^ own[k][p // words], valid, open_planes, radius)  # noqa: B023
        place, lane = _lanes(*found)
        forest.link(q[place // words], (place % words) * 64 + lane)
        at, step = at + step, min(step * 2, 64)
    return forest.links


def _pairs(fp: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(links, np.int64).reshape(-1, 2)
    ends = fp[at].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each cell; rows come sorted by cell, and no more than a cell and ``HELD`` rows are held."""
    names = ["choice", "bucket", "low", "high", "side", "fp"]

    def settled(held: dict[str, np.ndarray], all_of_it: bool):
        """Links of the cells that are complete, and the rows of the last one, which may go on."""
        key = np.stack([held[c].astype(np.int64) for c in names[:4]])
        new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]
        start = np.r_[np.flatnonzero(new), len(new)]
        if not all_of_it:
            start = start[:-1]
        end, out = start[-1] if len(start) else 0, []
        fp, size = held["fp"].view(np.uint64), np.diff(start)
        for i in np.flatnonzero(size > SMALL):
            cut = slice(start[i], start[i + 1])
            out.append(_pairs(fp[cut], links_of_cell(fp[cut], held["side"][cut], radius)))
        group = np.repeat(np.arange(len(size)), size)
        small = np.flatnonzero((size <= SMALL)[group])
        if len(small):
            # A cell of two small sides comes from a large bucket: pairs within a side are compared in another cell too.
            out.append(_pairs(fp[:end][small], links_within(fp[:end][small], group[small], radius)))
        return out, {c: v[end:] for c, v in held.items()}

    held = {c: np.zeros(0, np.int64) for c in names}
    fresh = 0
    for batch in batches:
        held = {c: np.concatenate([held[c], batch.column(c).to_numpy(zero_copy_only=False)]) for c in names}
        fresh += batch.num_rows
        if fresh >= HELD:
            out, held = settled(held, False)
            fresh = 0
            yield from out
    if len(held["fp"]):
        yield from settled(held, True)[0]


def masks(parts: int = PARTS, radius: int = RADIUS) -> list[int]:
    """One mask for each choice of the ``parts - radius`` stretches in which two near fingerprints agree."""
    edge = [round(i * BITS / parts) for i in range(parts + 1)]
    stretch = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(c) for c in combinations(stretch, parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """``a, b``: links of at most ``radius`` differing bits that connect the distinct ``fp`` of ``prints``.

    Every two fingerprints within the radius are connected by the links; links within a component are left out.
    ``parts`` grows with the corpus: buckets have ``64 * (parts - radius) / parts`` bits.
    """
    if not 0 <= radius <= 7 or parts <= radius:
        raise ValueError("radius must be 0 to 7 and parts above it")
    choices = F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks(parts, radius)])
    keyed = prints.select("fp", F.posexplode(choices).alias("choice", "mask"))
    keyed = keyed.select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"))
    shared = keyed.groupBy("choice", "bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = keyed.join(shared, ["choice", "bucket"]).withColumn("blocks", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = members.select("fp", "choice", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = dealt.select(
        "choice", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("other") < F.col("own")).cast("int").alias("side"), "fp",
    )
    key = ["choice", "bucket", "low", "high"]
    spread = cells.repartition(*key).sortWithinPartitions(*key, "side", "fp")
    return spread.mapInArrow(partial(_linked, radius=radius), "a bigint, b bigint")


def simhash_components(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``; all other columns are ignored.

    Links: fingerprints of at most ``radius`` differing bits. ``component_id`` is the smallest id reachable. Null, empty
    and blank texts have fingerprint zero and link like any other. Equal rows give equal rows. A row without id takes
    the component of its fingerprint; null where no row of the component has an id. An empty table gives no rows.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint"
    rows = settle(docs.select("doc_id", "text").mapInArrow(partial(_fingerprinted, width=width), schema))
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = settle(near_fingerprints(classes.select("fp"), radius, parts, block).distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = connected(links, settle(nodes)).withColumnRenamed("node", "fp")
    of_class = settle(classes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    first = of_class.groupBy("label").agg(F.min("least").alias("component_id"))
    named = of_class.join(first, "label").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
