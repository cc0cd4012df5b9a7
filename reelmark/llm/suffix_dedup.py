"""Removal of byte passages that documents with smaller ids already have, from sorted suffixes.

A full suffix array of a corpus orders a tuple for every byte. As in induced sorting, only a sample of the
suffixes is sorted, and what holds for the others is induced from their sampled neighbours. The sample is
content-defined: of every window of ``LENGTH`` bytes the 24-byte string with the smallest hash is sampled,
so equal windows have equal samples at equal places. Windows that share their sample form a run of at most
27; a sorted tuple carries the hash of the sampled string, the hash of the run's whole string (the common
prefix and suffix that equal runs have), the document and the place.

Of equal strings in a batch only those of its smallest document are compared further, so a hot passage is
reduced before the shuffle. Spark's external sort is the disk-backed queue: tuples are shuffled by sample, sorted
with spilling, and streamed in order with one row of state. A run whose string occurs in a smaller document is
removed whole. A run that only shares its sample goes with its bytes, one row of at most 81 for its windows, to
a second shuffle by sample and is settled there window by window, in a second sort of the same kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions.tables import settle
from .arrays import BASE, MIX_1, Block, blocks, mixed, prefix_hashes

LENGTH = 50
SAMPLE = 24
# A document's place in a tuple: 20 bits of its text's hash, so rows that repeat an id stay apart, 36 bits of
# the first byte, 6 bits of the number of windows.
TAG_SHIFT, AT_SHIFT = 42, 6
NO_ID = 2**63 - 1
# Tuples that are combined before the shuffle, and rows of one string held in a task.
COMBINE, HELD = 1 << 18, 1 << 17
# Runs, and bytes of texts or runs, that are worked on at a time, as each becomes many numbers.
PART, PART_BYTES = 1 << 14, 1 << 19


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place, by doubling."""
    total, size, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, done = total, size
            else:
                n = len(total) - done
                out = out[:n] * np.uint64(pow(BASE, size, 1 << 64)) + total[done : done + n]
                done += size
        if done == width:
            return mixed(out)
        total = total[: len(total) - size] * np.uint64(pow(BASE, size, 1 << 64)) + total[size:]
        size *= 2


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``x`` over ``width`` places from each one, by doubling."""
    best, size = x, 1
    while size * 2 <= width:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    return np.minimum(best[: len(x) - width + 1], best[width - size : width - size + len(x) - width + 1])


def runs(block: Block, length: int = LENGTH, sample: int = SAMPLE):
    """(doc, first byte in the block, windows, sample hash, run hash) of all runs of windows of a block.

    A run is a stretch of windows in one document with the same sampled string; equal strings at different
    places of a window are told apart by the run's own hash.
    """
    n = len(block.data) - length + 1
    if n <= 0:
        return (np.zeros(0, int),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = gram_hashes(block.data, sample)
    low = window_minima(grams, length - sample + 1)[:n]
    at = np.arange(n)
    doc = np.searchsorted(block.offsets, at, "right") - 1
    inside = at + length <= block.offsets[doc + 1]
    change = np.ones(n, bool)
    change[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    stop = np.r_[np.flatnonzero(change), n]
    end = stop[np.searchsorted(stop, first, "right")]
    # The last windows of a document reach over its end and belong to no run.
    end = np.minimum(end, block.offsets[doc[first] + 1] - length + 1)
    # A run of one repeated string can be long; it is cut so that its windows fit their field.
    parts = -(-(end - first) // 32)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, end = np.repeat(first, parts) + 32 * nth, np.repeat(end, parts)
        end = np.minimum(end, first + 32)
    windows = end - first
    strings = prefix_hashes(block.data, first, end + length - 1)
    whole = mixed(strings + windows.astype(np.uint64) * np.uint64(MIX_1))
    return doc[first], first, windows, low[first], whole


def _seen_here(whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Tuples whose string a smaller document of the same batch has."""
    order = np.argsort(whole, kind="stable")
    ordered, owner = whole[order], doc[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    least = np.minimum.reduceat(owner, starts)
    out = np.empty(len(doc), bool)
    out[order] = owner > np.repeat(least, np.diff(np.r_[starts, len(doc)]))
    return out


def _combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Tuples of a batch; those already seen in it are spread over keys of their own and compared no more."""
    sample, whole, doc, place = (np.concatenate(c) for c in zip(*parts, strict=True))
    seen = _seen_here(whole, doc)
    stretch = ((place[seen] >> AT_SHIFT) & (2**36 - 1)) >> 16
    sample[seen] = whole[seen] = mixed(doc[seen].view(np.uint64) + stretch.view(np.uint64) * np.uint64(MIX_1)).view(np.int64)
    cols = [pa.array(c) for c in (sample, whole, doc, place, seen)]
    return pa.RecordBatch.from_arrays(cols, names=["sample", "whole", "doc", "place", "seen"])


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        tags = batch.column("tag").to_numpy(zero_copy_only=False)
        parts, size = [], 0
        for b in blocks(batch.column("text"), PART_BYTES):
            doc, first, windows, low, whole = runs(b)
            if not len(doc):
                continue
            place = (tags[b.first + doc] << TAG_SHIFT) | ((first - b.offsets[doc]) << AT_SHIFT) | windows
            parts.append((low.view(np.int64), whole.view(np.int64), ids[b.first + doc], place))
            size += len(doc)
            if size >= COMBINE:
                yield _combined(parts)
                parts, size = [], 0
        if parts:
            yield _combined(parts)


def _sorted_verdicts(partial: bool) -> Callable:
    """Streams tuples sorted by (sample, whole, doc): ``seen`` rows have their string in a smaller document.

    With ``partial``, rows that are not seen come out too if their sample has another string. Of a group of any size
    the last row is held, and of the last string the rows that are not seen, which all have one id; beyond ``HELD`` of
    these they come out as if there were another string, which only has them judged window by window.
    """
    names = ["doc", "place", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least, held, linked = None, None, [np.zeros(0, np.int64)] * 4, False
        for batch in batches:
            sample, whole, doc, place, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(doc):
                continue
            first = np.ones(len(doc), bool)
            first[1:] = (sample[1:] != sample[:-1]) | (whole[1:] != whole[:-1])
            first[0] = last != (sample[0], whole[0])
            at = np.maximum.accumulate(np.where(first, np.arange(len(doc)), -1))
            smallest = np.where(at >= 0, doc[np.maximum(at, 0)], doc[0] if least is None else least)
            seen = (smallest < doc) | known
            out = [(doc[seen], place[seen], True)]
            last, least = (sample[-1], whole[-1]), smallest[-1]
            new = [np.r_[h, c[~seen]] for h, c in zip(held, (sample, whole, doc, place), strict=True)]
            if partial and len(new[0]):
                starts = np.r_[True, (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])]
                string = np.cumsum(starts) - 1
                of = new[0][starts]
                same = np.r_[linked, of[1:] == of[:-1]]
                open_ = (same | np.r_[same[1:], False])[string] & (string < string[-1])
                out.append((new[2][open_], new[3][open_], False))
                held, linked = [c[string == string[-1]] for c in new], bool(same[-1])
                if len(held[0]) > HELD:
                    out.append((held[2], held[3], False))
                    # One row stays, so that a later string of this sample is known to be another.
                    held = [c[:1] for c in held]
            for d, p, s in out:
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(p), pa.array(np.full(len(d), s))], names=names)
        if linked:
            yield pa.RecordBatch.from_arrays([pa.array(held[2]), pa.array(held[3]), pa.array(np.full(len(held[2]), False))], names=names)

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs in ``places`` of a text, one row for each run, with its sample."""
    for batch in batches:
        ids, texts = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("text")
        for b in blocks(texts, PART_BYTES):
            if len(b.data) < LENGTH:
                continue
            places = batch.column("places").slice(b.first, b.n)
            doc = np.repeat(np.arange(b.n), np.diff(places.offsets.to_numpy()))
            place = places.flatten().to_numpy(zero_copy_only=False)
            low = window_minima(gram_hashes(b.data, SAMPLE), LENGTH - SAMPLE + 1)
            start = b.offsets[doc] + ((place >> AT_SHIFT) & (2**36 - 1))
            own, sample = ids[b.first + doc], low[start].view(np.int64)
            del low
            for i in range(0, len(place), PART):
                part = slice(i, i + PART)
                size = (place[part] & 63) + LENGTH - 1
                ends = np.r_[0, np.cumsum(size)]
                data = b.data[np.repeat(start[part] - ends[:-1], size) + np.arange(ends[-1])]
                buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]
                string = pa.Array.from_buffers(pa.binary(), len(size), buffers)
                cols = [pa.array(sample[part]), pa.array(own[part]), pa.array(place[part]), string]
                yield pa.RecordBatch.from_arrays(cols, names=["sample", "doc", "place", "string"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each window of the runs."""
    for batch in batches:
        ids, places = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "place"))
        for b in blocks(batch.column("string"), PART_BYTES):
            place = places[b.first : b.first + b.n]
            count = place & 63
            each = np.repeat(np.arange(b.n), count)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            whole = gram_hashes(b.data, LENGTH)[b.offsets[each] + nth]
            other = gram_hashes(b.data[::-1], LENGTH)[::-1][b.offsets[each] + nth]
            # The first byte of the window, and one window.
            at = (((place >> AT_SHIFT)[each] + nth) << AT_SHIFT) | 1
            cols = [whole.view(np.int64), other.view(np.int64), ids[b.first + each], at, np.zeros(len(at), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["sample", "whole", "doc", "place", "seen"])


CUT = T.StructType([T.StructField("text", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])
TUPLE = "sample bigint, whole bigint, doc bigint, place bigint, seen boolean"
CONTEXT = "sample bigint, doc bigint, place bigint, string binary"


def _judged(dealt: DataFrame, partial: bool) -> DataFrame:
    """Verdicts on tuples that are dealt by sample."""
    ordered = dealt.sortWithinPartitions("sample", "whole", "doc")
    return ordered.mapInArrow(_sorted_verdicts(partial), "doc bigint, place bigint, seen boolean")


@pandas_udf(CUT)
def _cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
    """The bytes outside the removed windows."""
    kept, removed, spans = [], [], []
    for text, own in zip(texts, places, strict=True):
        if own is None or not len(own):
            kept.append(text), removed.append(0), spans.append(0)
            continue
        at = (own >> AT_SHIFT) & (2**36 - 1)
        gone = np.zeros(len(text) + 1, np.int64)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + (own & 63) + LENGTH - 1, -1)
        mask = np.cumsum(gone[:-1]) > 0
        data = np.frombuffer(text, np.uint8)
        kept.append(data[~mask].tobytes()), removed.append(int(mask.sum()))
        spans.append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()))
    return pd.DataFrame({"text": kept, "n_removed": removed, "n_spans": spans})


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc``, and the key and tag of a row; the text itself stays in ``doc``, so it is shuffled once."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 20)).alias("tag"),
    )


def _places(verdicts: DataFrame) -> DataFrame:
    """One row for each document: its runs, at most one for each few bytes of its text."""
    tag = F.shiftright("place", TAG_SHIFT)
    return verdicts.groupBy(F.col("doc").alias("p_doc"), tag.alias("p_tag")).agg(F.collect_set("place").alias("places"))


def removed_passages(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` as ``doc``, with ``n_bytes, n_removed, n_spans`` and the ``kept`` bytes.

    A byte goes if it lies in a ``LENGTH``-byte string that also starts in a row with a smaller id; matches do not
    cross rows and are judged on the texts as given. Null texts are empty; texts shorter than ``LENGTH`` stay.
    Rows without id come after all others and lose nothing to each other, as do rows that share an id. Repeated rows
    get equal results, and an empty table gives an empty one.
    """
    rows = _keyed(docs)
    text = F.coalesce("doc.text", F.lit(""))
    texts = rows.filter(F.octet_length("doc.text") >= LENGTH).select(F.col("key").alias("doc"), "tag", text.alias("text"))
    # Each step is written before the next, so the disk holds the shuffle of one step only.
    judged = settle(_judged(texts.mapInArrow(_tuples, TUPLE).repartition("sample"), True), release=True)
    same = (F.col("key") == F.col("p_doc")) & (F.col("tag") == F.col("p_tag"))
    open_runs = _places(judged.filter("not seen"))
    held = rows.join(open_runs, same).select(F.col("key").alias("doc"), text.alias("text"), "places")
    contexts = held.mapInArrow(_contexts, CONTEXT).repartition("sample")
    ends = settle(_judged(contexts.mapInArrow(_windows, TUPLE), False), release=True)
    gone = _places(judged.filter("seen").select("doc", "place").union(ends.select("doc", "place")))
    out = rows.join(gone, same, "left").withColumn("bytes", text.cast("binary"))
    out = out.select("doc", F.octet_length("bytes").cast("long").alias("n_bytes"), _cut("bytes", "places").alias("c"))
    return out.select("doc", "n_bytes", "c.n_removed", "c.n_spans", F.col("c.text").alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = removed_passages(docs)
    return out.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
