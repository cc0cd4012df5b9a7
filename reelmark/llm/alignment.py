"""Alignment of two tokenizers: which tokens of one overlap which of the other, counted over the whole corpus.

Tokens cover the bytes of a text without gaps, so running sums of token lengths give all borders, and tokens that
overlap are found by their borders for a block of documents at once. A very long text is tokenized in parts: no token
of either vocabulary spans from a letter or sign to a blank after it, so both treat the parts alike wherever they stand.

Counting spills outside of memory. A task gathers documents until they hold ``RUN`` links and writes their records
(pair of ids, document, times) as a run: sorted by pair with the B side first, parted by radix of the B id,
zstd-compressed. Runs of a radix are merged ``FAN_IN`` at a time by a heap, which counts each pair; Spark adds merged
counts up. As pairs are in order of the B side, its highest count is known when its pairs end. A second pass streams
the runs of a radix past the counts of its pairs and sends each document's share back. A hot radix is dealt over
several tasks, each with the counts of its pairs: these are bounded by the vocabularies, whatever the corpus holds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.tables import settle

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how byte-level vocabularies of this kind part a text before they merge bytes.
A_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RADIXES = 16
# Links of a run; runs that one heap merges; runs of a radix that one task streams past its counts.
RUN, FAN_IN, SHARE = 6_000_000, 64, 64
# Bytes of text aligned at a time; code points tokenized at a time.
BLOCK, PART = 1 << 20, 1 << 20
# The blank must be a plain one; what stands around it counts as blank by the widest definition, so cuts are safe.
CUT = re.compile(r"(?<=\S)(?= \S)")
# A record as a number: B id, A id, place of the document in its run.
A_BITS, PLACE_BITS = 20, 24


# ---- tokens ---------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def parts_of(text: str) -> Iterator[str]:
    """A text in parts that begin with a blank, but for the first, and that no token spans."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + PART)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Tokenizers:
    """Both tokenizers from the bytes of their files; ids, and the bytes of each id."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(a_file)
        special = {t["id"] for t in model["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items() if i not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["model"]["merges"]]
        if any(model["model"]["vocab"][word] != 256 + i for i, word in enumerate(merged)):
            raise ValueError("ids of the A vocabulary are not in order of its merges")
        # Merges in order of ids: the same as the file's list of merges.
        self.a = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.a_bytes[i] = word
        self.b = b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the B vocabulary spans a blank after a letter: texts cannot be cut there")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # Ids as text with the sign that follows them: A ids before another and at the end of a group, B ids likewise.
        signs = [f"{i}{sign}" for n, pair in ((len(self.a_bytes), ",|"), (len(pieces), ",;")) for sign in pair for i in range(n)]
        width = max(map(len, signs))
        self.signs = np.frombuffer("".join(x.ljust(width, "\0") for x in signs).encode(), np.uint8).reshape(-1, width)
        self.sign_size = np.array([len(x) for x in signs], np.int64)

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of the text after a blank, or none where a tokenizer does not give back its bytes."""
        spaced = " " + text
        a, b = [], []
        for part in parts_of(spaced):
            a += self.a.encode_ordinary(part)
            # This tokenizer adds the first blank itself.
            b += self.b.encode(part[1:])
        raw = spaced.encode()
        same = all(b"".join(map(t.__getitem__, own)) == raw for t, own in ((self.a_bytes, a), (self.b_bytes, b)))
        return (a, b) if same else None

    def align(self, docs: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """For documents together: number of groups, groups as text and number of links of each, and (B id, A id) of each link."""
        n_a, n_b = (np.array([len(d[k]) for d in docs], np.int64) for k in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(d[k] for d in docs), np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # The first and the last B token that a token of A overlaps; where both end together, a group ends.
        last = np.searchsorted(b_end, a_end, "left")
        first = np.searchsorted(b_end, a_end - self.a_size[a], "right")
        a_ends = b_end[last] == a_end
        b_ends = np.zeros(len(b), bool)
        b_ends[last[a_ends]] = True
        size = last - first + 1
        # Groups in order: a group's A tokens, then its B tokens.
        a_group = np.cumsum(a_ends) - a_ends
        b_group = np.cumsum(b_ends) - b_ends
        b_before = np.r_[0, last[a_ends] + 1][a_group]
        a_before = (np.flatnonzero(a_ends) + 1)[b_group]
        sign = np.empty(len(a) + len(b), np.int64)
        known = len(self.a_bytes)
        sign[np.arange(len(a)) + b_before] = a + known * a_ends
        sign[np.arange(len(b)) + a_before] = b + 2 * known + len(self.b_bytes) * b_ends
        flat = self.signs[sign].ravel()
        text = flat[flat > 0].tobytes()
        text_end = np.cumsum(self.sign_size[sign])[np.cumsum(n_a + n_b) - 1].tolist()
        texts = [text[s : e - 1] for s, e in zip([0, *text_end], text_end, strict=False)]
        a_doc_end = np.cumsum(n_a)
        groups, links = (np.diff(np.r_[0, np.cumsum(x)[a_doc_end - 1]]) for x in (a_ends, size))
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        return groups, texts, links, (b[at] << A_BITS) | np.repeat(a, size)


# ---- runs -----------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Run:
    """Records of the documents gathered by a task, and the rows that describe the documents."""

    def __init__(self, number: int, tokenizers: Tokenizers):
        self.number, self.tokenizers, self.size = number, tokenizers, 0
        self.docs: list[tuple] = []
        self.keys: list[np.ndarray] = []

    def add(self, block: list[tuple]) -> None:
        """Documents as (id, ids of both tokenizers or none)."""
        own = [ids for _, ids in block if ids]
        place = len(self.docs) + np.array([i for i, (_, ids) in enumerate(block) if ids], np.int64)
        found: Iterator[tuple] = iter(())
        if own:
            groups, texts, links, pair = self.tokenizers.align(own)
            self.keys.append(pair << PLACE_BITS | np.repeat(place, links))
            self.size += len(pair)
            found = zip(own, groups.tolist(), texts, links.tolist(), strict=True)
        for doc_id, ids in block:
            if not ids:
                self.docs.append((doc_id, 0, 0, 0, 0, ""))
                continue
            (a, b), n_groups, text, n_links = next(found)
            self.docs.append((doc_id, len(a), len(b), n_groups, n_links, hashlib.sha256(text).hexdigest()))

    def full(self) -> bool:
        return len(self.docs) >= (1 << PLACE_BITS) - BLOCK

    def rows(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        ids, *figures, digests = zip(*self.docs, strict=True)
        n = len(ids)
        none = pa.nulls(n, pa.binary())
        cols = [pa.array([self.number] * n), pa.array(range(n), pa.int32()), pa.array(ids, id_type)]
        cols += [pa.array(f, pa.int64()) for f in figures] + [pa.array(digests), pa.nulls(n, pa.int32()), none, none, none, none]
        yield pa.RecordBatch.from_arrays(cols, names=FIELDS)
        if not self.keys:
            return
        key = np.concatenate(self.keys)
        self.keys.clear()
        key.sort()
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[new, len(key)]).astype(np.int32)
        key = key[new]
        pair, place = key >> PLACE_BITS, (key & ((1 << PLACE_BITS) - 1)).astype(np.int32)
        radix = radix_of(pair)
        blank = [pa.nulls(1, pa.int32()), pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
        for r in range(RADIXES):
            own = np.flatnonzero(radix == r)
            if not len(own):
                continue
            p, n_times = pair[own], times[own]
            start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            total = np.add.reduceat(n_times, start, dtype=np.int64)
            each = np.diff(np.r_[start, len(own)])
            blobs = [np.diff(p[start], prepend=0), np.stack([total, each]), place[own], n_times]
            cols = [pa.array([r], pa.int32()), *[pa.array([_packed(x)], pa.binary()) for x in blobs]]
            yield pa.RecordBatch.from_arrays([pa.array([self.number]), *blank, *cols], names=FIELDS)


FIELDS = ["run", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "radix", "pairs", "totals", "docs", "times"]
SCHEMA = (
    "run bigint, place int, doc_id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "radix int, pairs binary, totals binary, docs binary, times binary"
)


def radix_of(pair: np.ndarray) -> np.ndarray:
    """The part of a pair: low bits of its B id."""
    return (pair >> A_BITS) % RADIXES


def _runs(batches: Iterator[pa.RecordBatch], files: Broadcast, size: int) -> Iterator[pa.RecordBatch]:
    tokenizers = Tokenizers(*files.value)
    part = TaskContext.get().partitionId()
    made, run, id_type = 0, Run(part << 32, tokenizers), None
    block, held = [], 0
    for batch in batches:
        id_type = batch.column("doc_id").type
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            text = text.as_py()
            block.append((doc_id.as_py(), tokenizers.ids(text) if text else None))
            held += len(text or "")
            if held < BLOCK and len(block) < BLOCK:
                continue
            run.add(block)
            block, held = [], 0
            if run.size >= size or run.full():
                yield from run.rows(id_type)
                made += 1
                run = Run(part << 32 | made, tokenizers)
    run.add(block)
    if run.docs:
        yield from run.rows(id_type)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and counts of up to ``FAN_IN`` runs of a radix, merged by a heap; rows come sorted by radix and group."""

    def of_run(pairs: bytes, totals: bytes) -> Iterator[tuple[int, int]]:
        total = _unpacked(totals, np.int64)
        return zip(np.cumsum(_unpacked(pairs, np.int64)).tolist(), total[: len(total) // 2].tolist(), strict=True)

    def counted(runs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        keys, counts, last = [], [], None
        for key, n in heapq.merge(*[of_run(*r) for r in runs]):
            if key == last:
                counts[-1] += n
                continue
            if len(keys) >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
                keys, counts = [], []
            keys.append(key)
            counts.append(n)
            last = key
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    now, runs = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("radix", "fan", "pairs", "totals")]
        for radix, fan, pairs, totals in zip(*cols, strict=True):
            if (radix, fan) != now or len(runs) >= FAN_IN:
                yield from counted(runs)
                now, runs = (radix, fan), []
            runs.append((pairs, totals))
    yield from counted(runs)


def _sent_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's links that are its B id's best, and sum of counts, by run; a radix's counts come before its runs."""
    now, known = None, []
    pair = n = best = np.zeros(0, np.int64)

    def shares(run: int, pairs: bytes, totals: bytes, docs: bytes, times: bytes) -> pa.RecordBatch:
        at = np.searchsorted(pair, np.cumsum(_unpacked(pairs, np.int64)))
        at = np.repeat(at, _unpacked(totals, np.int64).reshape(2, -1)[1])
        doc, links = _unpacked(docs, np.int32), _unpacked(times, np.int32).astype(np.int64)
        n_best, count_sum = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
        np.add.at(n_best, doc, links * best[at])
        np.add.at(count_sum, doc, links * n[at])
        place = np.flatnonzero(count_sum)
        cols = [pa.array(np.full(len(place), run)), pa.array(place.astype(np.int32)), pa.array(n_best[place]), pa.array(count_sum[place])]
        return pa.RecordBatch.from_arrays(cols, names=["run", "place", "n_best", "count_sum"])

    for batch in batches:
        own = [batch.column(c).fill_null(-1).to_numpy() for c in ("radix", "share", "run", "pair", "n", "best")]
        radix, share, runs = own[:3]
        edge = np.flatnonzero(np.r_[True, (radix[1:] != radix[:-1]) | (share[1:] != share[:-1]) | (runs[1:] != runs[:-1])])
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), batch.num_rows], strict=True):
            if (radix[i], share[i]) != now:
                now, known = (radix[i], share[i]), []
            if runs[i] < 0:
                known.append(np.stack([c[i:j] for c in own[3:]]))
                continue
            if known:
                pair, n, best = np.concatenate(known, axis=1)
                known = []
            for k in range(i, j):
                yield shares(int(runs[k]), *[batch.column(c)[k].as_py() for c in ("pairs", "totals", "docs", "times")])


def tokenizer_files(spark: SparkSession, folder: str = FOLDER) -> Broadcast:
    """Both files (about 2 MB, whatever the corpus holds), read by the driver and sent to the executors."""
    files = []
    for name in (A_FILE, B_FILE):
        with open(f"{folder}/{name}", "rb") as f:
            files.append(f.read())
    return spark.sparkContext.broadcast(tuple(files))


def pair_counts(runs: DataFrame) -> DataFrame:
    """``radix, pair, n, best``: each pair's number of links, and 1 where no other pair of its B id has more."""
    numbered = runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(1 << 30)).alias("spread"), "pairs", "totals")
    many = F.lit(max(1, -(-runs.select("run").distinct().count() // FAN_IN)))
    fans = numbered.select("radix", F.pmod(F.col("spread"), many).cast("int").alias("fan"), "pairs", "totals")
    sorted_runs = fans.repartition("radix", "fan").sortWithinPartitions("radix", "fan")
    merged = sorted_runs.mapInArrow(_merged, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    b_id = F.shiftright("pair", A_BITS)
    # At most the A vocabulary's pairs for each B id.
    most = F.max("n").over(Window.partitionBy(b_id))
    return merged.select((b_id % RADIXES).cast("int").alias("radix"), "pair", "n", (F.col("n") == most).cast("bigint").alias("best"))


def aligned(docs: DataFrame, folder: str = FOLDER, run: int = RUN) -> DataFrame:
    """One row per row of ``docs``: its tokens, groups and links, and what the corpus-wide counts say of these.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; all other columns are ignored. Texts that
    are null, empty, or that a tokenizer does not give back byte by byte have no tokens: zeros and ''. Repeated rows
    count each time, rows without id like any other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    schema = SCHEMA.format(docs.schema["doc_id"].dataType.simpleString())
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    written = settle(texts.mapInArrow(partial(_runs, files=tokenizer_files(spark, folder), size=run), schema))
    own = written.filter("radix is null").select("run", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    runs = written.filter("radix is not null").select("run", "radix", "pairs", "totals", "docs", "times")
    counts = settle(pair_counts(runs))

    shares = max(1, -(-runs.select("run").distinct().count() // SHARE))
    blank = lambda names, kind: [F.lit(None).cast(kind).alias(c) for c in names]
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    first = counts.select("radix", share, *blank(["run"], "bigint"), "pair", "n", "best", *blank(["pairs", "totals", "docs", "times"], "binary"))
    then = runs.select(
        "radix", F.pmod(F.xxhash64("run"), F.lit(shares)).cast("int").alias("share"), "run", *blank(["pair", "n", "best"], "bigint"),
        "pairs", "totals", "docs", "times",
    )
    meet = first.union(then).repartition("radix", "share").sortWithinPartitions("radix", "share", "run", "pair")
    back = meet.mapInArrow(_sent_back, "run bigint, place int, n_best bigint, count_sum bigint")
    back = back.groupBy("run", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return own.join(back, ["run", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
