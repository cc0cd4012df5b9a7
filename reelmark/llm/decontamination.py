"""Benchmark decontamination by MinHash containment search.

A test item is short and a document may be long, so their Jaccard similarity says nothing; what counts is the
share of the item's word shingles that the document has. The smaller side is sketched: of each item the
shingles with the smallest hashes, which are a uniform sample of its set whatever the other side is. Items are
parted by size: up to the sketch size the sketch is the whole set, above it fewer hits than the expected share
make a candidate. Documents too small to hold the needed share of an item are passed over. Candidates are
verified by exact containment of their full shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.once import bound
from .texts import nested, unnested, words

WIDTH = 5
CONTAINMENT = 0.8
SKETCH = 16
# A document with 80 % of an item misses all but three of 16 sampled shingles once in four million cases.
LARGE_ITEM_HITS = 4
# Sketch rows up to this number (16 bytes each) are sent to all tasks; beyond it Spark shuffles the join.
BROADCAST_ROWS = 500_000


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct hashes of the ``width``-word windows of the lower-cased text; none where there are fewer words."""

    def windows(w: Column) -> Column:
        each = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), each)

    none = F.array().cast("array<bigint>")
    return bound(
        words(F.lower(text)), lambda w: F.when(F.size(w) < width, none).otherwise(F.array_distinct(windows(w)))
    )


def item_sets(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, shingles, n_item`` of the items with at least ``width`` words."""
    sets = benchmark.select("item_id", shingle_hashes(F.col("text"), width).alias("shingles")).distinct()
    return sets.withColumn("n_item", F.size("shingles")).filter("n_item > 0 and item_id is not null")


def item_sketches(items: DataFrame, sketch: int = SKETCH, least: float = CONTAINMENT) -> DataFrame:
    """``value, item_id, n_item, need``: sketch values, with the hits that make a candidate in the item's size part."""
    own = lambda s: F.transform(s, lambda h: F.struct(F.xxhash64(h, F.lit(7)).alias("rank"), h.alias("value")))
    smallest = F.slice(F.sort_array(own(F.col("shingles"))), 1, sketch)
    need = F.when(F.col("n_item") <= sketch, F.ceil(F.col("n_item") * F.lit(least) - 1e-9)).otherwise(LARGE_ITEM_HITS)
    rows = items.select("item_id", "n_item", need.cast("int").alias("need"), F.explode(smallest).alias("s"))
    return rows.select(F.col("s.value").alias("value"), "item_id", "n_item", "need")


def contained_items(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_hash, item_id, n_common, n_item`` of documents that hold ``least`` of an item's shingles.

    Items with fewer than ``width`` words are too short to be found by; null and empty texts hold nothing. Rows
    of equal id and text count once, rows of equal id and different text are different documents, and rows
    without id are found under a null id. Empty tables give an empty result.
    """
    items = item_sets(benchmark, width)
    sketch = item_sketches(items, least=least)
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sets = rows.select("doc_id", "text_hash", shingle_hashes(F.col("text"), width).alias("own"))
    hits = sets.select("doc_id", "text_hash", F.size("own").alias("n_doc"), F.explode("own").alias("value")).join(sketch, "value")
    candidates = (
        hits.filter(F.col("n_doc") >= F.col("n_item") * F.lit(least) - 1e-9)
        .select("doc_id", "text_hash", "item_id", "need", "value").distinct()
        .groupBy("doc_id", "text_hash", "item_id").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
        .filter(F.col("n") >= F.col("need"))
        .select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), "item_id")
    )
    # One row for each candidate document, so its text is cut into shingles once; its items are at most all items.
    wanted = candidates.join(items, "item_id").groupBy("c_doc", "c_hash").agg(
        F.collect_list(F.struct("item_id", "shingles", "n_item")).alias("items")
    )
    same = F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("text_hash") == F.col("c_hash"))
    pairs = (
        rows.join(wanted, same).dropDuplicates(["doc_id", "text_hash"])
        .select("doc_id", "text_hash", "items", F.explode(F.array(shingle_hashes(F.col("text"), width))).alias("own"))
        .select("doc_id", "text_hash", F.inline(F.transform("items", lambda i: F.struct(
            i["item_id"].alias("item_id"), F.size(F.array_intersect(i["shingles"], F.col("own"))).cast("long").alias("n_common"),
            i["n_item"].cast("long").alias("n_item"),
        ))))
    )
    return pairs.filter(F.col("n_common") >= F.col("n_item") * F.lit(least) - 1e-9)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are."""
    found = contained_items(docs, benchmark).select(F.col("doc_id").alias("f_doc"), F.col("text_hash").alias("f_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.xxhash64("text") == F.col("f_hash"))
    return unnested(nested(docs).join(found, same, "left_anti"), docs)


ORACLE = """
with dw as (select doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') as w from documents),
ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from dw),
bw as (select item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') as w from benchmark),
bs as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from bw),
sizes as (select item_id, count(*) as n_item from bs group by item_id),
common as (select doc_id, item_id, count(*) as n_common from ds join bs using (s) group by doc_id, item_id)
select doc_id, item_id, n_common, n_item from common join sizes using (item_id) where n_common >= 0.8 * n_item - 1e-9
"""


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contained_items(docs, benchmark).select("doc_id", "item_id", "n_common", "n_item")
