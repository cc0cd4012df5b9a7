"""Line dedup: lines that many documents share stay only in one of them.

Lines are exploded with their position, hashed under a normalised key, and counted by distinct
document; keys over the threshold are joined back and their lines leave every document but one.
Only hashes and positions are exploded and shuffled by key. The texts themselves are shuffled once,
by document, when the lines that stay are put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.once import bound
from .texts import SPACES, lower_ascii, nested, unnested


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All rows and columns of ``docs`` as ``doc``, with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A text is split at newlines; null and empty texts have one empty line. Keys of ``min_chars`` code
    points or more that occur in ``min_docs`` distinct documents lose all their lines, repeats inside a
    document included, except in the largest ``doc_id`` holding them. Rows of one ``doc_id`` count as
    one document, repeated rows get equal results, and rows without ``doc_id`` count together as one
    document below all others. An empty table gives an empty result.
    """
    rows = nested(docs).select("doc", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n", -1)
    keys = F.transform(
        lines,
        lambda line, at: bound(
            line_key(line),
            lambda k: F.when(
                F.char_length(k) >= min_chars,
                F.struct(at.alias("at"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")),
            ),
        ),
    )
    marks = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.inline(F.filter(keys, lambda k: k.isNotNull()))
    )
    shared = (
        marks.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
    )
    dropped = (
        marks.join(shared, ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("drop_at"))
    )
    d = dropped.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), "drop_at")
    same = F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.xxhash64("text") == F.col("d_hash"))
    kept = bound(
        lines,
        lambda ls: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drop_at")), lambda at: F.get(ls, at)
        ),
    )
    out = rows.join(d, same, "left")
    return out.select(
        "doc",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop_at"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop_at").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def deduplicated(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the shared lines gone from ``text`` (and ``n_chars`` following, where there is one).

    A text that loses nothing stays as it is, null included.
    """
    out = drop_shared_lines(docs, min_chars, min_docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("doc.text"))
    return unnested(out, docs, text=text)


ORACLE = """
with split as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from split),
shared as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (
  select d.doc_id, d.pos, d.line, s.k is not null and d.doc_id <> s.keeper as gone
  from keyed d left join shared s on d.k = s.k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_shared_lines(docs).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )
