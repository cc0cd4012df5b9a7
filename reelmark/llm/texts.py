"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The blanks that part words, and the pattern of a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def nested(docs: DataFrame) -> DataFrame:
    """``doc`` with all columns of a row, and its ``doc_id`` and ``text``.

    Whatever other columns are called, they cannot clash with the columns an operator adds.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")


def unnested(df: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again; with a new ``text``, an ``n_chars`` column follows it."""
    if text is None:
        return df.select(*[F.col(f"doc.`{c}`") for c in docs.columns])
    df = df.withColumn("_text", text)
    new = {"text": F.col("_text"), "n_chars": F.char_length(F.coalesce("_text", F.lit(""))).cast("long")}
    changed = ~F.col("_text").eqNullSafe(F.col("doc.text"))
    return df.select(
        *[
            (F.when(changed, new[c]).otherwise(F.col(f"doc.`{c}`")) if c in new else F.col(f"doc.`{c}`")).alias(c)
            for c in docs.columns
        ]
    )


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; plain ``lower`` does the same where all is ASCII, and faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order, as an array without nulls; empty for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
