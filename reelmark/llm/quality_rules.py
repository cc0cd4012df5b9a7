"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each
rule that fails; a policy is a named mask over the bits, so a new policy, a threshold-free comparison
or an ablation never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.once import bound, fenced
from .texts import SPACES, n_words, nested, words

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on the measurements; ``bit`` is the rule's place in the mask, for good."""

    bit: int
    name: str
    fails: Column | None = None


def _rules() -> list[Rule]:
    n, col = F.col("n_words"), F.col
    return [
        Rule(0, "few_words", n < 50),
        Rule(1, "repeated_words", 100 * col("n_repeat_words") > 50 * n),
        Rule(2, "symbols", col("n_symbols") > n),
        Rule(3, "repeated_lines", 100 * col("n_dup_lines") > 50 * col("n_lines")),
        Rule(4, "word_length", (col("word_chars") < 2 * n) | (col("word_chars") > 20 * n)),
        Rule(5, "long_repetitive", (n > 100_000) & (100 * col("n_repeat_words") > 30 * n)),
    ]


# Versioned policies: the bits that reject a document. Old versions stay, new ones are added.
POLICIES = {"base": 0b000011, "v1": 0b001111, "v2": 0b011111}


def repeated_words(ws: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the array ``ws``.

    Window hashes are packed with their positions into one long and sorted; neighbours with equal hash
    bits are the only windows that can repeat, and those few are compared as words.
    """

    def packed(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 31).bitwiseOR(i.cast("long")),
        )
        return F.sort_array(hashes)

    def near(s: Column) -> Column:
        same = lambda x, y: F.coalesce(F.shiftright(x, 31) == F.shiftright(y, 31), F.lit(False))
        return F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))

    def exact(w: Column, some: Column) -> Column:
        pos = lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int")
        text = lambda p: F.array_join(F.slice(w, p + 1, 3), " ")
        return F.sort_array(F.transform(some, lambda x: bound(pos(x), lambda p: F.struct(text(p).alias("t"), p.alias("p")))))

    def starts(pairs: Column) -> Column:
        same = lambda x, y: F.coalesce(x["t"] == y["t"], F.lit(False))
        found = F.filter(pairs, lambda x, i: same(x, F.get(pairs, i + 1)) | same(x, F.get(pairs, i - 1)))
        return F.sort_array(F.transform(found, lambda x: x["p"]))

    def covered(at: Column) -> Column:
        spans = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda total, n: total + n)

    count = bound(
        bound(packed(ws), near),
        lambda some: F.when(F.size(some) == 0, F.lit(0).cast("long")).otherwise(
            bound(bound(exact(ws, some), starts), covered)
        ),
    )
    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(count)


def measurements(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return {
        "n_words": n_words(text),
        "word_chars": F.char_length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": bound(words(text), repeated_words),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` as ``doc``, the measurements, and ``fail_bits``.

    A null text counts as an empty one, which has no words and fails the length rule. Rows are judged one
    by one, so repeated rows get equal entries and null ids do not matter; an empty table gives none.
    """
    rows = nested(docs)
    entry = fenced(rows.select("doc", "text"), **measurements(F.col("text"))).drop("text")
    bits = F.lit(0).cast("long")
    for rule in _rules():
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return entry.withColumn("fail_bits", bits)


def kept_by(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that would be kept without it.

    Entries are first counted by mask, of which there are at most two to the number of rules.
    """
    mask = POLICIES[policy]
    by_mask = (
        entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("failed"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rules = [r for r in _rules() if mask >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("own")) for r in rules]))
    rows = by_mask.select("failed", "n", each.alias("r")).select("failed", "n", "r.rule", "r.own")
    rest = F.col("failed").bitwiseAND(F.bitwise_not("own"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(
        total(F.col("failed").bitwiseAND(F.col("own")) != 0).alias("n_fail"),
        total(F.col("failed") == F.col("own")).alias("n_fail_only"),
        total(rest == 0).alias("n_kept_without"),
    )


ORACLE = """
with lines as (
  select doc_id, line, row_number() over (partition by doc_id, line) as nth
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) l
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup_lines as (select doc_id, count(*) as n_lines, count(*) filter (where nth > 1) as n_dup_lines from lines group by doc_id),
ws as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from ws),
tri as (
  select doc_id, pos, word, lead(word) over d as w2, lead(word, 2) over d as w3
  from words window d as (partition by doc_id order by pos)),
twice as (select *, count(*) over (partition by doc_id, word, w2, w3) as c from tri where w3 is not null),
cover as (select distinct doc_id, pos + s as pos from twice, (values (0), (1), (2)) v(s) where c > 1),
rep as (select doc_id, count(*) as n_repeat_words from cover group by doc_id),
m as (
  select ws.doc_id, cast(len(w) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words
  from ws left join dup_lines using (doc_id) left join rep using (doc_id)),
bits as (
  select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (n_symbols > n_words)::bigint
    + 8 * (100 * n_dup_lines > 50 * n_lines)::bigint + 16 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::bigint
    + 32 * (n_words > 100000 and 100 * n_repeat_words > 30 * n_words)::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 as base_failed,
       fail_bits & 31 = 0 as kept, fail_bits from bits
"""


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ledger(docs).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~kept_by("base")).alias("base_failed"), kept_by("v2").alias("kept"), "fail_bits",
    )
