"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, identifier cues, a plus before a
digit, and pairs of digits with what may stand between them. At each anchor a small parser expands to the
left and right as far as the kind allows and checks the result (label rules, part ranges, check digits).
A parser never looks at a run of characters again that it has already judged, so a text costs time in
proportion to its length.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from .texts import nested

# Kinds in the order in which equal starts are listed, the base ones first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGITS = frozenset("0123456789")
CUES = ("iban", "account", "acct", "routing", "ssn", "social security", "passport")
DOMAIN_RE = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN_RE = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD_RE = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE_RE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USER_HOST_RE = re.compile(r"[^\s/?#\"'<>@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?")
TEL_RE = re.compile(r"\+?[0-9](?:[().-]?[0-9])+")
CUE_REST_RE = re.compile(r"(?:[ \t]{0,3}(?:no|nr|num|number|id|code))?[.]?[ \t]{0,3}[:#=]?[ \t]{0,3}", re.IGNORECASE)
IBAN_RE = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SSN_RE = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NUMBER_RE = re.compile(r"[0-9](?:[ -]?[0-9])+")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    digits = sorted(DIGITS)
    for a in digits:
        found.add_word(f"+{a}", ("phone", 2))
        for b in digits:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for between in ("", " ", "-"):
                found.add_word(f"{a}{between}{b}", ("card", 2 + len(between)))
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for word in ("mailto:", "tel:"):
        for form in (word, word.upper(), word.capitalize()):
            found.add_word(form, (word[:-1], len(word)))
    for word in CUES:
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            found.add_word(form, ("cue", len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    code = text.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return 15 <= len(code) <= 34 and int(number) % 97 == 1


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends at ``at``."""
    at = CUE_REST_RE.match(text, at).end()
    if m := IBAN_RE.match(text, at):
        end = m.end()
        while end - at >= 15 and not (text[end - 1] != " " and iban_ok(text[at:end])):
            end -= 1
        if end - at >= 15:
            return at, end
    if m := SSN_RE.match(text, at):
        return m.span()
    if (m := NUMBER_RE.match(text, at)) and 6 <= len(_digits(m[0])) <= 17:
        return m.span()
    return None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text in code points, by start, then kind as listed."""
    out, done = [], dict.fromkeys(("email", "ip", "card", "phone", "address", "account"), 0)
    for last, (kind, width) in anchors().iter(text):
        at = last - width + 1
        if kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN_RE.match(text, at + 1)):
                out.append(("email", start, m.end()))
                done["email"] = m.end()
        elif kind == "ip":
            if at < done["ip"]:
                continue
            while at > done["ip"] and text[at - 1] in DIGITS:
                at -= 1
            m = CHAIN_RE.match(text, at)
            done["ip"] = m.end()
            parts = m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                own = parts[i : i + 4]
                end = at + sum(map(len, own)) + 3
                if all(map(small_part, own)):
                    out.append(("ip", at, end))
                at = end + 1
        elif kind == "card":
            if at < done["card"]:
                continue
            m = CARD_RE.match(text, at)
            done["card"] = m.end()
            if m.end() - at <= 37 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                out.append(("card", at, m.end()))
        elif kind == "phone":
            m = PHONE_RE.match(text, at)
            if m and 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", at, m.end()))
        elif kind == "cue":
            if at >= done["account"] and not (at and text[at - 1].isalnum()) and (found := _account(text, last + 1)):
                out.append(("account", *found))
                done["account"] = found[1]
        else:
            found = None
            if at < done["address"]:
                continue
            if kind == "url":
                start = at
                while start > done["address"] and text[start - 1] in SCHEME:
                    start -= 1
                if start < at and (m := USER_HOST_RE.match(text, last + 1)):
                    found = (start, m.end())
            elif kind == "mailto":
                if (m := USER_HOST_RE.match(text, last + 1)) and DOMAIN_RE.fullmatch(m[0].rpartition("@")[2]):
                    found = (at, m.end())
            elif (m := TEL_RE.match(text, last + 1)) and 7 <= len(_digits(m[0])) <= 15:
                found = (at, m.end())
            if found:
                out.append(("address", *found))
                done["address"] = found[1]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@pandas_udf(T.ArrayType(SPAN))
def spans_of(texts: pd.Series) -> pd.Series:
    return pd.Series(
        [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] if t else [] for t in texts], dtype=object
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` as ``doc``, with ``spans`` (kind, start, end in code points).

    Null and empty texts have no spans. Rows are judged one by one: repeated rows get equal spans, null ids
    do not matter, and an empty table gives none. Spans of different kinds may overlap; those of one kind do not.
    """
    return nested(docs).select("doc", spans_of("text").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; where spans overlap, the first one counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        part = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        new = F.struct(F.concat(state["out"], part, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= state["at"], new).otherwise(state)

    end = lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.aggregate(spans, start, step, end)


def listed(spans: Column) -> Column:
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_personal_data(docs).select(
        "doc.doc_id", *[n(k) for k in BASE_KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
