"""Text rules as column expressions: normalisation, negation, promotional wording, links."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .once import bound

# ---------------------------------------------------------------------------
# Fixed values (must match for right results).
# ---------------------------------------------------------------------------
SPACE_CLASS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NEGATION_WINDOW = 64
NEGATION = r"\b(?:not|never|without|isnt|wasnt|werent|arent|wont|didnt|doesnt|dont|no)\b(?:\s+\w+){0,3}\s*$"
NOT_ONLY = r"\bnot\s+only\s*$"

PROMO_TEXT_PATTERNS = [
    ("promo code", r"\b(?:use|enter)\s+(?:(?:promo|discount|coupon|offer)\s+)?code\b"),
    ("discount code", r"\b(?:promo|discount|coupon|offer)\s+code\b"),
    ("percentage discount", r"\b\d{1,2}\s*%\s+off\b"),
    ("free trial", r"\b(?:free|extended)\s+trial\b"),
    ("limited-time offer", r"\blimited[- ]time\s+(?:deal|discount|offer)\b"),
    ("exclusive offer", r"\b(?:exclusive|special)\s+(?:deal|discount|offer)\b"),
    ("sponsor disclosure", r"\b(?:sponsored|presented)\s+by\b"),
    ("sponsor attribution", r"\b(?:thanks?\s+to(?:\s+our)?\s+sponsor|brought\s+to\s+you\s+by)\b"),
    ("description link call to action", r"\blink\s+in\s+(?:the\s+)?description\b"),
    ("shop now call to action", r"\bshop\s+now\b"),
    (
        "explicit savings",
        r"\bsave\s+(?:[$€£]\s*\d+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?\s*(?:%|dollars?|euros?|pounds?))\b",
    ),
]
PROMO_URL_TOKENS = [
    "affiliate", "bonus", "checkout", "claim", "coupon", "deal", "discount", "gift",
    "offer", "partner", "promo", "redeem", "shop", "sponsor", "subscribe", "trial",
]
URL_DELIMITERS = r"[._~!$&'()*+,;=:@/?#-]"
DOMAIN_LIKE = (
    r"^(?:www\.)?[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    r"(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+(?:[/?#:]|$)"
)
LINK = (
    r"\b(?:https?://)?(?:www\.)?(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+"
    r"(?:[a-z]{2,24}|xn--[a-z0-9-]{2,59})(?:[/?#][^\s<>\"']*)?"
)
LINK_TAIL = r"[),.;:!?]+$"
# ---------------------------------------------------------------------------

WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
# Letters NFKC never changes; any other non-ASCII character sends the text to the Arrow UDF. The list of letters is only
# looked at behind a non-ASCII character: as one class it is tried range by range for each character of a text.
_NFKC_MAYBE = r"[^\x00-\x7F](?<![\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}])"


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """ASCII word edges and the full white-space class, whatever the Java version."""
    if pattern.startswith(r"\b"):
        # Every pattern here goes on with a word character, so the edge is a plain look-behind.
        pattern = "(?<![A-Za-z0-9_])" + pattern[2:]
    out = pattern.replace(r"\b", WORD_EDGE).replace(r"[^\s", "[^\0").replace(r"\s", SPACE_CLASS)
    return ("(?i)" if ignore_case else "") + out.replace("\0", SPACE_CLASS[1:-1])


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def collapse(text: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def normalize_text(text: Column, nfkc: bool = True) -> Column:
    """Lower case, compatibility form, no apostrophes, single blanks.

    With ``nfkc`` the texts that could change under NFKC go through an Arrow UDF (all others
    reach it as NULL). Without it the whole expression stays in the JVM; use that only for
    text known to be in compatibility form already.
    """
    low = F.lower(text)
    if nfkc:
        low = F.coalesce(_nfkc(F.when(low.rlike(_NFKC_MAYBE), low)), low)
    return collapse(F.regexp_replace(low, r"[\x{2019}']", ""))


def normalize_phrase(phrase: str) -> str:
    """The same rules for one phrase of the configuration."""
    plain = unicodedata.normalize("NFKC", phrase.lower())
    return " ".join(plain.replace("'", "").replace(chr(0x2019), "").split())


def is_negated(text: Column, start: Column) -> Column:
    """True if the words before ``start`` (0-based) negate what follows."""
    size = F.least(F.lit(NEGATION_WINDOW), start).cast("int")
    prefix = F.substr(text, (start - size + 1).cast("int"), size)
    return ~prefix.rlike(java_pattern(NOT_ONLY)) & prefix.rlike(java_pattern(NEGATION))


def promo_text_semantic(text: Column, nfkc: bool = True) -> Column:
    """First promotional wording, in list order, whose first occurrence is not negated."""
    norm = normalize_text(text, nfkc)
    return F.coalesce(*[_wording(norm, name, pattern) for name, pattern in PROMO_TEXT_PATTERNS])


def _wording(norm: Column, name: str, pattern: str) -> Column:
    java = java_pattern(pattern)
    start = F.regexp_instr(norm, F.lit(java)) - 1
    return F.when(norm.rlike(java), F.when(~is_negated(norm, start), F.lit(name)))


def _http_like(url: Column) -> Column:
    """Trimmed URL with a scheme, or NULL if it is neither http(s) nor a domain name."""
    raw = F.regexp_replace(F.trim(url), r"\\", "/")
    with_scheme = F.when(raw.rlike("(?i)^https?://"), raw).when(
        raw.rlike("(?i)" + DOMAIN_LIKE), F.concat(F.lit("https://"), raw)
    )
    valid = r"(?i)^https?://+(?:[^/?#@]*@)?[^\s/?#<>\[\]^|%@:]+(?::\d{0,5})?(?:[/?#].*)?$"
    return F.when(with_scheme.rlike("(?s)" + valid), with_scheme)


def is_url_like(value: Column) -> Column:
    return _http_like(value).isNotNull()


def promo_url_semantic(url: Column) -> Column:
    """First promotional token of a URL, bounded by delimiters; NULL if none."""
    rest = F.regexp_replace(F.lower(_http_like(url)), "^https?://+", "")
    rest = F.regexp_replace(rest, "^[^/?#@]*@", "")
    rest = F.regexp_replace(rest, r"^([^/?#:]*):\d*", "$1")
    token = f"(?:^|{URL_DELIMITERS})({'|'.join(PROMO_URL_TOKENS)})(?:$|{URL_DELIMITERS})"
    return F.nullif(F.regexp_extract(rest, token, 1), F.lit(""))


def repair_spoken_links(text: Column) -> Column:
    """Turns ``dot``, ``slash`` and spaced punctuation into URL characters."""
    # Leading white space is taken possessively from the start of its run, which keeps the scan linear.
    run = r"(?<!" + SPACE_CLASS + ")" + SPACE_CLASS + "*+"
    steps = [
        (run + r"(?:\[dot\]|\(dot\)|\bdot\b)\s*", ".", True),
        (r"([A-Za-z])\s++\.\s*([A-Za-z])", "$1.$2", False),
        (r"([A-Za-z])\s*+\.\s+([a-z])", "$1.$2", False),
        (run + r"(?:\bslash\b|/)\s*", "/", True),
        (r"https\s*+:\s*+/\s*+/", "https://", True),
        (r"http\s*+:\s*+/\s*+/", "http://", True),
    ]
    for pattern, repl, ignore_case in steps:
        held = pattern.replace(run, "\1")
        java = java_pattern(held, ignore_case).replace("\1", run)
        text = F.regexp_replace(text, java, repl)
    return text


# Characters that a URL parser escapes in a path, a query and a fragment.
PATH_ESCAPES = r"[^\x21-\x7E]|[\"<>^`{}]"
QUERY_ESCAPES = r"[^\x21-\x7E]|[\"<>']"
FRAGMENT_ESCAPES = r"[^\x21-\x7E]|[\"<>`]"


def _escaped(part: Column, characters: str) -> Column:
    each = F.transform(F.split(part, ""), lambda c: F.when(c.rlike(characters), F.url_encode(c)).otherwise(c))
    return F.when(part.rlike(characters), F.array_join(each, "")).otherwise(part)


def _without_dots(path: Column) -> Column:
    """Dot segments folded: ``.`` goes, ``..`` takes the segment before it along."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    one, two = (lambda s: F.lower(s).isin(".", "%2e")), (lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"))

    def step(kept: Column, s: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(two(s), up).when(one(s), kept).otherwise(F.array_append(kept, s))

    last = F.element_at(parts, -1)
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    closed = F.when(one(last) | two(last), F.array_append(folded, F.lit(""))).otherwise(folded)
    has_dots = path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)")
    return F.when(has_dots, F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)


def _canonical_url(link: Column) -> Column:
    """As a URL parser writes it: scheme and host in lower case, no default port, a path of at least ``/`` without
    dot segments, and what the path, the query and the fragment must escape escaped."""
    origin = F.regexp_extract(link, "(?i)^https?://[^/?#\\\\]*", 0)
    host = F.regexp_replace(F.lower(origin), "^(https://.*):(?:443)?$|^(http://.*):(?:80)?$", "$1$2")
    rest = F.substr(link, F.length(origin) + 1)
    path = F.translate(F.regexp_extract(rest, "^[^?#]*", 0), "\\", "/")
    query, fragment = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1), F.regexp_extract(rest, "(#.*)$", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(
        host, bound(path, lambda p: _escaped(_without_dots(p), PATH_ESCAPES)), _escaped(query, QUERY_ESCAPES), _escaped(fragment, FRAGMENT_ESCAPES)
    )


def extract_links(text: Column) -> Column:
    """Canonical links in order of appearance, without repeats (case ignored)."""
    # A link holds a dot and no blanks, quotes or angle brackets: only such tokens meet the long pattern.
    tokens = F.split(repair_spoken_links(text), java_pattern("[\"'<>]") + "|" + SPACE_CLASS)
    repaired = F.array_join(F.filter(tokens, lambda t: t.contains(".")), " ")
    found = F.regexp_extract_all(repaired, F.lit("(?i)(@?" + java_pattern(LINK) + ")"), F.lit(0))
    kept = F.filter(found, lambda m: ~m.startswith("@"))
    bare = F.transform(kept, lambda m: F.regexp_replace(m, LINK_TAIL, ""))
    full = F.transform(
        bare, lambda m: _canonical_url(F.when(m.rlike("(?i)^https?://"), m).otherwise(F.concat(F.lit("https://"), m)))
    )

    def first_only(links: Column) -> Column:
        return bound(
            F.transform(links, F.lower), lambda low: F.filter(links, lambda m, i: F.array_position(low, F.lower(m)) == i + 1)
        )

    return bound(full, first_only)
