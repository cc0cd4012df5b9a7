"""Line dedup, quality rules, personal data, URL filter and mixing against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from reelmark.llm import line_dedup, mixing, pii, quality_rules, url_filter

SPACE = " \t\n\x0b\x0c\r"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, schema=DOC):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], schema)


def awkward(spark):
    """Nulls, empties, a long text, ties, repeated rows, and columns that clash with the operators' own."""
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "wort " * 30_000), (5, "the same line of twenty chars\nx"),
            (6, "the same line of twenty chars\nx"), (6, "the same line of twenty chars\nx"), (None, "The Same line of twenty chars "),
            (7, "é" * 30 + "\n\n"), (8, "mail a.b@c.example.org now")]
    names = "doc_id long, text string, n_lines string, drop_at string, h1 string, doc string, spans string, at string, keeper string"
    return spark.createDataFrame([(i, t, *["x"] * 7) for i, t in rows], names)


def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- line dedup -----------------------------------------------------------------


def lines_brute(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    best = lambda s: max((x for x in s if x is not None), default=None)
    gone = {k: best(v) for k, v in holders.items() if len(v) >= min_docs}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out[(i, len(lines), len(lines) - len(keep), "\n".join(keep))] += 1
    return out


def test_shared_lines_leave_all_but_the_last_document(spark):
    rng = random.Random(3)
    pool = [f"Line number {k} of the shared pool, {'x' * (k % 7)}" for k in range(12)] + ["short", "", "  ", "ÄÖ" * 12]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), f" {x}\t"]) for x in rng.choices(pool, k=rng.randint(0, 6)))) for i in range(40)]
    rows += [(41, None), (None, "\n".join(pool)), (3, rows[3][1])]
    got = line_dedup.drop_shared_lines(docs_of(spark, rows))
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.select("doc.doc_id", "n_lines", "n_dropped", "kept_text").collect())
    assert got == lines_brute(rows)


def test_line_dedup_takes_awkward_tables(spark):
    df = awkward(spark)
    out = line_dedup.deduplicated(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert {r.text for r in out.filter("doc_id = 1").collect()} == {None}
    # 5, 6 and the row without id count as three documents; the line stays in 6, in both of its rows.
    assert sorted(r.text for r in out.filter("doc_id in (5, 6)").collect()) == ["the same line of twenty chars\nx"] * 2 + ["x"]
    assert line_dedup.deduplicated(empty(spark)).count() == 0


# ---- quality rules --------------------------------------------------------------


def measures_brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, len(covered)


def test_measurements_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "a b c", "a a a a", "a b c a b c", "x\u00a0y z", "# | <b> **", "l\nl\nl\n\n \nl ", "é ü\x0bß\rß\x0cß é"]
    texts += ["".join(rng.choice(["a", "b", "cc", " ", " ", "\n", "#"]) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    got = quality_rules.ledger(docs_of(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures_brute(texts[r.doc.doc_id]), texts[r.doc.doc_id]


def test_policies_and_ablation_use_bits_only(spark):
    clean = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, clean), (2, "few"), (3, "a b c " * 40), (4, " ".join(f"w{i}###" for i in range(60))), (5, None)]
    entries = quality_rules.ledger(docs_of(spark, rows)).cache()
    kept = {r.doc_id: r.k for r in entries.select("doc.doc_id", quality_rules.kept_by("v2").alias("k")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    by_rule = {r.rule: (r.n_fail, r.n_fail_only, r.n_kept_without) for r in quality_rules.ablation(entries, "v1").collect()}
    assert by_rule["few_words"][0] == 2 and by_rule["symbols"] == (1, 1, 2)
    df = awkward(spark)
    assert quality_rules.ledger(df).count() == df.count()
    assert quality_rules.ledger(empty(spark)).count() == 0
    assert quality_rules.ablation(quality_rules.ledger(empty(spark)), "v1").count() == 0


# ---- personal data --------------------------------------------------------------


def base_brute(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_kinds_equal_the_patterns():
    rng = random.Random(9)
    parts = ["a", "B.", "@", "c-d", ".", "1", "255", "256", "0001", " ", "-", "+", "(", ")", "é", "4111 1111 1111 1111", "4111-1111-1111-1111",
             "+1 (523) 555-1055", "10.0.0.1", "x@y.example.com", "@@", "..", "\n", "iban ", "://", "mailto:"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == base_brute(text), text


def test_added_kinds_and_redaction(spark):
    text = "IBAN: GB82 WEST 1234 5698 7654 32, see https://me:pw@host.example/x or mailto:a@b.example; ssn 123-45-6789 account of one"
    found = [(k, text[s:e]) for k, s, e in pii.find_spans(text)]
    assert ("account", "GB82 WEST 1234 5698 7654 32") in found and ("account", "123-45-6789") in found
    assert ("address", "https://me:pw@host.example") in found and ("address", "mailto:a@b.example") in found
    assert pii.find_spans("clean account of an address: https://host.example/path, ssn none") == []
    df = awkward(spark)
    out = pii.find_personal_data(df)
    got = {r.doc.doc_id: [tuple(s) for s in r.spans] for r in out.collect()}
    assert out.count() == df.count() and got[1] == got[2] == [] and got[8] == [("email", 5, 22)]
    shown = out.filter("doc.doc_id = 8").select(pii.redacted(out["doc.text"], out["spans"]).alias("t")).first()
    assert shown.t == "mail [email] now"
    assert pii.find_personal_data(empty(spark)).count() == 0


# ---- URL filter -----------------------------------------------------------------


def test_rules_hosts_and_reputation(spark):
    urls = [None, "", "no scheme/x", "HTTP://Example.NET/en/1", "http://a.example.net/de", "http://a.example.net", "x://B.example.com/de/?q",
            "x://b.example.com/d", "x://v.org/fr/#a", "x://notexample.org/en/1", "x://ÄB.de:80?q#f://z", "x://bad.example.co/1"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, page string")
    bad = [("x://bad.example.co/1", True)] * 200 + [("x://v.org/1", False)] * 50 + [("x://one.org/1", True), (None, None), (None, False)]
    outcomes = spark.createDataFrame(bad, "url string, bad boolean")
    got = {r.page.page_id: r for r in url_filter.judge(pages, outcomes).collect()}
    assert len(got) == len(urls)
    assert [(got[i].host, got[i].path) for i in (0, 1, 2)] == [("", "")] * 3
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("example.net", "/en/1", "example.net/en/", "allow")
    assert (got[4].rule, got[4].verdict) == ("net/", "block") and got[5].rule is None
    assert (got[6].rule, got[6].path) == ("example.com/de/", "/de/") and got[7].rule is None
    assert (got[8].rule, got[9].rule) == ("org/fr/", None)
    assert (got[10].host, got[10].path) == ("Äb.de:80", "")
    assert got[11].verdict == "block" and got[9].verdict == "allow"
    assert url_filter.judge(pages.limit(0), outcomes.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, outcomes.limit(0)).filter("rule is null").collect()} == {"allow"}


@pytest.mark.parametrize(
    ("host", "domain"), [("a.b.example.com", "example.com"), ("x.co.uk", "x.co.uk"), ("a.x.co.uk", "x.co.uk"), ("h", "h"), ("", ""), ("a.de:8080", "a.de")]
)
def test_registered_domain(spark, host, domain):
    df = spark.createDataFrame([(host,)], "h string")
    assert df.select(url_filter.host_domain(df.h).alias("d")).first().d == domain


# ---- mixing ---------------------------------------------------------------------


def targets_brute(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, limit = share * sum(sizes.values()), {s: cap * sizes[s] for s in sizes}
    t = {s: total * w[s] / sum(w.values()) for s in names}
    for _ in range(1000):
        over = {s for s in names if t[s] >= limit[s] - 1e-12}
        excess = sum(t[s] - limit[s] for s in over)
        for s in over:
            t[s] = limit[s]
        rest = [s for s in names if s not in over]
        if excess <= 1e-9 or not rest:
            break
        for s in rest:
            t[s] += excess * w[s] / sum(w[x] for x in rest)
    return t


def test_mix_meets_targets_within_a_document(spark):
    rng = random.Random(11)
    names = ["a", "b", "B", "é", None, "tiny", "void"]
    rows = []
    for i in range(600):
        s = rng.choices(names[:5], [30, 5, 5, 3, 3])[0]
        rows.append((i, " ".join(["w"] * rng.choice([1, 3, 20, 60, 200, 900])), s))
    rows += [(700, "one two three", "tiny"), (701, None, "void"), (702, "", "void"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(mixing.sized(docs)).collect()
    again = mixing.mix(mixing.sized(docs.repartition(7))).collect()
    assert Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in again)
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    want = targets_brute(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(60, 0.01 * t), s
    assert mixing.mix(mixing.sized(empty(spark))).count() == 0


def test_dual_with_two_kinds_of_groups(spark):
    cells = spark.createDataFrame([("a", "x", 10, 50), ("a", "y", 10, 50), ("b", "x", 20, 30), ("b", "y", 5, 40)], "source string, lang string, size long, n long")
    by_source = spark.createDataFrame([("a", 800.0), ("b", 900.0)], "source string, target double")
    by_lang = spark.createDataFrame([("x", 1200.0), ("y", 500.0)], "lang string, target double")
    got = mixing.dual_rates(cells, {"source": by_source, "lang": by_lang}).collect()
    for kind, targets in (("source", {"a": 800, "b": 900}), ("lang", {"x": 1200, "y": 500})):
        for g, t in targets.items():
            assert sum(r.n * r.size * r.rate for r in got if r[kind] == g) == pytest.approx(t, rel=1e-3)
    assert all(0 < r.rate <= 2 for r in got)


def test_sha_of_kept_text_is_utf8(spark):
    row = line_dedup.op8(spark, "/root/testdata/sf0.001").filter("n_dropped = 0").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id = {row.doc_id}").first().text
    assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
