"""Decontamination, licences, near duplicates, quality model and suffix dedup against brute force on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelmark.llm import arrays, decontamination, licences, near_dup, quality_model, suffix_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = "doc_id long, text string, places string, bands string, rep string, doc string, items string, own string, key string, tag string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)


def awkward_rows():
    """Nulls, empties, a long text, ties and repeated rows."""
    long = " ".join(f"w{i % 9973}x{i // 9973}" for i in range(40_000))
    return [(1, None), (2, ""), (3, " \n "), (4, long), (5, long), (6, "one two"), (7, "one two"), (7, "one two"),
            (None, "one two"), (None, long), (8, "é" * 60), (9, "a" * 300), (10, "a" * 300)]


def awkward(spark):
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in awkward_rows()], AWKWARD)


def empty(spark):
    return spark.createDataFrame([], DOC)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sets_of(text):
    w = WORD.findall((text or "").lower())
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


# ---- arrays ---------------------------------------------------------------------


def test_words_and_shingles_follow_the_text():
    rng = random.Random(1)
    texts = [None, "", " ", "A b", "a\x0bB  c\n", "é ß x"] + [prose(rng, rng.randrange(0, 40), 5) for _ in range(50)]
    column = pa.array(["skip", *texts])[1:]
    for size in (1, 64, 1 << 20):
        seen = []
        for b in arrays.blocks(column, size):
            w = arrays.words(b)
            doc, h = arrays.shingles(w)
            for k in range(b.n):
                text = texts[b.first + k] or ""
                assert w.count()[k] == len(WORD.findall(text))
                assert (doc == k).sum() == len(sets_of(text)) == len(set(h[doc == k]))
            seen += range(b.first, b.first + b.n)
        assert seen == list(range(len(texts)))


# ---- near duplicates ------------------------------------------------------------


def groups_brute(rows, least=0.8):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keyed = [(i, sets_of(t), tuple(WORD.findall((t or "").lower()))) for i, t in rows if i is not None]
    for n, (a, sa, wa) in enumerate(keyed):
        for b, sb, wb in keyed[:n]:
            if wa == wb or len(sa & sb) >= least * len(sa | sb) - 1e-9 and sa and sb:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    element = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0, 6, 300), rng.uniform(0, 6, 300)
    a[:50], b[50:90] = 0, 0
    doc = np.r_[np.zeros(300, int), np.ones(300, int)]
    weight = np.r_[a, b]
    on = weight > 0
    sig = near_dup.signatures(doc[on], np.r_[element, element][on], weight[on], 3, 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    assert not sig[2].any() and sig[:2].all()


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    rows, k = [], 0
    for _ in range(25):
        base = prose(rng, rng.choice([6, 30, 120, 300])).split()
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((k, " ".join(w)))
            k += 1
    # A passage common to unlike documents, and a large group of near copies.
    common = prose(rng, 60)
    rows += [(1000 + i, common + " " + prose(rng, 60)) for i in range(60)]
    base = prose(rng, 200).split()
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"y{i}"
        rows.append((2000 + i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == groups_brute(rows)


def test_groups_linked_by_two_members_that_lead_nothing(spark):
    """Groups A and B are linked by a and b only; other members of each have smaller ids in all buckets of the two."""
    rng, rows = random.Random(7), []
    for k in range(10):
        core, own_a, own_b = ([f"{x}{k}v{rng.randrange(10**6)}" for _ in range(n)] for x, n in (("c", 95), ("a", 8), ("b", 8)))
        cut = lambda i, own: " ".join(core[:i] + core[i + 10 :] + own)  # noqa: E731, B023
        members = [cut(0, own_a), cut(85, own_a), cut(20, own_b), cut(60, own_b), " ".join(core + own_a), " ".join(core + own_b)]
        rows += [(10 * k + i, t) for i, t in enumerate(members)]
        sets = [sets_of(t) for t in members]
        linked = {(i, j) for j in range(6) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert linked == {(0, 4), (1, 4), (2, 5), (3, 5), (4, 5)}
    want = {i: i // 10 * 10 for i, _ in rows}
    assert groups_brute(rows) == want
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == want


def test_pairs_between_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rng = random.Random(8)
    rows = {(rng.randrange(3), i): (rng.randint(20, 30), rng.randrange(6), i % 17) for i in range(90)}
    members = spark.createDataFrame([(b, r, *v) for (b, r), v in rows.items()], "bucket long, rep long, n int, at int, label long")
    need = set()
    for (b, x), (n, at, label) in rows.items():
        for (c, y), (m, at_y, label_y) in rows.items():
            t = 0.8 / 1.8 * (n + m) - 1e-9
            if b == c and x < y and label != label_y and at + t <= n and at_y + t <= m and min(n, m) >= 0.8 * max(n, m) - 1e-9:
                need.add((x, y))
    found = near_dup._between_groups(members, 0.8).collect()
    assert {(r.a, r.b) for r in found} == need and len(found) == len(need) > 100


def test_prefix_buckets_lose_no_pair(spark):
    rng = random.Random(6)
    base = [prose(rng, 40, 30).split() for _ in range(6)]
    rows = []
    for i in range(80):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(40)] = f"w{rng.randrange(30)}"
        rows.append((i, sorted({hash_of(s) for s in sets_of(" ".join(w))})))
    sets = spark.createDataFrame(rows, "rep long, own array<long>")
    found = near_dup._prefix_buckets(sets.select("rep"), sets, 0.8)
    met = {tuple(sorted((a.rep, b.rep))) for rs in by_bucket(found.collect()).values() for a in rs for b in rs if a.rep < b.rep}
    own = {i: set(s) for i, s in rows}
    need = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
    assert need and need <= met


def test_shingles_are_counted_before_the_shuffle(spark):
    sets = spark.createDataFrame([(i, [1, 2, 10 + i]) for i in range(9)], "rep long, own array<long>")
    found = near_dup._prefix_buckets(sets.select("rep"), sets, 0.6)
    assert {(r.bucket, r.rep, r.at) for r in found.collect()} == {(1, i, 1) for i in range(9)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_count" in plan


def hash_of(shingle):
    return int.from_bytes(str(shingle).encode()[-7:], "big")


def by_bucket(rows):
    out = {}
    for r in rows:
        out.setdefault(r.bucket, []).append(r)
    return out


def test_near_duplicates_take_awkward_tables(spark):
    df = awkward(spark)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 9}
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 6, 8, 9, None, None])
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_connected_follows_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 102, 200]], "node long")
    got = {r.node: r.label for r in near_dup.connected(spark.createDataFrame(edges, "a long, b long"), nodes).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200}


# ---- suffix dedup ---------------------------------------------------------------


def removed_brute(rows, length=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: 2**63 - 1 if i is None else i
    for i, b in texts:
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            first[g] = min(first.get(g, 2**63 - 1), rank(i))
    out = Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < rank(i):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[(i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))] += 1
    return out


def removed(df):
    rows = suffix_dedup.removed_passages(df).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)


def test_removed_bytes_equal_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdefghij é\n"
    pieces = ["".join(rng.choice(letters) for _ in range(rng.choice([20, 48, 49, 50, 51, 60, 90, 200]))) for _ in range(25)]
    pieces += ["ab" * 60, "a" * 120, "xyz" * 30]
    rows = []
    for i in range(120):
        own = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.randrange(10**6), "".join(own() + rng.choice(pieces)[rng.randrange(0, 4) :] for _ in range(rng.randrange(0, 5))) + own()))
    rows = list({i: (i, t) for i, t in rows}.values())
    assert removed(docs_of(spark, rows)) == removed_brute(rows)


def test_suffix_dedup_takes_awkward_tables(spark):
    rows = [(i, t if t is None else t[:3000]) for i, t in awkward_rows()] + [(12, "z" * 80), (12, "z" * 70 + "y"), (13, "z" * 60)]
    df = spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], AWKWARD)
    assert removed(df) == removed_brute(rows)
    assert removed(empty(spark)) == Counter()


def test_sorted_verdicts_do_not_depend_on_batches(monkeypatch):
    rng = random.Random(10)
    rows = sorted((rng.randrange(6), rng.randrange(3), rng.randrange(9), k) for k in range(200))
    rows += [(6, 0, 4, 300 + k) for k in range(40)] + [(7, 0, 4, 400 + k) for k in range(40)] + [(7, 1, 4, 500)]
    names = ["sample", "whole", "doc", "place", "seen"]
    known = {5, 60, 301}

    def run(size):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        parts = [[(*r, r[3] in known) for r in p] for p in parts]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*p, strict=True)], names=names) for p in parts]
        return [tuple(r.values()) for b in suffix_dedup._sorted_verdicts(True)(iter(batches)) for r in b.to_pylist()]

    want = set()
    for s, w, d, p in rows:
        seen = p in known or any(x[:2] == (s, w) and x[2] < d for x in rows)
        if seen or any(x[0] == s and x[1] != w and x[3] not in known for x in rows):
            want.add((d, p, seen))
    assert set(run(1)) == set(run(7)) == set(run(1000)) == want
    # What is held is bounded; more strings are then judged window by window, none is lost.
    monkeypatch.setattr(suffix_dedup, "HELD", 8)
    few = set(run(7))
    assert few >= want and all(not seen for _, _, seen in few - want)


def test_strings_seen_in_a_batch_are_combined_before_the_shuffle():
    whole, doc = np.array([7, 7, 9, 7, 9, 4]), np.array([3, 2, 5, 2, 5, 1])
    assert suffix_dedup._seen_here(whole, doc).tolist() == [True, False, False, False, False, False]
    parts = [(np.array([1, 1, 2]), np.array([7, 7, 9]), np.array([3, 2, 5]), np.array([64, 128, 192]))]
    out = suffix_dedup._combined(parts).to_pylist()
    assert [r["seen"] for r in out] == [True, False, False]
    assert [(r["doc"], r["place"]) for r in out] == [(3, 64), (2, 128), (5, 192)]
    assert out[1]["sample"] == 1 and out[1]["whole"] == 7 and out[0]["sample"] == out[0]["whole"]


# ---- decontamination ------------------------------------------------------------


def contained_brute(rows, items, least=0.8):
    cut = lambda t: {s for s in sets_of(t) if len(s) == 5}
    out = set()
    for i, t in rows:
        own = cut(t)
        for j, b in items:
            item = cut(b)
            if j is not None and item and len(own & item) >= least * len(item) - 1e-9:
                out.add((i, j, len(own & item), len(item)))
    return out


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(12)
    items = [(j, prose(rng, rng.choice([3, 5, 8, 20, 21, 60, 150]), 90)) for j in range(30)] + [(99, None), (None, prose(rng, 30)), (98, "")]
    rows = []
    for i in range(120):
        w = prose(rng, rng.choice([0, 10, 200, 2000]), 90).split()
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(items)[1] or ""
            part = part.split()
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        rows.append((i, " ".join(w).capitalize()))
    rows += [(500, None), (None, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contained_items(docs_of(spark, rows), bench)
    got = {(r.doc_id, r.item_id, r.n_common, r.n_item) for r in found.collect()}
    assert got == contained_brute(rows, items) and found.count() == len(got) > 20
    kept = decontamination.decontaminated(docs_of(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, *_ in got}


def test_decontamination_takes_awkward_tables(spark):
    bench = spark.createDataFrame([(1, "w1x0 w2x0 w3x0 w4x0 w5x0 w6x0")], "item_id long, text string")
    df = awkward(spark)
    kept = decontamination.decontaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert decontamination.contained_items(empty(spark), bench).count() == 0
    assert decontamination.contained_items(df, bench.limit(0)).count() == 0


# ---- licences -------------------------------------------------------------------


def scan_brute(files, templates):
    term = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff-]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    terms = lambda t: Counter(term.findall(lower(t)))
    lines = [terms(x) for _, t in files for x in (t or "").split("\n")]
    vocabulary = sorted({w for _, t in templates for w in terms(t)})
    idf = {w: np.log((len(lines) + 1) / (sum(w in x for x in lines) + 1)) + 1 for w in vocabulary}
    other = np.log(len(lines) + 1) + 1

    def best(c, least):
        top = (0.0, None)
        norm = np.sqrt(sum((c[w] * idf[w]) ** 2 for w in c if w in idf) + sum(n for w, n in c.items() if w not in idf) * other**2)
        for name, t in templates:
            u = terms(t)
            dot = sum(c[w] * idf[w] * u[w] * idf[w] for w in u)
            cos = dot / norm / np.sqrt(sum((u[w] * idf[w]) ** 2 for w in u)) if norm else 0.0
            if cos > top[0] + 1e-12:
                top = (cos, name)
        return top if top[0] >= least else (0.0, None)

    own = {}
    for p, t in files:
        heads = [best(terms(x), licences.HEADER) for x in (t or "").split("\n")]
        own[p] = (max(heads, key=lambda h: h[0])[1], *best(terms(t or ""), licences.FILE))
    out = {}
    for p, (header, score, whole) in own.items():
        name, how, d = whole or header, "file" if whole else "header", p
        while not name:
            if not d:
                break
            d = d.rpartition("/")[0]
            here = [(round(s, 9), w) for q, (_, s, w) in own.items() if w and q.rpartition("/")[0] == d]
            if here:
                name, how = max(here)[1], "inherited"
        out[p] = (name, how if name else "none")
    return out


def test_scan_equals_brute_force(spark):
    rng = random.Random(14)
    names = [t for _, t in licences.TEMPLATES]
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/COPYING", names[9] + "\n" + names[9]), ("LICENSE", names[2])]
    for i in range(60):
        body = "\n".join(prose(rng, 8) for _ in range(rng.randrange(0, 6)))
        head = rng.choice(["", "", f"# {rng.choice(names)}\n", "see the license\n"])
        files.append((f"{rng.choice(['a', 'a/b', 'a/b/c', 'x', 'x/y'])}/f{i}", head + body))
    files.append(("x/y/none", None))
    df = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.license, r.how) for r in licences.scan(df).collect()}
    assert got == scan_brute(files, licences.TEMPLATES)
    assert {"file", "header", "inherited"} <= {h for _, h in got.values()}


def test_headers_are_found_inside_lines_and_across_them(spark):
    rng = random.Random(15)
    body = "\n".join(prose(rng, 12) for _ in range(20))
    long = dict(licences.TEMPLATES[::-1])
    heads = {
        "Apache-2.0": ["# Copyright 2024 Example Inc. Licensed under the Apache License, Version 2.0.", "// Licensed under the\n// Apache License,\n// Version 2.0."],
        "MIT": ["// Copyright (c) 2024 Jane Doe. Released under the MIT License.", "Parser for tables. Released under the MIT License.", long["MIT"].replace(" ", "\n * ")],
        "BSD-3-Clause": ["Use of this source code is governed\n# by a BSD-style license that can be\n# found in the LICENSE file."],
        "Proprietary": ["Copyright 2024 Example Inc. All rights reserved.", "Copyright (c) 2019-2024 Jane Doe and\nothers. All rights reserved. See below."],
        None: ["It was released under the bridge, in version 2.0 of the tale.", "copyright " + "x " * 20 + "all", "All rights"],
    }
    files = [(f"d{i}{k}/f", f"{t}\n{body}", name) for i, (name, ts) in enumerate(heads.items()) for k, t in enumerate(ts)]
    # A stretch does not cross two files.
    files += [("e/a", body + "\nCopyright. All", None), ("e/b", "rights reserved.\n" + body, None)]
    df = spark.createDataFrame([(p, t) for p, t, _ in files], "path string, text string").coalesce(1)
    got = {r.path: (r.license, r.how) for r in licences.scan(df).collect()}
    assert got == {p: (name, "header" if name else "none") for p, _, name in files}


def test_stretches_equal_brute_force():
    rng = np.random.default_rng(16)
    space = licences.Space()
    v = len(space.vocabulary)
    space.weigh(rng.integers(1, 900, v).astype(float), 1000)
    doc = np.sort(rng.integers(0, 12, 1500))
    place = rng.integers(0, v + 1, 1500)
    text = [space.place(licences.terms(b)[1]) for _, t in licences.TEMPLATES for b in arrays.blocks(pa.array([t]))]
    for t in text * 3:
        at = rng.integers(0, 1500 - len(t))
        place[at : at + len(t)] = np.where(rng.random(len(t)) < 0.15, v, t)
    want = np.zeros((12, len(text)))
    for t, (a, b) in enumerate(space.parts):
        assert a + b == len(text[t]) and (a, b) == ((1, 3) if space.names[t] == "Proprietary" else (a, 0))
        for gap in range(licences.HOLDER + 1 if b else 1):
            for i in range(1500 - a - gap - b + 1):
                if doc[i] == doc[i + a + gap + b - 1]:
                    own = np.r_[place[i : i + a], place[i + a + gap : i + a + gap + b]]
                    cos = space.cosines(np.zeros(len(own), int), own, 1)[0, t]
                    if cos >= licences.HEADER:
                        want[doc[i], t] = max(want[doc[i], t], cos)
    found = space.stretches(doc, place, 12, licences.HEADER)
    assert np.allclose(np.where(found >= licences.HEADER, found, 0), want) and (want > 0).sum() > 20


def test_licence_versions_and_identifiers_are_told_apart(spark):
    later = "under the terms of the GNU General Public License as\n * published by the Free Software Foundation; either version {} of\n * the License, or (at your option) any later version."
    texts = {
        "GPL-2.0-or-later": [f"/*\n * You can redistribute it and/or modify it {later.format(2)}\n */\nint x;", "// SPDX-License-Identifier: GPL-2.0-or-later\ncode"],
        "GPL-3.0-or-later": [f"/*\n * You can redistribute it and/or modify it {later.format(3)}\n */\nint x;", "# SPDX-License-Identifier: GPL-3.0-or-later"],
        "GPL-2.0": ["  GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n\nPreamble and much more", "SPDX-License-Identifier: GPL-2.0-only\nx"],
        "GPL-3.0": ["  GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nPreamble and much more", "SPDX-License-Identifier: GPL-3.0-only\nx"],
        "LGPL-3.0": ["  GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nThis version"],
        "ISC": ["// SPDX-License-Identifier: ISC\nlet y = 1"],
        "MIT": ["# SPDX-License-Identifier: MIT\ny = 1"],
        None: ["# SPDX-License-Identifier: Nokia-Example\ny = 1", "a license identifier of version 2 or later"],
    }
    files = [(f"d{k}_{j}/f", t, name) for k, (name, own) in enumerate(texts.items()) for j, t in enumerate(own)]
    filler = [(f"x{k}/f", "some words of no template at all\nand then others") for k in range(40)]
    df = spark.createDataFrame([f[:2] for f in files] + filler, "path string, text string")
    got = {r.path: r.license for r in licences.scan(df).collect()}
    assert {p: got[p] for p, _, _ in files} == {p: name for p, _, name in files}


def test_licences_take_awkward_tables(spark):
    df = awkward(spark).withColumn("path", F.col("doc_id").cast("string"))
    out = licences.scan(df)
    assert out.count() == df.count() and {r.how for r in out.collect()} == {"none"}
    assert licences.scan(empty(spark).withColumn("path", F.lit("x"))).count() == 0


# ---- quality model --------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_model.op9(spark, sf)
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, len(quality_model.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality_model.grow(x, y, n_trees=20, depth=3)
    got = trees.score(x)
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.95
    for row in range(0, 3000, 500):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[row, f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert got[row] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_takes_awkward_tables(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 0)], "doc_id long, quality int")
    got = quality_model.quality_scores(df, labels).collect()
    assert len(got) == df.count() and all(0 < r.score < 1 for r in got)
    assert quality_model.quality_scores(empty(spark), labels).count() == 0
    assert quality_model.quality_scores(df, labels.limit(0)).count() == df.count()


# ---- pipeline -------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "near duplicates", "decontamination", "source mixing",
    ]
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] >= counts[4]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    got = sorted((r.doc_id, r.text, r.copies) for r in corpus_pipeline.run(spark, sf).collect())
    assert sorted((r.doc_id, r.text, r.copies) for r in last.collect()) == got
    assert all(r[2] in (1, 2) for r in got)


def test_pipeline_takes_awkward_documents(spark):
    rows = [(i, t, None, None, None) for i, t in awkward_rows()]
    docs = spark.createDataFrame(rows, DOC).withColumn("copies", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert last.columns == [*docs.columns, "copies_taken"]
