"""SimHash components, spelling variants and tokenizer alignment against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from reelmark.llm import alignment, simhash, spelling

SPACE = " \t\n\x0b\x0c\r"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOC)


def awkward_rows():
    """Nulls, empties, long texts, one long word, ties, repeated rows and rows without id."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "wort " * 30_000), (5, "x" * 70_000), (6, "Same text here, twice"), (6, "Same text here, twice"),
        (None, "same text here, Twice"), (7, "éÉ ×÷ straße Größe"), (8, "▁ a<s>b <|endoftext|> \x00\x1c z"), (9, "one"), (None, None),
    ]


def with_clashing_columns(spark, rows, names):
    fields = ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in rows], f"doc_id long, text string, {fields}")


# ---- simhash --------------------------------------------------------------------


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def print_of(text):
    w = words_of(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(prints, ids, radius=4):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(prints))]


def check_simhash(spark, rows, df=None, **options):
    got = Counter(map(tuple, simhash.simhash_components(df if df is not None else docs_of(spark, rows), **options).collect()))
    prints = [print_of(t) for _, t in rows]
    comps = components_brute(prints, [i for i, _ in rows])
    assert got == Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, comps, strict=True))


def test_simhash_components_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [rng.choices(vocabulary, k=rng.choice([1, 3, 5, 40, 200])) for _ in range(25)]
    rows = []
    for i in range(220):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    check_simhash(spark, rows)
    check_simhash(spark, rows, block=8)


def test_simhash_of_awkward_rows_and_no_rows(spark):
    rows = awkward_rows()
    check_simhash(spark, rows, with_clashing_columns(spark, rows, ["fp", "label", "least", "component_id", "bucket"]))
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("block", [8192, 50])
@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_links_connect_what_all_pairs_connect(spark, radius, block):
    """Chains at the edge of the radius, in one hot bucket and in many small ones."""
    rng = np.random.default_rng(radius)
    fp = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(int(rng.integers(1, 40))):
            fp.add(x)
            for b in rng.choice(64, int(rng.integers(1, radius + 3)), replace=False):
                x ^= 1 << int(b)
    fp |= {int(x) for x in rng.integers(0, 1 << 20, 150)}
    fp = sorted(fp)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fp]
    links = simhash.near_fingerprints(spark.createDataFrame(signed, "fp long"), radius, radius + 2, block).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in links)
    place = {s[0]: i for i, s in enumerate(signed)}
    label = list(range(len(fp)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = root(place[a]), root(place[b])
        label[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(fp))] == components_brute(fp, range(len(fp)), radius)


# ---- spelling -------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def variants_brute(rows):
    def letter(c):
        return "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ"

    counts = Counter()
    for i, text in rows:
        runs = "".join(c if letter(c) else " " for c in text or "").split(" ")
        for run in filter(None, runs):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def variant_rows(seed, size=160):
    rng = random.Random(seed)
    letters = "abcdeé÷ß"
    words = ["".join(rng.choices(letters[: rng.choice([2, 8])], k=rng.randint(4, 9))) for _ in range(30)]
    words += ["aaaaaa", "aaaaa", "aaaaaaa", "abababab", "bababab", "information", "informatoin"]
    rows = []
    for i in range(size):
        own = []
        for w in rng.choices(words, k=25):
            if rng.random() < 0.35:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            own.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "-1"]).join(own)))
    return rows


@pytest.mark.parametrize("part_size", [20_000, 7])
def test_variants_are_those_of_all_pairs(spark, part_size):
    rows = variant_rows(part_size)
    got = spelling.spelling_variants(docs_of(spark, rows), part_size).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == variants_brute(rows)


def test_variants_of_awkward_rows_and_no_rows(spark):
    rows = [*awkward_rows(), *[(None, "straßen Straßen straßem " * 4)] * 3, (11, "strassen " * 5)]
    got = spelling.spelling_variants(with_clashing_columns(spark, rows, ["word", "n", "key", "part", "form"]))
    assert set(map(tuple, got.collect())) == variants_brute(rows)
    assert spelling.spelling_variants(docs_of(spark, [])).count() == 0


def test_suffix_order_and_stretches(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 300):
        text = rng.integers(0, 3, n)
        assert spelling.suffix_order(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
    monkeypatch.setattr(spelling, "STRETCH", 7)
    text = "ab cdefghijkl mno p qrstuvwx éé, yz"
    parts = list(spelling._stretches(text))
    assert "".join(parts) == text
    assert [w for p in parts for w in spelling.LETTERS.findall(p)] == spelling.LETTERS.findall(text)


# ---- alignment ------------------------------------------------------------------


def aligned_brute(rows):
    """Whole texts through both tokenizers, every pair of overlapping tokens."""
    a_model = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")
    letters = alignment.byte_letters()

    def b_token(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    per_doc, counts = [], Counter()
    for i, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(x)) for x in a]
        b_bytes = [b_token(x) for x in b]
        raw = (" " + text).encode() if text else b""
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            per_doc.append((i, 0, 0, 0, [], ""))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            end = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *end], end, strict=False)))
        links, j0 = [], 0
        for (s, e), x in zip(spans[0], a, strict=True):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                links.append((b[j], x))
                j += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [["", ""] for _ in ends]
        for side, (ids, own) in enumerate(((a, spans[0]), (b, spans[1]))):
            at = np.searchsorted(ends, [e for _, e in own]).tolist()
            for g, x in zip(at, ids, strict=True):
                groups[g][side] += f",{x}" if groups[g][side] else str(x)
        sha = hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest()
        per_doc.append((i, len(a), len(b), len(groups), links, sha))
        counts.update(links)
    top = {}
    for (b_id, _), n in counts.items():
        top[b_id] = max(n, top.get(b_id, 0))
    return Counter(
        (i, n_a, n_b, n_g, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), sha)
        for i, n_a, n_b, n_g, links, sha in per_doc
    )


@pytest.mark.parametrize("run", [2_000_000, 40])
def test_alignment_is_that_of_whole_texts(spark, run):
    rng = random.Random(run)
    pieces = ["the ", "The", " naïve", "Straße", "\n", "  ", "\t", "123", "don't", "日本語", "🙂", "á̂", "<s>", "<0x41>", " ", " ", "\x1c", "▁", "\r\n", "--", "x" * 40, "​", "'ll ", " ."]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(1, 30)))) for i in range(150)]
    got = alignment.aligned(docs_of(spark, rows), run=run).collect()
    assert Counter(map(tuple, got)) == aligned_brute(rows)


def test_alignment_of_awkward_rows_and_no_rows(spark):
    rows = awkward_rows()
    got = alignment.aligned(with_clashing_columns(spark, rows, ["run", "radix", "pair", "n_a", "place"]))
    assert Counter(map(tuple, got.collect())) == aligned_brute(rows)
    assert alignment.aligned(docs_of(spark, [])).count() == 0


def test_texts_in_parts_have_the_tokens_of_whole_texts(monkeypatch):
    both = alignment.Tokenizers(*[open(f"{alignment.FOLDER}/{f}", "rb").read() for f in (alignment.A_FILE, alignment.B_FILE)])
    rng = random.Random(2)
    pieces = ["the", " ", "  ", "\n", " \n ", "\u3000", "x, y", "'s", " été", "日本 語", "<0x0A>", "\x1c "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(300)]
    whole = [both.ids(t) for t in texts]
    monkeypatch.setattr(alignment, "PART", 3)
    assert [both.ids(t) for t in texts] == whole
    assert any(len(list(alignment.parts_of(" " + t))) > 3 for t in texts)
