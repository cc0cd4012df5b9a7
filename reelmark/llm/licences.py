"""License scans: TF-IDF cosine of headers and files to templates, then inheritance down the directories.

Vectors are sparse: one place for each term of the templates and one for all other words, which have the
weight of a word never seen elsewhere. Inverse document frequencies come from all lines of the corpus. A
file's own license is the template closest to any of its lines, or to any stretch of as many terms as the template
has, wherever lines break (a header); a file that as a whole is close to a template is a licence file and covers its
directory. Where a sentence ends inside a template, a stretch may hold a few words more, as the holder's name in
"Copyright 2024 Example Inc. All rights reserved." Files without an own license take that of the nearest
ancestor directory with one, found by joins of directory paths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.tables import settle
from .arrays import Block, blocks, mixed, prefix_hashes

# Names, header wordings, titles and identifier lines of common licenses. Versions that differ by a
# number only are told apart as each has a template of its own, and the closest one counts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
HEADER, FILE = 0.75, 0.5
# Words (year, name of the holder) that may stand where a sentence ends inside a template.
HOLDER = 12

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True
_LETTER[ord("-")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the terms of a block: runs of letters, digits and hyphens, A-Z lower-cased.

    Lines are numbered through the block; a new document starts a new line.
    """
    data = block.data
    part = _LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[block.offsets] = True
    starts, ends = part.copy(), part.copy()
    starts[1:] &= ~part[:-1] | cut[1:-1]
    ends[:-1] &= ~part[1:] | cut[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    line_of = np.cumsum((data == 10) | cut[:-1])
    return line_of[start], mixed(prefix_hashes(_LOWER[data], start, end))


class Space:
    """Vocabulary and template vectors; ``df`` are the lines that hold each term, of ``n`` lines."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        found = [terms(b)[1] for _, text in templates for b in blocks(pa.array([text]))]
        self.vocabulary = np.unique(np.concatenate(found))
        # Numbers of terms of each template before and after the end of a sentence inside it; else all, and none.
        self.parts = []
        for (_, text), h in zip(templates, found, strict=True):
            first, _, rest = text.partition(". ")
            before = sum(len(terms(b)[1]) for b in blocks(pa.array([first]))) if rest else len(h)
            self.parts.append((before, len(h) - before))
        self.counts = np.stack([np.bincount(self.place(h), minlength=len(self.vocabulary)) for h in found]).astype(float)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes in the vocabulary, or its size for other words."""
        at = np.searchsorted(self.vocabulary, h)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == h
        return np.where(known, at, len(self.vocabulary))

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.idf = np.log((n + 1) / (df + 1)) + 1
        self.other = math.log(n + 1) + 1
        t = self.counts * self.idf
        self.unit = t / np.linalg.norm(t, axis=1, keepdims=True)

    def cosines(self, group: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """(n, templates) cosines of groups of terms."""
        v = len(self.vocabulary)
        tf = np.bincount(group * (v + 1) + place, minlength=n * (v + 1)).reshape(n, v + 1).astype(float)
        tf[:, :v] *= self.idf
        tf[:, v] = np.sqrt(tf[:, v]) * self.other
        norm = np.linalg.norm(tf, axis=1)
        return tf[:, :v] @ self.unit.T / np.maximum(norm, 1e-300)[:, None]

    def stretches(self, doc: np.ndarray, place: np.ndarray, n: int, least: float) -> np.ndarray:
        """(n, templates) highest cosines, from ``least`` on, of stretches of a document's terms with each template.

        A stretch has as many terms as the template, its second part up to ``HOLDER`` terms after the first. Repeats
        of a term only make a stretch longer, so running sums bound its cosine; what passes is scored exactly.
        """
        v, m = len(self.vocabulary), len(place)
        out = np.zeros((n, len(self.names)))
        size = np.r_[self.idf, self.other] ** 2
        known = np.r_[0, np.cumsum(place < v)]
        sums = np.r_[0.0, np.cumsum(size[place])]
        for t, (a, b) in enumerate(self.parts):
            dots = np.r_[0.0, np.cumsum(np.r_[self.unit[t] * self.idf, 0.0][place])]
            for gap in range(HOLDER + 1 if b else 1):
                if m < a + gap + b:
                    break
                at = np.arange(m - a - gap - b + 1)
                # A stretch of other words alone has nothing of a template.
                at = at[known[at + a] > known[at]]
                at = at[doc[at] == doc[at + a + gap + b - 1]]
                second = at + a + gap
                dot = dots[at + a] - dots[at] + dots[second + b] - dots[second]
                norm = sums[at + a] - sums[at] + sums[second + b] - sums[second]
                at = at[dot >= (least - 1e-6) * np.sqrt(norm)]
                own = np.r_[np.arange(a), np.arange(a + gap, a + gap + b)]
                for k in range(0, len(at), 1 << 13):
                    some = at[k : k + (1 << 13)]
                    cosines = self.cosines(np.repeat(np.arange(len(some)), a + b), place[some[:, None] + own].ravel(), len(some))
                    np.maximum.at(out[:, t], doc[some], cosines[:, t])
        return out


def line_frequencies(files: DataFrame, space: Space) -> tuple[np.ndarray, int]:
    """Lines that hold each term of the vocabulary, and all lines. The driver reads one row for each term."""
    v = len(space.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(v + 1, np.int64), 0
        for batch in batches:
            for b in blocks(batch.column("text")):
                line, h = terms(b)
                place = space.place(h)
                held = np.unique(line[place < v].astype(np.int64) * v + place[place < v])
                df[:v] += np.bincount(held % v, minlength=v)
                n += int((b.data == 10).sum()) + b.n
        df[v] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(v + 1)), pa.array(df)], names=["term", "df"])

    counts = files.select("text").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(v + 1)
    for r in counts:
        df[r.term] = r.df
    return df[:v], int(df[v])


def own_licences(files: DataFrame, space: Space | None = None) -> DataFrame:
    """``path, header, header_score, file, file_score``: the closest templates of any line or stretch and of the whole text."""
    space = space or Space()
    space.weigh(*line_frequencies(files, space))
    names = np.array([*space.names, None], dtype=object)

    def best(scores: np.ndarray, least: float) -> tuple[pa.Array, pa.Array]:
        at = scores.argmax(1)
        top = scores[np.arange(len(scores)), at]
        return pa.array(names[np.where(top >= least, at, len(space.names))], pa.string()), pa.array(np.where(top >= least, top, 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text"), 1 << 19):
                line, h = terms(b)
                place = space.place(h)
                doc = np.searchsorted(b.offsets, np.arange(len(b.data)), "right") - 1
                first = np.flatnonzero((b.data == 10) | np.isin(np.arange(len(b.data)), b.offsets))
                # Only lines with a term of the templates can be near one; others are not scored.
                lines, group = np.unique(line, return_inverse=True)
                near = np.zeros(len(lines), bool)
                near[group[place < len(space.vocabulary)]] = True
                renumbered = np.cumsum(near) - 1
                use = near[group]
                by_line = space.cosines(renumbered[group[use]], place[use], int(near.sum()))
                line_doc = doc[first[lines[near] - 1]] if len(first) else np.zeros(0, int)
                header = np.zeros((b.n, len(space.names)))
                np.maximum.at(header, line_doc, by_line)
                term_doc = line_documents(line, first, doc)
                header = np.maximum(header, space.stretches(term_doc, place, b.n, HEADER))
                whole = space.cosines(term_doc, place, b.n)
                cols = [batch.column("path").slice(b.first, b.n), *best(header, HEADER), *best(whole, FILE)]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "header", "header_score", "file", "file_score"])

    kind = "path string, header string, header_score double, file string, file_score double"
    return files.select("path", "text").mapInArrow(run, kind)


def line_documents(line: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The document of each term from its line."""
    return doc[first[line - 1]] if len(line) else line


def directory(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, space: Space | None = None) -> DataFrame:
    """``path, license, how, score, directory`` for each row of ``files`` (``path, text``).

    ``how`` is ``file``, ``header``, ``inherited`` or ``none``. A directory with several licence files takes the
    highest score (to nine places), then the last name. Null and empty texts have no license of their own and inherit;
    a null path is a file of the root directory. Repeated rows get equal results; an empty table gives none.
    Directories, not files, are joined with their ancestors, so a large directory counts once there.
    """
    files = files.select(F.coalesce("path", F.lit("")).alias("path"), "text")
    own = settle(own_licences(files, space).withColumn("directory", directory(F.col("path"))))
    covers = own.filter("file is not null").groupBy("directory").agg(
        F.max_by("file", F.struct(F.round("file_score", 9), "file")).alias("license")
    )
    covers = covers.select(F.col("directory").alias("ancestor"), F.col("license").alias("dir_license"))
    places = own.select("directory").distinct()
    parts = F.split("directory", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("ancestor")))
    ancestors = places.select("directory", F.explode(F.array_distinct(up)).alias("a")).select("directory", "a.depth", "a.ancestor")
    nearest = ancestors.join(covers, "ancestor").groupBy("directory").agg(
        F.max_by(F.struct("dir_license", "ancestor"), "depth").alias("n")
    )
    nearest = nearest.select(F.col("directory").alias("n_directory"), "n.dir_license", "n.ancestor")
    out = own.join(nearest, F.col("directory") == F.col("n_directory"), "left")
    how = (
        F.when(F.col("file").isNotNull(), "file").when(F.col("header").isNotNull(), "header")
        .when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    )
    return out.select(
        "path", F.coalesce("file", "header", "dir_license").alias("license"), how.alias("how"),
        F.greatest("header_score", "file_score").alias("score"), F.when(how == "inherited", F.col("ancestor")).alias("directory"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """``path, text``: the table has no paths, so each document is a file under its source, by ranges of ids."""
    place = [F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 5000), F.floor(F.col("doc_id") / 50), F.col("doc_id")]
    return docs.select("doc_id", F.concat_ws("/", *[c.cast("string") for c in place]).alias("path"), "text")


def op5(spark, sf_dir: str) -> DataFrame:
    files = document_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = scan(files)
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).cast("long").alias("doc_id"), "path", "license", "how", F.round("score", 6).alias("score"), "directory")
