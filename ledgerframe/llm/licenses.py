"""Licence scan: TF-IDF cosine of whole files and headers to templates, then directory inheritance.

A text that holds a cue or lies in a file named as a licence file is compared as a whole with the
full texts in ``license_texts`` (frequencies damped by a logarithm); the nearest decides, if its
cosine reaches ``LEAST_WHOLE``. Failing that, the words that follow a cue line are compared with each
short full text over its own length, for licences written out above code.

Otherwise every line of a text that holds a cue word is a header; headers on neighbouring lines are also
taken together, and a line that matches nothing is taken sentence by sentence. A header's words, with
versions and identifiers brought to one spelling, become a sparse TF-IDF vector (frequencies of the
templates' words over all texts; words of no template weigh as ones that occur nowhere) and get the
template of the largest cosine, if it reaches ``LEAST_COSINE`` and the header holds all of the template's
identifying words (names and versions). "All rights reserved" counts only if no licence is found.

A file is a licence file if its name says so or if its licence statements make up ``FILE_SHARE`` of
its words (all of them, if the whole text was matched); it speaks for its directory. Where paths end
in no names that people chose, as those of rows in a table, a short text with a licence line is no
licence file: without ``statements`` only a name or a matched full text makes one. A file without
licence of its own takes that of the nearest directory above it that has one, by joins of ancestor paths.

Defined results: the best header of a text decides, ties going to the earlier template and the
earlier line. GPL, LGPL and AGPL without a version are named without one; "only" and "or later" are
not told apart. A null or empty text has no licence of its own, a null path lies in the root
directory "". Of several licence files in one directory the best cosine, then the smallest path
decides. One row per row; rows that repeat a path are judged one by one. Columns other than the
path and the text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, slices, text_or_empty

LEAST_COSINE = 0.7
LEAST_WHOLE = 0.85
FILE_SHARE = 0.8
#: Full texts of up to so many words are also sought above code.
SHORT = 400

#: Statements by which the licences are named in files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
)
#: Names by which headers call a licence; each is a template by itself and in the forms below.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache License"),
    "Apache-1.1": ("Apache Software License, Version 1.1", "Apache-1.1"),
    "Apache-1.0": ("Apache Software License, Version 1.0", "Apache-1.0"),
    **{
        f"{p}GPL-{v}": (f"GNU {n}General Public License, version {v}", f"GNU {n}General Public License v{v} or later", f"GNU {p}GPL version {v}", f"{p}GPL version {v} License", f"{p}GPL-{v}")
        for p, n, versions in (("", "", ("3.0", "2.0", "1.0")), ("L", "Lesser ", ("3.0", "2.1")), ("L", "Library ", ("2.0",)), ("A", "Affero ", ("3.0",)))
        for v in versions
    },
    **{p: (f"GNU {n}General Public License", f"GNU {p}", f"{p} License", p) for p, n in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero "))},
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD License", "BSD-style license"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "MPL-2.0"),
    "MPL-1.1": ("Mozilla Public License, v. 1.1", "MPL-1.1"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "EPL-2.0"),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "EPL-1.0"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "Zlib"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "BSL-1.0"),
    "Unlicense": ("Unlicense",),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic-2.0"),
    "Artistic-1.0": ("Artistic License 1.0", "Artistic License", "Artistic-1.0"),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3", "GFDL-1.3"),
    "GFDL-1.2": ("GNU Free Documentation License, Version 1.2", "GFDL-1.2"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0-1.0", "CC0 License", "CC0", "Creative Commons Zero v1.0 Universal"),
    **{
        f"CC-BY{p}-{v}": (f"CC BY{p} {v}", f"Creative Commons {n} {v} International License", f"Creative Commons {n} {v} License", f"Creative Commons {n} {v}", f"CC-BY{p}-{v}")
        for v in ("4.0", "3.0")
        for p, n in (
            ("", "Attribution"), ("-SA", "Attribution-ShareAlike"), ("-ND", "Attribution-NoDerivatives"), ("-NC", "Attribution-NonCommercial"),
            ("-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}
FORMS = ("{}", "Licensed under the {}", "Released under the {}", "Distributed under the terms of the {}", "This work is licensed under the {}", "This program is licensed under the {}.", "Licensed under {}", "License: {}", "SPDX-License-Identifier: {}")
#: The headers that the licences themselves recommend.
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *(
        (f"{p}GPL-{v}.0".replace(".1.0", ".1"), f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {n}General Public License as published by the Free Software Foundation; {how}.")
        for p, n, versions in (("", "", ("3", "2", "1")), ("L", "Lesser ", ("3", "2.1")), ("L", "Library ", ("2",)), ("A", "Affero ", ("3",)))
        for v in versions
        for how in (f"either version {v} of the License, or (at your option) any later version", f"version {v} of the License")
    ),
)
_CUES = (
    "licens", "licenc", "copyright", "permission", "redistribut", "all rights reserved", "public domain", "spdx", "creative commons",
    "gnu", "gpl", "apache", "mozilla", "bsd", "cc0", "cc by", "cc-by", "eclipse public", "free software",
)
_SENTENCE = re.compile(r"(?<=[.!?;])[ \t]+")
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
_NAMED = re.compile(_FILE)
#: One spelling of versions and identifiers: "GPLv3+", "GPL-3.0-or-later" and "GPL version 3" are gpl 3.
_SPELL = tuple(
    (re.compile(p), to)
    for p, to in (
        (r"licence", "license"),
        (r"\b([al]?gpl|[me]pl|bsl|gfdl|apache|bsd|artistic|cc0|by|sa|nc|nd)-(?=v?\d)", r"\1 "),
        (r"\bcc-(?=by)", "cc "),
        (r"(?<=gpl)(?=v?\d)", " "),
        (r"\bv(?:ersion)?s?\.?\s*(?=\d)", ""),
        (r"(?<![\d.])(\d+)\.0(?![.]?\d)", r"\1"),
        (r"(?<=\d)(?:\+|-or-later\b|-only\b)", ""),
    )
)


def words(text: str) -> list[str]:
    text = text.lower()
    for pattern, to in _SPELL:
        text = pattern.sub(to, text)
    return _WORD.findall(text)


def cued(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in _CUES)


_GENERIC = set(words("the license licensed gnu public international universal software free documentation or later creative commons new modified simplified zero style of code"))
IDENTIFYING = {w for names in NAMES.values() for n in names for w in words(n)} - _GENERIC - {"library", "cc"}
TEMPLATES = tuple(dict.fromkeys([*TEMPLATES, *HEADERS, *((k, f.format(n)) for k, names in NAMES.items() for n in names for f in FORMS if len(words(f.format(n))) > 1)]))


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Licence and whole text of every file beside this module; read on the driver only."""
    return tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


class Matcher:
    """Sparse TF-IDF vectors of the templates and full texts, and the nearest of them to a piece of text."""

    def __init__(self, idf: dict[str, float], unseen: float, full: tuple[tuple[str, str], ...]):
        self.idf, self.unseen = idf, unseen
        self.holding: dict[str, list[tuple[int, float]]] = {}  # word -> (template, weight)
        self.needs: list[frozenset[str]] = []
        for k, (_, text) in enumerate(TEMPLATES):
            vector, norm = self._vector(Counter(words(text)))
            self.needs.append(frozenset(vector) & IDENTIFYING)
            for w, x in vector.items():
                self.holding.setdefault(w, []).append((k, x / norm))
        self.full = []  # licence, words, vector of length 1
        for name, text in full:
            found = words(text)
            vector, norm = self._vector(Counter(found), damped=True)
            self.full.append((name, len(found), {w: x / norm for w, x in vector.items()}))
        self.short = [f for f in self.full if f[1] <= SHORT]

    def _vector(self, counts: Counter, damped: bool = False) -> tuple[dict[str, float], float]:
        v = {w: (1 + log(n) if damped else n) * self.idf.get(w, self.unseen) for w, n in counts.items()}
        return v, sum(x * x for x in v.values()) ** 0.5 or 1.0

    def nearest(self, text: str) -> tuple[int, float]:
        """The template of the largest cosine among those whose identifying words the text holds; -1 if none."""
        vector, norm = self._vector(Counter(words(text)))
        cosine: dict[int, float] = {}
        for w, x in vector.items():
            for k, y in self.holding.get(w, ()):
                cosine[k] = cosine.get(k, 0.0) + x * y / norm
        best, most = -1, 0.0
        for k, c in sorted(cosine.items(), key=lambda kc: (-round(kc[1], 12), kc[0])):
            if self.needs[k] <= vector.keys():
                best, most = k, min(1.0, c)
                break
        return best, most

    def _full(self, found: list[str], full: list) -> tuple[str, float]:
        vector, norm = self._vector(Counter(found), damped=True)
        best = ("", 0.0)
        for name, _, other in full:
            cosine = sum(x * other[w] for w, x in vector.items() if w in other) / norm
            if cosine > best[1] + 1e-12:
                best = (name, min(1.0, cosine))
        return best

    def _above_code(self, text: str) -> tuple[str, float, int] | None:
        """The nearest short full text among the words that follow a cue line."""
        best, rest = None, None
        lines = text.split("\n")
        for k, line in enumerate(lines):
            # only where a full text may start: its first words
            if not any(c in line.lower() for c in ("permission", "redistribution and use", "provided 'as-is'", "unencumbered")):
                continue
            rest = words("\n".join(lines[k : k + SHORT]))
            for full in self.short:
                name, cosine = self._full(rest[: full[1]], [full])
                if cosine >= LEAST_WHOLE and (best is None or cosine > best[1] + 1e-12):
                    best = (name, cosine, full[1])
        return best

    def scan(self, text: str, named: bool = False) -> tuple[str | None, float, int, bool]:
        """Licence, cosine, how many words all licence statements of the text hold, and whether a full text was matched."""
        found: tuple[str | None, float] = (None, 0.0)
        covered = 0
        if not named and not cued(text):
            return None, 0.0, 0, False
        name, cosine = self._full(words(text), self.full)
        if cosine >= LEAST_WHOLE:
            return name, cosine, len(text.split()), True
        block = self._above_code(text)
        if block:
            return *block, True
        groups: list[list[str]] = []  # neighbouring cue lines may be one statement that was wrapped
        last = None
        for k, line in enumerate(text.split("\n")):
            if cued(line):
                if last is not None and k == last + 1:
                    groups[-1].append(line)
                else:
                    groups.append([line])
                last = k
        for group in groups:
            whole = " ".join(group)
            lines = group if len(group) == 1 or not self._take(whole) else [whole]
            for line in lines:
                # the line as it is, else those of its sentences that hold a cue
                pieces = [line] if self._take(line) else [x for x in _SENTENCE.split(line) if cued(x)]
                for piece in pieces:
                    taken = self._take(piece)
                    if taken:
                        covered += len(piece.split())
                        weaker = found[0] in (None, "proprietary")
                        if (weaker and taken[0] != "proprietary") or ((taken[0] != "proprietary" or weaker) and taken[1] > found[1] + 1e-12):
                            found = taken
        return *found, covered, False

    def _take(self, text: str) -> tuple[str, float] | None:
        k, cosine = self.nearest(text)
        return (TEMPLATES[k][0], cosine) if k >= 0 and cosine >= LEAST_COSINE else None


def idf(files: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' and full texts' words over all texts, and that of unseen words."""
    vocabulary = sorted({w for _, t in (*TEMPLATES, *full_texts()) for w in words(t)})
    table = np.full(256, 32, np.uint8)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        table[c] = c
    plain = sorted({p for w in vocabulary for p in re.split("[.-]", w)})
    known = np.sort(Words(pa.array([" ".join(plain)])).hashes())
    by_hash = dict(zip(Words(pa.array([" ".join(plain)])).hashes().tolist(), plain))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(known), np.int64), 0
        for part in slices(batches):
            w = Words(part.column(0), table)
            h = w.hashes()
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            held = np.unique(w.owner()[hit] * len(known) + at[hit])
            total += np.bincount(held % len(known), minlength=len(known))
            n += part.num_rows
        yield pa.RecordBatch.from_pydict({"word": [*(by_hash[h] for h in known.tolist()), ""], "df": [*total.tolist(), n]})

    rows = files.select(F.lower(text_or_empty()).alias("text")).mapInArrow(count, "word string, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {r["word"]: r["df"] for r in rows}
    n = df.get("", 0)
    weight = {w: float(np.log((1 + n) / (1 + c)) + 1) for w, c in df.items() if w}
    # a compound such as "by-nc" weighs as the rarest of its parts
    return {w: max(weight.get(p, 1.0) for p in re.split("[.-]", w)) for w in vocabulary}, float(np.log(1 + n) + 1)


def own_licences(files: DataFrame) -> DataFrame:
    """The rows of ``files`` (key, path, text): key, path, license, score, share (of words in licence statements), whole (a full text was matched)."""
    shared = files.sparkSession.sparkContext.broadcast((*idf(files), full_texts()))
    key_type = files.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(*shared.value)
        for batch in batches:
            found = [(*m.scan(t, bool(_NAMED.search(p))), t) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            share = [c / max(1, len(t.split())) if c else 0.0 for _, _, c, _, t in found]
            whole = pa.array([f[3] for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(share, pa.float64()), whole],
                ["key", "path", "license", "score", "share", "whole"],
            )

    chosen = files.select("key", F.coalesce("path", F.lit("")).alias("path"), text_or_empty().alias("text"))
    return chosen.mapInArrow(run, f"key {key_type}, path string, license string, score double, share double, whole boolean")


def directory(path: str | Column) -> Column:
    """The directory of a path, "" for the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scanned(files: DataFrame, statements: bool = True) -> DataFrame:
    """key, path, license, score, how (header, file, inherited or none), from_dir for every row of ``files``.

    ``statements``: whether a text that is mostly licence statements is a licence file.
    """
    own = cut(own_licences(files).withColumn("dir", directory(F.col("path"))), "licence-own")
    mostly = (F.col("share") >= FILE_SHARE) & (F.lit(statements) | F.col("whole"))
    is_file = F.col("license").isNotNull() & (F.col("path").rlike(_FILE) | mostly)
    own = own.withColumn("is_file", is_file)
    best = F.min(F.struct((-F.col("score")).alias("s"), "path", "license"))
    speaking = cut(own.filter("is_file").groupBy("dir").agg(best.alias("b")).select("dir", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "licence-dirs")

    # Ancestors of the distinct directories only, so that a crowded directory is one row here.
    dirs = own.filter("license is null").select("dir").distinct()
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).withColumn("above", F.concat_ws("/", F.slice(F.split("dir", "/"), F.lit(1), F.col("depth"))))
    up = above.join(speaking.select(F.col("dir").alias("above"), "license", "score"), "above")
    nearest = up.groupBy("dir").agg(F.max(F.struct("depth", "above", "license", "score")).alias("n"))
    nearest = cut(nearest.select("dir", F.col("n.above").alias("from_dir"), F.col("n.license").alias("up_license"), F.col("n.score").alias("up_score")), "licence-nearest")
    joined = own.join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    return joined.select(
        "key",
        "path",
        F.coalesce("license", "up_license").alias("license"),
        F.when(has, F.col("score")).otherwise(F.coalesce("up_score", F.lit(0.0))).alias("score"),
        F.when(F.col("is_file"), "file").when(has, "header").when(F.col("up_license").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )
