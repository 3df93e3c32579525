"""Licence scans: TF-IDF cosine of licence statements to templates, then inheritance along directories.

1. Document frequencies of the templates' terms are counted over all texts; they weigh the terms.
2. Of a text that names a licence, every line that does so, every window of a template's number of terms (across
   line feeds and inside long lines) and the whole text are compared with the templates by the cosine of sparse
   TF-IDF vectors, the whole text with each licence's templates together too; terms outside the templates count in
   the length. The best template at or above ``limit`` is the file's own licence.
3. A file is a licence file of its directory if its name says so or if its licence paragraphs and windows hold at
   least half of its words. Files without a licence of their own take that of the nearest ancestor directory with a
   licence file, their own directory first: distinct directories are joined with their ancestors' licences,
   and files with their directories.

Defined results: null and empty texts have no own licence and may inherit one; a null path is in no directory
and inherits nothing; of equal templates the alphabetically first wins, of several licence files of a
directory the best score, then the first licence name; repeated rows are scanned each; other columns pass
through, and an output column takes the place of an input column of its name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extend, fresh, pieces, prepare, written

LIMIT = 0.6
# Short notices and opening sentences of common public licences, by SPDX name.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_WORD = re.compile(r"\S+")
_CUE = re.compile(r"licen[cs]|copyright|copyleft|spdx|permission is hereby|redistribution|creative commons", re.IGNORECASE)
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def document_frequencies(df: DataFrame, vocabulary: set[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """``(texts, {term: texts that hold it})`` of a bounded vocabulary, over all rows."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for b in pieces(batches, "t"):
            for t in b.column("t").to_pylist():
                found.update(vocabulary.intersection(terms(t or "")))
                n += 1
        found[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()))], ["term", "n"])

    got = df.select(F.col(text).alias("t")).mapInArrow(make, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in got}
    return counts.pop("", 0), counts


class Matcher:
    """Templates as unit TF-IDF vectors."""

    def __init__(self, templates: dict[str, list[str]], n: int, df: dict[str, int]):
        rows = [(name, Counter(terms(t))) for name in sorted(templates) for t in templates[name]]
        self.sizes = np.array([sum(c.values()) for _, c in rows])
        rows += [(name, Counter(terms("\n".join(templates[name])))) for name in sorted(templates) if len(templates[name]) > 1]
        self.names = [name for name, _ in rows]
        self.place = {t: i for i, t in enumerate(sorted({t for _, c in rows for t in c}))}
        self.idf = np.array([np.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in self.place])
        self.rare = float(np.log(n + 1) + 1)          # a term that no template holds
        self.rows = np.zeros((len(rows), len(self.place)))
        for i, (_, c) in enumerate(rows):
            for t, k in c.items():
                self.rows[i, self.place[t]] = k * self.idf[self.place[t]]
        self.rows /= np.linalg.norm(self.rows, axis=1, keepdims=True)

    def best(self, paragraph: str, whole: bool = False) -> tuple[float, str]:
        """``(cosine, licence)`` of the nearest template (``whole``: or of a licence's templates together)."""
        at, weight, square = [], [], 0.0
        for t, k in Counter(terms(paragraph)).items():
            if (i := self.place.get(t)) is None:
                square += (k * self.rare) ** 2
            else:
                at.append(i)
                weight.append(k * self.idf[i])
                square += weight[-1] ** 2
        if not at:
            return 0.0, ""
        cos = self.rows[: None if whole else len(self.sizes), at] @ np.array(weight) / np.sqrt(square)
        i = int(cos.argmax())
        return float(cos[i]), self.names[i]

    def windows(self, found: list[str]) -> tuple[float, str, np.ndarray]:
        """``(cosine, licence, terms in windows at or above LIMIT)`` of the best window of a template's length. Of windows
        that overlap, only the better one's terms are marked."""
        own = {t: len(self.place) + i for i, t in enumerate(dict.fromkeys(t for t in found if t not in self.place))}
        ids = np.array([self.place.get(t, own.get(t, 0)) for t in found], np.int64)
        known = ids < len(self.place)
        at = np.where(known, ids, 0)
        weight = np.where(known, self.idf[at], self.rare)
        square = np.append(0, np.cumsum(weight ** 2))
        best, inside, good = (0.0, ""), np.zeros(len(ids), bool), []
        for r, m in enumerate(self.sizes.tolist()):
            if m > len(ids):
                continue
            dot = np.append(0, np.cumsum(np.where(known, self.rows[r, at] * weight, 0)))
            dot = dot[m:] - dot[:-m]
            # a repeated term only makes a window longer, so this bounds its cosine from above
            starts = np.flatnonzero(dot >= (LIMIT - 1e-6) * np.sqrt(square[m:] - square[:-m]))
            for part in np.array_split(starts, len(starts) // 1024 + 1):
                if not len(part):
                    continue
                i = part[:, None] + np.arange(m)
                same = ids[i][:, :, None] == ids[i][:, None, :]
                cos = dot[part] / np.sqrt((same * (weight[i] ** 2)[:, None, :]).sum(axis=(1, 2)))
                good += [(-round(c, 9), s, m) for c, s in zip(cos.tolist(), part.tolist()) if c >= LIMIT]
                top = int(cos.argmax())
                if cos[top] >= LIMIT and (-round(cos[top], 9), self.names[r]) < (-round(best[0], 9), best[1]):
                    best = float(cos[top]), self.names[r]
        for _, s, m in sorted(good):
            if not inside[s: s + m].any():
                inside[s: s + m] = True
        return *best, inside

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """``(licence, cosine, share of words in licence paragraphs and windows)`` of a text's best part."""
        if not _CUE.search(text):
            return None, 0.0, 0.0
        low = text.lower()
        starts = np.array([m.start() for m in _WORD.finditer(low)], np.int64)
        best, words, named = (0.0, ""), 0, np.zeros(len(starts), bool)
        for line in text.split("\n"):
            n = len(line.split())
            if _CUE.search(line):
                got = self.best(line)
                named[words: words + n] |= got[0] >= LIMIT
                if got[0] > best[0]:
                    best = got
            words += n
        got = self.best(text, whole=True)
        if got[0] > best[0]:
            best = got
        if got[0] >= LIMIT:
            named[:] = True
        found = [(m.start(), m[0]) for m in _TERM.finditer(low)]
        *got, inside = self.windows([t for _, t in found])
        if got[0] > best[0] + 1e-9:
            best = tuple(got)
        if inside.any():
            named[np.searchsorted(starts, np.array([s for s, _ in found])[inside], side="right") - 1] = True
        return (best[1], best[0], float(named.sum()) / max(words, 1)) if best[0] >= LIMIT else (None, best[0], 0.0)


def scan(df: DataFrame, text: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``df`` with ``own_licence`` (null: none), ``licence_score`` and ``licence_share``."""
    prepare(df.sparkSession)
    vocabulary = {t for texts in templates.values() for x in texts for t in terms(x)}
    shared = df.sparkSession.sparkContext.broadcast(Matcher(templates, *document_frequencies(df, vocabulary, text)))

    def compute(b: pa.RecordBatch) -> list:
        got = [shared.value.scan(t or "") for t in b.column(text).to_pylist()]
        return [pa.array([x[0] for x in got], pa.string()), *[pa.array([x[i] for x in got], pa.float64()) for i in (1, 2)]]

    return extend(df, "licenses", text, [T.StructField("own_licence", T.StringType()), T.StructField("licence_score", T.DoubleType()),
                             T.StructField("licence_share", T.DoubleType())], compute)


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """Scanned ``files`` with ``licence`` and ``licence_from``: the path prefix it comes from (the file's own path or
    a directory; null: no licence)."""
    folder, above, name = fresh("folder"), fresh("above"), fresh("name")
    inside = F.regexp_extract(F.col(path), r"^(.*?)/?[^/]*$", 1)          # "" is the root
    files = written(files.withColumn(folder, inside), "licence-files")
    licence_file = F.col(path).rlike(LICENCE_FILE) | (F.col("licence_share") >= 0.5)
    given = (files.where(F.col("own_licence").isNotNull() & F.col(path).isNotNull() & licence_file).groupBy(F.col(folder).alias("given"))
             .agg(F.min(F.struct(-F.col("licence_score"), F.col("own_licence").alias("name"))).alias("x")).select("given", F.col("x.name").alias("name")))
    # each folder with all its ancestors, itself included
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    folders = files.where(F.col(path).isNotNull()).select(F.col(folder).alias("folder")).distinct()
    nearest = (folders.select("folder", F.explode(up).alias("u")).select("folder", "u.depth", "u.above").join(given, F.col("above") == F.col("given"))
               .groupBy("folder").agg(F.max(F.struct("depth", "above", "name")).alias("x"))
               .select(F.col("folder").alias(folder), F.col("x.above").alias(above), F.col("x.name").alias(name)))
    out = files.join(nearest, folder, "left")
    own = F.col("own_licence").isNotNull()
    return (out.withColumn("licence", F.coalesce("own_licence", name)).withColumn("licence_from", F.when(own, F.col(path)).otherwise(F.col(above)))
            .drop(folder, above, name))
