"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest licence file above.

Units of a file are runs of up to LINES lines (notices wrap), and the whole text; only units
with a cue word of licences are weighed. Terms are lower-cased runs of letters, digits and dots; a term's weight is
(1 + log tf) * idf, idf being log((N + 1) / (df + 1)) + 1 from the document frequencies of the template terms over all
files; terms of no template count with the idf of an unseen term, so surrounding text lowers the cosine. A file's own
licence is the template of its best unit at COSINE or more; ties go to the longer template, then the smaller name.

A licence file (named LICENSE, LICENCE, COPYING, COPYRIGHT, NOTICE or UNLICENSE, with any ending) gives its licence to
its directory; of several in one directory the best cosine counts, then the smaller path. A file without a licence of
its own takes that of the nearest directory at or above its own that has one. Directories, not files, are joined with
their ancestors, so a directory with a third of all files is one row there.

Defined cases: null text is empty and has no own licence; a null path has no directory and inherits nothing; repeated
rows are files of their own; an empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

COSINE = 0.75
LINES = 5
# Short forms of the notices by which each licence is given.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
CUE = re.compile(r"licen[sc]e|licensed|copyright|spdx|permission|redistribut|public domain|free software|mozilla public|unencumbered", re.I)
#: Licences that are another one and a clause of their own, which decides.
EXTENDS = {"BSD-2-Clause": "BSD-3-Clause"}
NAMES = r"(?i)^(un)?licen[sc]e([.\-_].*)?$|^copying([.\-_].*)?$|^copyright([.\-_].*)?$|^notice([.\-_].*)?$"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


VOCABULARY = frozenset(t for _, text in TEMPLATES for t in terms(text))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many files of a task each template term is, and, without a term, how many files there are."""
    n, found = 0, Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n += 1
            found.update(VOCABULARY.intersection(terms(text or "")))
    yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.string()), pa.array([n, *found.values()], pa.int64())], names=["term", "n"])


class Scanner:
    def __init__(self, files: int, frequency: dict[str, int]) -> None:
        self.idf = {t: math.log((files + 1) / (frequency.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.other = math.log(files + 1) + 1
        self.templates = []
        for name, text in TEMPLATES:
            vector = self.vector(terms(text))
            norm = math.sqrt(sum(x * x for x in vector.values()))
            self.templates.append((name, len(vector), {t: x / norm for t, x in vector.items()}))

    def vector(self, found: list[str]) -> dict[str, float]:
        return {t: (1 + math.log(n)) * self.idf.get(t, self.other) for t, n in Counter(found).items()}

    def best(self, found: list[str]) -> tuple[float, int, str] | None:
        """(cosine, length of template, name) of the nearest template."""
        if not found:
            return None
        vector = self.vector(found)
        norm = math.sqrt(sum(x * x for x in vector.values()))
        scored = [(round(sum(x * vector.get(t, 0.0) for t, x in own.items()) / norm, 9), n, name) for name, n, own in self.templates]
        return min(scored, key=lambda s: (-s[0], -s[1], s[2]))

    def scan(self, text: str) -> tuple[str | None, float]:
        if not CUE.search(text):
            return None, 0.0
        lines = text.split("\n")
        cued = {i for i, line in enumerate(lines) if CUE.search(line)}
        units = {(a, b) for i in cued for a in range(max(0, i - LINES + 1), i + 1) for b in range(i + 1, min(len(lines), a + LINES) + 1)}
        split = {i: terms(lines[i]) for i in {k for a, b in units for k in range(a, b)}}
        best = [self.best([t for k in range(a, b) for t in split[k]]) for a, b in units]
        best = [x for x in [*best, self.best(terms(text))] if x and x[0] >= COSINE]
        if not best:
            return None, 0.0
        score, _, name = min(best, key=lambda s: (-s[0], -s[1], s[2]))
        more = [x for x in best if x[2] == EXTENDS.get(name)]
        if more:
            score, _, name = min(more, key=lambda s: (-s[0], -s[1]))
        return name, score


def _own(batches: Iterator[pa.RecordBatch], files: int, frequency: dict[str, int]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(files, frequency)
    for batch in batches:
        found = [scanner.scan(text or "") for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "path", "own", "score"])


def scanned(files: DataFrame) -> DataFrame:
    """(doc_id, path, license, score, origin, from_path) for each row (doc_id, path, text).

    origin: own, inherited or none; score is the cosine at from_path.
    """
    rows = files.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    counts = rows.select("text").mapInArrow(_frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row a template term
    told = {r["term"]: r["n"] for r in counts}
    n = told.pop(None, 0) or 0
    own = settle(rows.mapInArrow(lambda b: _own(b, n, told), "doc_id long, path string, own string, score double"))
    # "" is the directory of a file at the top
    folder = F.when(F.col("path").isNotNull(), F.regexp_replace("path", r"/?[^/]*$", ""))
    own = own.withColumn("folder", folder)
    name = F.element_at(F.split("path", "/"), -1)
    given = own.where(F.col("own").isNotNull() & name.rlike(NAMES)).groupBy("folder")
    given = given.agg(F.min_by(F.struct("own", "score", "path"), F.struct(-F.col("score"), "path")).alias("g")).select(F.col("folder").alias("above"), "g")
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("above"), k.alias("depth")))
    folders = own.where("own is null and folder is not null").select("folder").distinct().select("folder", F.explode(ups).alias("u")).select("folder", "u.above", "u.depth").distinct()
    nearest = folders.join(given, "above").groupBy("folder").agg(F.max_by("g", "depth").alias("g"))
    out = own.join(nearest, "folder", "left")
    has, gets = F.col("own").isNotNull(), F.col("g").isNotNull()
    pick = lambda mine, theirs: F.when(has, mine).when(gets, theirs)
    return out.select(
        "doc_id", "path", pick(F.col("own"), F.col("g.own")).alias("license"), F.coalesce(pick(F.col("score"), F.col("g.score")), F.lit(0.0)).alias("score"),
        F.when(has, "own").when(gets, "inherited").otherwise("none").alias("origin"), pick(F.col("path"), F.col("g.path")).alias("from_path"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree: source/lang/group/name; every hundredth id is its directory's licence file."""
    name = F.when(F.pmod("doc_id", F.lit(100)) == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    group = F.concat(F.lit("g"), F.pmod(F.floor(F.col("doc_id") / 1000), F.lit(10)))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), group, name).alias("path"), "text")
