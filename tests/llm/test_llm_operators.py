"""Training-data operators against brute force, and on odd input: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkmeter.llm import ann, embdedup, licenses, lm, mixing, packing, pages, quality, simhash, suffixes
from sparkmeter.llm.common import components

RNG = np.random.default_rng(0)
WORDS = ["".join(RNG.choice(list("abcdeé"), RNG.integers(2, 7))) for _ in range(300)]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[int(i)] for i in rng.integers(0, len(WORDS), n))


BASE = prose(120, 1)
PASSAGE = prose(60, 2)
ODD = [
    (1, BASE), (2, BASE), (3, "".join(c.upper() if c.isascii() else c for c in BASE)), (4, BASE + " one more end"), (5, None), (6, ""), (7, "  \t\n "), (8, "one two"), (9, prose(9000, 3)),
    (10, prose(40, 4) + PASSAGE + prose(30, 5)), (11, prose(35, 6) + PASSAGE + prose(20, 7)), (11, prose(35, 6) + PASSAGE + prose(20, 7)), (None, BASE), (None, "lone words here"), (12, "é" * 400), (13, "x" * 99), (14, "x" * 99), (15, prose(80, 8)),
]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, fp long, sequence_id string, half int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if n % 5 == 0 else f"src{n % 3}", len(t or ""), 7, "clash", 1) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (9, 9), *((10, n) for n in range(11, 60)), *((n, n + 1) for n in range(100, 140))]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, **{n: 10 for n in range(11, 60)}, **{n: 100 for n in range(101, 141)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 -----------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_sparks_own_hash(spark):
    text = "Alpha beta gamma"
    want = spark.sql("select hex(xxhash64('alpha beta gamma'))").first()[0].lower()
    assert f"{simhash.fingerprint(text.encode()):016x}" == want == f"{slow_fingerprint(text):016x}"
    for _, t in ODD:
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t)


def test_simhash(docs, none):
    got = [tuple(r)[:3] for r in simhash.near_duplicates(docs).collect()]
    fps = {f for _, f, _ in got}
    assert len(got) == len(ODD) and all(len(f) == 16 and f == f.lower() for f in fps)
    by = {}
    for i, f, c in got:
        by.setdefault(i, []).append((f, c))
    assert by[1][0][1] == by[2][0][1] == by[3][0][1] == 1 and by[5] == [("0" * 16, 5)] and by[6][0][1] == by[7][0][1] == 5
    assert {c for _, c in by[None]} == {None, 1}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and ids.count(11) == 1 and ids.count(5) == 1 and 6 not in ids


@pytest.mark.parametrize("bucket", [2, 8192])
def test_simhash_links_are_those_of_brute_force(spark, bucket):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 25, dtype=np.uint64) * np.uint64(2)
    fps = set()
    for s in seeds.tolist():
        x = s
        for _ in range(30):
            fps.add(x)
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                x ^= 1 << b
    fps = np.array(sorted(fps), dtype=np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components(simhash.links(rows, bucket)).collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    mine = Counter(got.get(int(x), int(x)) for x in fps.view(np.int64))
    assert sorted(mine.values()) == sorted(Counter(find(i) for i in range(len(fps))).values())


@pytest.mark.parametrize("part", [2, 4096])
def test_near_copies_go(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rows, rng = [], np.random.default_rng(8)
    for n in range(60):
        words = prose(200, 20_000 + n // 6).split()
        for at in rng.integers(0, 200, n % 6).tolist():
            words[at] = f"new{n}"
        rows.append((n, " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.node: r.root for r in components(simhash.similar(df)).collect()}
    assert len(set(root)) < 20 and (part == 2 or [got.get(n, n) for n in range(60)] == root)
    assert {r.doc_id for r in simhash.representatives(df).collect()} <= set(root)


@pytest.mark.parametrize("part", [2])
def test_any_two_documents_of_a_key_meet(spark, monkeypatch, part):
    """Whatever the size of the parts, the components are those of all pairs."""
    monkeypatch.setattr(simhash, "PART", part)
    rows, rng = [], np.random.default_rng(8)
    for n in range(60):
        words = prose(200, 20_000 + n // 20).split()
        for at in rng.integers(0, 200, n % 6).tolist():
            words[at] = f"new{n}"
        rows.append((n, " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = {r.node: r.root for r in components(simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [got.get(n, n) for n in range(60)] == root


# 2 -----------------------------------------------------------------------------------------------------------------


def slow_removal(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for a, b in zip(b"\0" + gone, gone, strict=False) if b and not a)
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot, chunk, fan", [(256, 12 << 20, 256), (2, 4000, 256), (2, 4000, 3), (256, 3000, 2)])
def test_suffixes(docs, none, monkeypatch, hot, chunk, fan):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "FAN", fan)  # merges in several levels
    got = sorted((tuple(r) for r in suffixes.deduplicated(docs, chunk).collect()), key=str)
    assert got == slow_removal(ODD)
    assert suffixes.deduplicated(none).count() == 0


def test_suffixes_of_many_variants(spark):
    rng = np.random.default_rng(5)
    line = prose(25, 9)
    rows = [(n, prose(int(rng.integers(1, 25)), 100 + n) + line[int(rng.integers(0, 20)) :] + prose(int(rng.integers(1, 25)), 300 + n % 7)) for n in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in suffixes.deduplicated(df, 6000).collect()), key=str) == slow_removal(rows)


def test_rows_without_an_id_spread_and_keep_their_first_copy(spark):
    rows = [(None, PASSAGE * 3) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = suffixes.deduplicated(df, 9000).collect()
    assert sorted(r.n_removed for r in out)[1:] == [len((PASSAGE * 3).encode())] * 199


def test_texts_without_repeats(docs):
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert rows[1].text == BASE and 2 not in rows and rows[5].text is None and rows[6].text == "" and rows[13].text == "x" * 99
    assert rows[10].text.count(PASSAGE[:50]) == 1 and PASSAGE[5:-5] not in rows[11].text and rows[11].n_chars == len(rows[11].text)


@pytest.mark.parametrize("runs", [1, 2, 3, 5, 8])
def test_loser_tree(runs):
    rng = np.random.default_rng(runs)
    rows = [[(bytes(rng.integers(97, 99, rng.integers(1, 9)).tolist()), b"", int(i), 0, 0, 0, 0, 7) for i in range(rng.integers(0, 30))] for _ in range(runs)]
    coded = [suffixes.front_coded(sorted(r)) for r in rows]
    out = list(suffixes.merged([suffixes.Run(r) for r in coded])) if coded else []
    texts, before = [], b""
    flat = sorted(x[0] for r in rows for x in r)
    for (n, right, row), want in zip(out, flat, strict=True):
        assert right == want and row[-1] == 7 and n == suffixes._shared(before, want, 0)
        before = want
        texts.append(want)
    assert len(out) == len(flat)


# 3 -----------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs, none):
    long = "word " * 3000
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "print(1)"), (3, "a/b/LICENSE.txt", "This work is licensed under the GNU\nGeneral Public License, version 3."), (4, "a/y.py", None),
        (5, "z/w.py", f"{long}\nLicensed under CC BY-NC 4.0.\n{long}"), (6, "q.py", ""), (7, None, "nothing"), (8, "a/b/c/own.py", "# Licensed under the Apache License, Version 2.0"), (8, "a/b/c/own.py", "# Licensed under the Apache License, Version 2.0"), (9, "a/bb/v.py", "the license of life is not a licence to kill"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("score", F.lit("clash"))
    got = sorted((r.doc_id, r.license, r.origin, r.from_path) for r in licenses.scanned(df).collect())
    assert got == [
        (1, "MIT", "own", "a/LICENSE"), (2, "GPL-3.0", "inherited", "a/b/LICENSE.txt"), (3, "GPL-3.0", "own", "a/b/LICENSE.txt"), (4, "MIT", "inherited", "a/LICENSE"), (5, "CC-BY-NC-4.0", "own", "z/w.py"),
        (6, None, "none", None), (7, None, "none", None), (8, "Apache-2.0", "own", "a/b/c/own.py"), (8, "Apache-2.0", "own", "a/b/c/own.py"), (9, "MIT", "inherited", "a/LICENSE"),
    ]
    assert licenses.scanned(licenses.as_files(none)).count() == 0 and licenses.scanned(licenses.as_files(docs)).count() == len(ODD)


def test_licenses_by_brute_force(spark):
    """Each file's best unit of lines, from document frequencies counted again and cosines summed term by term."""
    import math

    notices = [t for _, t in licenses.TEMPLATES]
    rng = np.random.default_rng(12)
    rows = []
    for n in range(60):
        lines = [prose(int(rng.integers(1, 9)), 40_000 + 9 * n + k) for k in range(4)]
        if n % 2:
            words = notices[n % len(notices)].split()
            words = [w for w in words if n % 3 or rng.random() < 0.8]
            lines.insert(2, " ".join(words[: len(words) // 2]) + "\n" + " ".join(words[len(words) // 2 :]))
        rows.append((n, f"f{n}", "\n".join(lines)))
    split = [[licenses.terms(line) for line in t.split("\n")] for _, _, t in rows]
    vocabulary = {t for text in notices for t in licenses.terms(text)}
    files = Counter(t for lines in split for t in {t for line in lines for t in line} & vocabulary)
    idf = lambda t: math.log((len(rows) + 1) / (files[t] + 1)) + 1

    def cosine(a, b):
        x, y = ({t: (1 + math.log(n)) * idf(t) for t, n in Counter(terms).items()} for terms in (a, b))
        return sum(x[t] * y.get(t, 0) for t in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for (n, _, text), lines in zip(rows, split, strict=True):
        raw, best = text.split("\n"), (0.0, "")
        for a in range(len(raw)):
            for b in range(a + 1, min(len(raw), a + licenses.LINES) + 1):
                if any(licenses.CUE.search(line) for line in raw[a:b]):
                    unit = [t for line in lines[a:b] for t in line]
                    best = max(best, *((cosine(unit, licenses.terms(t)), name) for name, t in licenses.TEMPLATES)) if unit else best
        if best[0] >= licenses.COSINE + 1e-6:
            assert got[n].origin == "own" and abs(got[n].score - best[0]) < 1e-6, n
        elif best[0] < licenses.COSINE - 1e-6:
            assert got[n].license is None, n


def test_headers_of_each_version():
    wrapped = {
        "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
        "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
        "LGPL-3.0": "This library is free software: you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.",
    }
    scanner = licenses.Scanner(10, {})
    for name, text in wrapped.items():
        assert scanner.scan("int x;\n\n * " + text.replace("\n", "\n * ") + "\n\nint main() {}")[0] == name, name


def test_two_and_three_clauses():
    two = """Copyright (c) 2020, Someone
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    three = two + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    end = "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS\n"
    scanner = licenses.Scanner(10, {})
    assert scanner.scan(two + end)[0] == "BSD-2-Clause" and scanner.scan(three + end)[0] == "BSD-3-Clause"


# 4 and 10 ----------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[300:420] = x[300] + rng.normal(size=(120, 16)) * 0.08
    x[500:560] = x[500]
    x[600] = 0
    rows = [(i, [float(np.float32(c)) for c in v], None) for i, v in enumerate(x)]
    rows[601] = (601, None, 1)
    rows[602] = (602, [float("nan")] * 16, 1)
    rows[603] = (603, [float("inf")] * 16, 1)
    rows[604] = (604, [None] * 16, 1)
    rows[605] = (None, rows[5][1], 1)
    rows += [(7, rows[7][1], 1), (2000, [1.0, 2.0, 3.0], 1), (2020, [1.0, 2.0, 3.5], 1)]
    return rows


def usable(rows):
    out = []
    for i, v, _ in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            out.append((i, np.array(v, dtype=np.float64)))
    return out


@pytest.mark.parametrize("how", [{"parts": 8}, {"parts": 4, "leaf": 50, "least": 16}])  # one level of parts, and two
def test_neighbours(spark, cloud, how):
    df = vectors(spark, cloud)
    found = ann.nearest(df, block=64, **how)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = usable(cloud)
    hits = total = 0
    for q in {i for i, _ in good if i % 20 == 0}:
        own = next(v for i, v in good if i == q)
        at = next(n for n, (i, _) in enumerate(good) if i == q)
        others = [(float(own @ v), i) for n, (i, v) in enumerate(good) if n != at and len(v) == len(own)]
        want = [i for _, i in sorted(others, key=lambda s: (-s[0], s[1]))[:20]]
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1)) and len(mine) == min(20, len(others))
        assert [(-round(s, 9), i) for _, i, s in mine] == sorted((-round(s, 9), i) for _, i, s in mine)
        hits += len(set(want) & {i for _, i, _ in mine})
        total += len(want)
    assert set(got) == {i for i, _ in good if i % 20 == 0} and hits / total >= 0.9
    assert ann.nearest(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in ann.nearest(vectors(spark, [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [2.0, 0.0], 1)])).collect()] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]


def test_parts_grow_with_rows():
    assert ann.parts_for(100) == ann.parts_for(1000) == 16 and ann.parts_for(10_000) == 50 and ann.parts_for(10**9) == ann.PARTS


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_recall_on_the_tables(spark):
    """Of random vectors, whose neighbours are spread over all parts: the hardest case."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert ann.recall(ann.nearest(df), df) >= 0.9


def test_near_vectors(spark, cloud, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", 32)
    got = embdedup.near_duplicates(vectors(spark, cloud), window=8).collect()
    assert len(got) == len(cloud)
    good = usable(cloud)
    unit = [v / np.linalg.norm(v) for _, v in good]
    near = [[m for m, u in enumerate(unit) if m != n and len(u) == len(w) and float(u @ w) >= 0.95] for n, w in enumerate(unit)]
    want = Counter((i, len(near[n])) for n, (i, _) in enumerate(good))
    have = Counter((r.vec_id, r.n_links) for r in got)
    assert sum((want & have).values()) >= 0.99 * len(good)
    rows = {r.vec_id: r for r in got}
    assert rows[600].n_links == rows[601].n_links == rows[604].n_links == 0 and rows[601].kept and rows[602].component_id == 602
    assert {rows[n].component_id for n in range(300, 420)} == {300} and rows[310].n_links >= 100
    assert all(rows[n].n_links == 59 and rows[n].component_id == 500 for n in range(500, 560)) and not rows[501].kept
    assert embdedup.near_duplicates(vectors(spark, [])).count() == 0


# 5 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("task", [64, 1 << 15])
def test_links_do_not_depend_on_tasks(spark, monkeypatch, task):
    """Pairs at the threshold, in an even spread, in a dense group and in a tight one, whatever the tasks' borders."""
    monkeypatch.setattr(embdedup, "TASK", task)
    rng = np.random.default_rng(2)

    def near(v, cosine):
        u = rng.normal(size=v.shape)
        u -= (u @ v) / (v @ v) * v
        return cosine * v / np.linalg.norm(v) + (1 - cosine**2) ** 0.5 * u / np.linalg.norm(u)

    even = [rng.normal(size=32) for _ in range(600)]
    centre = rng.normal(size=32)
    dense = [near(centre, 0.9) for _ in range(300)]
    tight = [near(even[0], 0.99) for _ in range(150)]
    paired = [near(v, 0.96) for v in even[100:200] + dense[:60]]
    x = np.stack([v / np.linalg.norm(v) for v in even + dense + tight + paired])
    linked = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    root = list(range(len(x)))
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root] if a != b else root
    got = {r.vec_id: r for r in embdedup.near_duplicates(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]), recall=0.9999).collect()}
    assert [got[i].component_id for i in range(len(x))] == root
    assert [got[i].n_links for i in range(len(x))] == linked.sum(axis=1).tolist()


def test_lm_scores(spark, none):
    rows = [(n, prose(60, 1000 + n % 40) if n % 9 else [None, "", "unheard-of " * 3][n // 9 % 3]) for n in range(200)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = lm.scored(df, chunk=4000).collect()
    every = [*rows, rows[3]]
    counts = Counter()
    for i, t in every:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*(t or "").lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(every)
    texts = dict(rows)
    for r in got:
        tokens = [*(texts[r.doc_id] or "").lower().split(), None]
        assert r.n_tokens == len(tokens) and r.n_known == sum(counts[t] > 0 for t in tokens) and r.train_tokens == n and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert np.isclose(r.base_score, sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens))
        assert np.isfinite(r.score) and r.score <= 1e-9
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.scored(none).count() == 0


def test_lm_is_normalised():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, (lm.SYMBOLS + 1, lm.SYMBOLS)).astype(float)
    model = lm.Model.begun(*lm.train(counts, steps=3))
    before = rng.integers(0, lm.SYMBOLS + 1, (5000, lm.CONTEXT))
    model.r[1:] = rng.normal(size=model.r[1:].shape)
    logs = np.concatenate(list(lm.log_probabilities(model, before)))
    assert logs.shape == (5000, lm.SYMBOLS) and np.allclose((10.0 ** logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    now = rng.integers(0, lm.SYMBOLS, 5000)
    before[2500:] = before[:2500]  # equal contexts are worked out once
    slow = []
    for context, symbol in zip(before.tolist(), now.tolist(), strict=True):
        logits = sum(model.r[k][context[k]].astype(float) for k in range(lm.CONTEXT)) @ model.q.T.astype(float) + model.b
        slow.append((logits[symbol] - logits.max() - np.log(np.exp(logits - logits.max()).sum())) / np.log(10))
    assert np.allclose(lm._symbol_logs(model, before.astype(np.int32), now.astype(np.int32)), slow, atol=1e-3)


def test_lm_learns_what_follows():
    counts = np.zeros((lm.SYMBOLS + 1, lm.SYMBOLS))
    counts[1, 2] = counts[2, 1] = counts[lm.BEGIN, 1] = 500
    counts[3, 4] = counts[4, 3] = 500
    model = lm.Model.begun(*lm.train(counts))
    before = np.full((4, lm.CONTEXT), lm.BEGIN)
    before[:, 0] = range(4)
    logs = np.concatenate(list(lm.log_probabilities(model, before)))
    assert logs[1, 2] > logs[1, 4] + 1 and logs[3, 4] > logs[3, 2] + 1


def test_lm_learns_from_places_further_back():
    """What follows depends on the symbol two places before alone."""
    rng = np.random.default_rng(7)
    model = lm.Model.begun(*lm.train(np.ones((lm.SYMBOLS + 1, lm.SYMBOLS)), steps=3))
    squares = [np.full_like(p, 1e-6) for p in (*model.r, model.q, model.b)]
    unigram = np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)
    for _ in range(600):
        before = rng.integers(0, 4, (512, lm.CONTEXT)).astype(np.int32)
        model.learn(before, before[:, 1] + 10, rng.integers(0, lm.SYMBOLS, lm.SHARED), unigram, squares)
    before = np.array([[0, 2, 1], [3, 1, 0]])[:, : lm.CONTEXT]
    logs = np.concatenate(list(lm.log_probabilities(model, before)))
    assert logs[0, 12] > logs[0, 11] + 0.5 and logs[1, 11] > logs[1, 12] + 0.5


# 6 -----------------------------------------------------------------------------------------------------------------

MARKED = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; tail</h1></header><p>One  two<br>three<p>Four &lt;b&gt; &#233;<ul><li>Item a<li>Item b</ul><form><label>Mail</label><input></form><aside>Side</aside><div class="ad">Buy</div>
<section id="comments"><p>First!</p></section><p hidden>no</p><!-- no --></article><footer>&copy; host</footer></body></html>"""
LINES = ["Home about contact and all the other pages of this site", "All rights are reserved by the owner of this site now"]


def test_page_blocks():
    assert [t for s, t in pages.blocks(MARKED) if s == pages.INSIDE] == ["Head & tail", "One two three", "Four <b> é", "Item a", "Item b"]
    assert pages.blocks("") == [] and pages.blocks("<p>a<b>c</p>d") == [(0, "ac"), (0, "d")] and pages.blocks("x < y & z") == [(0, "x < y & z")]


def test_names_of_layouts_and_slugs_drop_no_article():
    inside = lambda page: [t for s, t in pages.blocks(page) if s == pages.INSIDE]
    for wrapper in ("layout has-sidebar", "no-sidebar", "content sidebar", "ad-free"):
        assert inside(f"<div class='{wrapper}'><div class='ad'>Buy</div><article><p>Own text</p></article></div><p>end</p>") == ["Own text"], wrapper
    assert inside("<form id='aspnet'><main><p>Own text</p></main></form>") == ["Own text"]
    assert inside("<main><p>Own text</p></main><div class='related-posts'><article>Teaser</article></div>") == ["Own text"]
    assert pages.blocks("<p>A long plain text</p><div class='related'><article>Teaser</article></div>") == [(0, "A long plain text"), (0, "Teaser")]
    page = "<article><section id='related-work'><h2 id='social'>Related</h2><p class='notice'>One</p></section><h2 id='notice-period'>Two</h2><section id='social-impact'>Three</section><div class='ad-slot'>Buy</div><div class='related-posts'>More</div></article>"
    assert inside(page) == ["Related", "One", "Two", "Three"]
    assert inside("<aside class='x'><article>Card</article></aside><article>Own</article>") == ["Own"]


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (40, 2), (300, 3)):
        tokens = rng.integers(0, kinds, n)
        order, common = pages.suffix_array(tokens, 512)
        suffixes = [tokens[i:].tolist() for i in range(n)]
        assert order.tolist() == sorted(range(n), key=lambda i: suffixes[i])
        for k in range(1, n):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def slow_repeats(hosted, run, least, share):
    """Which blocks of different pages (marked, blocks) go, from all runs of their token streams."""
    def runs(lines):
        stream, at = [], []
        for k, line in enumerate(lines):
            stream += [*line.split(" "), "\n"]
            at += [k] * len(line.split(" ")) + [None]
        return [(tuple(stream[i : i + run]), at[i : i + run]) for i in range(len(stream) - run + 1)], stream, at

    on, whole = Counter(), Counter()
    for _, lines in hosted:
        on.update({r for r, _ in runs(lines)[0]})
        whole.update({line for line in lines if len(line.split(" ")) < run})
    out = []
    for marked, lines in hosted:
        found, stream, at = runs(lines)
        gone = []
        for k, line in enumerate(lines):
            size = len(line.split(" "))
            held = lambda most: sum(1 for p in range(len(stream)) if at[p] == k and any(on[found[i][0]] >= most for i in range(max(0, p - run + 1), min(p, len(found) - 1) + 1)))
            if marked:
                gone.append(len(hosted) >= pages.ENOUGH and held(max(least, pages.MOST * len(hosted))) == size)
            else:
                gone.append(2 * held(least) >= size or size < run and whole[line] >= max(least, share * len(hosted)))
        out.append([line for line, g in zip(lines, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("lot", [400_000, 150])
def test_repeated_runs_of_a_host(spark, lot):
    """Boilerplate inside and outside marked articles, copies of a page, shared passages of a few articles; one lot and several."""
    foot, menu, shared = prose(14, 1), ["home", "about us", "all posts and more"], prose(30, 2)
    rows, want, seen = [], {}, {}
    for n in range(24):
        own = [prose(12, 900 + n), *([shared] if n % 4 == 0 else []), prose(3, 950 + n)]
        marked = n % 2 == 0
        lines = [*own, foot] if marked else [*menu, *own, foot, "ok"]
        body = "".join(f"<p>{line}</p>" for line in lines)
        rows.append((n, "http://h.example/x", f"<article>{body}</article>" if marked else f"<div>{body}</div>"))
        seen[n] = (marked, lines)
    rows += [(100 + n, "http://h.example/copy", rows[5][2]) for n in range(30)]  # one page, however often
    for n, lines in zip(seen, slow_repeats(list(seen.values()), pages.RUN, pages.PAGES, pages.SHARE), strict=True):
        want[n] = "\n".join(lines)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in pages.extracted(df, lot=lot).collect()}
    assert all(got[n] == want[n] for n in want) and all(got[100 + n] == want[5] for n in range(30))
    assert all(foot not in t for t in want.values()) and all(shared in want[n] for n in (0, 4)) and "home" not in want[1]


def test_articles_of_a_host_in_several_lots(spark):
    """What stands in all articles of a host goes, what is in every fourth stays, though no lot sees all pages."""
    foot, shared = prose(14, 1), prose(30, 2)
    rows = [(n, "http://h.example/x", "<article>" + "".join(f"<p>{line}</p>" for line in [prose(12, 900 + n), *([shared] if n % 4 == 0 else []), foot]) + "</article>") for n in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for lot in (400_000, 1500):
        got = {r.page_id: r.text for r in pages.extracted(df, lot=lot).collect()}
        assert all(got[n] == "\n".join([prose(12, 900 + n), *([shared] if n % 4 == 0 else [])]) for n in range(120))


def test_what_goes_does_not_depend_on_lots(spark):
    """Marked articles with passages on 20 to 80 % of a host's pages, on exactly half and just below: many lots, one lot and brute force agree."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for host, count in (("a", 48), ("b", 31), ("c", 7)):
        on = [set(rng.permutation(count)[: max(1, int(share * count))].tolist()) for share in (0.2, 0.3, 0.4, 0.45, 0.5, 0.5, 0.55, 0.6, 0.8)] + [set(range(count // 2 - 1)), set(range(count // 2))]
        seen = []
        for n in range(count):
            lines = [prose(10 + n % 9, own := 10_000 + 100 * ord(host) + n), *(prose(9 + 2 * k, 700 + k) for k in range(len(on)) if n in on[k]), prose(3, own + 5000)]
            seen.append((True, lines))
            rows += [(len(rows), f"http://{host}.example/{n}", "<article>" + "".join(f"<p>{line}</p>" for line in lines) + "</article>")] * (1 + n % 3)
        for n, lines in enumerate(slow_repeats(seen, pages.RUN, pages.PAGES, pages.SHARE)):
            want[host, n] = lines
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for lot in (400_000, 2000, 500, 100):
        got = pages.extracted(df, lot=lot).collect()
        assert len(got) == len(rows)
        assert all(r.text == "\n".join(want[r.url[7], int(r.url.rsplit("/", 1)[1])]) for r in got), lot


def test_quotes_inside_unquoted_values():
    assert [t for _, t in pages.blocks("<p title=don't>hello</p><p>it's fine</p><p class=a'b\"c id='x'>next</p>")] == ["hello", "it's fine", "next"]
    assert [t for _, t in pages.blocks("<p a = 'x > y' b=\"<i>\" c>one</p><br/><img src=a/b.png>two <x y=1")] == ["one", "two <x y=1"]


def test_pages(spark):
    plain = [(n, f"http://h.example/{n}", f"<div>{LINES[0]}</div><p>{prose(30, n)}</p><div>{LINES[1]}</div>") for n in range(6)]
    odd = [(100, None, None), (101, "http://[bad", "<p>only text</p>"), (102, "http://h.example/m", MARKED), (102, "http://h.example/m", MARKED), (103, "http://h.example/m2", MARKED), (104, "http://h.example/m3", MARKED), (None, "http://lone.example", "words " * 20_000)]
    df = spark.createDataFrame([*plain, *odd], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = pages.extracted(df).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(plain) + len(odd)
    assert all(got[n].text == prose(30, n) for n in range(6))
    assert got[100].text == "" and got[100].n_chars == 0 and got[101].text == "only text" and got[None].n_chars == 119_999
    assert got[102].text == got[104].text == "Head & tail\nOne two three\nFour <b> é\nItem a\nItem b" and got[102].n_chars == len(got[102].text)
    assert pages.extracted(df.limit(0)).count() == 0


# 7 -----------------------------------------------------------------------------------------------------------------


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    names = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    whole = Tokenizer.from_file(names[0])
    ids = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
    encode = packing.encoder(*names)
    for t in ["", " ", "a  b", " lead", "tail ", "a\n\n b \n", "don't  x\t y", "é" * 9, "<|endoftext|> x", "a  b", "x <|endoftext|>", "  z"]:
        assert encode(t) == ids(t)[:-1].tobytes(), t
    rows = packing.pack_documents(docs, *names).collect()
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i, t in ODD:
        x = ids(t)
        first = len(x) % 1024 or 1024
        cuts = [0, *range(min(first, len(x)), len(x) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert pieces == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and sum(n for _, n in held) <= 1024
    assert len(places) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack_documents(none, *names).count() == 0


def test_genetic_packing_keeps_every_piece_and_never_grows():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1024, 400).tolist()
    first = packing.best_fit(lengths, list(range(400)), [], 1024)
    best = packing.evolve(lengths, first, seed=1)
    assert sorted(i for b in best for i in b) == list(range(400)) and len(best) <= len(first)
    assert all(sum(lengths[i] for i in b) <= 1024 for b in best)
    child = packing.cross(lengths, first, best, 1024, rng)
    assert sorted(i for b in child for i in b) == list(range(400))


def test_crossover_wins_where_longest_first_does_not():
    """Triplets that fill a bin exactly: best fit of the longest first needs more bins, and so do the packings that evolution begins with."""
    rng = np.random.default_rng(6)
    triplets = []
    for _ in range(40):
        a = int(rng.integers(380, 500))
        b = int(rng.integers(250, 1024 - a - 250 + 1))
        triplets += [a, b, 1024 - a - b]
    order = rng.permutation(len(triplets))
    lengths = [triplets[i] for i in order]
    decreasing = len(packing.best_fit(lengths, list(range(120)), [], 1024))
    begun, bred = (len(packing.evolve(lengths, [], seed=3, generations=n)) for n in (0, packing.GENERATIONS))
    assert 40 <= bred < min(decreasing, begun)


def test_small_pieces_fill_bins():
    assert len(packing.evolve(np.array([512] * 100 + [300] * 30 + [212] * 30), [], seed=2)) <= 66


# 8 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def judged(spark):
    good = [(n, prose(60, 5000 + n), 1, 0) for n in range(300)]
    bad = [(1000 + n, "!! ".join(prose(40, 7000 + n).upper().split()) + "!!", 0, 0) for n in range(100)]
    docs = spark.createDataFrame([r[:2] for r in good + bad] + [(5000, None), (5001, ""), (None, prose(50, 1)), (0, good[0][1]), (6000, prose(9000, 2))], "doc_id long, text string").withColumn("half", F.lit("clash")).withColumn("log_weight", F.lit(1)).repartition(3)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in good[:200] + bad[:60]] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(judged):
    docs, labels = judged
    rows = quality.sampled(docs, labels).collect()
    ids = {r.doc_id for r in rows}
    assert len(ids & set(range(300))) >= 294 and len(ids & set(range(1000, 1100))) <= 2 and 6000 in ids and all(r.kept for r in rows)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows)
    assert quality.sampled(docs, labels.limit(0)).count() == docs.count()
    assert quality.sampled(docs.limit(0), labels).count() == 0


def test_quality_ratios_and_draw_by_brute_force(judged):
    """Counts of all n-grams one by one, their smoothed ratios, and the k greatest keys of all."""
    docs, labels = judged
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    judge = quality.Judge(docs, labels)
    half = {r.label_id: (r.half, r.good) for r in judge.known.collect()}
    raw, good = np.zeros(quality.BUCKETS), np.zeros((quality.FOLDS, quality.BUCKETS))
    marks = quality.PUNCTUATION
    for i, text in rows:
        words = [*(text or "").encode().lower().split(), lm.END]
        cores = [w.strip(marks) for w in words]
        hashed = [zlib.crc32(c) % quality.WORDS if c else 0 for c in cores]
        for k, (w, c) in enumerate(zip(words, cores, strict=True)):
            before = hashed[k - 1] if k else 1
            pair = 0 if before == hashed[k] > 0 else (before * 40503 + hashed[k] * 2654435761) % quality.PAIRS
            for bucket in (hashed[k], quality.WORDS + zlib.crc32(w.replace(c, b"\0", 1) if c else w) % quality.MARKS, quality.WORDS + quality.MARKS + pair):
                raw[bucket] += 1
                if half.get(i, (0, False))[1]:
                    good[half[i][0], bucket] += 1
    kinds = (slice(0, quality.WORDS), slice(quality.WORDS, quality.WORDS + quality.MARKS), slice(quality.WORDS + quality.MARKS, quality.BUCKETS))
    for fold in range(quality.FOLDS):
        for part in kinds:
            due = raw[part] / raw[part].sum() * good[fold][part].sum()
            assert np.allclose(judge.ratios[fold][part], np.log((good[fold][part] + quality.SMOOTH) / (due + quality.SMOOTH)))
    weighed, weight, key = judge.weights(docs.select("doc_id", "text"))
    every = [(r.doc_id, r[weight], r[key]) for r in weighed.collect()]
    for i, w, g in every:
        chance = (zlib.crc32(b"gumbel %d" % (-1 if i is None else i)) + 0.5) / (1 << 32)
        assert np.isclose(g, w / quality.TEMPERATURE - np.log(-np.log(chance)))
    k = sum(w >= judge.cut for _, w, _ in every)
    last = sorted((g for _, _, g in every), reverse=True)[k - 1]
    got = sorted(r.gumbel_key for r in quality.sampled(docs, labels).collect())
    assert np.allclose(got, sorted(g for _, _, g in every if g >= last))


def test_toxic_documents_go(spark):
    rude = [f"grunk{c}" for c in "abcdefghij"]
    said = lambda n: " ".join(rude[(n * 3 + k) % 10] for k in range(3))
    toxic = [(2000 + n, f"{prose(60, 9000 + n)} {said(n)} {prose(500, 9500 + n)}", 1, 1) for n in range(120)]
    clean = [(n, prose(563, 15000 + n), 1, 0) for n in range(400)]
    bad = [(3000 + n, "!! ".join(prose(40, 17000 + n).upper().split()) + "!!", 0, 0) for n in range(60)]
    docs = spark.createDataFrame([r[:2] for r in toxic + clean + bad], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in toxic[:60] + clean[:200] + bad[:30]], "doc_id long, quality int, toxic int")
    ids = {r.doc_id for r in quality.sampled(docs, labels).collect()}
    assert len(ids & set(range(2000, 2120))) <= 6 and len(ids & set(range(400))) >= 392 and len(ids & set(range(3000, 3060))) <= 1


def test_documents_likelier_bad_than_good_go(spark):
    clean = [(n, prose(60, 5000 + n), 1) for n in range(300)]
    doubtful = [(1000 + n, prose(60, 8000 + n).upper().replace(" ", "; "), int(n % 10 < 3)) for n in range(200)]
    docs = spark.createDataFrame([r[:2] for r in clean + doubtful], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(*r[::2], 0) for r in clean[:200] + doubtful[:150]], "doc_id long, quality int, toxic int")
    ids = {r.doc_id for r in quality.sampled(docs, labels).collect()}
    assert len(ids & set(range(300))) >= 294 and len(ids & set(range(1000, 1200))) <= 10


def test_best_cut():
    weight = np.array([-3.0, -1.0, 0.5, 1.0, 4.0, 5.0])
    assert quality.best_cut(weight, np.array([False, False, False, False, True, True])) == 2.5
    assert quality.best_cut(weight, np.array([False, True, False, False, True, True])) == 2.5
    assert quality.best_cut(np.zeros(3), np.array([False, True, True])) == float("-inf")


def test_kth_greatest(spark):
    rng = np.random.default_rng(6)
    keys = np.concatenate([rng.normal(size=9000), np.full(500, 0.25), [1e6, -1e6]])
    df = spark.createDataFrame([(float(k),) for k in keys], "k double")
    for k in (1, 2, 77, 4000, 4100, len(keys)):
        assert quality.kth_greatest(df, "k", k, few=50) == sorted(keys, reverse=True)[k - 1]


# 9 -----------------------------------------------------------------------------------------------------------------


def slow_targets(sizes):
    weights = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = goal - sum(2 * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        level = left / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weights[s] for s in sizes}
        full |= over


def test_mixing(spark, docs, none):
    for df in (docs, spark.createDataFrame([(n, prose(n % 50 + 1, n), None if n % 11 == 0 else f"s{(n * n) % 7}") for n in range(700)], "doc_id long, text string, source string")):
        rows = mixing.mixed(df).collect()
        source = Counter()
        for r in df.collect():
            source[r.source] += len((r.text or "").split())
        want = slow_targets(dict(source))
        sums, seen = Counter(), {}
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size
            seen[round(r.target, 6), r.source_size] = seen.get((round(r.target, 6), r.source_size), 0) + r.taken
        assert sorted(k for k in seen) == sorted({(round(want[s], 6), source[s]) for s in source})
        for (t, _), n in seen.items():
            assert abs(n - t * sum(1 for s in source if (round(want[s], 6), source[s]) == (t, _))) <= len(source)
        assert sorted(rows) == sorted(mixing.mixed(df.repartition(5)).collect()) if None not in [r.doc_id for r in rows] else True
        del sums
    assert mixing.mixed(none).count() == 0
    assert mixing.repeated(docs).columns == docs.columns and mixing.repeated(none).count() == 0


def test_the_mix_itself_agrees_and_its_shards_are_disjoint(spark):
    df = spark.createDataFrame([(n, prose(n % 50 + 1, n), f"s{(n * n) % 7}") for n in range(2000)], "doc_id long, text string, source string")
    draws = mixing.mix(df, levels=3).collect()
    sums = Counter()
    for r in draws:
        sums[r.doc_id] += r.words
    assert sums == Counter({r.doc_id: r.taken for r in mixing.mixed(df).collect() if r.taken})
    assert len({(r.doc_id, r["pass"]) for r in draws}) == len(draws) and len({r.shard for r in draws}) == 8


def test_hypergeometric(spark):
    n, good, draws = 4000, 30, 20
    df = spark.range(n).select(mixing._hypergeometric(mixing._chance(F.col("id"), 1), F.lit(good).cast("long"), F.lit(50).cast("long"), F.lit(draws).cast("long")).alias("k"))
    x = np.array([r.k for r in df.collect()])
    p = good / 80
    assert abs(x.mean() - draws * p) < 0.12 and abs(x.var() - draws * p * (1 - p) * 60 / 79) < 0.35 and x.min() >= 0 and x.max() <= draws
