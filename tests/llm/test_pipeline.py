"""The pipeline's stages, one after another, on a small corpus."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = ["".join(np.random.default_rng(n).choice(list("abcdefgh"), 5)) for n in range(400)]


def prose(n, seed):
    return " ".join(WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n))


def test_stages(spark, tmp_path):
    shared = prose(60, 1)
    good = [(n, prose(70, 100 + n), "en", f"s{n % 4}") for n in range(240)]
    good += [(300, good[5][1], "en", "s0"), (301, prose(30, 7) + " " + shared + " " + prose(30, 8), "en", "s1"), (302, prose(30, 9) + " " + shared + " " + prose(30, 10), "en", "s2")]
    bad = [(500 + n, "!! ".join(prose(40, 900 + n).upper().split()) + "!!", "en", "s3") for n in range(80)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in good + bad], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, 0) for r in good[:150]] + [(r[0], 0, 0) for r in bad[:50]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if n < 4:
            assert now.columns == docs.columns, name
        now.write.parquet(str(tmp_path / f"out{n}"))
        now = spark.read.parquet(str(tmp_path / f"out{n}"))
        seen.append(now.toPandas())
    first, second, third, fourth, last = seen
    assert first["doc_id"].lt(400).all() and len(first) >= 0.97 * len(good)
    assert 300 not in set(second["doc_id"]) and 5 in set(second["doc_id"]) and second["doc_id"].is_unique
    texts = third.set_index("doc_id")["text"]
    assert shared[:40] in texts[301] and shared[10:-10] not in texts[302] and (third["n_chars"] == third["text"].str.len()).all()
    assert set(fourth["doc_id"]) <= set(third["doc_id"]) and fourth.groupby("doc_id").size().max() <= 2
    assert set(last["doc_id"]) == set(fourth["doc_id"]) and last.groupby("sequence_id")["length"].sum().max() <= 1024
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == list(last.columns)


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, half int, row long, chunk int, `__label` string, `log_weight` double"
ODD = [
    (1, prose(80, 1)), (2, prose(80, 1)), (3, None), (4, ""), (5, " \t\n "), (6, prose(20_000, 2)), (7, prose(70, 3)), (7, prose(70, 3)), (8, prose(70, 4)), (8, prose(70, 5)), (None, prose(60, 6)), (None, None), (9, "one"), (10, "é" * 400), (11, "x" * 99),
]


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if n % 4 == 0 else f"s{n % 3}", len(t or ""), 1, n, 2, "clash", 0.5) for n, (i, t) in enumerate(rows)], SHAPE).repartition(3)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (7, 1, 0), (8, 0, 0), (9, 0, 1), (None, 1, 0), (10, None, None)]])
def test_odd_rows(spark, tmp_path, labels):
    """Nulls, empty and very long texts, repeats, shared ids, and columns whose names the operators use themselves."""
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    first, second, third, fourth, last = (f for _, f in corpus_pipeline.STAGES)
    docs = odd(spark, ODD)
    judged = first(spark, docs, str(tmp_path))
    assert judged.columns == docs.columns and set(kept(judged)) <= set(kept(docs))
    if not labels:
        assert kept(judged) == kept(docs)
    apart = kept(second(spark, docs, str(tmp_path)))
    assert apart.count((7, ODD[6][1])) == 1 and (2, ODD[1][1]) not in apart and (1, ODD[0][1]) in apart
    assert {(8, ODD[8][1]), (8, ODD[9][1]), (None, None), (None, ODD[10][1])} <= set(apart)
    assert [i for i, t in apart if not (t or "").split() and i is not None] == [3]
    cut = third(spark, docs, str(tmp_path))
    texts = kept(cut)
    assert cut.columns == docs.columns and (1, ODD[0][1]) in texts and (3, None) in texts and (4, "") in texts and not any(i == 2 for i, _ in texts) and (11, "x" * 99) in texts
    mixed = fourth(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and all((t or "").split() for _, t in kept(mixed)) and set(kept(mixed)) <= set(kept(docs))
    packed = last(spark, docs, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in packed) == len(ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
