"""The queries of the training-data operators; each reads whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, embdedup, licenses, lm, mixing, packing, pages, quality, simhash, suffixes
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(licenses.as_files(table(spark, sf_dir, "documents")))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    return packing.pack_documents(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, names))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_learned_partitions": op4_learned_partitions,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_html_extraction": op6_html_extraction,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

#: Where SQL can say the same; documents and vectors have ids here, each once.
SQL: dict[str, str] = {
    "op2_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, n - 99))) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, TRUE) AS is_new FROM again),
numbered AS (SELECT doc_id, i, sum(CAST(is_new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k, CAST(sum(b - a) AS BIGINT) AS gone, CAST(count(*) AS BIGINT) AS runs FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT vec_id, b FROM reach JOIN links ON r = a)
SELECT vec_id, (SELECT CAST(count(*) AS BIGINT) FROM links WHERE a = vec_id) AS n_links, min(r) AS component_id, min(r) = vec_id AS kept FROM reach GROUP BY vec_id
""",
}
