"""The corpus pipeline: documents through quality, near-duplicates, repeated passages and source mix into packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet into the shared
folder and reads them back as the next stage's docs. All but the last return the columns of documents, whatever others
there are and whatever they are called. A stage's rows have to be written before the next stage is called: it begins by
removing the temporary tables of the one before.

Defined cases: an empty table gives empty tables; rows without text are judged by the classifier like any other, pass the
dedup stages as texts without words, and are not mixed, since they have none; rows without an id stay in the dedup
stages and are mixed and packed like others; of rows that repeat id and text one stays from the second stage on; texts of
any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkmeter.llm import mixing, packing, quality, simhash, suffixes
from sparkmeter.llm.common import discard, settle, settled, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier's sample keeps; all, if no labels of both kinds are there. Rows that repeat id and text are kept or rejected together."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id; of rows that repeat id and text, one; rows without an id stay."""
    return simhash.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that suffix-array dedup removes; a document left without text goes, one that had none stays."""
    return suffixes.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole passes, and once more if the last pass takes half of it or more; a document without words not at all."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences; each row is packed, repeated or not."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


#: What the last stage that was called settled.
_left: list[str] = []


def _after_the_last(stage: Callable) -> Callable:
    """The stage, which first removes what the stage before it settled, but for its own docs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left, docs)
        before = settled()
        out = stage(spark, docs, sf_dir)
        _left[:] = [path for path in settled() if path not in before]
        return out

    return run_stage


STAGES = [
    (name, _after_the_last(stage))
    for name, stage in (
        ("quality classifier", keep_quality),
        ("SimHash near-dedup", drop_near_duplicates),
        ("suffix-array dedup", drop_repeated_passages),
        ("mixing sources", mix_sources),
        ("best-fit packing", pack_sequences),
    )
]

#: The classifier, the fingerprints and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote is removed as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), settled()
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "zstd")
        discard(spark, [path for path in settled() if path not in before], docs)
    return docs
