"""Token counts and segments by a tokenizer whose file is given; without one, a token for four bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<id: int, text: string, byte_start: int, byte_end: int>>"


@lru_cache(maxsize=2)
def _loaded(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def counted(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs (doc_id, text) with tokens, and whether that is an estimate; empty text has none."""
    if vocabulary is None:
        return docs.withColumn("tokens", F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4)).withColumn("is_estimate", F.lit(True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _loaded(vocabulary).encode_batch([t or "" for t in batch.column(1).to_pylist()], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(f.ids) for f in found], pa.int64()), pa.array([False] * len(found))], names=["doc_id", "text", "tokens", "is_estimate"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, text string, tokens long, is_estimate boolean")


def segments(docs: DataFrame, vocabulary: str, most: int = 2000) -> DataFrame:
    """(doc_id, segments): the first tokens of each text with the bytes that they stand for."""
    kind = pa.list_(pa.struct([("id", pa.int32()), ("text", pa.string()), ("byte_start", pa.int32()), ("byte_end", pa.int32())]))

    def cut(text: str) -> list[dict]:
        found = _loaded(vocabulary).encode(text, add_special_tokens=False)
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
        return [{"id": i, "text": text[a:b], "byte_start": at[a], "byte_end": at[b]} for i, (a, b) in zip(found.ids[:most], found.offsets[:most], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cut(t or "") for t in batch.column(1).to_pylist()], kind)], names=["doc_id", "segments"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, segments {SEGMENTS}")
