"""Quality classifier by importance resampling.

A target model and a raw model are hashed n-gram models: words without their punctuation, the punctuation at words, and
pairs of neighbouring words (a word after itself is one pair of its own), each hashed into buckets with their relative
frequencies. The raw model counts all documents, the target model the good ones (quality 1 and not toxic) of at most
LABELS labelled documents, those with the least hash. A bucket's importance is the ratio of its target to its raw
frequency, both smoothed by SMOOTH occurrences, so that rare buckets say little. A document's weights are the means of
its log ratios and what its very negative ones add up to. Toxicity has a model of its own, of the toxic labelled
documents, since a few words among thousands make a document toxic: its weights are what a document's very positive log
ratios there add up to, and the greatest. A logistic fit on the labelled documents joins all into one log weight.
Labelled documents are weighed by models of the other half, so none is weighed by its own counts.

The sample is drawn without replacement by Gumbel top-k: each document's key is log weight / TEMPERATURE plus Gumbel
noise that follows from its id, and the k greatest keys are kept, k being the number of documents with a log weight of at
least the cut. The cut is chosen on held-out labelled documents, each half weighed by a fit on the other: the fewest good
ones lost and bad or toxic ones kept, each counting the same. The k-th key is found from counts of keys in intervals,
narrowed step by step; equal keys (repeated rows) are kept or rejected together.

Defined cases: null or blank text has weights of no evidence (zero) and is judged like any other; documents without a
label are judged alone by their text; without labelled documents of both kinds nothing is rejected; repeated labels of an
id count as bad, or toxic, if any is; an empty table gives no rows; other columns of the input are passed on by keep().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidied
from .lm import Texts

LABELS = 50_000
WORDS, MARKS, PAIRS = 1 << 16, 1 << 10, 1 << 14
BUCKETS = WORDS + MARKS + PAIRS
SMOOTH = 3.0
DEEP = 0.7
TEMPERATURE = 0.05
RANGES = 16
FOLDS = 2
MODELS = 1 + 2 * FOLDS
FEATURES = 12
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of each token: its word, its punctuation, and the pair that it ends."""
    word, mark = np.empty(len(texts.words), dtype=np.int64), np.empty(len(texts.words), dtype=np.int64)
    for i, w in enumerate(texts.words):
        core = w.strip(PUNCTUATION)
        word[i] = zlib.crc32(core) % WORDS if core else 0
        mark[i] = zlib.crc32(w.replace(core, b"\0", 1) if core else w) % MARKS
    now = word[texts.tokens]
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[texts.begins] = 1
    pair = (before * 40503 + now * 2654435761) % PAIRS
    pair[(before == now) & (now > 0)] = 0
    return now, WORDS + mark[texts.tokens], WORDS + MARKS + pair


@tidied
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a task: of all texts, of the good ones of each fold, and of the toxic ones of each fold."""
    sums = np.zeros((MODELS, BUCKETS), dtype=np.int64)
    for batch in batches:
        for texts, part in Texts.slices(batch):
            found = grams(texts)
            fold = np.repeat(part.column("fold").to_numpy(zero_copy_only=False), texts.lengths)
            for m in range(MODELS):
                some = slice(None) if m == 0 else fold == m - 1
                for g in found:
                    sums[m] += np.bincount(g[some], minlength=BUCKETS)
    for r, cells in enumerate(np.array_split(sums, RANGES, axis=1)):
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.ascontiguousarray(cells).tobytes()], pa.binary())], names=["range", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[r] = sums.get(r, 0) + np.frombuffer(raw, np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["range", "counts"])


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log importance of each bucket, by kind of gram."""
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORDS), slice(WORDS, WORDS + MARKS), slice(WORDS + MARKS, BUCKETS)):
        due = raw[part] / max(1, raw[part].sum()) * target[part].sum()
        out[part] = np.log((target[part] + SMOOTH) / (due + SMOOTH))
    return out


def features(texts: Texts, ratios: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """FEATURES figures a text; fold: which models' ratios weigh each text, the toxic ones being FOLDS further on."""
    out = np.zeros((len(texts.lengths), FEATURES))
    if not len(texts.lengths):
        return out
    own = np.repeat(fold, texts.lengths)
    for k, g in enumerate(grams(texts)):
        v = ratios[own, g]
        low = np.add.reduceat(np.minimum(0, v + DEEP), texts.begins)
        out[:, k] = np.add.reduceat(v, texts.begins) / texts.lengths
        out[:, 3 + k] = low / np.sqrt(texts.lengths)
        out[:, 6 + k] = np.log1p(-low)
        if k == 0:
            toxic = np.maximum(0, ratios[FOLDS + own, g] - DEEP)
            high = np.add.reduceat(toxic, texts.begins)
            out[:, 9] = high / np.sqrt(texts.lengths)
            out[:, 10] = np.log1p(high)
            out[:, 11] = np.maximum.reduceat(toxic, texts.begins)
    out[texts.lengths <= 1] = 0  # the end alone
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / deviation, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(len(w)), z.T @ (y - p) - 1e-1 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "deviation": deviation, "w": w}


def weigh(fit: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = np.c_[(x - fit["mean"]) / fit["deviation"], np.ones(len(x))]
    return np.clip(z @ fit["w"], -1e6, 1e6)


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The log weight with the fewest good rows below and bad ones above; in the middle of the widest of equal gaps."""
    order = np.argsort(weight, kind="stable")
    w, y = weight[order], good[order]
    at = np.flatnonzero(w[1:] > w[:-1]) + 1
    if not len(at):
        return float("-inf")
    wrong = np.cumsum(y)[at - 1] + (~y).sum() - np.cumsum(~y)[at - 1]
    best = at[wrong == wrong.min()]
    k = best[np.argmax(w[best] - w[best - 1])]
    return float((w[k - 1] + w[k]) / 2)


def held_out(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Log weights of labelled rows by fits on the other halves; by the fit on all where a half has one kind only."""
    out = weigh(logistic(x, y), x)
    for h in range(FOLDS):
        rest = y[half != h]
        if 0 < rest.sum() < len(rest):
            out[half == h] = weigh(logistic(x[half != h], rest), x[half == h])
    return out


def _other(fold: np.ndarray) -> np.ndarray:
    """The model for a document: of the other half if it is labelled (fold 0 or 1), else the first."""
    return np.where(fold == 0, 1, 0)


def _label_features(batches: Iterator[pa.RecordBatch], ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts, part in Texts.slices(batch):
            x = features(texts, ratios, _other(part.column("half").to_numpy()))
            yield pa.RecordBatch.from_arrays([part.column("good"), part.column("half"), *(pa.array(c) for c in x.T)], names=["good", "half", *(f"x{k}" for k in range(FEATURES))])


@tidied
def _weights(batches: Iterator[pa.RecordBatch], ratios: np.ndarray, fit: dict | None, half: str, weight: str, key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts, part in Texts.slices(batch):
            ids = part.column("doc_id").to_pylist()
            weights = weigh(fit, features(texts, ratios, _other(part.column(half).to_numpy(zero_copy_only=False)))) if fit else np.zeros(len(ids))
            chance = (np.array([zlib.crc32(b"gumbel %d" % (-1 if i is None else i)) for i in ids], dtype=np.float64) + 0.5) / (1 << 32)
            columns = {n: part.column(n) for n in part.schema.names if n != half}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(weights), pa.array(weights / TEMPERATURE - np.log(-np.log(chance)))], names=[*columns, weight, key])


class Judge:
    """Models from all documents and the labels; documents: (doc_id, text, ...)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, most: int = LABELS) -> None:
        spark = docs.sparkSession
        good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
        known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(good).alias("good"), F.max(F.coalesce("toxic", F.lit(0)) != 0).alias("toxic"))
        known = known.orderBy(F.xxhash64("label_id", F.lit(2)), "label_id").limit(most)
        # at most LABELS rows of 14 bytes
        self.known = F.broadcast(settle(known.withColumn("half", F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(FOLDS)).cast("int"))))
        given = self._labelled(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
        fold = F.when(F.col("good"), F.col("half")).when(F.col("toxic"), F.col("half") + FOLDS).otherwise(F.lit(-1))
        counted = given.select("doc_id", "text", fold.alias("fold")).mapInArrow(_counts, "range int, counts binary")
        sums = counted.repartition("range").mapInArrow(_added, "range int, counts binary").collect()
        self.fit, self.cut, self.ratios = None, float("-inf"), np.zeros((2 * FOLDS, BUCKETS))
        if sums:
            cells = [np.frombuffer(r["counts"], np.int64).reshape(MODELS, -1) for r in sorted(sums, key=lambda r: r["range"])]
            raw, *targets = np.concatenate(cells, axis=1)
            self.ratios = np.stack([log_ratios(raw, t) for t in targets])
        ratios = spark.sparkContext.broadcast(self.ratios)
        ours = given.where("half >= 0").select("doc_id", "text", "half", "good")
        shape = "good boolean, half int, " + ", ".join(f"x{k} double" for k in range(FEATURES))
        rows = ours.mapInArrow(lambda b: _label_features(b, ratios.value), shape).toArrow()  # fourteen figures a labelled document
        y = rows.column("good").to_numpy().astype(float) if rows.num_rows else np.empty(0)
        if 0 < y.sum() < len(y):
            x = np.stack([rows.column(f"x{k}").to_numpy() for k in range(FEATURES)], axis=1)
            self.fit = logistic(x, y)
            self.cut = best_cut(held_out(x, y, rows.column("half").to_numpy()), y > 0)

    def _labelled(self, docs: DataFrame) -> DataFrame:
        return docs.join(self.known, docs.doc_id == F.col("label_id"), "left").drop("label_id").withColumn("half", F.coalesce("half", F.lit(-1)))

    def weights(self, docs: DataFrame) -> tuple[DataFrame, str, str]:
        """The rows with their log weight (log odds of being good) and Gumbel key, and the names of these columns, which no other column has."""
        given = docs.sparkSession.sparkContext.broadcast((self.ratios, self.fit))
        label, half, weight, key = _free(docs.columns, "label", "half", "log_weight", "gumbel_key")
        known = self.known.select(F.col("label_id").alias(label), F.col("half").alias(half))
        rows = docs.join(known, docs.doc_id == F.col(label), "left").drop(label).withColumn(half, F.coalesce(half, F.lit(-1)))
        shape = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", {weight} double, {key} double"
        return rows.mapInArrow(lambda b: _weights(b, *given.value, half, weight, key), shape), weight, key


def _free(taken: list[str], *names: str) -> list[str]:
    """The names, with so many underscores before them that none of the columns has them."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name in have:
            name = "_" + name
        out.append(name)
    return out


def kth_greatest(keys: DataFrame, column: str, k: int, cells: int = 1024, few: int = 4096) -> float:
    """The k-th greatest of a column, from counts in intervals that narrow; never more than a few rows come to the driver."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    while True:
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / cells
        if width <= 0 or low + width == low:
            return low
        cell = F.least(F.lit(cells - 1), F.floor((F.col(column) - low) / width)).cast("int")
        counts = sorted(inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda r: -r["cell"])
        for row in counts:
            if k <= row["n"]:
                break
            k -= row["n"]
        if row["low"] == row["high"]:
            return row["low"]
        if row["n"] <= few:
            some = keys.where((F.col(column) >= row["low"]) & (F.col(column) <= row["high"])).select(column).toArrow().column(0).to_pylist()
            return sorted(some, reverse=True)[k - 1]
        low, high = row["low"], row["high"]


def chosen(docs: DataFrame, labels: DataFrame, texts: bool = True) -> tuple[DataFrame, str, str]:
    """The rows of docs that are kept, with log weight and Gumbel key, and the names of these columns; each text is weighed once."""
    judge = Judge(docs, labels)
    weighed, weight, key = judge.weights(docs)
    weighed = settle(weighed if texts else weighed.drop("text"), "snappy")
    k = weighed.where(F.col(weight) >= judge.cut).count()
    last = kth_greatest(weighed, key, k) if k else float("inf")
    return weighed.where(F.col(key) >= last), weight, key


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) of the documents that are kept."""
    kept, weight, key = chosen(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels, texts=False)
    return kept.select("doc_id", weight, key, F.lit(True).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    return chosen(docs, labels)[0].select(*[F.col(f"`{c}`") for c in docs.columns])
