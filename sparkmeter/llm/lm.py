"""Log-bilinear language model, trained by noise-contrastive estimation, and the log10 probability of each text.

Tokens are lower-cased words and one end a text. The model predicts a token's symbol from the CONTEXT symbols before it,
each by a matrix of its own place: the SHORTLIST most frequent tokens are symbols of their own, any other word is one of
CLASSES classes by its last bytes. P(token | before) = (1 - u) * softmax(sum over k of R[k][symbol k before] . Q[symbol]
+ b[symbol]) * (share of the token in its class), for tokens seen in training; an unseen token has probability u, the
share of training tokens that occur once. Over the vocabulary and one unseen token these sum to one: the softmax runs
over all symbols, as one matrix product per batch of contexts.

Everything is counted over all texts. Rows are dealt over chunks by a hash of id and row number, so that rows without an
id spread. Each chunk gives its words' hashes with their counts, once each; a window over equal hashes adds them up in
64 bits and tells every chunk the totals of its own words, so no count table is broadcast or collected. What reaches the
driver is bounded by the symbols: their counts, and how often each follows each in the whole corpus.

Training is in two steps, both by noise-contrastive estimation with unigram noise. On the driver the matrix of the
nearest place is fitted on the counts of neighbouring symbols, in expectation over all pairs and the noise. From there
every task runs through its own training texts once (and again until STEPS updates are done), in batches that share
their noise, and learns all places together; the tasks' models are averaged by their tokens.

Defined cases: null text is empty and has the one token end; words are told apart by 64-bit hashes; a null doc_id
counts as the text 'null' for the fold; repeated rows and ids are texts of their own; without training texts every
token is unseen and has probability 1; other columns of the input play no part. The input has to give its rows in the
same order whenever it is read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, tidied, tidy

SHORTLIST = 448
CLASSES = 191
SYMBOLS = SHORTLIST + CLASSES
BEGIN = SYMBOLS  # what stands before a text's first token
CONTEXT = 2
WIDTH = 32
NOISE = 10
PAIR_STEPS = 220
STEPS = 60
BATCH = 4096
SHARED = 64  # noise symbols a batch
RATE = 0.03
CHUNK = 12 << 20
FOLDS = 10
END = b" end"  # no word has a space in it


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % FOLDS == 0


def classes_of(words: list[bytes]) -> np.ndarray:
    """The class of each word, by its last bytes."""
    crc = zlib.crc32
    return np.array([crc(w[-3:]) for w in words], dtype=np.int64) % CLASSES


class Texts:
    """The tokens of some texts as numbers of their different words."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None]) -> None:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        get = number.__getitem__
        end = get(END)
        self.ids, rows = ids, []
        for text in texts:
            words = (text or b"").lower().split()
            row = np.empty(len(words) + 1, dtype=np.int32)
            row[:-1] = np.fromiter(map(get, words), dtype=np.int32, count=len(words))
            row[-1] = end
            rows.append(row)
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.tokens = np.concatenate(rows) if rows else np.empty(0, np.int32)
        self.words = list(number)
        self.begins = np.append(0, np.cumsum(self.lengths)[:-1]) if rows else np.empty(0, np.int64)
        self.out = np.array([held_out(i) for i in ids], dtype=bool)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words, repeat(42)), dtype=np.uint64, count=len(self.words))

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch) -> Texts:
        return cls(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist())

    @classmethod
    def slices(cls, batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[tuple[Texts, pa.RecordBatch]]:
        """The texts of a batch in turn, about so many bytes at a time, however long each is."""
        lengths = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths + 16)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            part = batch.slice(at, stop - at)
            yield cls.of(part), part
            at = stop

    def symbols(self, shortlist: np.ndarray) -> np.ndarray:
        """The symbol of each different word; shortlist: the hashes of the tokens that are their own, in order."""
        at = np.searchsorted(shortlist, self.hashes)
        own = np.zeros(len(self.hashes), dtype=bool)
        if len(shortlist):
            own = shortlist[np.minimum(at, len(shortlist) - 1)] == self.hashes
        classes = classes_of(self.words)
        return np.where(own, at, SHORTLIST + classes).astype(np.int32)


def contexts(now: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token of texts of these lengths the symbols before it, nearest first."""
    place = np.arange(len(now)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    before = np.full((len(now), CONTEXT), BEGIN, dtype=np.int32)
    for k in range(CONTEXT):
        inside = np.flatnonzero(place > k)
        before[inside, k] = now[inside - k - 1]
    return before


@tidy
def _counts_out(table: pa.Table) -> pa.Table:
    texts = Texts.of(table)
    train = np.repeat(~texts.out, texts.lengths)
    counts = np.bincount(texts.tokens[train], minlength=len(texts.words)).astype(np.int64)
    classes = classes_of(texts.words).astype(np.int16)
    number = table.column("chunk")[0].as_py()
    return pa.table({"chunk": pa.array(np.full(len(counts), number, np.int32)), "h": pa.array(texts.hashes.view(np.int64)), "n": pa.array(counts), "kind": pa.array(classes)})


@tidied
def _symbols_out(batches: Iterator[pa.RecordBatch], shortlist: bytes) -> Iterator[pa.RecordBatch]:
    """The training texts as symbols, a row for each slice: (symbols, lengths)."""
    own = np.frombuffer(shortlist, np.uint64)
    for batch in batches:
        for texts, _ in Texts.slices(batch):
            now = texts.symbols(own).astype(np.int16)[texts.tokens[np.repeat(~texts.out, texts.lengths)]]
            yield pa.RecordBatch.from_arrays([pa.array([now.tobytes()], pa.binary()), pa.array([texts.lengths[~texts.out].tobytes()], pa.binary())], names=["symbols", "lengths"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, symbols) of each slice."""
    for batch in batches:
        for symbols, lengths in zip(batch.column(0), batch.column(1), strict=True):
            now = np.frombuffer(symbols.as_buffer(), np.int16).astype(np.int32)
            yield contexts(now, np.frombuffer(lengths.as_buffer(), np.int64)), now


@tidied
def _neighbours(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """How often each symbol follows each in the training texts of a task, in ranges of contexts."""
    counts = np.zeros((SYMBOLS + 1) * SYMBOLS, dtype=np.int64)
    for before, now in _read(batches):
        np.add(counts, np.bincount(before[:, 0].astype(np.int64) * SYMBOLS + now, minlength=len(counts)), out=counts)
    parts = np.array_split(counts.reshape(SYMBOLS + 1, SYMBOLS), ranges)
    yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([p.astype(np.uint32 if p.max(initial=0) < 1 << 32 else np.uint64).tobytes() for p in parts], pa.binary())], names=["range", "counts"])


def _added(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    rows = [len(p) for p in np.array_split(np.arange(SYMBOLS + 1), ranges)]
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cells = rows[r] * SYMBOLS
            part = np.frombuffer(raw, np.uint32 if len(raw) == 4 * cells else np.uint64)
            sums[r] = sums.get(r, 0) + part.astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["range", "counts"])


def train(counts: np.ndarray, width: int = WIDTH, noise: int = NOISE, steps: int = PAIR_STEPS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R, Q and b from the counts of symbols after contexts: noise-contrastive estimation, the noise being unigrams.

    The gradient is the expectation over all counted pairs and over the noise, so no pair is sampled or left out.
    """
    rng = np.random.default_rng(seed)
    total = max(1.0, counts.sum())
    seen = counts / total
    unigram = (counts.sum(axis=0) + 0.1) / (counts.sum() + 0.1 * counts.shape[1])
    drawn = noise * seen.sum(axis=1, keepdims=True) * unigram
    offset = np.log(noise * unigram)
    params = [rng.normal(0, 0.1, (counts.shape[0], width)), rng.normal(0, 0.1, (counts.shape[1], width)), np.log(unigram)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        r, q, b = params
        real = 1 / (1 + np.exp(-(r @ q.T + b - offset)))
        grad = seen * (1 - real) - drawn * real
        rate = 0.05 * min(1.0, 2 * (1 - (step - 1) / steps))
        for i, g in enumerate((grad @ q, grad.T @ r, grad.sum(axis=0))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)
    return tuple(p.astype(np.float32) for p in params)


class Model:
    """R: a matrix for each place before; Q and b: one row and number a symbol."""

    def __init__(self, r: np.ndarray, q: np.ndarray, b: np.ndarray) -> None:
        self.r, self.q, self.b = r, q, b

    @classmethod
    def begun(cls, r: np.ndarray, q: np.ndarray, b: np.ndarray) -> Model:
        """From the nearest place's matrix; the others begin at zero."""
        return cls(np.concatenate([r[None], np.zeros((CONTEXT - 1, *r.shape), r.dtype)]), q, b)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.r.ravel(), self.q.ravel(), self.b])

    @classmethod
    def of(cls, flat: np.ndarray) -> Model:
        cells = (SYMBOLS + 1) * WIDTH * CONTEXT
        return cls(flat[:cells].reshape(CONTEXT, SYMBOLS + 1, WIDTH), flat[cells : cells + SYMBOLS * WIDTH].reshape(SYMBOLS, WIDTH), flat[cells + SYMBOLS * WIDTH :])

    def predicted(self, before: np.ndarray) -> np.ndarray:
        out = self.r[0][before[:, 0]]
        for k in range(1, CONTEXT):
            out = out + self.r[k][before[:, k]]
        return out

    def learn(self, before: np.ndarray, now: np.ndarray, noise: np.ndarray, unigram: np.ndarray, squares: list[np.ndarray]) -> None:
        """One update: the tokens that followed against noise symbols that all of them share; steps shrink with what each row has moved."""
        made = self.predicted(before)
        share = np.log(len(noise) * unigram).astype(np.float32)
        of_now, of_noise = self.q[now], self.q[noise]
        up = _sigmoid(share[now] - np.einsum("ij,ij->i", made, of_now) - self.b[now])
        false = made @ of_noise.T
        false += self.b[noise] - share[noise]
        false = _sigmoid(false)
        up_made, of_now = up[:, None] * made, of_now * up[:, None]
        of_now -= false @ of_noise
        gains = [_rows(before[:, k], of_now, SYMBOLS + 1) for k in range(CONTEXT)]
        gain_q = _rows(now, up_made, SYMBOLS)
        np.add.at(gain_q, noise, -(false.T @ made))
        gain_b = np.bincount(now, weights=up, minlength=SYMBOLS)
        np.add.at(gain_b, noise, -false.sum(axis=0))
        for target, gain, square in zip((*self.r, self.q, self.b), (*gains, gain_q, gain_b), squares, strict=True):
            gain = gain.astype(np.float32) / len(now)
            square += gain * gain
            target += RATE * gain / np.sqrt(square + 1e-12)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _rows(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each key."""
    order = np.argsort(keys.astype(np.int16), kind="stable")  # by radix
    held = keys[order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    out[held[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


@tidied
def _trained(batches: Iterator[pa.RecordBatch], begun: np.ndarray, unigram: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """A task's model after its training texts, times their tokens, in ranges; and the tokens."""
    model, seen, done = Model.of(begun.copy()), 0, 0
    rng = np.random.default_rng(5)
    squares = [np.full_like(p, 1e-6) for p in (*model.r, model.q, model.b)]
    ends = np.cumsum(unigram)

    def update(before: np.ndarray, now: np.ndarray) -> int:
        order = rng.permutation(len(now))
        for at in range(0, len(now), BATCH):
            some = order[at : at + BATCH]
            noise = np.minimum(np.searchsorted(ends, rng.random(SHARED)), SYMBOLS - 1)
            model.learn(before[some], now[some], noise, unigram, squares)
        return -(-len(now) // BATCH)

    held = None
    for held in _read(batches):
        seen += len(held[1])
        done += update(*held)
    while held is not None and len(held[1]) and done < STEPS:  # a task of few texts
        done += update(*held)
    if seen:
        parts = np.array_split(model.flat().astype(np.float64) * seen, ranges)
        yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([seen] * ranges, pa.int64())], names=["range", "sums", "tokens"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    tokens: dict[int, int] = {}
    for batch in batches:
        for r, raw, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            sums[r] = sums.get(r, 0) + np.frombuffer(raw, np.float64)
            tokens[r] = tokens.get(r, 0) + n
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / tokens[r]).tobytes() for r, x in sums.items()], pa.binary())], names=["range", "mean"])


def log_probabilities(model: Model, before: np.ndarray, batch: int = 2048) -> Iterator[np.ndarray]:
    """log10 P(symbol | contexts), normalised, by batches of contexts."""
    for at in range(0, len(before), batch):
        logits = model.predicted(before[at : at + batch]) @ model.q.T + model.b
        logits -= logits.max(axis=1, keepdims=True)
        yield (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))) / np.float32(np.log(10))


def _symbol_logs(model: Model, before: np.ndarray, now: np.ndarray, batch: int = 2048) -> np.ndarray:
    """log10 P of each token's symbol; what equal contexts are normalised by is worked out once."""
    key = before[:, 0].astype(np.int64)
    for k in range(1, CONTEXT):
        key = key * (SYMBOLS + 1) + before[:, k]
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    made = model.predicted(before[first])
    whole = np.empty(len(first), dtype=np.float32)
    for at in range(0, len(first), batch):
        logits = made[at : at + batch] @ model.q.T + model.b
        top = logits.max(initial=0.0)
        logits -= top
        whole[at : at + batch] = np.log(np.maximum(np.exp(logits, out=logits).sum(axis=1), 1e-37)) + top
    out = np.empty(len(now))
    for at in range(0, len(now), 1 << 16):
        some = slice(at, at + (1 << 16))
        out[some] = np.einsum("ij,ij->i", made[which[some]], model.q[now[some]]) + model.b[now[some]] - whole[which[some]]
    return out / np.log(10)


@tidy
def _scores(table: pa.Table, said: pa.Table, model: dict) -> pa.Table:
    texts = Texts.of(table)
    h, totals = said.column("h").to_numpy().view(np.uint64), said.column("total").to_numpy()
    order = np.argsort(h)
    counts = totals[order][np.searchsorted(h[order], texts.hashes)]
    symbols = texts.symbols(model["shortlist"])
    n, v = model["n"], model["v"]
    base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
    in_class = np.where(symbols < SHORTLIST, 0.0, np.log10((counts + 0.1) / np.maximum(model["weights"][np.maximum(symbols - SHORTLIST, 0)], 0.1)))
    known = counts > 0
    unseen = np.log10(model["unseen"])
    seen = np.log10(max(1 - model["unseen"], 1e-300))
    now = symbols[texts.tokens]
    logs = _symbol_logs(model["model"], contexts(now, texts.lengths), now)
    token = np.where(known[texts.tokens], logs + in_class[texts.tokens] + seen, unseen)
    add = lambda x: np.add.reduceat(x, texts.begins) if len(texts.begins) else np.empty(0)
    return pa.table({
        "doc_id": table.column("doc_id"), "held_out": pa.array(texts.out), "n_tokens": pa.array(texts.lengths),
        "n_known": pa.array(add(known[texts.tokens].astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(len(texts.ids), n, np.int64)),
        "base_score": pa.array(add(base[texts.tokens])), "score": pa.array(add(token)),
    })


def scored(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    chunks = max(1, -(-((size[0] or 0) + 16 * size[1]) // chunk))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))
    by_chunk = dealt.repartition(chunks, "chunk").groupBy("chunk")
    asked = by_chunk.applyInArrow(lambda t: _counts_out(t), "chunk int, h long, n long, kind short")
    same = Window.partitionBy("h").orderBy("chunk")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    answers = settle(asked.select("chunk", "h", "kind", F.sum("n").over(whole).alias("total"), (F.row_number().over(same) == 1).alias("first")))
    words = answers.where("first")
    one = words.agg(F.sum("total"), F.count_if(F.col("total") > 0), F.count_if(F.col("total") == 1)).first()
    n, v, once = (int(x or 0) for x in one)
    kinds = words.where("total > 0").groupBy("kind").agg(F.sum("total").alias("sum"), F.count("*").alias("words")).collect()  # at most CLASSES rows
    top = words.where("total > 0").orderBy(F.col("total").desc(), "h").limit(SHORTLIST).select("h", "total", "kind").collect()
    shortlist = np.sort(np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64))
    weights = np.zeros(CLASSES)
    for r in kinds:
        weights[r["kind"]] += r["sum"] + 0.1 * r["words"]
    for r in top:
        weights[r["kind"]] -= r["total"] + 0.1
    ranges = 16
    coded = settle(rows.mapInArrow(lambda b: _symbols_out(b, shortlist.tobytes()), "symbols binary, lengths binary"))
    near = coded.mapInArrow(lambda b: _neighbours(b, ranges), "range int, counts binary")
    near = near.repartition("range").mapInArrow(lambda b: _added(b, ranges), "range int, counts binary").collect()
    cells = [np.frombuffer(r["counts"], np.int64) for r in sorted(near, key=lambda r: r["range"])]
    counts = np.concatenate(cells).reshape(SYMBOLS + 1, SYMBOLS).astype(np.float64) if cells else np.zeros((SYMBOLS + 1, SYMBOLS))
    begun = Model.begun(*train(counts)).flat()
    unigram = (counts.sum(axis=0) + 0.1) / (counts.sum() + 0.1 * SYMBOLS)
    start = spark.sparkContext.broadcast((begun, unigram))
    made = coded.mapInArrow(lambda b: _trained(b, *start.value, ranges), "range int, sums binary, tokens long")
    mean = made.repartition("range").mapInArrow(_averaged, "range int, mean binary").collect()
    flat = np.concatenate([np.frombuffer(r["mean"], np.float64) for r in sorted(mean, key=lambda r: r["range"])]) if mean else begun
    model = {"model": Model.of(flat.astype(np.float32)), "shortlist": shortlist, "weights": weights, "n": n, "v": v, "unseen": (once + 0.1) / (n + 0.1)}
    given = spark.sparkContext.broadcast(model)
    said = answers.select("chunk", "h", "total")
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk.cogroup(said.groupBy("chunk")).applyInArrow(lambda t, s: _scores(t, s, given.value), shape)
