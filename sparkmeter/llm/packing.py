"""Best-fit packing of token sequences by a grouping genetic algorithm.

Texts become token ids in one pass, cut into pieces of at most SIZE tokens; only the pieces' figures go on, never the
ids. Full pieces are sequences of their own. The others are dealt over islands of about ISLAND pieces by their row
number, so that copies, however many, spread evenly. An island evolves packings, which begin in random orders: a packing
is a set of bins (a gene is a whole bin); crossover injects well-filled bins of one parent into the other, removes bins
that hold any of their pieces, and puts the displaced pieces back by best fit, longest first. After a round the elite,
bins with a waste of at most CLOSED, are final; the other bins migrate, whole, to islands of the next round, where they
stand beside bins of other islands as one parent of the new population. A round never needs more bins than came in, and
the last one closes all.

Defined cases: null text is empty and gives one piece with the end id alone; null or repeated doc_id and repeated rows
are packed as rows of their own; an empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidied

SIZE = 1024
END = 2
ISLAND = 2048
CLOSED = 4
ROUNDS = 3
POPULATION = 4
GENERATIONS = 60
CACHE = 100_000


class WordIds(dict):
    """From a word after a space to its ids as little-endian 32-bit numbers.

    Two generations of at most CACHE words: when the young one is full it becomes the old one, whose words come back as
    they recur. What is held is bounded, and words that recur stay.
    """

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.encode(" " + word), dtype="<u4").tobytes()
        self[word] = ids
        return ids


@lru_cache(maxsize=1)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=1)
def _ranked(ranks: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=1)
def _special(vocabulary: str) -> tuple[str, ...]:
    with open(vocabulary, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", ()))


def encoder(vocabulary: str, ranks: str | None = None):
    """A function from text to ids as bytes, the same as the vocabulary's own tokenizer gives.

    Byte-level BPE with the usual split pattern never joins a space's left to its right, unless white space follows; so
    a text can be encoded word by word, and words recur. Texts with other white space after a space, or with a special
    token in them, go through the tokenizer whole. The known words go with the function, so a task leaves none behind.
    """
    special = _special(vocabulary)
    plain = lambda text: _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    fast = _ranked(ranks).encode_ordinary if ranks is not None else plain
    words = WordIds(fast)
    get = words.__getitem__

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in special):
            return np.array(plain(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        if "" in rest or not first or any(s in text for s in (" \n", " \t", " \r")) or any(w[0].isspace() for w in rest):
            return np.array(fast(text), dtype="<u4").tobytes()
        return np.array(fast(first), dtype="<u4").tobytes() + b"".join(map(get, rest))

    return encode


@tidied
def _cut(batches: Iterator[pa.RecordBatch], vocabulary: str, ranks: str | None, size: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary, ranks)
    end = np.array([END], dtype="<u4").tobytes()
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + end
            n = len(ids) // 4
            first = n % size or size
            for piece, stop in enumerate(range(min(first, n), n + 1, size)):
                start = max(0, stop - size) if piece else 0
                for column, value in zip(out, (row, doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                    column.append(value)
                row += 1
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None, size: int = SIZE) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda b: _cut(b, vocabulary, ranks, size), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], size: int, longest: bool = True) -> list[list[int]]:
    """Put items, longest first or in their order, each into the fullest bin that has room."""
    bins = [list(b) for b in bins]
    room = sorted((size - n, k) for k, n in enumerate(_fills(lengths, bins)))
    for i in sorted(items, key=lengths.__getitem__, reverse=True) if longest else items:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at == len(room):
            bins.append([i])
            insort(room, (size - n, len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            insort(room, (left - n, k))
    return bins


def _fills(lengths: list[int], bins: list[list[int]]) -> list[int]:
    get = lengths.__getitem__
    return [sum(map(get, b)) for b in bins]


def _worth(lengths: list[int], bins: list[list[int]]) -> tuple[int, int]:
    """Smaller is better: bins, then less of full bins."""
    return len(bins), -sum(n * n for n in _fills(lengths, bins))


def cross(lengths: list[int], giver: list[list[int]], taker: list[list[int]], size: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject well-filled bins of the giver into the taker; bins that share a piece with them go, displaced pieces are best-fitted."""
    fill = np.array(_fills(lengths, giver))
    good = np.flatnonzero(fill >= np.quantile(fill, rng.uniform(0.2, 0.8)))
    given = [giver[k] for k in good[rng.random(len(good)) < rng.uniform(0.3, 1.0)].tolist()]
    held = {i for b in given for i in b}
    kept, loose = [], []
    for b in taker:
        if held.isdisjoint(b):
            kept.append(b)
        else:
            loose += [i for i in b if i not in held]
    # the emptiest bins, seldom many of them, are opened too, so that their pieces can find better places
    order = np.argsort(-np.array(_fills(lengths, kept)), kind="stable").tolist() if kept else []
    stay = int(len(kept) * (1 - rng.uniform(0, 1) ** 2))
    loose += [i for k in order[stay:] for i in kept[k]]
    return best_fit(lengths, loose, given + [kept[k] for k in order[:stay]], size)


def evolve(lengths: np.ndarray | list[int], came: list[list[int]], size: int = SIZE, seed: int = 0, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing found; came: bins that migrated here, a whole packing, or nothing.

    The others of the population begin with the pieces in random orders, each piece in the fullest bin that has room.
    """
    lengths = [int(n) for n in lengths]
    rng = np.random.default_rng([seed, len(lengths)])
    least = -(-sum(lengths) // size)
    people = [came] if came else []
    while len(people) < POPULATION:
        people.append(best_fit(lengths, rng.permutation(len(lengths)).tolist(), [], size, longest=False))
    ranked = sorted(((_worth(lengths, p), n, p) for n, p in enumerate(people)), key=lambda r: r[:2])
    born = len(ranked)
    for _ in range(generations * min(16, max(1, ISLAND // max(1, len(lengths))))):  # a small island's cost as much as a full one's
        if ranked[0][0][0] <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False).tolist()
        child = cross(lengths, ranked[a][2], ranked[b][2], size, rng)
        worth = _worth(lengths, child)
        if worth < ranked[-1][0] and all(worth != r[0] for r in ranked):
            ranked[-1] = (worth, born, child)
            born += 1
            ranked.sort(key=lambda r: r[:2])
    return ranked[0][2]


def _island(group: pd.DataFrame, size: int, seed: int, last: bool, generations: int) -> pd.DataFrame:
    group = group.sort_values("uid", ignore_index=True)
    lengths = group["length"].to_numpy()
    came = [b.tolist() for b in group.groupby("bin", sort=True).indices.values()] if (group["bin"] >= 0).all() else []
    made = evolve(lengths, came, size, seed, generations)
    own, at, final = np.empty(len(group), np.int64), np.empty(len(group), np.int64), np.empty(len(group), bool)
    for b in made:
        b.sort()
        own[b] = group["uid"].iloc[b[0]]  # a bin is named by its first piece
        at[b] = np.append(0, np.cumsum(lengths[b])[:-1])
        final[b] = last or size - lengths[b].sum() <= CLOSED
    return pd.DataFrame({"uid": group["uid"], "length": lengths, "bin": own, "at": at, "final": final})


def _islander(size: int, seed: int, last: bool, generations: int):
    return lambda group: _island(group, size, seed, last, generations)


def pack(cut: DataFrame, size: int = SIZE, island: int = ISLAND, rounds: int = ROUNDS, seed: int = 11, generations: int = GENERATIONS) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length); uid differs from row to row."""
    done = cut.where(F.col("length") == size).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = cut.where(F.col("length") < size).select("uid", "length", F.lit(-1).cast("long").alias("bin"))
    for turn in range(rounds):
        last = turn == rounds - 1
        islands = max(1, round(open_.count() / island))
        # a bin migrates whole: its pieces hash alike
        place = F.when(F.col("bin") < 0, F.col("uid")).otherwise(F.col("bin"))
        dealt = open_.withColumn("isle", F.pmod(F.xxhash64(place, F.lit(seed + turn)), F.lit(islands)).cast("int"))
        dealt = dealt.repartition(-(-islands // 4), "isle")  # the rows are few bytes, the work is not
        made = settle(dealt.groupBy("isle").applyInPandas(_islander(size, seed + turn, last, generations), "uid long, length long, bin long, at long, final boolean"))
        done = done.unionByName(made.where("final").select("uid", F.col("bin").alias("sequence_id"), F.col("at").alias("offset")))
        open_ = made.where("not final").select("uid", "length", "bin")
    return done


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs."""
    cut = settle(pieces(docs, vocabulary, ranks, size))
    placed = pack(cut.select("uid", "length"), size)
    return cut.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
