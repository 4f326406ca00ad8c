"""Suffix-array dedup: remove every byte covered by a SPAN-byte string that also starts earlier in the table.

The order of suffixes is by document (doc_id, null last; rows that share one in the order of the table) and start. A
SPAN-byte window is known by its anchor: the leftmost GRAM-byte string in it with the least hash. Equal windows have
equal anchors at equal offsets, so it is enough to order the suffixes that begin at anchors, each with the few bytes
before it that its own windows reach back over; no window is left out.

1. Rows are dealt over chunks of about CHUNK bytes, by a hash of id and row number, so that rows without an id or with
   one id spread. Each chunk gives its anchors' hashes, once each with their count; a window over equal hashes tells
   which occur more than once in the table. (Anchors that occur once cannot repeat: nothing else is left out by this.)
2. Each chunk sorts the suffixes at its recurring anchors. Equal ones are settled in the chunk: the first stands for
   all, so a passage in a third of all documents leaves a chunk once. The sorted runs travel front-coded (length of the
   prefix shared with the one before, and the rest). Anchors with more than HOT occurrences are split into their windows,
   which are dealt by their whole SPAN bytes, so that no key can gather what only shares an anchor.
3. Runs are merged in levels of FAN: a chunk sends at most FAN runs, a merge takes at most FAN and sends FAN on, until
   the parts are as many as the chunks; so the rows exchanged grow in proportion to the chunks. Each merge is a loser
   tree whose players carry the length of the prefix they share with the last winner: the longer one wins without a look
   at the bytes, and only bytes beyond a known prefix are ever compared. In the last level the merged order gives the
   lengths of common prefixes; within a group that shares an anchor, windows that are equal and not first give removed
   spans, as places in their chunk, where they are united.

Defined cases: null text is empty; texts under SPAN bytes keep all; rows that share a doc_id are documents one after
another; a null doc_id comes after all others; an empty table gives no rows; other columns of the input play no part.
The input has to give its rows in the same order whenever it is read (a file does, and so does a checkpoint).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

SPAN = 100
GRAM = 48
CHUNK = 5 << 20
HOT = 256
FAN = 256
SEGMENT = 1 << 17
LAST = (1 << 63) - 1

_MULT = 6364136223846793005
_BYTES = np.random.default_rng(1848).integers(1, 1 << 63, 256, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MULT, n, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of each gram-byte string: polynomial, from strings of half the length, then mixed."""
    with np.errstate(over="ignore"):
        have, n, out, done = _BYTES[data], 1, None, 0
        while True:
            if gram & n:
                out = have.copy() if out is None else out[: len(have) - done] * _power(n) + have[done:]
                done += n
            if n * 2 > gram:
                break
            have = have[:-n] * _power(n) + have[n:]
            n *= 2
        out = out[: len(data) - gram + 1]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many neighbours."""
    n = 1
    while n * 2 <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def anchors(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts that lie one after another in data: (anchor, its hash, first window, last window); windows by start."""
    starts = np.append(0, ends[:-1])
    found: list[tuple] = []
    reach = span - gram + 1
    for at in range(0, max(0, len(data) - span + 1), SEGMENT):
        part = data[at : at + SEGMENT + span - 1]
        if len(part) < span:
            break
        h = gram_hashes(part, gram)
        packed = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        place = (_least(packed, reach) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        q = place[first]
        doc = np.searchsorted(ends, q + at, "right")
        low, high = np.maximum(first + at, starts[doc]), np.minimum(last + at, ends[doc] - span)
        ok = low <= high
        found.append((q[ok] + at, h[q[ok]], low[ok], high[ok]))
    if not found:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


class Chunk:
    """The documents of one chunk in their order, as one run of bytes."""

    def __init__(self, table: pa.Table) -> None:
        ids = np.array([LAST if d is None else d for d in table.column("doc_id").to_pylist()], dtype=np.int64)
        rows = table.column("row").to_numpy()
        texts = table.column("text").cast(pa.binary()).to_pylist()
        self.order = np.lexsort((rows, ids)).tolist()
        self.ids, self.rows = ids[self.order], rows[self.order]
        self.texts = [texts[i] or b"" for i in self.order]
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.whole = b"".join(self.texts)
        self.data = np.frombuffer(self.whole, dtype=np.uint8)


@tidy
def _hashes_out(table: pa.Table) -> pa.Table:
    chunk = Chunk(table)
    _, h, _, _ = anchors(chunk.data, chunk.ends)
    own, times = np.unique(h, return_counts=True)
    number = table.column("chunk")[0].as_py()
    return pa.table({"chunk": pa.array(np.full(len(own), number, np.int32)), "h": pa.array(own.view(np.int64)), "n": pa.array(times.astype(np.int64))})


#: lot: the chunks whose runs meet in one merge; the others are arrays of the run's rows, packed.
_RUN = "part long, lot int, kind int, chunk binary, lcp binary, size binary, rest binary, left_size binary, lefts binary, doc binary, row binary, at binary, low binary, high binary"
_COLUMNS = [c.split()[0] for c in _RUN.split(", ")]
_KINDS = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _RUN.split(", ")])
#: A row of kind SPANS holds removed spans of chunks: chunk, at (start), doc (end).
PLAIN, WINDOWS, SPANS = 0, 1, 2
#: What suffixes of one group share.
TOGETHER = {PLAIN: GRAM, WINDOWS: SPAN}


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which so much is known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return known + (len(x) * 8 - (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length()) // 8


def _pressed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _whole(raw: bytes | None) -> bytes | None:
    return zstandard.ZstdDecompressor().decompress(raw) if raw is not None else None


def front_coded(rows: list[tuple]) -> dict[str, bytes]:
    """A run of sorted (right, left, doc, row, at, low, high, chunk)."""
    lcp, rests, before = bytearray(), [], b""
    for row in rows:
        right = row[0]
        n = _shared(before, right, 0)
        lcp.append(n)
        rests.append(right[n:])
        before = right
    column = lambda i, kind: np.array([r[i] for r in rows], dtype=kind).tobytes()
    return {
        "lcp": bytes(lcp), "size": bytes(map(len, rests)), "rest": b"".join(rests), "left_size": bytes(len(r[1]) for r in rows), "lefts": b"".join(r[1] for r in rows),
        "doc": column(2, np.int64), "row": column(3, np.int64), "at": column(4, np.int32), "low": column(5, np.uint8), "high": column(6, np.uint8), "chunk": column(7, np.int32),
    }


def _packed(part: int, lot: int, kind: int, columns: dict[str, bytes]) -> dict:
    return {"part": part, "lot": lot, "kind": kind} | {c: _pressed(x) for c, x in columns.items()}


def _united(chunk: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order, those that touch joined; a chunk is far from the next one."""
    a, b = chunk.astype(np.int64) << 32, None
    a, b = a + start, a + end
    order = np.argsort(a, kind="stable")
    a, far = a[order], np.maximum.accumulate(b[order])
    first = np.append(True, a[1:] > far[:-1])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(a) - 1)
    return (a[first] >> 32).astype(np.int32), (a[first] & 0xFFFFFFFF).astype(np.int32), (far[last] & 0xFFFFFFFF).astype(np.int32)


@tidy
def _runs_out(table: pa.Table, flags: pa.Table, parts: int, fan: int) -> pa.Table:
    if not table.num_rows or not flags.num_rows:
        return _KINDS.empty_table()
    number = table.column("chunk")[0].as_py()
    lot = number // fan
    chunk = Chunk(table)
    q, h, low, high = anchors(chunk.data, chunk.ends)
    known, warm = flags.column("h").to_numpy().view(np.uint64), flags.column("hot").to_numpy()
    at = np.isin(h, known)
    q, h, low, high = q[at], h[at], low[at], high[at]
    is_hot = np.isin(h, known[warm])
    doc = np.searchsorted(chunk.ends, q, "right")
    whole, runs, first_of = chunk.whole, defaultdict(list), set()
    lost: list[tuple[int, int]] = []
    place = (h >> np.uint64(32)).astype(np.int64) % parts
    ids, rows = chunk.ids.tolist(), chunk.rows.tolist()
    for p, d, a, b, split, to in zip(q.tolist(), doc.tolist(), low.tolist(), high.tolist(), is_hot.tolist(), place.tolist(), strict=True):
        # every window of a later equal stretch starts earlier too: here, in this chunk, is where that is settled
        stretch = whole[a : b + SPAN]
        mark = (stretch, p - a)
        if mark in first_of:
            lost.append((a, b + SPAN))
            continue
        first_of.add(mark)
        if not split:
            runs[PLAIN, to].append((whole[p : b + SPAN], whole[a:p][::-1], ids[d], rows[d], p, p - b, p - a, number))
            continue
        for s in range(a, b + 1):
            window = whole[s : s + SPAN]
            if window in first_of:
                lost.append((s, s + SPAN))
            else:
                first_of.add(window)
                runs[WINDOWS, hash_of(window) % parts].append((window, b"", ids[d], rows[d], s, 0, 0, number))
    first_of.clear()
    out = []
    for key in list(runs):
        run = runs.pop(key)
        run.sort()
        out.append(_packed(key[1], lot, key[0], front_coded(run)))
    if lost:
        start, end = (np.array(x, dtype=np.int64) for x in zip(*lost, strict=True))
        _, start, end = _united(np.zeros(len(start), np.int64), start, end)
        spans = {"chunk": np.full(len(start), number, np.int32), "at": start, "doc": end}
        out.append(_packed(number % parts, lot, SPANS, {c: x.tobytes() for c, x in spans.items()}))
    return pa.Table.from_pylist(out, schema=_KINDS)


def hash_of(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=7).digest(), "big")


class Run:
    """A front-coded run: one row at a time, with the length of the prefix it shares with the row before."""

    def __init__(self, row: dict) -> None:
        self.row, self.n = row, len(row["lcp"])
        self.doc, self.rows, self.at, self.chunk = (np.frombuffer(row[c], k) for c, k in (("doc", np.int64), ("row", np.int64), ("at", np.int32), ("chunk", np.int32)))
        self.low, self.high = row["low"], row["high"]
        self.ends = np.cumsum(np.frombuffer(row["size"], np.uint8), dtype=np.int64)
        self.left_ends = np.cumsum(np.frombuffer(row["left_size"], np.uint8), dtype=np.int64)
        self.i, self.right = -1, b""

    def next(self) -> int:
        """Length shared with the row before, or -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        n, end = self.row["lcp"][self.i], self.ends[self.i]
        self.right = self.right[:n] + self.row["rest"][end - self.row["size"][self.i] : end]
        return n

    def now(self) -> tuple:
        """(left, doc, row, at, low, high, chunk)"""
        i, end = self.i, self.left_ends[self.i]
        return self.row["lefts"][end - self.row["left_size"][i] : end], int(self.doc[i]), int(self.rows[i]), int(self.at[i]), self.low[i], self.high[i], int(self.chunk[i])


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, tuple]]:
    """(length shared with the row before, suffix, row) in the order of all runs, by a loser tree.

    share[r] is what the head of run r shares with the last winner. Of two heads the one that shares more comes first;
    only if they share equally are bytes compared, from there on; the loser then shares with the winner what was found.
    """
    k = len(runs)
    share = [0] * k
    alive = [r.next() >= 0 for r in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if not alive[b]:
            return a, b
        if not alive[a]:
            return b, a
        x, y = share[a], share[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        left, right = runs[a].right, runs[b].right
        n = _shared(left, right, x)
        if n == len(left) or (n < len(right) and left[n] < right[n]):
            share[b] = n
            return a, b
        share[a] = n
        return b, a

    losers = [-1] * max(1, k)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    if not k:
        return
    top = build(1) if k > 1 else 0
    while alive[top]:
        yield share[top], runs[top].right, runs[top].now()
        n = runs[top].next()
        alive[top], share[top] = n >= 0, max(n, 0)
        node = (top + k) >> 1
        while node >= 1 and k > 1:
            top, losers[node] = play(top, losers[node])
            node >>= 1


def _small(group: list[tuple], lcps: list[int], give) -> None:
    """Pairs within a group of a few."""
    order = sorted(range(len(group)), key=lambda i: group[i][1:4])
    for n, j in enumerate(order):
        left, _, _, _, low, high, _ = group[j]
        for i in order[:n]:
            right = min(lcps[min(i, j) + 1 : max(i, j) + 1])
            a, b = max(low, group[i][4], SPAN - right), min(high, group[i][5])
            if a <= b:
                b = min(b, _shared(left, group[i][0], 0))
                if a <= b:
                    give(group[j], b, a)


def _large(group: list[tuple], lcps: list[int], give) -> None:
    """For each offset of the anchor in a window: classes of equal windows, from the classes of what follows and precedes."""
    n = len(group)
    order = np.array(sorted(range(n), key=lambda i: group[i][1:4]))
    by_left = sorted(range(n), key=lambda i: group[i][0])
    shared = np.array([0] + [_shared(group[a][0], group[b][0], 0) for a, b in zip(by_left[:-1], by_left[1:], strict=True)])
    low, high = np.array([g[4] for g in group]), np.array([g[5] for g in group])
    following = np.array(lcps)
    following[0] = 0
    left = np.empty(n, dtype=np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        right = np.cumsum(following < SPAN - o)
        left[by_left] = np.cumsum(shared < o)
        some = order[(low[order] <= o) & (high[order] >= o)]
        _, first = np.unique(right[some] * (n + 1) + left[some], return_index=True)
        later = np.ones(len(some), dtype=bool)
        later[first] = False
        for j in some[later].tolist():
            give(group[j], o, o)


def _unpacked(rows: list[dict], kind: int) -> list[Run]:
    return [Run(r | {c: _whole(r[c]) for c in _COLUMNS[3:]}) for r in rows if r["kind"] == kind]


@tidy
def _merge_on(table: pa.Table, level: int, fan: int) -> pa.Table:
    """Merges of one part and lot, as runs of the next level's parts."""
    rows = table.to_pylist()
    part, lot = rows[0]["part"] * fan, rows[0]["lot"] // fan
    out = [r | {"part": part, "lot": lot} for r in rows if r["kind"] == SPANS]
    for kind in (PLAIN, WINDOWS):
        runs: dict[int, list[tuple]] = defaultdict(list)
        for _, right, row in merged(_unpacked(rows, kind)):
            runs[hash_of(right[: TOGETHER[kind]]) // fan**level % fan].append((right, *row))
        out += [_packed(part + digit, lot, kind, front_coded(run)) for digit, run in runs.items()]
    return pa.Table.from_pylist(out, schema=_KINDS)


@tidy
def _merge_part(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    spans: list[tuple[int, int, int]] = []

    def give(row: tuple, most: int, least: int) -> None:
        spans.append((row[6], row[3] - most, row[3] - least + SPAN))

    for kind, together in TOGETHER.items():
        group: list[tuple] = []
        lcps: list[int] = []

        def close(kind: int = kind) -> None:
            if len(group) < 2:
                return
            if kind == WINDOWS:
                first = min(range(len(group)), key=lambda i: group[i][1:4])
                for i, row in enumerate(group):
                    if i != first:
                        give(row, 0, 0)
            else:
                (_small if len(group) <= 12 else _large)(group, lcps, give)

        for n, _, row in merged(_unpacked(rows, kind)):
            if n < together:
                close()
                group.clear()
                lcps.clear()
            group.append(row)
            lcps.append(n)
        close()
    found = [np.array(spans, dtype=np.int64).reshape(-1, 3).T]
    found += [np.stack([np.frombuffer(_whole(r[c]), np.int32).astype(np.int64) for c in ("chunk", "at", "doc")]) for r in rows if r["kind"] == SPANS]
    every = np.concatenate(found, axis=1)
    columns = _united(*every) if every.shape[1] else every.astype(np.int32)
    return pa.table(dict(zip(("chunk", "at", "stop"), map(pa.array, columns), strict=True)))


class Kept:
    """The documents of a chunk without the spans that are removed from it."""

    def __init__(self, table: pa.Table, spans: pa.Table) -> None:
        self.chunk = chunk = Chunk(table)
        self.begins = np.append(0, chunk.ends[:-1])
        change = np.zeros(len(chunk.data) + 1, dtype=np.int32)
        np.add.at(change, spans.column("at").to_numpy(), 1)
        np.add.at(change, spans.column("stop").to_numpy(), -1)
        self.gone = np.cumsum(change[:-1], dtype=np.int32) > 0

    def __iter__(self) -> Iterator[tuple[bytes, bytes, np.ndarray]]:
        """(text, what remains, mask of removed bytes) of each document in the chunk's order."""
        for raw, begin, end in zip(self.chunk.texts, self.begins.tolist(), self.chunk.ends.tolist(), strict=True):
            mask = self.gone[begin:end]
            yield raw, self.chunk.data[begin:end][~mask].tobytes() if mask.any() else raw, mask


@tidy
def _digests(table: pa.Table, spans: pa.Table) -> pa.Table:
    kept = Kept(table, spans)
    out: list[list] = [[] for _ in range(4)]
    for raw, rest, mask in kept:
        runs = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(len(mask) > 0 and bool(mask[0]))
        for column, value in zip(out, (len(raw), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest()), strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    ids = table.column("doc_id").take(pa.array(kept.chunk.order, pa.int64()))
    return pa.table([ids, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


@tidy
def _texts(table: pa.Table, spans: pa.Table, names: list[str]) -> pa.Table:
    """The rows with what remains of their texts; a text of which nothing but white space remains goes with its row."""
    kept = Kept(table, spans)
    rows, texts = [], []
    for k, (raw, rest, _) in zip(kept.chunk.order, kept, strict=True):
        if len(rest) == len(raw) or rest.strip():
            rows.append(k)
            # parts of characters that removal cut go with it
            texts.append(rest.decode("utf-8", errors="ignore"))
    out = table.select(["text" if n == "text" else "__" + n for n in names]).take(pa.array(rows, pa.int64())).rename_columns(names)
    null = out.column("text").is_null().to_pylist()
    return out.set_column(names.index("text"), "text", pa.array([None if n else t for n, t in zip(null, texts, strict=True)], pa.string()))


def _merger(level: int, fan: int):
    return lambda t: _merge_on(t, level, fan)


def _levels(chunks: int, fan: int) -> int:
    levels = 1
    while fan**levels < chunks:
        levels += 1
    return levels


def _spans(rows: DataFrame, chunk: int) -> tuple[object, DataFrame]:
    """The rows (doc_id, text, ...) grouped by chunk, and the removed spans (chunk, at, stop)."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    # one partition a chunk, so that what a task reads does not grow with the table
    by_chunk = numbered.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk").groupBy("chunk")
    hashes = by_chunk.applyInArrow(lambda t: _hashes_out(t), "chunk int, h long, n long")
    again = hashes.withColumn("all", F.sum("n").over(Window.partitionBy("h"))).where("all > 1")
    flags = again.select("chunk", "h", (F.col("all") > HOT).alias("hot"))
    fan = FAN
    levels = _levels(chunks, fan)
    parts = chunks if levels == 1 else fan
    runs = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(lambda t, f: _runs_out(t, f, parts, fan), _RUN)
    for level in range(levels - 1):
        runs = runs.repartition(chunks, "part", "lot").groupBy("part", "lot").applyInArrow(_merger(level, fan), _RUN)
    # in the last level all chunks are of one lot
    return by_chunk, runs.repartition(chunks, "part").groupBy("part").applyInArrow(lambda t: _merge_part(t), "chunk int, at int, stop int")


def deduplicated(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs."""
    by_chunk, spans = _spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), chunk)
    made = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return by_chunk.cogroup(spans.groupBy("chunk")).applyInArrow(lambda t, s: _digests(t, s), made)


def without_repeats(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs with the removed bytes gone from their texts, and n_chars, if there is one, of what remains."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias("__" + c) for c in others))
    by_chunk, spans = _spans(rows, chunk)
    made = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    names = docs.columns
    out = by_chunk.cogroup(spans.groupBy("chunk")).applyInArrow(lambda t, s: _texts(t, s, names), made)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out
