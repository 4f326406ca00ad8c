"""SimHash near-duplicate detection by deletion-variant signatures.

A fingerprint has 64 bits; two link at 3 or fewer differing bits. It is cut into two segments of 32 bits, the fewest for
which one of them must differ by at most one bit. Each segment is indexed under its 32 one-wildcard variants (one bit
left out), so that every linking pair meets in at least one of 64 keys by equality, and is verified there. Buckets are
read as sorted runs; within a bucket only the links of a spanning forest leave the task, never all pairs. A bucket of
more than BUCKET fingerprints goes on, whole, to a second index that cuts the other 32 bits the same way: its keys fix
46 of 64 bits, so no bucket there can hold more than 2**18 different fingerprints.

representatives() also joins documents whose sets of WIDE-word shingles have a Jaccard index of SIMILAR or more, which
most near copies with changed words are, though their fingerprints differ by more bits than segments can be cut for.
Candidates share one of BANDS keys of ROWS min-hashes (a pair at SIMILAR does in all but 4 of 10,000 cases) and are
verified by their exact sets: first each with the least document of its key, then all pairs of the keys whose documents
that leaves apart. Only there, a key of more than PART documents is cut into parts, and each two parts are compared in a
task, so that any two of its documents meet.

Defined cases: null or blank text has fingerprint zero and links like any other; equal fingerprints are one node,
however many documents share them; a null doc_id keeps its row and takes the smallest id of its component (null if
there is none); repeated rows are returned as often as they come; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle, tidied

DISTANCE = 3
BUCKET = 8192
WIDE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
PART = 4096
TURNS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of each run of so many words; of all words if they are fewer."""
    n = len(words)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < width:
        return np.array([digest(line, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([digest(line[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """64 bits over the 3-word shingles of a text; the result is unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    hashes = _shingles(words, 3)
    bits = np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
    on = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(on).tobytes(), "big")


@tidied
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        prints = np.fromiter((fingerprint(t or b"") for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest over the fingerprints of one bucket, compared in blocks of rows."""
    n = len(fps)
    root = np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= DISTANCE) + i + 1
        if len(near):
            tops = np.unique(root[near])
            least = min(root[i], tops[0])
            if tops[-1] != least or root[i] != least:
                root[np.isin(root, np.append(tops, root[i]))] = least
    signed = fps.view(np.int64)
    own = np.flatnonzero(root != np.arange(n))
    return list(zip(signed[own].tolist(), signed[root[own]].tolist(), strict=True))


def _links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) come sorted by key. Gives (a, b, key): a link, or with b null a row of an overfull bucket."""
    out = ([], [], [])

    def packed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "key"])
        for x in out:
            x.clear()
        return made

    def take(fps: np.ndarray, key: int) -> None:
        if len(fps) > limit:
            out[0].extend(fps.tolist())
            out[1].extend([None] * len(fps))
            out[2].extend([key] * len(fps))
        else:
            for a, b in _forest(fps.view(np.uint64)):
                out[0].append(a)
                out[1].append(b)
                out[2].append(None)

    held_keys, held = np.empty(0, np.int64), np.empty(0, np.int64)
    over: int | None = None
    for batch in batches:
        keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
        fps = np.concatenate([held, batch.column(1).to_numpy()])
        cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
        # an overfull bucket is passed on as it comes, never held whole
        if len(keys) and (len(keys) - cut > limit or over == keys[-1]):
            over = int(keys[-1])
            take_tail, cut_to = fps[cut:], len(keys)
            out[0].extend(take_tail.tolist())
            out[1].extend([None] * len(take_tail))
            out[2].extend([over] * len(take_tail))
        else:
            cut_to = cut
        k, f = keys[:cut], fps[:cut]
        if len(k) and over is not None and k[0] == over and over != keys[-1]:
            first = int(np.searchsorted(k, over, "right"))
            out[0].extend(f[:first].tolist())
            out[1].extend([None] * first)
            out[2].extend([over] * first)
            k, f = k[first:], f[first:]
        same = np.flatnonzero(k[1:] == k[:-1])
        if len(same):
            edges = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            sizes = np.diff(np.append(edges, len(k)))
            pairs = edges[sizes == 2]
            u = f.view(np.uint64)
            ok = pairs[np.bitwise_count(u[pairs] ^ u[pairs + 1]) <= DISTANCE]
            out[0].extend(f[ok].tolist())
            out[1].extend(f[ok + 1].tolist())
            out[2].extend([None] * len(ok))
            for s, n in zip(edges[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                take(f[s : s + n], int(k[s]))
        held_keys, held = keys[cut_to:], fps[cut_to:]
        if out[0]:
            yield packed()
    if len(held):
        if over is not None and held_keys[0] == over:
            out[0].extend(held.tolist())
            out[1].extend([None] * len(held))
            out[2].extend([over] * len(held))
        elif len(held) > 1:
            take(held, int(held_keys[0]))
    if out[0]:
        yield packed()


def _variants(fp: str, bits: int, shift: int) -> str:
    """Spark SQL: the segment of so many bits at a shift, bit w left out, with w beside it."""
    part = f"(shiftrightunsigned({fp}, {shift}) & {(1 << bits) - 1}L)"
    return f"(({part} & ~shiftleft(1L, w)) | shiftleft(cast(w as bigint), {bits}))"


def _meet(rows: DataFrame, limit: int) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _links(b, limit), "a long, b long, key long")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join all different fingerprints within DISTANCE, directly or through each other."""
    distinct = prints.select("fp").distinct()
    wild = distinct.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(31))))
    low = wild.select(F.expr(_variants("fp", 32, 0)).alias("key"), "fp")
    high = wild.select(F.expr(f"{_variants('fp', 32, 32)} | shiftleft(1L, 40)").alias("key"), "fp")
    first = settle(_meet(low.unionByName(high), bucket))
    found = first.where("b is not null").select("a", "b")
    rest = first.where("b is null").select("key", F.col("a").alias("fp"))
    if rest.isEmpty():
        return found
    deep = rest.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(15))))
    other = F.expr("if((key & shiftleft(1L, 40)) = 0, shiftrightunsigned(fp, 32), fp & 4294967295L)")
    deep = deep.withColumn("part", other)
    keys = [F.xxhash64("key", F.expr(f"{_variants('part', 16, 16 * s)} | {s << 20}L")) for s in (0, 1)]
    second = _meet(deep.select(F.explode(F.array(*keys)).alias("key"), "fp").distinct(), 1 << 62)
    return found.unionByName(second.select("a", "b"))


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs; see the module's text for the cases."""
    prints = settle(fingerprints(docs))
    roots = components(links(prints, bucket))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@tidied
def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_class, keys): a hash of all words, and the keys of the bands."""
    for batch in batches:
        classes, keys = [], np.empty((batch.num_rows, BANDS), dtype=np.int64)
        for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            words = (text or b"").lower().split()
            classes.append(xxhash.xxh64_intdigest(b" ".join(words), 7) - (1 << 63))
            h = np.unique(_shingles(words, WIDE))
            least = np.full(len(TURNS), np.iinfo(np.uint64).max, dtype=np.uint64)
            for at in range(0, len(h), 4096):
                least = np.minimum(least, (h[at : at + 4096, None] * TURNS).min(axis=0))
            keys[i] = [xxhash.xxh64_intdigest(band.tobytes(), b) - (1 << 63) for b, band in enumerate(least.reshape(BANDS, ROWS))]
        width = np.arange(0, (batch.num_rows + 1) * BANDS, BANDS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(width), pa.array(keys.ravel()))], names=["doc_id", "text_class", "keys"])


@tidied
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(_shingles((t or b"").lower().split(), WIDE)).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "grams"])


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard index of SIMILAR or more."""
    if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


@tidied
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(k).to_pylist() for k in (2, 3))
        ok = pa.array([_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(left, right, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1)], names=["a", "b"])


def _joined(nodes: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between all documents of one key that are alike, but for those that others join already."""
    root, out = np.array(roots), []
    for i in range(len(nodes) - 1):
        for j in range(i + 1, len(nodes)):
            if root[i] != root[j] and _alike(sets[i], sets[j]):
                root[root == root[j]] = root[i]
                out.append((nodes[i], nodes[j]))
    return out


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, node, root, grams) sorted by key and part; gives links (a, b)."""
    now, held = None, []

    def made() -> pa.RecordBatch:
        found = _joined([h[0] for h in held], [h[1] for h in held], [np.frombuffer(h[2], np.uint64) for h in held])
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for key, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, part) != now:
                if len(held) > 1:
                    yield made()
                now, held = (key, part), []
            held.append(row)
    if len(held) > 1:
        yield made()


def similar(docs: DataFrame) -> DataFrame:
    """(a, b): links that join all documents of (doc_id, text) with SIMILAR sets, directly or through each other; a null id has none."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    banded = settle(own.mapInArrow(_banded, "doc_id long, text_class long, keys array<long>"))
    classes = banded.groupBy("text_class").agg(F.min("doc_id").alias("node"))
    same = banded.join(classes, "text_class").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    # one document of each text goes on
    keyed = banded.join(classes, ["text_class"]).where("doc_id = node").select(F.explode("keys").alias("key"), "node").distinct()
    shared = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("m")).where("m > 1")
    met = settle(keyed.join(shared, "key"))
    pairs = met.where("node <> lead").select("node", "lead").distinct()
    named = met.select(F.col("node").alias("doc_id")).distinct()
    sets = settle(own.join(named, "doc_id", "left_semi").mapInArrow(_sets, "node long, grams binary"))
    lead = sets.select(F.col("node").alias("lead"), F.col("grams").alias("theirs"))
    first = settle(pairs.join(sets, "node").join(lead, "lead").select("node", "lead", "grams", "theirs").mapInArrow(_verified, "a long, b long"))
    roots = components(first)
    placed = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    parts = F.ceil(F.col("m") / F.lit(PART)).cast("int")
    own_part = F.pmod(F.xxhash64("node"), parts).cast("int")
    some = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.least(own_part, q) * parts.cast("long") + F.greatest(own_part, q))
    rest = placed.join(split, "key").select("key", F.explode(some).alias("part"), "node", "root").join(sets, "node").select("key", "part", "node", "root", "grams")
    more = rest.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_apart, "a long, b long")
    return same.unionByName(first).unionByName(more)


def representatives(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs that stand for their component, with all columns: the row with the component's smallest doc_id.

    Components are those of near_duplicates() joined by the links of similar(). A document is an id with a text: rows that
    repeat both are one, of which one row stays; rows that share an id and not the text are judged apart. Rows without an
    id have nothing to stand for and stay.
    """
    node = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = docs.where("doc_id is not null")
    own = named.select(node.alias("doc_id"), "text")
    prints = near_duplicates(own, bucket)
    links_ = prints.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(similar(own))
    roots = settle(components(links_))
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    ids = named.select(node.alias("n"), F.col("doc_id").cast("long").alias("id")).distinct()
    first = F.min(F.struct("id", "node"))
    members = whole.join(ids, whole.node == ids.n).select("node", "root", "id")
    stay = members.groupBy("root").agg(first.alias("first")).select(F.col("first.node").alias("stay"))
    gone = members.join(stay, members.node == F.col("stay"), "left_anti").select(F.col("node").alias("gone"))
    rows = named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node.alias("node"))
    kept = rows.join(gone, rows.node == F.col("gone"), "left_anti").dropDuplicates(["node"]).select("row.*")
    return kept.unionByName(docs.where("doc_id is null"))
