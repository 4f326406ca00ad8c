"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets the signs of 63 random projections, in an order of that pass, as one number; vectors are
ordered by it, which orders them lexicographically by the concatenated hashes, and each is compared with its next
WINDOW neighbours in double precision. A vector's place in the whole order tells its task, and the first WINDOW of a task
are read by the one before it too, so the links found do not depend on the number of tasks. Verified links of all passes
are united into components. The number of passes follows from the number of vectors, so that a pair at the threshold is
met with probability RECALL if vectors spread evenly. Where they do not, the order itself tells: a vector that shares
more bits with the one WINDOW places on than log2(n / WINDOW), on the mean of the passes, takes part in further passes,
as many as the shared bits of such vectors call for, at most MORE in all; not so in a group whose vectors all link anyway.

A bounded window cannot count the links of a vector in a group larger than itself. So members of a component are counted
by their angle to its centre: those within half the linking angle (core) all link with each other and are counted by
their number alone; only the others are compared, in blocks of BLOCK, with each other and with the core, one matrix
product a pair of blocks, and only the number of links of each vector leaves a task. Exact copies are one class
throughout; a class counts as many links as it has rows.

Defined cases: vectors that are null, zero, or hold null or non-finite components have no links and are their own
component; a null vec_id takes no part and is returned with no links; vectors of different lengths never link; rows
that repeat a vec_id are separate vectors with that id; other columns of the input play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, placed, settle
from .vectors import marked

LINK = 0.95
WINDOW = 64
RECALL = 0.999
BLOCK = 1024
BITS = 63
TASK = 1 << 15
MORE = 96
#: Vectors this near to half the linking angle, in radians, are compared rather than counted.
MARGIN = 1e-6


def passes_for(n: int, window: int, recall: float, link: float) -> int:
    """Passes after which a pair at the threshold has met in a window: a pass meets it if about log2(n / window) bits agree."""
    return max(4, passes_of_bits(max(1.0, math.log2(max(2.0, n / window))), recall, link))


def passes_of_bits(bits: float, recall: float, link: float) -> int:
    """Passes after which a pair at the threshold has met, if so many bits and one more have to agree."""
    met = (1 - math.acos(link) / math.pi) ** (bits + 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def _planes(dim: int, turn: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, turn]).standard_normal((dim, BITS))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column as rows of matrices, without Python floats."""
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _codes(batches: Iterator[pa.RecordBatch], first: int, turns: int, seed: int) -> Iterator[pa.RecordBatch]:
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    planes: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        vectors = _vectors(batch.column(1))
        codes = np.zeros((len(vectors), turns), dtype=np.int64)
        dims = np.array([len(v) for v in vectors])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            block = np.stack([vectors[i] for i in at])
            for t in range(turns):
                key = (int(dim), first + t)
                if key not in planes:
                    planes[key] = _planes(*key, seed)
                codes[at, t] = (block @ planes[key] > 0) @ weights
        width = np.arange(0, (len(vectors) + 1) * turns, turns, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(width), pa.array(codes.ravel()))], names=["cid", "codes"])


def _unit(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, padded with zeros to one width, and their own widths."""
    dims = np.array([len(v) for v in vectors], dtype=np.int64)
    out = np.zeros((len(vectors), int(dims.max(initial=1))))
    for i, v in enumerate(vectors):
        top = np.abs(v).max()
        out[i, : len(v)] = v / top
    return out / np.linalg.norm(out, axis=1, keepdims=True), dims


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable by the links a-b, for each of n rows."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _windows(batches: Iterator[pa.RecordBatch], window: int, link: float) -> Iterator[pa.RecordBatch]:
    """Rows (zone, cid, v) in order, a zone being a pass in a task; gives links of a spanning forest of what each batch's windows verify."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    width = 1
    for batch in batches:
        unit, dims = _unit(_vectors(batch.column(2)))
        turn, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        width = max([width, unit.shape[1], *(h[3].shape[1] for h in held)])
        parts = [*held, (turn, cid, dims, unit)]
        turn, cid, dims = (np.concatenate([p[i] for p in parts]) for i in range(3))
        unit = np.concatenate([np.pad(p[3], ((0, 0), (0, width - p[3].shape[1]))) for p in parts])
        a, b = [], []
        for d in range(1, min(window, len(cid) - 1) + 1):
            near = np.flatnonzero((np.einsum("ij,ij->i", unit[:-d], unit[d:]) >= link) & (turn[:-d] == turn[d:]) & (dims[:-d] == dims[d:]))
            a.append(near)
            b.append(near + d)
        if a:
            root = _roots(len(cid), np.concatenate(a), np.concatenate(b))
            own = np.flatnonzero(root != np.arange(len(cid)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(cid[own]), pa.array(cid[root[own]])], names=["a", "b"])
        held = [(turn[-window:], cid[-window:], dims[-window:], unit[-window:])]


def _counted(batches: Iterator[pa.RecordBatch], link: float) -> Iterator[pa.RecordBatch]:
    """Rows (comp, i, j, own, cid, n, v) sorted by pair of blocks; gives (cid, linked rows in the other block)."""

    def count(key: tuple, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        own, cid, n = (batch.column(k).to_numpy() for k in (3, 4, 5))
        unit, dims = _unit(_vectors(batch.column(6)))
        left = np.flatnonzero(own == key[1])
        right = left if key[1] == key[2] else np.flatnonzero(own == key[2])
        near = (unit[left] @ unit[right].T >= link) & (dims[left][:, None] == dims[right])
        if key[1] == key[2]:
            near |= np.eye(len(left), dtype=bool)
            ids, sums = cid[left], near @ n[right]
        else:
            ids, sums = np.concatenate([cid[left], cid[right]]), np.concatenate([near @ n[right], near.T @ n[left]])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], names=["cid", "linked"])

    key, rows = None, []
    for batch in batches:
        k = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            now = tuple(k[:, a].tolist())
            if key is not None and now != key:
                yield count(key, rows)
                rows = []
            key = now
            rows.append(batch.slice(a, b - a))
    if rows:
        yield count(key, rows)


def _ordered(classes: DataFrame, first: int, turns: int, window: int, seed: int) -> DataFrame:
    """(bucket, place, turn, code, cid) of some passes over (cid, v): the whole order, in tasks that share WINDOW rows with the next one."""
    coded = classes.select("cid", "v").mapInArrow(lambda b: _codes(b, first, turns, seed), "cid long, codes array<long>")
    ranked = placed(coded.select(F.posexplode("codes").alias("turn", "code"), "cid"), [F.col("turn"), F.col("code"), F.col("cid")], {})
    bucket = F.floor(F.col("place") / TASK)
    shared = (F.col("place") % TASK < window) & (bucket > 0)
    return ranked.withColumn("bucket", F.explode(F.when(shared, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))))


def _met(ordered: DataFrame, classes: DataFrame, turns: int, window: int, link: float) -> DataFrame:
    """(a, b): links that the windows of some passes verify."""
    zoned = ordered.withColumn("zone", F.col("bucket") * turns + F.col("turn")).join(classes.select("cid", "v"), "cid")
    tasks = max(1, -(-classes.count() * turns // TASK))
    return zoned.repartition(tasks, "bucket").sortWithinPartitions("bucket", "place").select("zone", "cid", "v").mapInArrow(lambda b: _windows(b, window, link), "a long, b long")


def _crowded(ordered: DataFrame, window: int, n: int, link: float) -> DataFrame:
    """(cid, bits) of vectors that share more bits, on the mean of the passes, with the one a window further on than an even spread would give.

    Not those of a tight group, which differ from it in so few of all bits that all in between link with each other.
    """
    later = lambda c: F.lead(c, window).over(Window.partitionBy("bucket").orderBy("place"))  # noqa: E731  at most TASK + WINDOW rows
    apart = F.col("code").bitwiseXOR(later("code"))
    bits = F.when(later("turn") != F.col("turn"), 0).when(apart == 0, BITS).otherwise(BITS - F.length(F.bin(apart)))
    own = ordered.withColumn("bits", F.coalesce(bits, F.lit(0))).withColumn("apart", F.coalesce(F.bit_count(apart), F.lit(BITS)))
    own = own.where(F.floor(F.col("place") / TASK) == F.col("bucket")).groupBy("cid").agg(F.avg("bits").alias("bits"), F.avg("apart").alias("apart"))
    tight = BITS * math.acos(link) / math.pi * 0.7
    return own.where((F.col("bits") > math.log2(max(2.0, n / window))) & (F.col("apart") > tight)).select("cid", "bits")


def _sums(batches: Iterator[pa.RecordBatch], held: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows (root, v) as sums of the vectors of each root, at most so many at a time."""
    sums: dict[int, np.ndarray] = {}

    def given() -> pa.RecordBatch:
        flat = pa.array(np.concatenate(list(sums.values())))
        ends = np.cumsum([0, *map(len, sums.values())]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["root", "v"])

    for batch in batches:
        for root, v in zip(batch.column(0).to_pylist(), _vectors(batch.column(1)), strict=True):
            top = np.abs(v).max()
            sums[root] = sums.get(root, 0) + (v / np.linalg.norm(v / top) / top if top else v)
        if len(sums) > held:
            yield given()
            sums.clear()
    if sums:
        yield given()


def _sums_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums, all of a root in one partition, added up: one row a root."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for root, v in zip(batch.column(0).to_pylist(), _vectors(batch.column(1)), strict=True):
            sums[root] = sums.get(root, 0) + v
    if sums:
        ends = np.cumsum([0, *map(len, sums.values())]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(sums.values()))))], names=["root", "v"])


def _angled(batches: Iterator[pa.RecordBatch], link: float) -> Iterator[pa.RecordBatch]:
    """Rows (root, cid, n, v, centre); core: within half the linking angle of the centre."""
    half = math.acos(link) / 2 - MARGIN
    for batch in batches:
        unit, _ = _unit(_vectors(batch.column(3)))
        centre, _ = _unit(_vectors(batch.column(4)))
        core = np.einsum("ij,ij->i", unit, centre[:, : unit.shape[1]]) >= math.cos(half)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(core)], names=["root", "cid", "n", "v", "core"])


def _links_of(roots: DataFrame, classes: DataFrame, link: float, block: int) -> DataFrame:
    """(cid, root, linked): how many rows each class of a component links with, itself included."""
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = settle(whole.join(classes, whole.node == classes.cid).select("root", "cid", "n", "v"))
    centres = members.select("root", "v").mapInArrow(_sums, "root long, v array<double>").repartition("root").mapInArrow(_sums_again, "root long, v array<double>")
    angled = settle(members.join(centres.select("root", F.col("v").alias("centre")), "root").mapInArrow(lambda b: _angled(b, link), "root long, cid long, n long, v array<double>, core boolean"))
    sized = angled.groupBy("root").agg(
        F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_rows"), F.ceil(F.count_if("core") / block).cast("int").alias("cores"), F.ceil(F.count_if(~F.col("core")) / block).cast("int").alias("loose")
    )
    about = angled.join(sized, "root")
    part = F.xxhash64("cid", F.lit(1))
    own = F.when(F.col("core"), F.pmod(part, F.col("cores"))).otherwise(F.col("cores") + F.pmod(part, F.col("loose"))).cast("int")
    others = F.when(F.col("core"), F.sequence(F.col("cores"), F.col("cores") + F.col("loose") - 1)).otherwise(F.sequence(F.lit(0), F.col("cores") + F.col("loose") - 1))
    pairs = about.where("loose > 0").withColumn("own", own).withColumn("other", F.explode(others))
    pairs = pairs.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "n", "v")
    sorted_ = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    compared = sorted_.mapInArrow(lambda b: _counted(b, link), "cid long, linked long").groupBy("cid").agg(F.sum("linked").alias("linked"))
    return about.select("cid", "root", "core", "core_rows").join(compared, "cid", "left").select("cid", "root", (F.coalesce("linked", F.lit(0)) + F.when(F.col("core"), F.col("core_rows")).otherwise(0)).alias("linked"))


def near_duplicates(rows: DataFrame, link: float = LINK, window: int = WINDOW, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; see the module's text for the cases."""
    every = marked(rows)
    # one class for each different vector; its id is a hash of the whole vector
    member = settle(every.where("ok").select("vec_id", "v", F.xxhash64("v").alias("cid")))
    classes = settle(member.groupBy("cid").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("v").alias("v")))
    n = classes.count()
    turns = passes_for(n, window, recall, link)
    ordered = settle(_ordered(classes, 0, turns, window, seed))
    met = _met(ordered, classes, turns, window, link)
    crowded = settle(_crowded(ordered, window, n, link))
    some, bits = crowded.agg(F.count("*"), F.percentile_approx("bits", 0.95)).first()
    if some > window:
        more = min(MORE, passes_of_bits(bits, recall, link)) - turns
        dense = settle(classes.join(crowded, "cid", "left_semi"))
        for at in range(turns, turns + max(0, more), turns):
            met = met.unionByName(_met(_ordered(dense, at, turns, window, seed), dense, turns, window, link))
    roots = settle(components(met))
    counted = settle(_links_of(roots, classes, link, BLOCK))
    lowest = counted.join(classes.select("cid", "least"), "cid").groupBy("root").agg(F.min("least").alias("low"))
    found = counted.join(lowest, "root").select("cid", "linked", "low")
    about = classes.select("cid", "n", "least").join(found, "cid", "left")
    about = about.select("cid", (F.coalesce("linked", "n") - 1).alias("n_links"), F.coalesce("low", "least").alias("component_id"))
    out = member.select("vec_id", "cid").join(about, "cid").select("vec_id", "n_links", "component_id")
    out = out.unionByName(every.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
