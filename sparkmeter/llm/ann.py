"""Approximate nearest neighbours by learned partitions.

The index is fitted on a bounded sample of SAMPLE vectors (those with the least hashes, so reruns agree): their
neighbour graph is cut into balanced parts, by growing parts of equal size over the graph and then moving vectors to the
part that holds most of their neighbours, within the balance; a small classifier (one hidden layer) learns which parts
hold a vector's neighbours. It places every vector of the table in its most probable part and sends each query to its
most probable parts, where it is compared with every vector, in double precision. How many parts are probed is found on
the sample, as the fewest that reach RECALL of the true neighbours there; recall() measures against brute force.

Parts grow with the square root of the rows, up to PARTS. Beyond PARTS * LEAF rows every part is cut again in the same
way, by a classifier of its own that is fitted on a bounded sample of the part, so there are up to PARTS * PARTS parts in
two levels; the classifiers, at most PARTS + 1 of bounded size, are broadcast.

Parts are searched in blocks of at most BLOCK vectors by tasks of their own, so a part with a third of all rows is many
blocks; a query's best K of each block meet in one group. Exact copies are one class: of a class only the K + 1 smallest
ids can be among the K nearest of any query, as ties go to the smaller id; the rest are set aside with no loss.

Defined cases: vectors that are null, zero, or hold null or non-finite components neither ask nor answer, nor does a
null vec_id; a query never finds its own row, but finds other rows that repeat its id or vector; vectors of another
length than most are compared only among those of their own length; with fewer candidates all are returned; other
columns of the input play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .vectors import marked

K = 20
EVERY = 20
SAMPLE = 16_384
PARTS = 128
LEAF = 50_000
HIDDEN = 96
RECALL = 0.94
BLOCK = 8192


def parts_for(n: int, most: int = PARTS) -> int:
    return max(16, min(most, round(n**0.5 / 2)))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product for each row, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def cut(graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A balanced partitioning: parts grow over the graph from seeds, then vectors move to where their neighbours are."""
    n = len(graph)
    room = int(np.ceil(n / parts * slack))
    part = np.full(n, -1)
    fronts = [[int(s)] for s in rng.choice(n, parts, replace=False)]
    sizes = np.zeros(parts, dtype=np.int64)
    free = rng.permutation(n).tolist()
    even = int(np.ceil(n / parts))
    while (part < 0).any():
        for p in np.argsort(sizes).tolist():
            if sizes[p] >= even:
                continue
            front = fronts[p]
            while front and part[front[0]] >= 0:
                front.pop(0)
            while not front and free:
                v = free.pop()
                if part[v] < 0:
                    front.append(v)
            if not front:
                break
            v = front.pop(0)
            part[v] = p
            sizes[p] += 1
            front.extend(graph[v][part[graph[v]] < 0].tolist())
            break
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        moved = 0
        for v in np.argsort(-gain)[: np.count_nonzero(gain > 0)].tolist():
            to = int(votes[v].argmax())
            if sizes[to] < room:
                sizes[part[v]] -= 1
                sizes[to] += 1
                part[v] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A classifier with one hidden layer over parts."""

    def __init__(self, dim: int, parts: int, rng: np.random.Generator) -> None:
        self.p = [rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.maximum(x @ a + b, 0) @ c + d

    def fit(self, x: np.ndarray, goal: np.ndarray, rng: np.random.Generator, epochs: int = 30, size: int = 256) -> None:
        """goal: for each row the shares of the parts."""
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            rate = 0.004 * (1 - epoch / epochs)
            for at in range(0, len(x), size):
                rows = order[at : at + size]
                a, b, c, d = self.p
                h = np.maximum(x[rows] @ a + b, 0)
                z = h @ c + d
                z = np.exp(z - z.max(axis=1, keepdims=True))
                g = (z / z.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
                back = (g @ c.T) * (h > 0)
                t += 1
                for i, grad in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def fit(x: np.ndarray, parts: int = PARTS, k: int = K, want: float = RECALL, seed: int = 3, least: int = 64) -> tuple[Router, int]:
    """The router and the number of parts to probe, from sample vectors."""
    rng = np.random.default_rng(seed)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = max(1, min(parts, len(x) // least))
    router = Router(x.shape[1], parts, rng)
    if parts == 1 or len(x) < 3:
        return router, 1
    graph = neighbour_graph(x, k)
    part = cut(graph, parts, rng)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1 / (graph.shape[1] + 2))
    goal[np.arange(len(x)), part] += 2 / (graph.shape[1] + 2)
    router.fit(unit, goal, rng)
    logits = router.logits(unit)
    order = np.argsort(-logits, axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    placed = order[:, 0]
    reached = np.take_along_axis(rank, placed[graph], axis=1)
    for probes in range(1, parts + 1):
        if (reached < probes).mean() >= want:
            break
    return router, probes


def _route(batches: Iterator[pa.RecordBatch], model: tuple[Router, int], every: int) -> Iterator[pa.RecordBatch]:
    """(cid, ids, v) of classes; adds the class's part and, if one of its ids asks, the parts that it probes."""
    router, probes = model
    for batch in batches:
        x = _matrix(batch.column(1))
        if len(x) and x.shape[1] == router.p[0].shape[0]:
            order = np.argsort(-router.logits(x / np.linalg.norm(x, axis=1, keepdims=True)), axis=1)
        else:
            order = np.zeros((len(x), 1), dtype=np.int64)
        top = order[:, : min(probes, order.shape[1])].astype(np.int32)
        width = np.arange(0, top.size + 1, top.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order[:, 0].astype(np.int32)), pa.ListArray.from_arrays(pa.array(width), pa.array(top.ravel()))], names=["cid", "v", "part", "probes"])


def _fit_part(table: pa.Table, k: int, want: float, least: int) -> pa.Table:
    """The router of one part, from its sample (rows: of the whole part)."""
    x = _matrix(table.column("v").combine_chunks())
    model = fit(x, parts_for(table.column("rows")[0].as_py()), k, want, least=least)
    return pa.table({"part": table.column("part").slice(0, 1), "model": pa.array([pickle.dumps((model[0].p, model[1]))], pa.binary())})


def _route_on(batches: Iterator[pa.RecordBatch], models: dict[int, tuple[Router, int]], most: int) -> Iterator[pa.RecordBatch]:
    """(cid, v, asks, part, probes) with parts of the second level."""
    for batch in batches:
        x = _matrix(batch.column(1))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        part, asks = batch.column(3).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        own = np.empty(len(x), dtype=np.int32)
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            own[at] = p * most + models[p][0].logits(unit[at]).argmax(axis=1)
        probed: list[list[int]] = [[] for _ in range(len(x))]
        lists = batch.column(4).to_pylist()
        wanted: dict[int, list[int]] = {}
        for i in np.flatnonzero(asks).tolist():
            for p in lists[i]:
                if p in models:
                    wanted.setdefault(p, []).append(i)
        for p, rows in wanted.items():
            router, probes = models[p]
            for i, top in zip(rows, np.argsort(-router.logits(unit[rows]), axis=1)[:, :probes].tolist(), strict=True):
                probed[i] += [p * most + t for t in top]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(probed, pa.list_(pa.int32()))], names=["cid", "v", "part", "probes"])


def _deeper(told: DataFrame, classes: DataFrame, k: int, want: float, sample: int, least: int) -> DataFrame:
    """The routed classes (cid, v, part, probes) cut once more."""
    spark = told.sparkSession
    told = settle(told.join(classes.select("cid", "asks"), "cid").select("cid", "v", "asks", "part", "probes"))
    few = Window.partitionBy("part").orderBy(F.xxhash64("cid", F.lit(9)), "cid")  # limited before the shuffle
    some = told.select("cid", "v", "part").withColumn("r", F.row_number().over(few)).where(F.col("r") <= sample).drop("r", "cid")
    some = some.join(F.broadcast(told.groupBy("part").agg(F.count("*").alias("rows"))), "part")  # one row a part
    made = some.groupBy("part").applyInArrow(lambda t: _fit_part(t, k, want, least), "part int, model binary").collect()  # at most PARTS models
    models = {}
    for row in made:
        weights, probes = pickle.loads(row["model"])
        router = Router.__new__(Router)
        router.p = weights
        models[row["part"]] = (router, probes)
    given = spark.sparkContext.broadcast(models)
    return told.mapInArrow(lambda b: _route_on(b, given.value, PARTS), "cid long, v array<double>, part int, probes array<int>")


def _search(asks: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Each asking class's nearest classes in one block: enough of them that k rows other than the query's own are in."""
    schema = pa.schema([("ask", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])
    if not asks.num_rows or not rows.num_rows:
        return schema.empty_table()
    column = lambda t, c: t.column(c).combine_chunks()
    q, x = _matrix(column(asks, "qv")), _matrix(column(rows, "v"))
    ask, cid = column(asks, "ask").to_numpy(), column(rows, "cid").to_numpy()
    least = column(rows, "least").to_numpy()
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(q), 512):
        # one term after another, so that a score does not depend on the block's shape
        s = q[at : at + 512] @ x.T
        n = min(k + 1, s.shape[1])
        cutoff = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
        who, what = np.nonzero(s >= cutoff - 1e-9)
        exact = np.einsum("ij,ij->i", q[at + who], x[what])
        # of those at the cut, the classes with the smallest ids
        order = np.lexsort((least[what], -exact, who))
        who, what, exact = who[order], what[order], exact[order]
        place = np.arange(len(who)) - np.searchsorted(who, who, "left")
        ok = place < n
        for c, values in zip(out, (ask[at + who[ok]], cid[what[ok]], exact[ok]), strict=True):
            c.append(values)
    return pa.table({f.name: pa.array(np.concatenate(c), f.type) for f, c in zip(schema, out, strict=True)})


def nearest(rows: DataFrame, k: int = K, every: int = EVERY, sample: int = SAMPLE, parts: int | None = None, block: int = BLOCK, leaf: int = LEAF, least: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row whose vec_id is divisible by every."""
    member = settle(marked(rows).where("ok").select("vec_id", "v", F.xxhash64("v").alias("cid")))
    classes = settle(member.groupBy("cid").agg(F.min("vec_id").alias("least"), F.max(F.pmod("vec_id", F.lit(every)) == 0).alias("asks"), F.any_value("v").alias("v")))
    some = classes.orderBy(F.xxhash64("cid", F.lit(9))).limit(sample).select("v").toArrow().column("v").to_pylist()
    dims = [len(v) for v in some]
    usual = max(set(dims), key=dims.count) if dims else 1
    n = classes.count()
    deep = n > (parts or PARTS) * leaf
    want = RECALL**0.5 if deep else RECALL
    model = fit(np.array([v for v in some if len(v) == usual]), parts or parts_for(n), k, want, least=least) if dims else (Router(1, 1, np.random.default_rng(0)), 1)
    given = rows.sparkSession.sparkContext.broadcast(model)
    told = classes.select("cid", "v").where(F.size("v") == usual).mapInArrow(lambda b: _route(b, given.value, every), "cid long, v array<double>, part int, probes array<int>")
    if deep:
        told = _deeper(told, classes, k, want, sample // 4, least)
    odd = classes.where(F.size("v") != usual).select("cid", "v", (-F.size("v")).alias("part"), F.array(-F.size("v")).alias("probes"))
    placed = settle(told.unionByName(odd).join(classes.select("cid", "least", "asks"), "cid"))
    sizes = placed.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes)  # one row a part, at most PARTS * PARTS
    found = placed.select("cid", "v", "least", "part").join(sizes, "part")
    found = found.select("part", F.pmod(F.xxhash64("cid", F.lit(4)), F.col("blocks")).cast("int").alias("block"), "cid", "v", "least")
    asks = placed.where("asks").select(F.col("cid").alias("ask"), F.col("v").alias("qv"), F.explode("probes").alias("part")).join(sizes, "part")
    asks = asks.select(F.col("part").alias("qpart"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qblock"), "ask", "qv")
    pairs = asks.groupBy("qpart", "qblock").cogroup(found.groupBy("part", "block")).applyInArrow(lambda a, b: _search(a, b, k), "ask long, cid long, score double")
    # k + 1 classes of each block hold the k nearest of all, with one to spare for the query's own row
    best = Window.partitionBy("ask").orderBy(F.col("score").desc(), "least")
    pairs = pairs.join(classes.select("cid", "least"), "cid").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    # the limit on row_number is applied before the shuffle, so a class with a third of all rows sends k + 1 rows a task
    few = Window.partitionBy("cid").orderBy("vec_id")
    ids = member.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).select("cid", "vec_id", F.col("r").alias("copy"))
    asking = member.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("row", F.monotonically_increasing_id()).select(F.col("vec_id").alias("query_id"), F.col("cid").alias("ask"), "row")
    hits = asking.join(pairs.select("ask", "cid", "score"), "ask").join(ids, "cid")
    # a query's own row is one row of its own class with its id
    own = Window.partitionBy("row").orderBy(F.col("is_self").desc(), "copy")
    hits = hits.withColumn("is_self", (F.col("ask") == F.col("cid")) & (F.col("vec_id") == F.col("query_id")))
    hits = hits.withColumn("o", F.row_number().over(own)).where(~(F.col("is_self") & (F.col("o") == 1)))
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(found: DataFrame, rows: DataFrame, k: int = K) -> float:
    """Share of the true nearest, by brute force over all rows in blocks of queries, that were found. For tests and reports."""
    data = marked(rows).where("ok").select("vec_id", "v").toPandas()
    ids, x = data["vec_id"].to_numpy(), np.stack(data["v"].to_numpy())
    got = found.toPandas().groupby("query_id")["vec_id"].apply(set)
    hit = total = 0
    for q, mine in got.items():
        at = np.flatnonzero(ids == q)[0]
        s = x @ x[at]
        s[at] = -np.inf
        true = ids[np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
        hit += len(mine & set(true.tolist()))
        total += len(true)
    return hit / max(1, total)
