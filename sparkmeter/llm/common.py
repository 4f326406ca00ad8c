"""What the training-data operators share: tables in the shared folder, components of a link graph, table reading."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Links a task, for the small tables of components().
ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none (tests) gets one made; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_written: list[str] = []


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is None:
        return
    for path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def settle(df: DataFrame, codec: str = "none") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors.

    By default without a codec, whose buffers lie outside the heap until a full collection.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def settled() -> list[str]:
    """The tables settled by now."""
    return list(_written)


def discard(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> None:
    """Remove settled tables, but for one: what they were for is done. So are the shuffles that nothing refers to."""
    for path in paths:
        if path in _written and path != getattr(keep, "_settled_path", None):
            _remove(spark, path)
            _written.remove(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark removes the files of collected shuffles and broadcasts


def placed(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """The rows with their place in a total order (from 0), and sums over the rows before them, without one task for all.

    Ranges of the order are dealt over partitions, each adds up its own, and the few partitions' totals are added up before.
    """
    ranged = settle(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    own = ranged.groupBy("__p").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = own.select(F.col("__p").alias("__q"), zero(F.sum("__n").over(before)).alias("__n0"), *[zero(F.sum(f"__{k}").over(before)).alias(f"__{k}0") for k in sums])
    within = Window.partitionBy("__p").orderBy(*order)
    done = within.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), F.col("__p") == F.col("__q"))
    named = [(F.col(f"__{k}0") + zero(F.sum(c).over(done))).alias(k) for k, c in sums.items()]
    return out.select(*rows.columns, (F.col("__n0") + F.row_number().over(within) - 1).alias("place"), *named)


def _trim() -> None:
    """Give freed memory of this process back: workers are reused, by tasks that need it elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def tidied(work):
    """As tidy(), for a generator over batches."""

    @wraps(work)
    def done(*args, **named):
        try:
            yield from work(*args, **named)
        finally:
            _trim()

    return done


def tidy(work):
    """A function of a group that leaves no freed memory with its worker when it is done."""

    @wraps(work)
    def done(*args, **named):
        try:
            return work(*args, **named)
        finally:
            _trim()

    return done


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (u, v) of a partition as stars: each node with the smallest that these links reach from it."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    nodes, where = np.unique(np.concatenate([np.concatenate(p) for p in zip(*parts, strict=True)]), return_inverse=True)
    a, b = np.split(where, 2)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    if len(own):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b), both long.

    Alternating large-star and small-star rounds over settled tables: every node ends up linked to the smallest node
    of its component. Before a round each partition, of about ROWS links, contracts its own. A round is two group-bys
    (combined before the shuffle, so a hub with a third of all links costs one row a task) and two equality joins, which
    Spark may split where a hub is hot. Nothing goes to the driver but two counts a round. Returns (node, root) for each
    node that has a link; root is the component's smallest node.
    """
    shared_root(edges.sparkSession)
    kept = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    settled_ = lambda links, n: links.coalesce(2 + n // ROWS).mapInArrow(_contracted, "u long, v long").checkpoint()
    now, seen = kept.checkpoint(), None
    now = settled_(now, now.count())
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = settled_(star, mark[0])
