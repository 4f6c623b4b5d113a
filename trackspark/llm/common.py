"""Helpers that several operators share: whole-text access, lineage cuts in the shared folder, gapless numbering."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are handled in groups of about so many characters, which bounds the numpy work space of a task.
GROUP_CHARS = 1_000_000
#: Bytes of an Arrow batch that ``small_batches`` allows; Spark's own bound is 64 MB, which a task holds several times over on both sides.
BATCH_BYTES = 4 << 20
#: Bytes that a Python worker's memory of words may take before it starts anew.
MEMORY_BYTES = 48 << 20
#: A key with over a thousandth of all rows is hot. There are fewer than a thousand of these, so their rows of a table by key may be broadcast.
HOT_PARTS, HOT_LEAST = 1_000, 1_000
#: Narrow rows (a few numbers each) that one task of ``fitting`` may get.
TASK_ROWS = 50_000
_resident: dict[str, Any] = {}


def resident(name: str, make: Callable[[], Any]) -> Any:
    """The one object that this Python worker keeps between tasks; asking for another name lets go of it."""
    if name not in _resident:
        _resident.clear()
        _resident[name] = make()
    return _resident[name]


def small_batches(spark: SparkSession) -> None:
    """From now on this session gives Python tasks Arrow batches of BATCH_BYTES or so (a longer row is a batch of its own). A smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def let_go() -> None:
    """Forget the object of ``resident``: for tasks that need none, whose worker may have served an earlier operator."""
    _resident.clear()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all runs in this process, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once, written to the shared folder, and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The rows as Parquet in the shared folder, so that later passes read single columns of them."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fitting(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about so many narrow rows, in as many tasks as these need and one a core at least, however many shuffle partitions are set."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def release(spark: SparkSession) -> None:
    """Have shuffle files of plans that nothing refers to any more deleted: Spark's cleaner acts only when the driver's heap is
    collected, which a long row of small plans may not bring about before the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row a key, whose column ``size`` says how many of the ``total`` rows have the key.

    The few hot keys are met by a broadcast, so their rows stay where they are; the others by a shuffle.
    """
    least = max(HOT_LEAST, total // HOT_PARTS)
    hot, cold = groups.where(F.col(size) > least), groups.where(F.col(size) <= least)
    marked = rows.join(F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True))), keys, "left")
    near = marked.where("_hot").drop("_hot").join(F.broadcast(hot), keys)
    return near.unionByName(marked.where("_hot is null").drop("_hot").join(cold, keys))


def row_groups(texts: pa.Array, most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each; a longer text makes a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield start, len(sizes)


def by_groups(work: Callable[[list, list], dict], schema: pa.Schema, key: str = "doc_id", text: str = "text") -> Callable:
    """A mapInArrow function that gives ``work`` the keys and texts (null text: empty) of one group of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            for a, b in row_groups(column):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                out = work(batch.column(key).slice(a, b - a), texts)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """Column ``out``: gapless numbers from 0 within each group, in an arbitrary but fixed order.

    A group may hold any share of the rows: rows are dealt to hash buckets, each bucket is numbered by
    its own task, and the buckets' counts (groups x buckets rows, whatever the input) give each bucket
    its first number. ``order`` must name enough columns to tell rows apart; rows equal in all of them
    are interchangeable. The columns of ``group`` must not be null.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = dealt.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    same = [F.col("_bucket") == F.col("_b"), *[F.col(g) == F.col(f"_g{i}") for i, g in enumerate(group)]]
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    rows = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    return rows.join(first, same).withColumn(out, F.col("_first") + F.col("_at")).drop("_bucket", "_b", "_first", "_at", *[f"_g{i}" for i in range(len(group))])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an edge table (a, b) of longs; component is the smallest node reachable.

    Alternates large-star and small-star contraction, each a grouped minimum and a join on the node;
    every round is cut in the shared folder. A round's tasks follow the number of edges. Nodes without an edge do not appear.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    few = lambda table: fitting(table, 2 * n)
    edges, state = few(edges), None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        low = few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = few(few(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        low = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(low, "a"))
        edges = cut(few(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(few(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
