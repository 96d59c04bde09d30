"""What the operators of this subpackage share: scratch tables, joins of uneven keys and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master (tests) may go without the setting; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sparkfringe-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Rows of an Arrow batch of texts, and of what Python takes from it at a time.
BATCH_ROWS, SLICE_ROWS = 1000, 500


def release() -> None:
    """Gives freed memory back to the system, as idle Python workers stay beside those that work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``make`` on small slices of the batches, and :func:`release` at the end of the task.

    The session's Arrow batches are lowered to ``BATCH_ROWS`` rows if they are larger: whole texts are long, and a
    batch stands in the memory of the JVM and of Python, on the way there and back.
    """
    spark, name = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))
        try:
            yield from make(slices)
        finally:
            release()

    return run


#: Folders of results, by the blocks of :func:`releasing` that are open.
_KEPT: list[list[str]] = []


def _remove(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _remove(spark, folder)
    except Exception:  # noqa: BLE001  the session has ended, and with it the way to the folder
        pass


@contextmanager
def releasing(spark: SparkSession):
    """Results kept within the block go at its end, as those who need them have written theirs by then."""
    _KEPT.append([])
    try:
        yield
    finally:
        for folder in _KEPT.pop():
            _remove(spark, folder)


class Scratch:
    """Tables written to the shared folder to cut lineage; all but the kept ones go at the end of the block. The kept
    ones, which results read, go at the end of a :func:`releasing` block around it or of the program.

    A lost executor costs a reread of such a table and never the job that made it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.keeps = False

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, kept: bool = False) -> DataFrame:
        if kept and not self.keeps:
            self.keeps = True
            if _KEPT:
                _KEPT[-1].append(f"{self.root}-kept")
            else:
                atexit.register(_remove_at_exit, self.spark, f"{self.root}-kept")
        to = f"{self.root}{'-kept' if kept else ''}/{uuid.uuid4().hex}"
        df.write.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def keep(self, df: DataFrame) -> DataFrame:
        """A table that outlives the block, for results."""
        return self.table(df, kept=True)

    def __exit__(self, *exc) -> None:
        _remove(self.spark, self.root)


#: The most bytes that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows of one key from which a join treats it apart.
HOT = 200_000


def _bytes_of(name: str, kind: str) -> Column:
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if kind.startswith("array"):
        return F.coalesce(F.size(name), F.lit(0)) * 8 * (1 + kind.count(":")) + 16
    return F.lit(16 * (1 + kind.count(":")))


def small(df: DataFrame) -> DataFrame:
    """``df``, which is a table at hand, to be broadcast if its rows hold few bytes, and else as it is."""
    parts = [_bytes_of(f"`{f.name}`", f.dataType.simpleString()) for f in df.schema.fields]
    size = df.agg(F.sum(sum(parts[1:], parts[0]).cast("double"))).first()[0] or 0.0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def joined(scratch: Scratch, left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``left`` with at most one row of ``right`` for its ``key``. Keys that very many rows of ``left`` have, of which there can be
    but few, get theirs by broadcast, so that no task takes all rows of one; ``rows`` is how many ``left`` has, if known."""
    if (left.count() if rows is None else rows) <= HOT:
        return left.join(right, key, how)
    hot = scratch.table(left.groupBy(key).count().where(f"count > {HOT} AND `{key}` IS NOT NULL").select(key))
    if hot.isEmpty():
        return left.join(right, key, how)
    few = scratch.table(right.join(F.broadcast(hot), key, "left_semi"))
    own = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how)
    return own.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that ``edges`` (a, b) reach from node.

    Every round takes the smallest label among the neighbours, then follows labels of labels, and
    counts what changed in the rows written; nodes without an edge aren't returned. Sums are combined before each
    shuffle, and joins treat nodes of very many edges and labels of very many nodes apart (:func:`joined`).
    """
    edges = scratch.table(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = 2 * edges.count()
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = (
            joined(scratch, both, labels.withColumnRenamed("node", "b"), "b", rows=rows)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        hooked = scratch.table(hooked) if rows > HOT else hooked
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = scratch.table(
            joined(scratch, hooked, up, "label", rows=rows).select("node", F.least("label", "up").alias("label"), "old")
        )
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
