"""What the operators share: word rules, shared scratch tables, safe column names, linked components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import fresh  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text):
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where the session names none and is on one machine, as in tests, a local one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="binloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of settled tables that haven't been freed, and whether they outlast a scratch().
_held: dict[str, tuple[SparkSession, bool]] = {}


def _discard_held(among: set[str] | None = None) -> None:
    for path in [*_held] if among is None else among & _held.keys():
        discard(_held[path][0], path)


atexit.register(_discard_held)


@contextlib.contextmanager
def scratch():
    """What is settled inside and isn't lasting is freed at the end, so a result that reads it must be written inside."""
    before = {*_held}
    try:
        yield
    finally:
        _discard_held({path for path, (_, lasting) in _held.items() if not lasting} - before)


def settle(df: DataFrame, name: str = "t", lasting: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and lost executors cost nothing upstream.

    The files go with drop_settled, at the end of a scratch() that the table doesn't outlast, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/binloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _held[path] = spark, lasting
    out = spark.read.schema(df.schema).parquet(path)
    out.binloom_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    _held.pop(path, None)
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_settled(*tables: DataFrame) -> None:
    """Free settled tables that nothing will read again."""
    for df in tables:
        discard(df.sparkSession, df.binloom_path)


def no_more_than(table: DataFrame, rows: int) -> DataFrame:
    """The table, to be sent to all executors if it has at most so many rows; else it is joined as any other. The rows are counted."""
    return F.broadcast(table) if table.count() <= rows else table


def swept(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of tables that are no more; it learns of these when the driver's memory is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component the smallest node.

    Alternating large-star and small-star rounds: each round is two grouped aggregations, the number of rounds grows
    with the logarithm of the graph, and no adjacency list is gathered (a hub is spread over partial minima).
    Nodes without an edge to another node are absent. Null ends are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))
    )
    e = settle(e.distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large star: every neighbour above u goes to the smallest of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), "large")
        # small star: the lower neighbours of u, and u, go to its smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.when(F.col("v") == F.col("m"), F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).otherwise(
                    F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
                )
            ).alias("x")
        )
        new = settle(small.select("x.u", "x.v").distinct(), "small")
        # stars only: nobody is both a leaf and a centre, and every leaf has one centre
        n = new.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        mixed = new.select("u").join(new.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        drop_settled(e, large)
        e = new
        if n["n"] == n["d"] and not mixed:
            break
    centres = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)


def give_back() -> None:
    """Give the system what memory a Python process has freed: idle ones stay beside running ones."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A map over Arrow batches that gives back what memory it held."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return outer


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


