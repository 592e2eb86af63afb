"""Written intermediate tables, connected components and small helpers shared by the operators.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``, or else to the context's checkpoint folder (all
executors share it); only on a local master, as in tests, a folder of this process stands in, elsewhere it is an error that none is
named. They cut lineage: a lost executor costs a re-read, never a recomputation of earlier stages.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import io
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch: what a Python worker and the JVM beside it hold of a partition at once.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Bytes of data for each partition of a shuffle, where the session's number of partitions would make them larger.
PART_BYTES = 128 << 20

#: Ids (of 8 bytes) that are still broadcast.
SENT_IDS = 1 << 20

#: Bits of a block of the id filter.
FILTER_BLOCK = 1 << 15

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: that of the setting, or of the context; a folder of this process on a local master without either."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="cardpulse-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> str:
    """Limit the session's Arrow batches to ``size`` bytes, unless they are smaller; the setting before. Operators that run jobs do so for
    their time (see Workspace); an application does it for those whose result it runs itself."""
    before = str(spark.conf.get(_BATCH_SETTING))
    if int(before.rstrip("b")) > size:
        spark.conf.set(_BATCH_SETTING, size)
    return before


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` whose workers can import this package wherever they run: its source goes along once per
    application, as ``--py-files`` would send it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if getattr(context, "_cardpulse_sent", None) is None:
        package = Path(__file__).resolve().parents[1]
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.writestr(zipfile.ZipInfo(str(f.relative_to(package.parent))), f.read_bytes())
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/code-{uuid.uuid4().hex}/cardpulse_code.zip")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(held.getvalue())
        out.close()
        context.addPyFile(path.toString())
        context._cardpulse_sent = True
    return df.mapInArrow(_released(function), schema)


def _released(function: Callable) -> Callable:
    """``function`` over a partition, after which the worker, which waits for further tasks, gives freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _release()

    return run


def _release() -> None:
    """Give freed memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than on glibc there is nothing to trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _trim_jvm(spark: SparkSession) -> None:
    """As _release does for Python, give memory that the driver's JVM has freed outside its heap back to the system. Every plan brings classes to
    compile, and glibc keeps what the compiler's threads free, some 200 MB after a few runs of the pipeline."""
    java, gateway = spark._jvm.java.lang, spark.sparkContext._gateway

    def array(kind: object, *items: object) -> object:
        made = gateway.new_array(kind, len(items))
        for k, item in enumerate(items):
            made[k] = item
        return made

    with contextlib.suppress(Py4JError):  # a JVM that is not of glibc, or older than 17.0.9, has no such command
        # the server's own class is not exported, so its method is taken from the interface
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, *map(java.Class.forName, kinds)))
        commands = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(java.Object, commands, "systemTrimNativeHeap", array(java.Object), array(java.String)))


class Workspace:
    """Written tables of one run of an operator, each dropped as soon as the operator is done with it, all of them at the end of its ``with``
    block, also after an error. Arrow batches are bounded for as long."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        self.kept: list[DataFrame] = []
        self.before = bound_batches(spark)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: the plan above starts at files that outlive any executor."""
        self.made += 1
        path = f"{self.root}/t{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cardpulse_path = path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """An intermediate result that two steps read right after one another: cached in memory and on disk, not written. A lost executor's part is
        computed again from the written tables below it."""
        self.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.kept[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables and forget kept ones that nothing will read again."""
        for t in tables:
            path = getattr(t, "_cardpulse_path", None)
            if any(t is k for k in self.kept):
                self.kept = [k for k in self.kept if k is not t]
                t.unpersist(blocking=True)
            elif path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Delete and forget whatever is left."""
        self.drop(*self.kept)
        self._delete(self.root)
        self.spark.conf.set(_BATCH_SETTING, self.before)
        self.tidy()

    def tidy(self) -> None:
        """After many jobs: give the driver's memory back, and let Spark's cleaner see which shuffles are done with, so that their files go now
        and not at some later collection."""
        _release()
        self.spark._jvm.System.gc()
        _trim_jvm(self.spark)


def dealt(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` with all rows of a key in one partition. Adaptive execution sizes the partitions; where ``size`` bytes would make more than the
    session's number of partitions, there is one for each PART_BYTES."""
    n = -(-size // PART_BYTES)
    return df.repartition(int(n), key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids``; null ids stay. Up to SENT_IDS distinct ids are sent to the rows, more are joined by shuffle."""
    gone = durable(docs.sparkSession, ids.select(F.col(id_col).alias("_gone")).where("_gone IS NOT NULL").distinct())
    gone = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def durable(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a result that callers read lazily; Spark's cleaner removes its files."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Bits of an id filter, at least and at most.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def filter_bits(ids: int) -> int:
    """Bits of a filter of so many ids: 16 each, of which 1.4 % of other ids pass, within the bounds. From about 10**8 ids on more than a quarter pass."""
    return 1 << int(np.ceil(np.log2(np.clip(16 * ids, LEAST_BITS, MOST_BITS))))


def id_filter(ids: DataFrame, bits: int) -> bytes:
    """A filter over the ``id`` column of ``ids`` with two slots each (see ``filter_slots``), built in Spark and at most ``bits``
    bits on the driver whatever the number of ids: a fuller filter only lets more rows through."""
    slots = ids.select(F.explode(filter_slots(F.col("id"), bits)).alias("s")).select((F.col("s") / FILTER_BLOCK).cast("int").alias("block"), (F.col("s") % FILTER_BLOCK).cast("int").alias("place"))
    parts = map_arrow(slots.repartition("block").sortWithinPartitions("block"), _mark_blocks, "block int, bitmap binary")
    held = np.zeros(bits // 8, dtype=np.uint8)
    for block, bitmap in parts.collect():
        held[block * FILTER_BLOCK // 8 : (block + 1) * FILTER_BLOCK // 8] = np.frombuffer(bitmap, np.uint8)
    return held.tobytes()


def _mark_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, place) sorted by block -> (block, bitmap of the places that occur)."""
    schema = pa.schema([("block", pa.int32()), ("bitmap", pa.binary())])
    block, marks = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], schema=schema)

    for batch in batches:
        blocks, places = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for part in np.split(np.arange(len(blocks)), np.flatnonzero(blocks[1:] != blocks[:-1]) + 1):
            if not len(part):
                continue
            if blocks[part[0]] != block:
                if block is not None:
                    yield done()
                block, marks = int(blocks[part[0]]), np.zeros(FILTER_BLOCK, dtype=bool)
            marks[places[part]] = True
    if block is not None:
        yield done()


def filter_slots(column: Column, bits: int) -> Column:
    """The slots of an id in a filter of ``bits`` bits."""
    return F.array(*(F.pmod(F.xxhash64(column, F.lit(k)), F.lit(bits)) for k in (0, 1)))


def in_filter(packed: np.ndarray, slots: pa.Array) -> np.ndarray:
    """Which rows' ids may be in the filter."""
    s = slots.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    return ((packed[s >> 3] >> (s & 7).astype(np.uint8)) & 1).all(axis=1)


#: What a plan without statistics is taken to read.
UNKNOWN_BYTES = 1 << 30


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the scan below ``df``, known on the driver without a job. It sizes sketches and shuffles, never results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else UNKNOWN_BYTES


def components(ws: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): rows (node, component = its smallest node).

    Alternates large-star and small-star steps over distributed edges, with per-node minima pre-aggregated before
    each shuffle, until no edge changes; a star per component remains. Nothing is collected; a hub's edges meet
    only in joins, whose hot partitions adaptive execution can split. Nulls and loops are ignored.
    """
    e = ws.table(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    for _ in range(rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ws.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")))
        large = ws.keep(
            both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = ws.keep(large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")))
        parent = F.col("b") == F.col("m")
        now = ws.table(
            large.join(least, F.col("a") == F.col("k"))
            .select(F.when(parent, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        ws.drop(e, low, large, least)
        e = now
        # done when every non-root node has one edge, and that to a root
        nodes = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        nodes = nodes.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if nodes.where("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ws.tidy()
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
