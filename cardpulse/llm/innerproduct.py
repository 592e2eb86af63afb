"""Exact top-k inner products over norm-sorted vectors.

Vectors are written once, range-partitioned by descending length, so that a partition holds one band of lengths. The longest vectors
give every query a first threshold and, by singular value decomposition, a rotation that puts most of the length
into the leading coordinates. Vectors whose |q| |x| falls short of the threshold of every query of a block are not read (a filter on the
stored length, by which files are sorted); a step is passed over for a query by the same bound; in it, the product over the leading
coordinates plus the Cauchy-Schwarz bound of the rest prunes vectors; what is left is multiplied in integers. Queries are taken in blocks
of a bounded number, each against all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import PART_BYTES, Workspace, durable, map_arrow, plan_bytes

#: Queries of a block, longest vectors that set thresholds and rotation, share of their squared length in the leading coordinates.
QUERY_BLOCK, LONGEST, LEADING = 8192, 2048, 0.6
#: Vectors that are bounded and multiplied at once.
STEP = 1024
#: Relative slack of bounds in floating point.
SLACK = 1e-9

_VECTORS = "vec_id long, dims int, length double, components binary"


def _integers(scale: float):
    """(vec_id, embedding) -> floor(scale * component) as 64-bit integers, by row; vectors that take no part are left out."""
    schema = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("length", pa.float64()), ("components", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = vectors.flatten()
            values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.maximum(sizes, 0))
            keep, rows, lengths = [], [], []
            for i in np.flatnonzero((sizes >= 0) & ids.is_valid().to_numpy(zero_copy_only=False)):
                x = np.floor(scale * values[ends[i] - sizes[i] : ends[i]])
                if np.isfinite(x).all():
                    if len(x) and np.abs(x).max() >= 2.0**63:
                        raise OverflowError("a scaled component does not fit 64 bits")
                    keep.append(i)
                    rows.append(x.astype(np.int64).tobytes())
                    lengths.append(float(np.sqrt((x * x).sum())))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(sizes[keep], pa.int32()), pa.array(lengths, pa.float64()), pa.array(rows, pa.binary())], schema=schema)

    return run


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in floating point where no sum can leave 2**53, in wide integers where one could leave 2**63; an error where one does."""
    greatest = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))), 1) for m in (one, two)]
    most = greatest[0] * greatest[1] * max(one.shape[1], 1)
    if most < 1 << 53:
        return (one.astype(np.float64) @ two.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return one @ two.T
    wide = one.astype(object) @ two.astype(object).T
    if any(abs(x) >= 1 << 63 for x in wide.ravel()):
        raise OverflowError("a product does not fit 64 bits")
    return wide.astype(np.int64)


class Block:
    """A block of queries of one number of components, with what prunes for them."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int):
        self.numbers, self.ids, self.rows, self.k = numbers, ids, rows, k
        self.length = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
        dims = rows.shape[1]
        _, s, right = np.linalg.svd(sample.astype(float), full_matrices=False) if len(sample) and dims else (None, np.zeros(0), np.zeros((0, dims)))
        share = np.cumsum(s**2) / max(float((s**2).sum()), 1e-300)
        self.leading = right[: int(np.searchsorted(share, LEADING)) + 1].T if len(s) else np.zeros((dims, 0))
        self.part = rows.astype(float) @ self.leading
        self.rest = np.sqrt(np.maximum(self.length**2 - (self.part**2).sum(axis=1), 0))
        self.threshold = np.full(len(ids), -np.inf)
        if len(sample) and len(ids):
            score = products(rows, sample).astype(float)
            score[ids[:, None] == sample_ids[None, :]] = -np.inf
            if len(sample) >= k:
                self.threshold = np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k]


    def least_length(self) -> float:
        """No shorter vector is among the best of any query of the block."""
        if not len(self.ids) or not np.isfinite(self.threshold).all() or (self.threshold <= 0).any():
            return 0.0
        return float((self.threshold / np.maximum(self.length, 1e-300)).min()) * (1 - 1e-6)


def search(block: Block, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vec_id, score) of the k best of each query among (ids, lengths, rows) that come by falling length; at least the k best, ties by id."""
    found = [np.zeros(0, np.int64)] * 3
    floor = block.threshold.copy()
    for ids, lengths, rows in batches:
        for a in range(0, len(ids), STEP):
            i, x, n = ids[a : a + STEP], rows[a : a + STEP], lengths[a : a + STEP]
            slack = SLACK * block.length * (n.max(initial=0) + 1) + 1e-6
            live = np.flatnonzero(block.length * n.max(initial=0) + slack >= floor)
            if not len(live):
                continue
            part = x.astype(float) @ block.leading
            rest = np.sqrt(np.maximum(n**2 - (part**2).sum(axis=1), 0))
            bound = part @ block.part[live].T + rest[:, None] * block.rest[live][None, :] + slack[live][None, :]
            able = bound >= floor[live][None, :]
            some_x, some_q = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
            if not len(some_x):
                continue
            q = live[some_q]
            score = products(x[some_x], block.rows[q])
            take = (score >= floor[q][None, :]) & (i[some_x][:, None] != block.ids[q][None, :])
            v, w = np.nonzero(take)
            found = [np.concatenate(p) for p in zip(found, (q[w], i[some_x][v], score[v, w]), strict=True)]
            order = np.lexsort((found[1], -found[2], found[0]))
            found = [f[order] for f in found]
            first = np.searchsorted(found[0], found[0])
            rank = np.arange(len(first)) - first
            keep = rank < block.k
            found = [f[keep] for f in found]
            last = rank[keep] == block.k - 1
            floor[found[0][last]] = np.maximum(floor[found[0][last]], found[2][last])
    return found[0], found[1], found[2]


_HITS = "query long, query_id long, vec_id long, score long"


def _search_partition(sent):
    schema = pa.schema([(n, pa.int64()) for n in ("query", "query_id", "vec_id", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = sent.value
        best: dict[int, list] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                if (block := blocks.get(int(d))) is None:
                    continue
                own = np.flatnonzero(dims == d)
                own = own[np.argsort(-batch.column(2).to_numpy(zero_copy_only=False)[own], kind="stable")]
                rows = np.array([np.frombuffer(batch.column(3)[int(k)].as_buffer(), np.int64) for k in own], dtype=np.int64).reshape(len(own), int(d))
                hits = search(block, iter([(batch.column(0).to_numpy(zero_copy_only=False)[own], batch.column(2).to_numpy(zero_copy_only=False)[own], rows)]))
                best.setdefault(int(d), []).append(hits)
        for d, parts in best.items():
            block = blocks[d]
            q, v, s = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < block.k
            yield pa.RecordBatch.from_arrays([pa.array(block.numbers[q[keep]]), pa.array(block.ids[q[keep]]), pa.array(v[keep]), pa.array(s[keep])], schema=schema)

    return run


def _matrix(rows: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), dims)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each row of ``queries`` with the rows of ``vectors`` of another id: ``query_id``, ``rank`` (from 1),
    ``vec_id``, ``score``; ties go to the smaller id, and all are returned if there are fewer than ``k``.

    A component x counts as floor(scale * x). Null vectors, vectors with null or non-finite components and rows with null ids take no part; a
    vector meets only vectors with as many components. Repeated rows are rows of their own on either side. Other columns are ignored; an empty
    table on either side gives an empty result. A very long vector is a row like any other. Scaled components and products that do not fit 64
    bits are an error. For every distinct number of components among the queries, LONGEST vectors reach the driver.
    """
    spark: SparkSession = vectors.sparkSession
    with Workspace(spark, "innerproduct") as ws:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(vectors) // PART_BYTES))

        def whole(df: DataFrame) -> DataFrame:
            return map_arrow(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")), _integers(scale), _VECTORS)

        held = ws.table(whole(vectors).repartitionByRange(n, F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id"))
        asked = ws.table(whole(queries).withColumn("query", F.monotonically_increasing_id()))
        passes = max(1, -(-asked.count() // QUERY_BLOCK))
        first = F.row_number().over(Window.partitionBy("dims").orderBy(F.desc("length"), "vec_id"))
        longest = held.join(F.broadcast(asked.select("dims").distinct()), "dims", "left_semi").withColumn("rank", first).where(F.col("rank") <= LONGEST).toPandas()
        parts = []
        for p in range(passes):
            own = asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p).orderBy("query").toPandas()
            blocks = {}
            for d, q in own.groupby("dims"):
                top = longest[longest["dims"] == d].sort_values("rank")
                blocks[int(d)] = Block(q["query"].to_numpy(dtype=np.int64), q["vec_id"].to_numpy(dtype=np.int64), _matrix(q["components"].tolist(), int(d)), top["vec_id"].to_numpy(dtype=np.int64), _matrix(top["components"].tolist(), int(d)), k)
            sent = spark.sparkContext.broadcast(blocks)
            near = held.where(F.col("length") >= min((b.least_length() for b in blocks.values()), default=0.0))
            parts.append(ws.table(map_arrow(near, _search_partition(sent), _HITS)))
            sent.destroy()
        hits = reduce(DataFrame.union, parts)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        return durable(spark, hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
