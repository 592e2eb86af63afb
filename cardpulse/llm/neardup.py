"""Near-duplicate classes by min-max hashing.

One permutation of the shingle hashes yields two signature values, its minimum and its maximum, so 64 hash
evaluations give 128 values; 32 bands of four values propose candidates, exact Jaccard similarity on full shingle
sets confirms them, and distributed connected components name the classes.

Scale: a document's set never travels unless some other document shares a band with it. Exact copies meet in one
pre-aggregated group. Documents that share bands, directly or over others, are a group. A group that is too large for one comparison,
as of pages from one template, is first taken apart without loss: two sets that link share one of the first
few shingles of each in any common order, and in an order that puts shingles which are frequent in the group last, unlike
documents share none. Candidates are compared inside bounded blocks (no pair rows): a group that is still large is dealt into blocks
by exact similarity to its pivot, and the triangle inequality of Jaccard distance rules out block pairs; documents
already linked to the pivot are not compared with one another. A block pair emits a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from . import textkit as tk
from .store import Workspace, components, dealt, durable, filter_bits, filter_slots, id_filter, in_filter, map_arrow, plan_bytes

#: Permutations (two values each) and bands of four values. At similarity 0.85 a pair shares no band with
#: probability 6e-11, at 0.8 5e-8.
PERMUTATIONS = 64
BANDS = PERMUTATIONS // 2
#: Most documents of a block.
BLOCK = 128
#: Standard errors of the 128-value estimate by which a pair may fall short and still be confirmed on full sets.
SLACK = 6.0
#: Documents of a large group (by hash, about so many) that tell which shingles are frequent in it, and in how many of them those stand. The
#: sample orders shingles and decides nothing: any order gives the same links.
ORDERED_BY, FREQUENT = 64, 3
#: Candidate documents whose places (32 bytes each) are still broadcast to their sets; more are joined by shuffle.
SENT_PLACES = 1 << 19
#: Band keys expected for each byte of input.
KEYS_PER_BYTE = 0.02

_rng = np.random.default_rng(20240611)
_FACTOR = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def shingle_sets(words: tk.Words, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their borders (rows + 1). A text of fewer than
    ``size`` words has one shingle, its whole sequence; one without words has none."""
    runs, first, sets = tk.windows(words.hash, size), words.first, []
    counts = np.zeros(rows + 1, dtype=np.int64)
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            s = np.sort(runs[a : b - size + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = tk.mix(tk.windows(words.hash[a:b], int(b - a)) + np.uint64(b - a))
        else:
            continue
        sets.append(s)
        counts[i + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(counts)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every permutation over each non-empty set that begins at ``at``: (sets, 2 * PERMUTATIONS)."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at), 2 * PERMUTATIONS), dtype=np.uint32)
    for p in range(PERMUTATIONS):
        v = (x ^ _FLIP[p]) * _FACTOR[p]
        out[:, 2 * p] = np.minimum.reduceat(v, at)
        out[:, 2 * p + 1] = np.maximum.reduceat(v, at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band (two permutations, four values) of each signature."""
    q = signature.reshape(len(signature), BANDS, 4).astype(np.uint64)
    high, low = q[:, :, 0] << np.uint64(32) | q[:, :, 1], q[:, :, 2] << np.uint64(32) | q[:, :, 3]
    return tk.mix(tk.mix(tk.mix(high) + low) + np.arange(BANDS, dtype=np.uint64))


_FIRST = f"doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, {sketch.COLUMNS}"


def _first_scan(size: int, width: int):
    """Set sizes, set fingerprints and band keys of all texts, and a sketch of the band keys."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_shingles", "f1", "f2")] + [("bands", pa.list_(pa.int64())), *sketch.FIELDS])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = sketch.Gathered(width)

        def blocks() -> Iterator[pa.RecordBatch]:
            if out := met.blocks():
                yield pa.RecordBatch.from_arrays([pa.nulls(len(out[0]), pa.int64())] * 4 + [pa.nulls(len(out[0]), pa.list_(pa.int64())), *out], schema=schema)

        for batch in batches:
            ids = batch.column(0)
            for a, b, words in tk.each_words(batch.column(1), "space", True):
                sets, border = shingle_sets(words, b - a, size)
                count, full = np.diff(border), np.flatnonzero(np.diff(border))
                f = np.zeros((2, b - a), dtype=np.uint64)
                keys, ends = np.zeros(0, np.int64), np.zeros(b - a + 1, np.int64)
                if len(full):
                    for k in (0, 1):
                        f[k, full] = np.add.reduceat(tk.salted(sets, k + 1), border[full])
                    keys = band_keys(signatures(sets, border[full])).view(np.int64).ravel()
                    ends[1:] = np.cumsum(np.where(count > 0, BANDS, 0))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(count), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys)), *(pa.nulls(b - a, t) for _, t in sketch.FIELDS)],
                    schema=schema,
                )
                if met.add(keys.view(np.uint64)):
                    yield from blocks()
        yield from blocks()

    return scan


def _met_bands(sketched):
    """(doc_id, bands) -> a row for each band key that another document may have, too."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sketched.value, np.uint8)
        for batch in batches:
            keys = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(sketch.repeated(bitmap, keys.view(np.uint64)))
            row = pa.array(np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(keys[at])], schema=schema)

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, members) -> a row for each shingle."""
    schema = pa.schema([("gid", pa.int64()), ("token", pa.int64())])
    for batch in batches:
        sets = [np.frombuffer(m.as_buffer(), np.int64) for m in batch.column(1)]
        row = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], schema=schema)


def prefix(members: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order (frequent, hash), as many as are not needed for a link: two sets that link share ``percent`` of either
    set's size at least, so that the rest of one cannot hold all they share, and the first shared shingle stands among the first of both."""
    least = -(-percent * len(members) // 100)
    common = np.isin(members, frequent)
    return np.concatenate((members[~common], members[common]))[: len(members) - least + 1]


def _prefixes(percent: int):
    """(doc_id, gid, members, frequent) -> a row (doc_id, key) for each shingle of the set's prefix; keys of different groups differ."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for gid, members, frequent in zip(batch.column(1).to_numpy(zero_copy_only=False), batch.column(2), batch.column(3), strict=True):
                often = frequent.values.to_numpy(zero_copy_only=False).view(np.uint64) if frequent.is_valid else np.zeros(0, np.uint64)
                keys.append(tk.salted(prefix(np.frombuffer(members.as_buffer(), np.uint64), often, percent), int(gid) & ((1 << 62) - 1)).view(np.int64))
            row = pa.array(np.repeat(np.arange(batch.num_rows), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))], schema=schema)

    return run


def _second_scan(size: int, wanted):
    schema = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()), ("members", pa.binary()), ("signature", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(wanted.value, dtype=np.uint8)
        for batch in batches:
            hit = in_filter(packed, batch.column(2))
            if not hit.any():
                continue
            batch = batch.filter(pa.array(hit))
            for a, b, words in tk.each_words(batch.column(1), "space", True):
                sets, border = shingle_sets(words, b - a, size)
                full = np.flatnonzero(np.diff(border))
                if not len(full):
                    continue
                signature = signatures(sets, border[full])
                f = [np.add.reduceat(tk.salted(sets, k + 1), border[full]).view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(full)), pa.array(f[0]), pa.array(f[1]), pa.array(np.diff(border)[full]), pa.array([sets[border[i] : border[i + 1]].tobytes() for i in full], pa.binary()), pa.array([s.tobytes() for s in signature], pa.binary())],
                    schema=schema,
                )

    return scan


def shared(one: np.ndarray, two: np.ndarray) -> int:
    """Size of the intersection of two sorted sets without repeats."""
    if len(one) > len(two):
        one, two = two, one
    at = np.searchsorted(two, one)
    at[at == len(two)] = 0
    return int((two[at] == one).sum()) if len(two) else 0


def is_link(both: int, one: int, two: int, percent: int) -> bool:
    """100 * intersection >= percent * union, in integers."""
    return 100 * both >= percent * (one + two - both)


def _to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, gid, pivot, members, signature, pivot_members) -> the same without the last, with n and both."""
    schema = pa.schema([("doc_id", pa.int64()), ("gid", pa.int64()), ("pivot", pa.int64()), ("members", pa.binary()), ("signature", pa.binary()), ("both", pa.int64()), ("total", pa.int64())])
    for batch in batches:
        both, total = [], []
        for m, p in zip(batch.column(3), batch.column(5), strict=True):
            m, p = np.frombuffer(m.as_buffer(), np.uint64), np.frombuffer(p.as_buffer(), np.uint64)
            both.append(shared(m, p))
            total.append(len(m) + len(p) - both[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(both, pa.int64()), pa.array(total, pa.int64())], schema=schema)


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def block_links(ids: list[int], known: list[bool], side: list[int], members: list[np.ndarray], signature: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of a block (one side) or between two blocks (sides 0 and 1). Documents ``known`` to be linked to
    the pivot are one tree from the start. Candidates are taken by falling estimate, so that trees grow early."""
    n, out = len(ids), []
    forest, tree = _Forest(n), [i for i in range(n) if known[i]]
    for i in tree[1:]:
        forest.up[i] = tree[0]
    two = 1 in side
    size = np.array([len(m) for m in members])
    least = percent / 100 - SLACK * float(np.sqrt(percent / 100 * (1 - percent / 100) / signature.shape[1]))
    rows, cols, guess = [], [], []
    sides, knows = np.array(side), np.array(known)
    for i in range(n):
        if two and side[i]:
            continue
        j = np.flatnonzero(sides == 1) if two else np.arange(i + 1, n)
        j = j[(100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])) & ~(knows[j] & knows[i])]
        if not len(j):
            continue
        e = (signature[j] == signature[i]).mean(axis=1)
        j, e = j[e >= least], e[e >= least]
        rows += [i] * len(j)
        cols += j.tolist()
        guess += e.tolist()
    for k in np.argsort(-np.array(guess), kind="stable") if guess else ():
        i, j = rows[k], cols[k]
        a, b = forest.root(i), forest.root(j)
        if a != b and ids[i] != ids[j] and is_link(shared(members[i], members[j]), len(members[i]), len(members[j]), percent):
            forest.up[a] = b
            out.append((ids[i], ids[j]))
    return out


def _blocks(percent: int):
    """Rows sorted by ``key`` -> links (a, b); only the rows of one key are held."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def links():
            found = block_links([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows], np.stack([np.frombuffer(r[4], np.uint32) for r in rows]), percent)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k, *row in zip(*columns, strict=True):
                if k != key and rows:
                    yield links()
                    rows = []
                key = k
                rows.append(row)
        if len(rows) > 1:
            yield links()

    return run


def _grouped(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Rows (doc_id, key) -> (doc_id, gid, size, pivot) of the documents that share a key with another one: groups are connected over
    keys, each a star around its smallest document; a group's pivot shares most keys with such centres."""
    rows = ws.table(rows)
    centre = ws.table(rows.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where("centre < last").select("key", "centre"))
    met = ws.table(rows.join(centre, "key").groupBy("centre", "doc_id").agg(F.count("*").alias("m")))
    groups = ws.table(components(ws, met.select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))))
    ws.drop(centre, rows)
    degree = met.groupBy("doc_id").agg(F.sum("m").alias("m"))
    ranked = groups.join(degree, F.col("node") == F.col("doc_id"), "left")
    top = F.max(F.struct(F.coalesce("m", F.lit(0)).alias("m"), (-F.col("node")).alias("x"))).alias("top")
    pivots = ranked.groupBy(F.col("component").alias("gid")).agg(F.count("*").alias("size"), top).select("gid", "size", (-F.col("top.x")).alias("pivot"))
    place = ws.table(groups.join(pivots, F.col("component") == F.col("gid")).select(F.col("node").alias("doc_id"), "gid", "size", "pivot"))
    ws.drop(met, groups)
    return place


def _sent(place: DataFrame) -> tuple[DataFrame, int]:
    """Places, marked to be broadcast if they are few, and their number."""
    n = place.count()
    return (F.broadcast(place) if n <= SENT_PLACES else place), n


def _apart(ws: Workspace, keyed: DataFrame, percent: int) -> DataFrame:
    """``keyed`` documents of large groups in smaller ones that hold every link: connected over the shingles of their prefixes."""
    some = keyed.where(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / ORDERED_BY).cast("long")) == 0)
    often = map_arrow(some.select("gid", "members"), _tokens, "gid long, token long").groupBy("gid", "token").count().where(F.col("count") >= FREQUENT)
    often = ws.table(often.groupBy("gid").agg(F.collect_list("token").alias("frequent")))
    asked = keyed.join(often, "gid", "left").select("doc_id", "gid", "members", "frequent")
    place = _grouped(ws, map_arrow(asked, _prefixes(percent), "doc_id long, key long"))
    return keyed.drop("gid", "size", "pivot").join(_sent(place)[0], "doc_id").select(*keyed.columns)


def _across(ws: Workspace, big: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows of block pairs, links to pivots) of groups larger than a block."""
    # exact similarity to the pivot places a document in a bin
    centre_sets = ws.table(big.where("doc_id = pivot").groupBy("gid").agg(F.max("members").alias("pivot_members")))
    placed = ws.table(map_arrow(big.join(centre_sets, "gid").select("doc_id", "gid", "pivot", "members", "signature", "pivot_members"), _to_pivot, "doc_id long, gid long, pivot long, members binary, signature binary, both long, total long"))
    link = F.col("both") * 100 >= F.col("total") * percent
    far = F.least(F.lit(19), (F.lit(20) * (F.col("total") - F.col("both")) / F.col("total")).cast("int"))
    # documents known to be linked are dealt by distance too, but in blocks of their own
    binned = placed.select("doc_id", "gid", "members", "signature", link.alias("known"), F.when(link, far).otherwise(far + 100).alias("bin"))
    parts = ws.table(binned.groupBy("gid", "bin").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts")))
    cells = parts.select("gid", "bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = cells.select("gid", F.col("bin").alias("bin1"), F.col("part").alias("part1"))
    right = cells.select("gid", F.col("bin").alias("bin2"), F.col("part").alias("part2"))
    near = F.abs(F.col("bin1") % 100 - F.col("bin2") % 100) * 5 <= 100 - percent + 5
    duty = ws.table(
        left.join(right, "gid")
        .where(near & (F.struct("bin1", "part1") <= F.struct("bin2", "part2")) & ~((F.col("bin1") < 100) & (F.col("bin2") < 100)))
        .select("gid", "bin1", "part1", "bin2", "part2", F.concat_ws(":", "gid", "bin1", "part1", "bin2", "part2").alias("key"))
    )
    sides = duty.select("gid", F.col("bin1").alias("bin"), F.col("part1").alias("part"), "key", F.lit(0).alias("side")).union(
        duty.where("bin1 <> bin2 OR part1 <> part2").select("gid", "bin2", "part2", "key", F.lit(1))
    )
    split = binned.join(parts, ["gid", "bin"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("long")).cast("int"))
    rows = split.join(sides, ["gid", "bin", "part"]).select("key", "doc_id", "known", "side", "members", "signature")
    return rows, placed.where(link).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate texts: one row for each row of ``docs`` with ``doc_id``, ``n_shingles`` (distinct shingles of
    ``words`` lower-cased words), ``component_id`` (smallest id reachable over links) and ``kept`` (doc_id = component_id).

    Two documents link if 100 * |A ∩ B| >= percent * |A ∪ B| on their full shingle sets. Null or empty texts have no
    shingles and link with nothing; a text of fewer than ``words`` words has one shingle. Rows that share an id
    are one document: they are in one class, and each of their texts can link. A null id links with nothing: its
    component_id is null and it is kept. Other columns of ``docs`` are ignored. An empty table gives an empty result. A very long text is
    hashed whole as one step, in memory of some forty times its size; its set is one value of eight bytes a shingle.
    """
    spark: SparkSession = docs.sparkSession
    with Workspace(spark, "neardup") as ws:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        volume = plan_bytes(docs)
        width = sketch.width_for(volume * KEYS_PER_BYTE)
        first = ws.table(map_arrow(source, _first_scan(words, width), _FIRST))
        sketched = spark.sparkContext.broadcast(sketch.repeated_bitmap(first.where("block IS NOT NULL"), width, volume))
        scanned = first.where("block IS NULL")
        has_set = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
        some = scanned.where(has_set)

        # exact copies: one representative for each distinct set
        one = ["f1", "f2", "n_shingles"]
        copies = ws.table(some.groupBy(*one).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last"))
        own = some.select("doc_id", *one, "bands").join(copies, one, "left").where("rep IS NULL OR rep = doc_id")
        place = _grouped(ws, map_arrow(own.select("doc_id", "bands"), _met_bands(sketched), "doc_id long, key long"))
        sketched.destroy()

        # full sets of the documents that met another one; the filter spares the rest the second hashing
        sent, n = _sent(place)
        bits = filter_bits(n)
        wanted = spark.sparkContext.broadcast(id_filter(place.select(F.col("doc_id").alias("id")), bits))
        asked = source.where("doc_id IS NOT NULL").withColumn("slots", filter_slots(F.col("doc_id"), bits))
        sets = map_arrow(asked, _second_scan(words, wanted), "doc_id long, f1 long, f2 long, n long, members binary, signature binary")
        keyed = ws.table(sets.join(sent, "doc_id").select("doc_id", "gid", "size", "pivot", "members", "signature"))
        wanted.destroy()

        many = F.col("size") > BLOCK
        whole = keyed.where(~many)
        rows, links = [], []
        if not place.where(many).isEmpty():
            apart = ws.table(_apart(ws, keyed.where(many), percent))
            whole = whole.union(apart.where(~many))
            if not apart.where(many).isEmpty():
                across, to_pivot = _across(ws, apart.where(many), percent)
                rows.append(across)
                links.append(to_pivot)
        rows.append(whole.select(F.concat_ws(":", F.col("gid")).alias("key"), "doc_id", F.lit(False).alias("known"), F.lit(0).alias("side"), "members", "signature"))
        links.append(map_arrow(dealt(reduce(DataFrame.union, rows), "key", volume).sortWithinPartitions("key"), _blocks(percent), "a long, b long"))
        classes = ws.table(components(ws, ws.table(reduce(DataFrame.union, links))))

        # rows without a set, or without an id, are in no join
        alone = scanned.where(~has_set | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        same = some.select("doc_id", *one).join(copies, one, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
        out = same.join(classes, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
        return durable(spark, out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
