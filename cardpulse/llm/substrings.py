"""Exact substring removal with a count-min prefilter.

A window of 50 words contains 26 runs of 25 words; the smallest run hash among them is the window's key (equal windows
have equal keys, and neighbouring windows mostly share one). Pass one stores each text's keys and counts them in a count-min sketch: a
task's sketch travels as sparse blocks, blocks are summed in a distributed group-by, and a bitmap of the counters that reached two, of a
bounded size, returns to the stored keys. Keys that are estimated repeated are counted exactly, a key in 13 words instead of a window in
each, so that what a full bitmap lets through at great sizes costs a shuffle of keys but no windows. A window is at most as frequent as its key and a
key at most as frequent as its counters say, so pass two loses nothing when it takes, of the texts that have repeated keys, the windows of
these keys. Those, and only those, are grouped exactly by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from . import textkit as tk
from .store import SENT_IDS, Workspace, durable, filter_bits, filter_slots, id_filter, in_filter, map_arrow, plan_bytes

#: Sketch keys expected for each byte of input: a key in 13 words, a word in 4 bytes of compressed text.
KEYS_PER_BYTE = 0.02
#: Most candidate windows in one row between the passes.
ROW_WINDOWS = 1 << 15
#: Most classes of exact copies that the second scan is told of; further ones take the way of windows.
KNOWN_COPIES = 1 << 18


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` consecutive values, by doubling."""
    width, block = 1, values
    while 2 * width <= size:
        block = np.minimum(block[: len(block) - width], block[width:])
        width *= 2
    n = len(values) - size + 1
    return np.minimum(block[:n], block[size - width : size - width + n])


class _Windows:
    """Windows of a step of texts: ``text`` and ``start`` (word index in the step) of each, its ``key``."""

    def __init__(self, words: tk.Words, rows: int, size: int):
        n = np.diff(words.first)
        count = np.maximum(n - size + 1, 0)
        self.text = np.repeat(np.arange(rows), count)
        offset = np.concatenate(([0], np.cumsum(count)))
        self.start = np.arange(offset[-1]) - np.repeat(offset[:-1], count) + np.repeat(words.first[:-1], count)
        run = (size + 1) // 2
        if len(self.start):
            self.key = _sliding_least(tk.windows(words.hash, run), size - run + 1)[self.start]
        else:
            self.key = np.zeros(0, np.uint64)


def _fingerprints(words: tk.Words, rows: int) -> np.ndarray:
    """Two 64-bit fingerprints of each text's word sequence; 0 without words."""
    f = np.zeros((2, rows), dtype=np.uint64)
    full = np.flatnonzero(np.diff(words.first))
    if len(full):
        place = np.arange(len(words.hash), dtype=np.uint64) - np.repeat(words.first[:-1], np.diff(words.first)).astype(np.uint64)
        for k in (0, 1):
            f[k, full] = np.add.reduceat(tk.mix(tk.salted(words.hash, 21 + k) + tk.mix(place)), words.first[full])
    return f.view(np.int64)


_FIRST = f"doc_id long, text_hash long, f1 long, f2 long, n_words long, keys array<long>, {sketch.COLUMNS}"


def _first_scan(size: int, width: int):
    """(doc_id, text, text_hash) -> fingerprints and distinct window keys of all texts, and the task's sketch of them."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "text_hash", "f1", "f2", "n_words")] + [("keys", pa.list_(pa.int64())), *sketch.FIELDS])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = sketch.Gathered(width)

        def blocks() -> Iterator[pa.RecordBatch]:
            if out := met.blocks():
                yield pa.RecordBatch.from_arrays([pa.nulls(len(out[0]), t) for t in schema.types[:6]] + out, schema=schema)

        for batch in batches:
            for a, b, words in tk.each_words(batch.column(1), "space", False):
                f, rows = _fingerprints(words, b - a), b - a
                w = _Windows(words, rows, size)
                new = np.concatenate(([True], (w.key[1:] != w.key[:-1]) | (w.text[1:] != w.text[:-1]))) if len(w.key) else np.zeros(0, bool)
                key, text = w.key[new], w.text[new]
                order = np.lexsort((key, text))
                key, text = key[order], text[order]
                if len(key):
                    first = np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
                    key, text = key[first], text[first]
                ends = pa.array(np.searchsorted(text, np.arange(rows + 1)).astype(np.int32))
                own = [batch.column(0).slice(a, rows), batch.column(2).slice(a, rows), pa.array(f[0]), pa.array(f[1]), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(own + [pa.nulls(rows, t) for _, t in sketch.FIELDS], schema=schema)
                if met.add(key):
                    yield from blocks()
        yield from blocks()

    return scan


def _whole_copies(known: np.ndarray, f1: np.ndarray, f2: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which texts are those of a known class of copies whose least id is smaller than their own."""
    if not len(known):
        return np.zeros(len(f1), dtype=bool)
    at = np.searchsorted(known[:, 0], f1)
    at[at == len(known)] = 0
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return (known[at, 0] == f1) & (known[at, 1] == f2) & (known[at, 2] < number) & ids.is_valid().to_numpy(zero_copy_only=False)


def _likely_keys(sketched, copies):
    """(doc_id, text_hash, f1, f2, keys) -> a row for each key that is estimated repeated, of texts that are no known copies of an earlier one."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "text_hash", "key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, known = np.frombuffer(sketched.value, np.uint8), np.frombuffer(copies.value, np.int64).reshape(-1, 3)
        for batch in batches:
            whole = _whole_copies(known, *(batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)), batch.column(0))
            batch = batch.filter(pa.array(~whole))
            keys = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(sketch.repeated(bitmap, keys.view(np.uint64)))
            row = pa.array(np.repeat(np.arange(batch.num_rows), batch.column(4).value_lengths().to_numpy(zero_copy_only=False))[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(keys[at])], schema=schema)

    return run


_SECOND = "uid long, doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string, text string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _second_scan(size: int, wanted, copies):
    """(doc_id, text, text_hash, slots) -> a row each. A text that has no repeated key, or is a whole copy of an earlier one, is final. Any other
    goes on; its digest is that of the whole text, which holds unless a window turns out to repeat."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, known = np.frombuffer(wanted.value, np.uint8), np.frombuffer(copies.value, np.int64).reshape(-1, 3)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, some = batch.column(1), in_filter(packed, batch.column(3)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for a, b, words in tk.each_words(texts, "space", False):
                rows, count, own = b - a, np.diff(words.first), texts.slice(a, b - a)
                ids = batch.column(0).slice(a, rows)
                whole = _whole_copies(known, *_fingerprints(words, rows), ids) & (count >= size)
                open_ = some[a:b] & (count >= size) & ~whole
                data, offsets = tk.column_bytes(own)
                raw = data.tobytes()
                digests = [_EMPTY if w else hashlib.sha256(b" ".join(raw[x:y].split())).hexdigest() for w, x, y in zip(whole.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                removed = pa.array(np.where(whole, count, 0).astype(np.int64), mask=open_)
                held = own.take(pa.array(np.arange(rows), mask=~open_))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + rows)), ids, batch.column(2).slice(a, rows), pa.array(count.astype(np.int64)), removed, pa.array(digests, pa.string()), held], schema=schema)
                uid += rows

    return scan


_WINDOWS = "uid long, doc_id long, windows array<struct<h1:long,h2:long,at:int>>"


def _candidates(size: int):
    """(uid, doc_id, text, keys) -> the windows that have one of the text's repeated keys, a bounded number in a row."""
    pair = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32())])
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("windows", pa.list_(pair))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in tk.each_words(batch.column(2), "space", False):
                w = _Windows(words, b - a, size)
                border = np.searchsorted(w.text, np.arange(b - a + 1))
                keep = np.zeros(len(w.key), dtype=bool)
                for i in range(b - a):
                    own = batch.column(3)[a + i]
                    if own.is_valid:
                        keep[border[i] : border[i + 1]] = np.isin(w.key[border[i] : border[i + 1]].view(np.int64), own.values.to_numpy(zero_copy_only=False))
                start, text = w.start[keep], w.text[keep]
                if not len(start):
                    continue
                h = [tk.windows(words.hash, size, salt)[start].view(np.int64) for salt in (0, 5)]
                cut = np.unique(np.concatenate((np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))), np.arange(0, len(text), ROW_WINDOWS))))
                row = pa.array(a + text[cut])
                fields = pa.StructArray.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array((start - words.first[text]).astype(np.int32))], fields=list(pair))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.ListArray.from_arrays(pa.array(np.append(cut, len(text)).astype(np.int32)), fields)], schema=schema)

    return run


def _remove(size: int):
    """(doc_id, text, starts of removed windows) -> the contract's row, and what is left of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = covered(len(words), starts.values.to_numpy(zero_copy_only=False) if starts.is_valid else np.zeros(0, np.int32), size)
                total.append(len(words))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], schema=schema)

    return run


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts.astype(np.int64), 1)
    np.add.at(step, np.minimum(starts.astype(np.int64) + size, n), -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the words covered by a window of ``size`` words that also starts in a document with a smaller id.

    One row for each row of ``docs``: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of the kept words joined by
    one space. Windows are judged on the input. Null and empty texts have no words. Rows that share an id do not
    remove from one another; a row with a null id neither removes nor loses words. Other columns are ignored; an empty table gives an
    empty result. A very long text is hashed whole as one step, in memory of some forty times its size, and its windows go on in bounded rows.
    """
    spark: SparkSession = docs.sparkSession
    with Workspace(spark, "substrings") as ws:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
        volume = plan_bytes(docs)
        width = sketch.width_for(volume * KEYS_PER_BYTE)
        first = ws.table(map_arrow(source, _first_scan(size, width), _FIRST))
        sketched = spark.sparkContext.broadcast(sketch.repeated_bitmap(first.where("block IS NOT NULL"), width, volume))
        texts = first.where(f"block IS NULL AND n_words >= {size} AND doc_id IS NOT NULL")
        classes = texts.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("m"))
        copies = classes.where("least < last").orderBy(F.desc("m"), "least").limit(KNOWN_COPIES).select("f1", "f2", "least").toPandas().to_numpy(dtype=np.int64).reshape(-1, 3)
        known = spark.sparkContext.broadcast(copies[np.argsort(copies[:, 0], kind="stable")].tobytes())

        # keys that two documents have, and the texts that have such keys
        likely = ws.table(map_arrow(texts.select("doc_id", "text_hash", "f1", "f2", "keys"), _likely_keys(sketched, known), "doc_id long, text_hash long, key long"))
        ws.drop(first)
        sketched.destroy()
        shared = likely.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("key")
        lists = ws.table(likely.join(shared, "key", "left_semi").groupBy("text_hash").agg(F.collect_set("key").alias("keys")))
        ws.drop(likely)
        bits = filter_bits(lists.count())
        wanted = spark.sparkContext.broadcast(id_filter(lists.select(F.col("text_hash").alias("id")), bits))

        second = ws.table(map_arrow(source.withColumn("slots", filter_slots(F.col("text_hash"), bits)), _second_scan(size, wanted, known), _SECOND))
        known.destroy()
        wanted.destroy()
        texts = second.where("text IS NOT NULL")
        asked = texts.select("text_hash", "uid", "doc_id", "text").join(lists, "text_hash").select("uid", "doc_id", "text", "keys")
        windows = ws.table(map_arrow(asked, _candidates(size), _WINDOWS))
        found = windows.select("uid", "doc_id", F.explode("windows").alias("w")).select("uid", "doc_id", "w.h1", "w.h2", "w.at")
        exact = ws.table(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("h1", "h2", "least"))
        gone = found.join(exact, ["h1", "h2"]).where("doc_id > least").select("uid", "at")
        starts = ws.table(gone.groupBy("uid").agg(F.collect_list("at").alias("starts")))
        ws.drop(exact, windows)
        # only texts that lose words travel; their ids are sent to the rows up to a bound
        losing = starts.select("uid")
        some = texts.join(F.broadcast(losing), "uid", "left_semi") if starts.count() <= SENT_IDS else texts
        left = some.select("uid", "doc_id", "text").join(starts, "uid").select("doc_id", "text", "starts")
        whole = texts.select("uid", "doc_id", "n_words", "kept_sha256").join(losing, "uid", "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
        done = second.where("n_removed IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept_sha256").union(whole)
        return durable(spark, done.union(map_arrow(left, _remove(size), "doc_id long, n_words long, n_removed long, kept_sha256 string")))
