"""Benchmark decontamination on a stored, distributed positional inverted index.

The training text is indexed once: a segment (about a quarter of a megabyte of text) holds, for every term in it, the ascending word
positions at which it stands; terms are 64-bit hashes of words. Segments are document-partitioned, so a common term has a list in every
segment and no list is a hot key. The written index serves any number of searches, for other benchmarks or for the parts of a large one. A
search intersects, segment by segment, the lists of a test window shifted by each term's offset, from the segment's rarest term on: a window
with a term that the segment lacks costs nothing. Exact phrases and proximity matches (each term within ``slop`` words of its
place) are found alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .store import Workspace, durable, map_arrow

#: Characters of benchmark text that one search takes to the segments (some 60 MB of windows); a larger benchmark is searched for in parts.
PASS_CHARS = 1 << 22
#: Candidates that are followed at once in a segment.
STEP_CANDIDATES = 1 << 20


class Phrases:
    """Distinct windows of a set of test items: ``terms`` (windows, size; -1 beyond ``length``) as places in the sorted term hashes
    ``vocabulary``; the items that have window w are ``item[first[w]:first[w + 1]]``, places in ``names``, which are
    the item ids as strings, sorted."""

    def __init__(self, ids: list[str], texts: list[str | None], size: int):
        self.size, self.names = size, sorted(set(ids))
        place = {name: k for k, name in enumerate(self.names)}
        words = tk.Words(*tk.column_bytes(pa.array(texts, pa.string())), tk.separators("ascii"), True)
        self.vocabulary, term = np.unique(words.hash, return_inverse=True)
        owner = np.array([place[i] for i in ids], dtype=np.int64)
        count = np.diff(words.first)
        windows = np.where(count > 0, np.maximum(count - size, 0) + 1, 0)
        text = np.repeat(np.arange(len(ids)), windows)
        begin = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + words.first[:-1][text]
        at = begin[:, None] + np.arange(size)[None, :]
        padded = np.append(term, -1).astype(np.int32)
        rows = padded[np.where(at < words.first[1:][text][:, None], at, len(term))]
        self.terms, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (np.zeros((0, size), np.int32), np.zeros(0, np.int64))
        self.length = (self.terms >= 0).sum(axis=1)
        pair = np.unique(which.ravel().astype(np.int64) * max(len(self.names), 1) + owner[text])
        self.item = pair % max(len(self.names), 1)
        self.first = np.searchsorted(pair, np.arange(len(self.terms) + 1) * max(len(self.names), 1))


_INDEX = "uid array<long>, doc_id array<long>, first binary, term binary, count binary, position binary"
_index = pa.schema([("uid", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("first", "term", "count", "position")]])


def _index_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> segments: documents, the first word of each, and the posting lists of all terms, by term. Counts and positions have two
    bytes where a segment has no more words than these can tell apart, else four."""
    uid = TaskContext.get().partitionId() << 33
    for batch in batches:
        for a, b, words in tk.each_words(batch.column(1), "ascii", True):
            position = np.argsort(words.hash, kind="stable")
            term = words.hash[position]
            edge = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            small = np.uint16 if len(term) < 1 << 16 else np.int32
            lists = [words.first.astype(np.int32), term[edge], np.diff(np.append(edge, len(term))).astype(small), position.astype(small)]
            own = pa.array([np.arange(uid, uid + b - a)], pa.list_(pa.int64()))
            uid += b - a
            ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([own, ids, *(pa.array([x.tobytes()], pa.binary()) for x in lists)], schema=_index)


class Segment:
    """A stored segment: ``first`` words of its documents (and the end), its sorted ``term`` hashes, the ``count`` of each and their ``position`` lists,
    end to end."""

    def __init__(self, first: bytes, term: bytes, count: bytes, position: bytes):
        self.first, self.term = np.frombuffer(first, np.int32), np.frombuffer(term, np.uint64)
        self.words = int(self.first[-1]) if len(self.first) else 0
        small = np.uint16 if self.words < 1 << 16 else np.int32
        self.count, self.position = (np.frombuffer(x, small).astype(np.int64) for x in (count, position))

    def lists(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the vocabulary, count) of the segment's test terms, and their lists, end to end."""
        at = np.searchsorted(vocabulary, self.term)
        at[at == len(vocabulary)] = 0
        known = np.flatnonzero(vocabulary[at] == self.term) if len(vocabulary) else np.zeros(0, np.int64)
        n, begin = self.count[known], (np.cumsum(self.count) - self.count)[known]
        return at[known], n, self.position[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def occurrences(phrases: Phrases, segment: Segment, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, word) of every match of every window in a segment, by intersecting offset-adjusted posting lists from the rarest term on. A
    match lies in one document. With ``slop`` the window's first term stands at ``word`` and every other one within that many words of its
    place: a definition that does not depend on the segment."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    term, count, position = segment.lists(phrases.vocabulary)
    if not len(phrases.terms) or not len(term):
        return none
    have = np.zeros(len(phrases.vocabulary) + 1, dtype=np.int64)
    begin = np.zeros(len(phrases.vocabulary) + 1, dtype=np.int64)
    have[term], begin[term] = count, np.cumsum(count) - count
    # lists in the order of terms, positions rising: one sorted array of (term, position), in which a list is intersected by bisection
    stride = segment.words + 1
    posting = np.repeat(term, count) * stride + position
    size, first = phrases.size, segment.first

    def stands(wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Does the wanted term stand at a word of [low, high)?"""
        from_, to = np.searchsorted(posting, wanted * stride + low), np.searchsorted(posting, wanted * stride + high)
        return (high > low) & (to > from_)

    frequency = np.where(phrases.terms >= 0, have[phrases.terms], np.iinfo(np.int64).max)
    alive = np.flatnonzero(frequency.min(axis=1) > 0)
    if not len(alive):
        return none
    order = np.argsort(frequency[alive], axis=1, kind="stable")
    rare = frequency[alive, order[:, 0]]
    out_window, out_word = [], []
    cut = np.searchsorted(np.cumsum(rare), np.arange(STEP_CANDIDATES, int(rare.sum()) + STEP_CANDIDATES, STEP_CANDIDATES), side="left") + 1
    lo = 0
    for hi in np.unique(np.minimum(cut, len(alive))):
        w, r = alive[lo:hi], rare[lo:hi]
        k = order[lo:hi]
        which = np.repeat(np.arange(hi - lo), r)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(r) - r, r)
        word = position[begin[phrases.terms[w, k[:, 0]]][which] + inside] - k[which, 0]
        if slop:  # the first term stands within reach of where the rarest one puts it
            word, which = (word[:, None] + np.arange(-slop, slop + 1)).ravel(), np.repeat(which, 2 * slop + 1)
            real = (word >= 0) & (word < segment.words)
            pair = np.unique(which[real] * stride + word[real])
            which, word = pair // stride, pair % stride
            begins = stands(phrases.terms[w[which], 0].astype(np.int64), word, word + 1)
            which, word = which[begins], word[begins]
        else:
            which, word = which[word >= 0], word[word >= 0]
        doc = np.searchsorted(first, word, side="right") - 1
        low, high = first[doc].astype(np.int64), first[np.minimum(doc + 1, len(first) - 1)].astype(np.int64)
        for j in range(size):
            offset = k[which, j]
            wanted = phrases.terms[w[which], offset].astype(np.int64)
            here = word + offset
            ok = (wanted < 0) | stands(np.maximum(wanted, 0), np.maximum(here - slop, low), np.minimum(here + slop + 1, high))
            which, word, low, high = which[ok], word[ok], low[ok], high[ok]
            if not len(which):
                break
        out_window.append(w[which])
        out_word.append(word)
        lo = int(hi)
    return np.concatenate(out_window), np.concatenate(out_word)


def _item_sets(phrases: Phrases, doc: np.ndarray, window: np.ndarray, rows: int) -> list[list[str]]:
    """Sorted names of the items that have a match in each document."""
    n = phrases.first[window + 1] - phrases.first[window]
    item = phrases.item[np.repeat(phrases.first[window], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    pair = np.unique(np.repeat(doc, n) * max(len(phrases.names), 1) + item)
    out: list[list[str]] = [[] for _ in range(rows)]
    for d, i in zip((pair // max(len(phrases.names), 1)).tolist(), (pair % max(len(phrases.names), 1)).tolist(), strict=True):
        out[d].append(phrases.names[i])
    return out


_HITS = "uid long, doc_id long, n_words long, hits array<struct<a:int,b:int>>, items array<string>, near array<string>"
_span = pa.struct([("a", pa.int32()), ("b", pa.int32())])
_hits = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(_span)), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])


def _search(sent, slop: int):
    """Segments -> one row per document: hit word ranges [a, b), items with exact matches, further items with proximity matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(*(batch.column(c)[k].as_buffer() for c in range(2, 6)))
                first, n_words = segment.first, segment.words
                rows = len(first) - 1
                found = {}
                for s in sorted({0, slop}):
                    window, word = occurrences(phrases, segment, s) if n_words else (np.zeros(0, np.int64),) * 2
                    found[s] = window, word, np.searchsorted(first, word, side="right") - 1, phrases.length[window]
                window, word, doc, length = found[0]
                step = np.zeros(n_words + 1, dtype=np.int64)
                np.add.at(step, word, 1)
                np.add.at(step, word + length, -1)
                hit = (np.cumsum(step[:-1]) > 0).astype(np.int8)
                # ranges end where a document ends
                inner = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < n_words)]
                edge = np.diff(np.concatenate(([0], hit, [0])))
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                if len(begin):
                    cutting = np.unique(inner[hit[inner].astype(bool) & hit[inner - 1].astype(bool)])
                    begin, end = np.sort(np.concatenate((begin, cutting))), np.sort(np.concatenate((end, cutting)))
                owner = np.searchsorted(first, begin, side="right") - 1
                ends = np.searchsorted(owner, np.arange(rows + 1))
                spans = pa.StructArray.from_arrays([pa.array((begin - first[owner]).astype(np.int32)), pa.array((end - first[owner]).astype(np.int32))], fields=list(_span))
                items = _item_sets(phrases, doc, window, rows)
                near = [[] for _ in items]
                if slop:
                    window, _, doc, _ = found[slop]
                    near = [sorted(set(n) - set(i)) for n, i in zip(_item_sets(phrases, doc, window, rows), items, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[k].values, batch.column(1)[k].values, pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))],
                    schema=_hits,
                )

    return run


def segments_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``, a row for each segment, to be written and searched as often as one likes. It takes about as much room as the
    compressed text. Null texts have no words; other columns are ignored."""
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _index_scan, _INDEX)


def search(index: DataFrame, items: DataFrame, size: int = 13, slop: int = 2, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``matches`` of the documents of a written index. The index is read once for each PASS_CHARS characters of ``items``."""
    spark: SparkSession = index.sparkSession
    test = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    with Workspace(spark, "contamination") as ws:
        chars = test.agg(F.sum(F.length("text"))).first()[0] or 0
        passes = max(1, -(-chars // PASS_CHARS))
        parts = []
        for k in range(passes):
            own = (test.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k) if passes > 1 else test).toArrow()
            sent = spark.sparkContext.broadcast(Phrases(own["item"].to_pylist(), own["text"].to_pylist(), size))
            found = map_arrow(index, _search(sent, slop), _HITS)
            if passes == 1:
                return durable(spark, found)
            parts.append(ws.table(found))
            sent.destroy()
        out = reduce(DataFrame.union, parts)
        merged = (F.flatten(F.collect_list(c)) for c in ("hits", "items", "near"))
        out = out.groupBy("uid", "doc_id", "n_words").agg(*(m.alias(c) for m, c in zip(merged, ("hits", "items", "near"), strict=True)))
        return durable(spark, out.withColumns({"items": F.array_sort(F.array_distinct("items")), "near": F.array_sort(F.array_distinct(F.array_except("near", "items")))}))


def matches(docs: DataFrame, items: DataFrame, size: int = 13, slop: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Where windows of ``size`` consecutive words of ``items`` stand in ``docs``: one row for each row of ``docs`` with ``uid``, ``doc_id``,
    ``n_words``, ``hits`` (ranges [a, b) of words in exact matches), ``items`` (ids, as sorted strings, of items with exact matches) and ``near``
    (further items with proximity matches: a window's first term, and every other one within ``slop`` words of its place from there).

    Words are lower-cased letters, digits and everything beyond ASCII. An item with fewer words, but some, is one
    window. Null texts have no words; items with a null id are passed over; items that share an id are one. Other columns are
    ignored; repeated rows are judged each; empty tables give no matches. A very long text is a segment of its own, held whole in memory of some
    forty times its size.
    """
    with Workspace(docs.sparkSession, "index") as ws:
        return search(ws.table(segments_of(docs, id_col, text_col)), items, size, slop, item_col, text_col)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("n_near", pa.int64())])
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        hit, digests = [], []
        for spans, items in zip(batch.column(2), batch.column(3), strict=True):
            total, last = 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans.as_py()) if len(spans) else ():
                total += max(0, b - max(a, last))
                last = max(last, b)
            hit.append(total)
            digests.append(hashlib.sha256(",".join(items.as_py()).encode()).hexdigest() if len(items) else empty)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in batch.column(3)], pa.int64()), pa.array(digests, pa.string()), pa.array([len(x) for x in batch.column(4)], pa.int64())], schema=schema)


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, slop: int = 2, **columns: str) -> DataFrame:
    """``matches`` summed up: ``doc_id``, ``n_words``, ``n_hit`` (words in exact matches), ``n_items``, ``items_sha256`` (of the sorted item
    ids, comma-joined), ``contaminated`` (n_hit > 0 and share * n_hit >= n_words) and ``n_near`` (items with proximity matches only)."""
    found = matches(docs, items, size, slop, **columns).select("doc_id", "n_words", "hits", "items", "near")
    out = map_arrow(found, _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, n_near long")
    verdict = (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", verdict.alias("contaminated"), "n_near")
