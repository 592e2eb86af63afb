"""Mixture-controlled sequence packing by deficit round-robin.

Documents are tokenised once, into a written table of ids. A plan says how many tokens of each source the first x tokens of the output hold: at the
target shares until a source runs dry, at those of the others, in proportion, from there on. A document's place in its source is random, the plan
turns it into a place in the output, and places are cut into shards of about half a million tokens. A shard packs its documents window by
window: every source's deficit grows by its share of the window, the source with the largest deficit is served next, documents are cut
where a turn or a window ends, and what a source is owed at the end of a window stays in its deficit. The deficits with which a shard begins
are what the plan promised less what the shards before it hold, known from running sums of the stored lengths, so that shards are
packed in parallel. A shard's last, unfilled window becomes sequences whose lengths are powers of two: there is no padding at all.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .store import Workspace, dealt, durable, map_arrow

#: Tokens of a shard, and the most shards (beyond, shards grow).
SHARD_TOKENS, MOST_SHARDS = 1 << 19, 1 << 20
#: Tokens that a source may be owed before it must be served within a window with room; the longest turn.
LEAST_TURN, LONGEST_TURN = 256, 512
#: Distinct words that a worker remembers the ids of (then it starts anew), and words that are tokenised as one text.
REMEMBERED, TOGETHER = 1 << 20, 256
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"

_encoders: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder:
    """Ids of a text as the tokenizer gives them, with a memory of words.

    Only for tokenizers whose pre-tokenizer never joins what ASCII white space parts, drops the white space, parts letters from
    marks and lower-cases, and whose last token of a word is marked as such, as in the word-end vocabulary: a text's ids
    are then its words' ids end to end, and a word's are those of its letters and of the marks after them. Words are
    remembered by 64-bit hash and length in an open-addressed table, so that a step of texts is looked up and put together in a few vector
    operations and only new words reach the tokenizer. A text that holds the string of an added token, in any case, is left to the tokenizer whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.end_id = end_id
        self._forget()
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = token.endswith("</w>")

    def _ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word by itself; letters only are tokenised many at a time and parted after each last token."""
        found: dict[bytes, bytes] = {}
        plain = [w for w in words if w.isalpha() or w.decode("utf-8", "replace").isalpha()]
        size = self.kind.itemsize
        for a in range(0, len(plain), TOGETHER):
            own = plain[a : a + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(own).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, self.kind)
            cut = ((np.flatnonzero(self.last[ids]) + 1) * size).tolist()
            if len(cut) == len(own):
                raw = ids.tobytes()
                found.update(zip(own, (raw[x:y] for x, y in zip([0, *cut[:-1]], cut, strict=True)), strict=True))
        rest = [w for w in words if w not in found]
        ids = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        found.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(rest, ids, strict=True))
        return found

    def _forget(self) -> None:
        """Know nothing but the end id, entry 0."""
        slots = 2 * REMEMBERED
        self.key, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.begin, self.count = np.zeros(REMEMBERED + 1, np.int64), np.zeros(REMEMBERED + 1, np.int32)
        self.count[0], self.entries, self.used = 1, 1, 1
        self.pool = np.zeros(1 << 16, self.kind)
        self.pool[0] = self.end_id

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key; 0 where it is new."""
        mask = np.uint64(len(self.key) - 1)
        out, at = np.zeros(len(keys), np.int32), (keys & mask).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            have = self.key[at]
            hit = have == keys[todo]
            out[todo[hit]] = self.entry[at[hit]]
            on = ~hit & (self.entry[at] != 0)
            todo, at = todo[on], (at[on] + 1) & int(mask)
        return out

    def _learn(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """Remember new, distinct keys."""
        counts = np.array([len(i) // self.kind.itemsize for i in ids], dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), self.kind)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        entries = np.arange(self.entries, self.entries + len(keys), dtype=np.int32)
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin[entries], self.count[entries] = self.used + np.cumsum(counts) - counts, counts
        self.used, self.entries = self.used + len(flat), self.entries + len(keys)
        mask, at = len(self.key) - 1, (keys & np.uint64(len(self.key) - 1)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.entry[at] == 0
            _, first = np.unique(at, return_index=True)
            mine = np.zeros(len(todo), dtype=bool)
            mine[first] = True
            mine &= free
            self.key[at[mine]], self.entry[at[mine]] = keys[todo[mine]], entries[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & mask

    def __call__(self, words: tk.Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, end to end; their borders) of a step's lower-cased words."""
        keys = tk.mix(words.hash ^ (words.end - words.start).astype(np.uint64))
        entry = self._find(keys)
        new = np.flatnonzero(entry == 0)
        if len(new):
            new_keys, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            if self.entries + len(new_keys) > REMEMBERED:
                self._forget()
                return self(words, rows) if len(np.unique(keys)) < REMEMBERED - 1 else self._by_halves(words, rows)
            raw = words.data.tobytes()
            texts = [raw[a:b] for a, b in zip(words.start[new[first]].tolist(), words.end[new[first]].tolist(), strict=True)]
            begun = self.entries
            self._learn(new_keys, self._each(texts))
            entry[new] = begun + back
        # an end id after each text's words
        every = np.zeros(len(entry) + rows, dtype=np.int32)
        every[np.arange(len(entry)) + np.repeat(np.arange(rows), np.diff(words.first))] = entry
        count = self.count[every].astype(np.int64)
        total = np.cumsum(count)
        ids = self.pool[np.repeat(self.begin[every] - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)]
        ends = words.first[1:] + np.arange(rows)
        return ids, np.concatenate(([0], total[ends]))

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids of these texts, each with the end id, end to end, their borders) over a column."""
        texts = texts.fill_null("")
        odd = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            odd |= pc.match_substring(texts, content, ignore_case=True).to_numpy(zero_copy_only=False)
        for a, b, words in tk.each_words(texts, "space", True):
            ids, border = self(words, b - a)
            if odd[a:b].any():
                each = [self.whole(texts[a + k].as_py()) if odd[a + k] else ids[border[k] : border[k + 1]] for k in range(b - a)]
                ids, border = np.concatenate(each), np.concatenate(([0], np.cumsum([len(e) for e in each])))
            yield a, b, ids, border

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text as the tokenizer gives them, and the end id."""
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end_id], self.kind)

    def _by_halves(self, words: tk.Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """A single text with more distinct words than are remembered: tokenised as it is."""
        out = [np.array([*self.tokenizer.encode_batch_fast([words.data[a:b].tobytes().decode("utf-8", "replace")], add_special_tokens=False)[0].ids, self.end_id], self.kind) for a, b in zip(np.append(words.start, 0)[words.first[:-1]], np.append(words.end, 0)[words.first[1:] - 1], strict=True)]
        return np.concatenate(out), np.concatenate(([0], np.cumsum([len(o) for o in out])))

    def _each(self, words: list[bytes]) -> list[bytes]:
        """Ids of new words. One that ends in letters and then marks has the letters' ids and the marks'."""
        parted = {}
        for w in words:
            core = w.rstrip(_MARKS)
            if core and len(core) < len(w) and (core[-1:].isalpha() or core[-4:].decode("utf-8", "replace").lower()[-1:].isalpha()):
                parted[w] = core, w[len(core) :]
        ids = self._ids(list({w for w in words if w not in parted}.union(*parted.values()))) if parted else self._ids(words)
        return [ids[parted[w][0]] + ids[parted[w][1]] if w in parted else ids[w] for w in words]


_TOKENS = "doc_id long, source string, slot long, n_tokens long, ids binary"


def _tokenise(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("slot", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end_id) not in _encoders:
            _encoders[path, end_id] = WordEncoder(path, end_id)
        encode = _encoders[path, end_id]
        seen = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, ids, border in encode.column(batch.column(2)):
                # a pseudo-random slot deals neighbours, copies and repeated ids to different shards
                slot = (tk.mix(np.arange(seen, seen + b - a, dtype=np.uint64)) >> np.uint64(1)).astype(np.int64)
                seen += b - a
                ends = (border * encode.kind.itemsize).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(slot), pa.array(np.diff(border)), held], schema=schema)

    return run


def pack_shard(lengths: list[int], source: list[int], share: np.ndarray, deficit: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token of the documents once.

    ``source`` numbers each document's queue, ``share`` the queues' target shares and ``deficit`` what each is owed at the start.
    Queues are served in the given order of documents. Full windows have ``window`` tokens; the rest is cut into powers of two.
    """
    queues: list[list[int]] = [[] for _ in share]
    for d, s in enumerate(source):
        queues[s].append(d)
    owed = deficit.astype(float).copy()
    head, at = [0] * len(queues), [0] * len(lengths)
    open_ = np.array([len(q) > 0 for q in queues])
    left, sequence, out = int(sum(lengths)), 0, []
    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        owed += share * size
        offset = 0
        while offset < size:
            s = int(np.argmax(np.where(open_, owed, -np.inf)))
            d = queues[s][head[s]]
            rest, room = lengths[d] - at[d], size - offset
            turn = min(rest, room, max(LEAST_TURN, min(LONGEST_TURN, int(owed[s]))))
            if out and out[-1][0] == d and out[-1][3] == sequence and out[-1][1] + out[-1][2] == at[d]:
                out[-1] = (d, out[-1][1], out[-1][2] + turn, sequence, out[-1][4])
            else:
                out.append((d, at[d], turn, sequence, offset))
            at[d] += turn
            offset += turn
            owed[s] -= turn
            if at[d] == lengths[d]:
                head[s] += 1
                open_[s] = head[s] < len(queues[s])
        left -= size
        sequence += 1
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _pack(window: int, ids_too: bool):
    """Rows sorted by shard, a shard's source rows (ids null; share and deficit set) first -> pieces."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if ids_too else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, sources, rows = None, {}, []

        def pieces() -> pa.RecordBatch:
            names = list(sources)
            place = {name: k for k, name in enumerate(names)}
            found = pack_shard([r[3] for r in rows], [place[r[1]] for r in rows], np.array([sources[n][0] for n in names]), np.array([sources[n][1] for n in names]), window)
            ids = [np.frombuffer(r[2], np.uint16 if len(r[2]) == 2 * r[3] else np.uint32).astype("<u4") for r in rows]
            columns: list[list] = [[] for _ in schema]
            for d, start, length, sequence, offset in found:
                own = ids[d][start : start + length]
                row = [rows[d][0], start, length, zlib.crc32(own.tobytes()), rows[d][3], (shard << 32) + sequence, offset, rows[d][1]]
                for column, value in zip(columns, row + [own.astype(np.int32)] * ids_too, strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for k, doc_id, source, ids, n, share, deficit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != shard:
                    if rows:
                        yield pieces()
                    shard, sources, rows = k, {}, []
                if ids is None:
                    sources[source] = (share, deficit)
                else:
                    rows.append((doc_id, source, ids, n))
        if rows:
            yield pieces()

    return run


Knots = dict[str | None, list[tuple[float, float]]]


def plan_of(totals: Mapping[str | None, int], targets: Mapping[str | None, float]) -> tuple[Knots, float]:
    """How many tokens of each source with a target the first x tokens hold, as knots (x, tokens) of a broken line, and where the last of these
    sources runs dry. Each source takes its share until it is dry; the others then share its part in proportion to theirs."""
    left = {s: float(totals[s]) for s, p in targets.items() if p > 0 and totals.get(s, 0) > 0}
    knots: Knots = {s: [(0.0, 0.0)] for s in left}
    x = 0.0
    while left:
        whole = sum(targets[s] for s in left)
        dry = min(left, key=lambda s: left[s] * whole / targets[s])
        step = left[dry] * whole / targets[dry]
        x += step
        for s in left:
            left[s] = 0.0 if s == dry else left[s] - step * targets[s] / whole
            knots[s].append((x, totals[s] - left[s]))
        left = {s: n for s, n in left.items() if s != dry and n > 0}
    return knots, x


def _along(x: Column, xs: str, ys: str) -> Column:
    """The broken line through (xs, ys), both rising, at ``x``; where it is upright, its end once ``x`` has got there."""
    own = F.col(xs)
    part = F.transform(
        F.sequence(F.lit(1), F.size(own) - 1),
        lambda i: F.when(own[i] > own[i - 1], (F.greatest(F.least(x, own[i]), own[i - 1]) - own[i - 1]) / (own[i] - own[i - 1])).otherwise((x >= own[i]).cast("double")) * (F.col(ys)[i] - F.col(ys)[i - 1]),
    )
    return F.aggregate(part, F.lit(0.0), lambda total, p: total + p)


def _plan(spark: SparkSession, tokens: DataFrame, total: int, targets: Mapping[str | None, float] | None) -> DataFrame:
    """(planned, own, xs, ys) for each source: its tokens, and the knots of its line."""
    own = tokens.groupBy(F.col("source").alias("planned")).agg(F.sum("n_tokens").cast("double").alias("own"))
    xs, ys = "array<double>", "array<double>"
    if targets is None:
        begin = F.lit(0.0)
        made = own.withColumns({"xs": F.lit(None).cast(xs), "ys": F.lit(None).cast(ys)})
    else:  # as many sources as there are targets reach the driver
        names = spark.createDataFrame([(s,) for s in targets], "s string")
        totals = {r["planned"]: int(r["own"]) for r in own.join(F.broadcast(names), F.col("planned").eqNullSafe(F.col("s")), "left_semi").collect()}
        knots, end = plan_of(totals, targets)
        rows = [(s, [x for x, _ in k], [y for _, y in k]) for s, k in knots.items()]
        begin = F.lit(float(end))
        made = own.join(F.broadcast(spark.createDataFrame(rows, f"s string, xs {xs}, ys {ys}")), F.col("planned").eqNullSafe(F.col("s")), "left").drop("s")
    # sources without a target share what is left by their sizes
    rest = F.when(begin > 0, F.array(F.lit(0.0), begin, F.lit(float(total)))).otherwise(F.array(F.lit(0.0), F.lit(float(total))))
    rest_y = F.when(begin > 0, F.array(F.lit(0.0), F.lit(0.0), F.col("own"))).otherwise(F.array(F.lit(0.0), F.col("own")))
    return made.select("planned", "own", F.coalesce("xs", rest).alias("xs"), F.coalesce("ys", rest_y).alias("ys"))


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, ids_too: bool = False, targets: Mapping[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack all documents into sequences of at most ``window`` (a power of two) tokens that mix sources by ``targets``.

    ``targets`` are shares of tokens by source, not negative, of any sum; without them sources are mixed by their share of all tokens. As every
    token is packed, targets hold until a source runs dry; from there on the others share its part in proportion, and sources without a
    target come last. Sequences are in the order of ``sequence_id``.

    A document's tokens are its text's ids by the tokenizer file ``tokenizer`` (see WordEncoder) and then ``end_id``. A row for
    each piece: ``doc_id``, ``start`` and ``length`` in the document, ``ids_crc32`` (of little-endian 32-bit ids), ``doc_tokens``, ``sequence_id``,
    ``offset`` in the sequence, ``source``, and with ``ids_too`` the ``ids``. Every token is in one piece; sequences are full but for a
    shard's last ones, which are powers of two long. Null texts are empty: their one token is ``end_id``. A null source is a
    source of its own; ids may repeat or be null, and repeated rows are documents each. A very long text is tokenised and packed whole, by one task, in
    memory proportional to its length. Other columns are ignored; an empty table gives no pieces.
    """
    if targets is not None and any(p < 0 for p in targets.values()):
        raise ValueError("a target share is not negative")
    spark: SparkSession = docs.sparkSession
    with Workspace(spark, "packing") as ws:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
        tokens = ws.table(map_arrow(source, _tokenise(tokenizer, end_id), _TOKENS))

        total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
        shards = int(np.clip(-(-total // SHARD_TOKENS), 1, MOST_SHARDS))
        plan = ws.table(_plan(spark, tokens, total, targets))
        place = _along(F.col("slot") / F.lit(float(1 << 63)) * F.col("own"), "ys", "xs")
        shard = F.least(F.floor(place / F.lit(float(max(total, 1))) * shards), F.lit(shards - 1)).cast("long")
        sharded = tokens.join(plan, F.col("source").eqNullSafe(F.col("planned"))).withColumn("shard", shard).select(*tokens.columns, "shard")
        counts = ws.table(sharded.groupBy("shard", "source").agg(F.sum("n_tokens").alias("n")))
        # tokens of all sources before each shard (at most MOST_SHARDS rows), and of each source
        of_shard = counts.groupBy("shard").agg(F.sum("n").alias("all"))
        all_before = F.coalesce(F.sum("all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
        of_shard = of_shard.select("shard", "all", all_before.alias("all_before"))
        own_before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        heads = counts.withColumn("own_before", own_before).join(of_shard, "shard").join(plan, F.col("source").eqNullSafe(F.col("planned")))
        promised = _along(F.col("all_before"), "xs", "ys")
        share = (_along(F.col("all_before") + F.col("all"), "xs", "ys") - promised) / F.col("all")
        zero = F.lit(0).cast("long")
        heads = heads.select("shard", F.lit(None).cast("long").alias("doc_id"), "source", F.lit(None).cast("binary").alias("ids"), zero.alias("n_tokens"), share.alias("share"), (promised - F.col("own_before")).alias("deficit"), zero.alias("slot"))
        none = F.lit(None).cast("double")
        bodies = sharded.select("shard", "doc_id", "source", "ids", "n_tokens", none.alias("share"), none.alias("deficit"), "slot")
        rows = dealt(ws.table(heads).union(bodies), "shard", total * 4).sortWithinPartitions("shard", F.col("ids").isNotNull(), "slot", "source")
        rows = rows.select("shard", "doc_id", "source", "ids", "n_tokens", "share", "deficit")
        return durable(spark, map_arrow(rows, _pack(window, ids_too), _PIECES + ", ids array<int>" * ids_too))
