"""Quality classifier: supervised subword embeddings in the manner of bag-of-tricks text classification.

Words, word pairs and the 3- and 4-grams of a word's characters are hashed to buckets, each with a learned vector; a document is the average of
its vectors, and a softmax layer gives the class. Training is numpy stochastic gradient descent on a bounded sample
of labelled rows. Because averaging and the output layer are linear, scoring needs one number per bucket: a document's logit
is the average of its buckets' numbers, taken over the whole text in one vectorised pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import map_arrow

#: Hash buckets of all kinds of features, and the lengths of character n-grams.
BUCKETS, GRAMS = 1 << 16, (3, 4)
#: Most labelled rows that training reads (the smallest by a hash of their id), dimensions, passes and step.
SAMPLE, DIMENSIONS, EPOCHS, RATE = 2000, 8, 16, 4.0


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of every text of a step, by text."""
    words = tk.Words(data, offsets, tk.separators("space"), False)
    rows = len(offsets) - 1
    first = words.first
    pair = tk.windows(words.hash, 2)
    # a word that repeats itself is one feature, whatever the word
    pair[words.hash[1:] == words.hash[:-1]] = np.uint64(1)
    text = np.repeat(np.arange(rows), np.diff(first))
    same = text[1:] == text[:-1]
    found_text = [text, text[1:][same]]
    found = [_bucket(words.hash, 1), _bucket(pair[same], 2)]
    for n in GRAMS:
        word, gram = words.grams(n)
        found.append(_bucket(gram, n))
        found_text.append(text[word])
    return np.concatenate(found_text), np.concatenate(found)


def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (tk.salted(hashes, 40 + salt) & np.uint64(BUCKETS - 1)).astype(np.int64)


def bags(texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, end row, [(distinct buckets, counts)]) of each text."""
    data, offsets = tk.column_bytes(texts)
    for a, b in tk.steps(offsets):
        text, bucket = buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        pair, count = np.unique(text * BUCKETS + bucket, return_counts=True)
        border = np.searchsorted(pair, np.arange(b - a + 1) * BUCKETS)
        yield a, b, [(pair[x:y] % BUCKETS, count[x:y]) for x, y in zip(border[:-1], border[1:], strict=True)]


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(a number per bucket, a constant): a text's logit for label 1 is the mean of its buckets' numbers plus the constant.
    With one class only, every text gets that class's smoothed share."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(np.unique(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, counts = examples[k]
            if not len(at):
                continue
            w = (counts / counts.sum()).astype(np.float32)
            own = vectors[at]
            h = w @ own
            z = h @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[k])] -= 1
            back = output @ p
            output -= np.float32(rate * 0.1) * np.outer(h, p)
            bias -= np.float32(rate * 0.02) * p
            # the average's gradient, spread over its buckets by weight; scaled up as the weights are small
            vectors[at] = own - np.float32(rate) * np.outer(np.sqrt(w), back)
    number = vectors @ (output[:, 1] - output[:, 0])
    return number.astype(np.float32), float(bias[1] - bias[0])


def logits(texts: pa.Array, number: np.ndarray, constant: float) -> np.ndarray:
    """Logit of each text; without features the constant alone."""
    data, offsets = tk.column_bytes(texts)
    out = np.empty(len(offsets) - 1)
    for a, b in tk.steps(offsets):
        text, bucket = buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        total = np.bincount(text, weights=number[bucket], minlength=b - a)
        count = np.bincount(text, minlength=b - a)
        out[a:b] = total / np.maximum(count, 1) + constant
    return out


_BAG = "doc_id long, label int, bucket binary, count binary"


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bucket", pa.binary()), ("count", pa.binary())])
    for batch in batches:
        for a, b, found in bags(batch.column(2)):
            own = [pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in zip(zip(*found, strict=True), (np.uint16, np.uint32), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *own], schema=schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most ``most`` labelled (doc_id, label, text) rows per text of an id: the labels smallest by a hash of their id. Null ids and labels
    are passed over; an id with several labels counts with the largest."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(own), "doc_id").select("doc_id", "label", "text")


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """The model of ``train`` from at most ``most`` labelled documents (features are hashed where the texts are; only bags of
    at most BUCKETS entries reach the driver). Without labelled rows every text scores one half."""
    sample = map_arrow(labelled_sample(docs, labels, most, id_col, text_col, label_col), _bag_rows, _BAG)
    rows = sample.groupBy("doc_id").agg(F.min(F.struct("label", "bucket", "count")).alias("x")).select("doc_id", "x.*").toArrow().sort_by("doc_id")
    examples = [(np.frombuffer(i.as_buffer(), np.uint16), np.frombuffer(c.as_buffer(), np.uint32)) for i, c in zip(rows["bucket"], rows["count"], strict=True)]
    return train(examples, rows["label"].to_numpy().astype(np.int64))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of ``docs``: the probability of label 1 over the whole text. Null texts are empty and
    score by the constant; ids may be null or repeat, and repeated rows score alike; other columns are ignored; an empty table gives an empty
    result. A very long text is one step, in memory of some fifty times its size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, constant = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(logits(batch.column(1), number, constant)))], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double")


def quality_filter(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text scores at least ``least``. No join: rows are judged where they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, constant = sent.value
        for batch in batches:
            yield batch.filter(pa.array(sigmoid(logits(batch.column(place), number, constant)) >= least))

    return map_arrow(docs, run, docs.schema)
