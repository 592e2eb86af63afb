"""Counterfactual-regularised toxicity classifier.

A logistic model over the distinct words of a text, by whole word and by word beginnings, so that inflected forms of a stem count.
Weights are not negative and mostly zero (an L1 penalty): long texts gather no noise, and a toxic word is not outvoted by
the text around it. Identity terms in labelled sentences are swapped for others of their group and every change of score is
penalised, as are swaps within each group of the lexicon itself, so that a neutral mention of a group does not move a score. The penalty
is on the change of the logit, of which a score's change is at most a quarter: it holds in every context, also where the score of
the labelled sentence is near 0 or 1 and would hide the change, and it keeps the fit convex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .quality import labelled_sample, sigmoid
from .store import map_arrow

#: Hash buckets; lengths in bytes of the word beginnings that are features.
BUCKETS, BEGINNINGS = 1 << 18, (4, 5, 6, 7, 8)
#: Most labelled rows that training reads (the smallest by a hash of their id), steps, and the penalties' factors.
SAMPLE, STEPS, SPARSE, SWAP = 6000, 400, 5e-4, 0.05
#: Parts of the sample that are scored by a fit without them, for calibration.
FOLDS = 3
#: How much likelier under label 1 a bucket must be to be fitted at all.
LIFT = 2.0
#: Swaps that are tried for each identity term of a labelled sentence.
SWAPS = 2

#: Terms by group, of which one can stand for another in a neutral sentence.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "chrétien", "musulman", "juif", "christlich", "muslimisch", "jüdisch", "cristiano", "musulmán", "judío"),
    "origin": ("american", "european", "african", "asian", "arab", "mexican", "chinese", "indian", "turkish", "polish", "immigrant", "refugee", "étranger", "ausländer", "extranjero"),
    "colour": ("black", "white", "brown", "noir", "blanc", "schwarz", "weiß", "negro", "blanco"),
    "gender": ("woman", "man", "women", "men", "girl", "boy", "transgender", "femme", "homme", "frau", "mann", "mujer", "hombre"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual", "schwul", "lesbisch"),
    "age": ("old", "young", "elderly", "teenage", "vieux", "jeune", "alt", "jung", "viejo", "joven"),
    "ability": ("disabled", "blind", "deaf", "autistic", "handicapé", "aveugle", "behindert", "taub", "discapacitado", "ciego"),
}


def features(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every feature: each word, and its beginnings where it is longer."""
    every = np.arange(len(words.hash))
    word, found = [every], [_bucket(words.hash, 0)]
    length = words.end - words.start
    for n in BEGINNINGS:
        long = np.flatnonzero(length > n)
        code = np.zeros(len(long), dtype=np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | words.data[words.start[long] + k].astype(np.uint64)
        word.append(long)
        found.append(_bucket(code, n))
    return np.concatenate(word), np.concatenate(found)


def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (tk.salted(hashes, 60 + salt) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _words(texts: list[str]) -> tk.Words:
    return tk.Words(*tk.column_bytes(pa.array(texts, pa.string())), tk.separators("ascii"), True)


class Lexicon:
    """Hashes of the identity terms, the group of each, and the buckets that each has."""

    def __init__(self, groups: dict[str, tuple[str, ...]]):
        terms = [(g, t) for g, own in enumerate(groups.values()) for t in own]
        words = _words([t for _, t in terms])
        if len(words.hash) != len(terms):
            raise ValueError("an identity term is one word")
        self.hash, self.group = words.hash, np.array([g for g, _ in terms])
        word, bucket = features(words)
        self.bag = [set(bucket[word == k].tolist()) for k in range(len(terms))]
        self.order = np.argsort(self.hash)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The term that each word is; -1 where it is none."""
        at = np.searchsorted(self.hash, hashes, sorter=self.order)
        at = self.order[np.minimum(at, len(self.order) - 1)]
        return np.where(self.hash[at] == hashes, at, -1)

    def swaps(self, term: int, turn: int) -> list[tuple[list[int], list[int]]]:
        """(buckets gained, buckets lost) when ``term`` is swapped for the next SWAPS terms of its group."""
        own = np.flatnonzero(self.group == self.group[term])
        at = int(np.flatnonzero(own == term)[0])
        others = [int(own[(at + 1 + (turn + k) % max(len(own) - 1, 1)) % len(own)]) for k in range(min(SWAPS, len(own) - 1))]
        return [(sorted(self.bag[o] - self.bag[term]), sorted(self.bag[term] - self.bag[o])) for o in others]


def bags(texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray], list[np.ndarray]]]:
    """(first row, end row, distinct buckets of each text, its words' hashes)."""
    for a, b, words in tk.each_words(texts, "ascii", True):
        word, bucket = features(words)
        text = np.repeat(np.arange(b - a), np.diff(words.first))
        pair = np.unique(text[word] * BUCKETS + bucket)
        border = np.searchsorted(pair, np.arange(b - a + 1) * BUCKETS)
        yield a, b, [pair[x:y] % BUCKETS for x, y in zip(border[:-1], border[1:], strict=True)], [words.hash[x:y] for x, y in zip(words.first[:-1], words.first[1:], strict=True)]


def counterfactuals(hashes: np.ndarray, bag: np.ndarray, lexicon: Lexicon) -> list[tuple[list[int], list[int]]]:
    """(gained, lost) buckets of a text's swaps; a bucket that other words of the text have, too, does not change."""
    out = []
    for turn, term in enumerate(np.unique(lexicon.find(hashes)).tolist() if len(hashes) else ()):
        if term >= 0:
            have = set(bag.tolist())
            out += [([g for g in gained if g not in have], lost) for gained, lost in lexicon.swaps(term, turn)]
    return out


def train(examples: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, float]:
    """(weight per bucket, constant): the weights of ``fit``, scaled and shifted so that scores are probabilities (Platt), by the logits that fits
    without a part of the sample give to this part; those of a fit to its own sample are too sure."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(np.unique(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    weight, bias = fit(examples, labels, swaps)
    logit, part = np.zeros(len(examples)), np.arange(len(examples)) % FOLDS
    for k in range(FOLDS):
        rest = np.flatnonzero(part != k)
        own, b = fit([examples[i] for i in rest], labels[rest], swaps) if len(np.unique(labels[rest])) == 2 else (weight, bias)
        for i in np.flatnonzero(part == k):
            logit[i] = own[examples[i]].sum() + b
    a, c = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * logit + c)
        q = np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(q * logit * logit).sum() + 1e-3, (q * logit).sum()], [(q * logit).sum(), q.sum() + 1e-3]])
        move = np.linalg.solve(hess, [((p - labels) * logit).sum(), (p - labels).sum()])
        a, c = a - np.clip(move[0], -1, 1), c - np.clip(move[1], -1, 1)
    a = max(a, 0.0)
    return (weight * a).astype(np.float32), float(a * bias + c)


def fit(examples: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, float]:
    """(weight per bucket, constant) by accelerated proximal gradient on the mean log loss, classes weighted alike, plus SPARSE times
    the weights' sum plus SWAP times the mean squared change of the logit over ``swaps``; weights are never negative."""
    weight = np.zeros(BUCKETS)
    size = np.array([len(e) for e in examples])
    at = np.concatenate(examples).astype(np.int32)
    # a bucket that one text alone has, or that is no likelier under label 1, would end at zero
    with_one = np.bincount(at[np.repeat(labels == 1, size)], minlength=BUCKETS)
    every = np.bincount(at, minlength=BUCKETS)
    keep = ((every > 1) & (with_one * (len(labels) - labels.sum()) > LIFT * (every - with_one) * labels.sum()))[at]
    row = np.repeat(np.arange(len(examples), dtype=np.int32), size)[keep]
    at = at[keep]
    used, at = np.unique(at, return_inverse=True)
    place = {int(u): k for k, u in enumerate(used)}
    pairs = [([place[g] for g in gained if g in place], [place[x] for x in lost if x in place]) for gained, lost in swaps]
    pairs = [p for p in pairs if p[0] or p[1]]
    swap_row = np.array([k for k, p in enumerate(pairs) for _ in p[0] + p[1]], dtype=np.int64)
    swap_at = np.array([i for p in pairs for i in p[0] + p[1]], dtype=np.int64)
    swap_sign = np.array([s for p in pairs for s in [1.0] * len(p[0]) + [-1.0] * len(p[1])])
    n, y = len(examples), labels.astype(float)
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))  # classes weigh alike

    w, v, b, vb, t = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 1.0
    # step by a bound of the curvature: the greatest row sum of the two Hessians' absolute values (a text's column of ones among them)
    wide = each * (np.bincount(row, minlength=n) + 1)
    steep = 0.25 * max(np.bincount(at, weights=wide[row], minlength=len(used)).max(initial=0.0), wide.sum())
    if len(pairs):
        steep += 2 * SWAP / len(pairs) * np.bincount(swap_at, weights=np.bincount(swap_row, minlength=len(pairs))[swap_row], minlength=len(used)).max(initial=0.0)
    step = 1.0 / steep
    for _ in range(STEPS):
        z = np.bincount(row, weights=v[at], minlength=n) + vb
        r = each * (sigmoid(z) - y)
        g = np.bincount(at, weights=r[row], minlength=len(used))
        if len(pairs):
            change = np.bincount(swap_row, weights=swap_sign * v[swap_at], minlength=len(pairs)) * (2 * SWAP / len(pairs))
            g += np.bincount(swap_at, weights=swap_sign * change[swap_row], minlength=len(used))
        new, newb = np.maximum(v - step * (g + SPARSE), 0), vb - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), newb + (t - 1) / t2 * (newb - b)
        w, b, t = new, newb, t2
    weight[used] = w
    return weight, float(b)


def logits(texts: pa.Array, weight: np.ndarray, constant: float) -> np.ndarray:
    """Logit of each whole text: the constant and the weights of its distinct buckets."""
    out = np.full(len(texts), constant)
    for a, b, words in tk.each_words(texts, "ascii", True):
        word, bucket = features(words)
        hit = weight[bucket] > 0
        if hit.any():
            text = np.repeat(np.arange(b - a), np.diff(words.first))
            pair = np.unique(text[word[hit]] * BUCKETS + bucket[hit])
            out[a:b] += np.bincount(pair // BUCKETS, weights=weight[pair % BUCKETS], minlength=b - a)
    return out


_BAG = "doc_id long, label int, bucket binary, swaps binary"


def _bag_rows(groups: dict[str, tuple[str, ...]]):
    """(doc_id, label, text) -> distinct buckets, and the swaps as numbers: gained buckets, lost ones as -1 - bucket, -BUCKETS - 1 after each."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bucket", pa.binary()), ("swaps", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(groups)
        for batch in batches:
            for a, b, found, hashes in bags(batch.column(2)):
                swaps = []
                for bag, own in zip(found, hashes, strict=True):
                    flat = [x for gained, lost in counterfactuals(own, bag, lexicon) for x in [*gained, *(-1 - k for k in lost), -BUCKETS - 1]]
                    swaps.append(np.array(flat, np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([f.astype(np.int32).tobytes() for f in found], pa.binary()), pa.array(swaps, pa.binary())], schema=schema)

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, groups: dict[str, tuple[str, ...]] = IDENTITY_TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """The model of ``train`` from at most ``most`` labelled documents, hashed where they are. Swaps are those of identity terms in these
    documents and those within each group of the lexicon. Without labelled rows every text scores one half."""
    sample = map_arrow(labelled_sample(docs, labels, most, id_col, text_col, label_col), _bag_rows(groups), _BAG)
    rows = sample.groupBy("doc_id").agg(F.min(F.struct("label", "bucket", "swaps")).alias("x")).select("doc_id", "x.*").toArrow().sort_by("doc_id")
    lexicon = Lexicon(groups)
    swaps = [s for k in range(len(lexicon.hash)) for s in lexicon.swaps(k, k)]
    for flat in rows["swaps"]:
        numbers = np.frombuffer(flat.as_buffer(), np.int32)
        for own in np.split(numbers, np.flatnonzero(numbers == -BUCKETS - 1) + 1)[:-1]:
            own = own[:-1]
            swaps.append((own[own >= 0].tolist(), (-1 - own[own < 0]).tolist()))
    return train([np.frombuffer(b.as_buffer(), np.int32) for b in rows["bucket"]], rows["label"].to_numpy().astype(np.int64), swaps)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of ``docs``: the probability of label 1 over the whole text. Null texts are empty and
    score by the constant; ids may be null or repeat, and repeated rows score alike; other columns are ignored; an empty table gives an empty
    result. A very long text is one step, in memory of some forty times its size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, constant = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(logits(batch.column(1), weight, constant)))], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double")
