"""Supervised text classifier: hashed word and character n-gram vectors, averaged, softmax, numpy SGD.

A word's vector is the mean of the vectors of its hash and of its byte n-grams (with a blank at both ends);
repeats make words of their own: one for each word equal to the one before, one for each word of a line
that the text had before. A text's vector is the mean over all of these, and a linear layer with softmax
turns it into probabilities. Training runs on a bounded sample of labelled rows; scoring runs on Spark,
where two classes need one number per bucket only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retroscope.llm._common import GOLD, bytes_of, mix

BUCKETS, DIMS, GRAMS = 1 << 17, 8, (3, 4, 5)
#: Labelled rows that a fit uses at most (those of smallest hashed id), epochs, texts a step, step size.
SAMPLE, EPOCHS, BATCH, RATE = 4000, 12, 16, 8.0
SAME, COPY = 0, 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) of all features; a text's weights sum to 1, texts without words have none."""
    split = [t.split() for t in texts]
    n = np.array([len(w) for w in split])
    data = np.frombuffer(b"".join(b" " + b" ".join(w) + b" " for w in split), np.uint8)
    slots = n + 1  # the blank at a text's end opens a slot without letters
    slots[n == 0] += 1
    blank = data == 32
    opened = np.cumsum(blank)
    slot = opened - 1
    owner = np.repeat(np.arange(len(texts)), slots)
    codes = data.astype(np.uint64) + np.uint64(1)
    ids, weights_of = [], []
    for g in GRAMS:
        if data.size < g:
            continue
        m = data.size - g + 1
        inner = opened[g - 2 : g - 2 + m] - opened[:m]
        at = np.flatnonzero(inner == 0)
        h = np.full(at.size, g, np.uint64)
        for k in range(g):
            h = h * _BASE + codes[at + k]
        ids.append((mix(h) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2)
        weights_of.append(slot[at])
    starts = np.flatnonzero(blank)
    size = np.diff(np.append(starts, data.size)) - 1
    word = size > 0
    word_id = np.zeros(starts.size, np.uint64)
    # a word's hash: its letters, summed with mixed places
    place = np.arange(data.size) - starts[slot]
    letters = mix(codes + place.astype(np.uint64) * GOLD)
    letters[blank] = 0
    if data.size:
        word_id = np.add.reduceat(letters, starts)
    ids.append((mix(word_id[word]) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2)
    weights_of.append(np.flatnonzero(word))
    flat, of = np.concatenate(ids), np.concatenate(weights_of)
    parts = np.bincount(of, minlength=starts.size)
    same = np.zeros(starts.size, bool)
    same[1:] = word[1:] & word[:-1] & (word_id[1:] == word_id[:-1])
    same_n = np.bincount(owner[same], minlength=len(texts))
    copy_n = np.array([_copied(t) if n[i] else 0 for i, t in enumerate(texts)])
    total = np.maximum(n + same_n + copy_n, 1)
    text = np.concatenate((owner[of], np.flatnonzero(same_n), np.flatnonzero(copy_n)))
    bucket = np.concatenate((flat, np.full(np.count_nonzero(same_n), SAME), np.full(np.count_nonzero(copy_n), COPY)))
    weight = np.concatenate((1.0 / (parts[of] * total[owner[of]]), (same_n / total)[same_n > 0], (copy_n / total)[copy_n > 0]))
    return text, bucket, weight


def _copied(text: bytes) -> int:
    """Words in lines that the text had before."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    out = 0
    for line in lines:
        if line in seen:
            out += len(line.split())
        seen.add(line)
    return out


@dataclass
class Model:
    """For each bucket the number that it adds to class 1's logit over class 0's, and the bias."""

    value: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        text, bucket, weight = features(texts)
        z = np.bincount(text, self.value[bucket] * weight, minlength=len(texts)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Fit by stochastic gradient descent. Without rows, or with one class only, scores are that share."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0 if not labels else 5.0 if labels[0] else -5.0)
    rows = []
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        text, bucket, weight = features(part)
        # sums by text and bucket
        key, where = np.unique(text * BUCKETS + bucket, return_inverse=True)
        total = np.bincount(where, weight, minlength=key.size).astype(np.float32)
        bounds, place = np.searchsorted(key, np.arange(len(part) + 1) * BUCKETS), (key % BUCKETS).astype(np.int32)
        rows.extend((place[lo:hi], total[lo:hi, None]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True))  # views of few arrays
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIMS, 1.0 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMS), np.float32), np.zeros(2, np.float32)
    y = np.eye(2, dtype=np.float32)[np.array(labels)]
    steps, done = epochs * -(-len(rows) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, order.size, BATCH):
            lr = rate * (1 - done / steps)
            done += 1
            pick = order[at : at + BATCH]
            one = np.stack([(vectors[rows[i][0]] * rows[i][1]).sum(axis=0) for i in pick])
            z = one @ layer.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - y[pick]) / pick.size
            back = g @ layer
            layer -= lr * (g.T @ one)
            bias -= lr * 0.1 * g.sum(axis=0)
            for i, step in zip(pick, -lr * back, strict=True):
                vectors[rows[i][0]] += rows[i][1] * step
    value = vectors.astype(np.float64) @ (layer[1] - layer[0]).astype(np.float64)
    return Model(value, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may use: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """A model of labels (doc_id, label) on texts of docs, from at most `most` rows that are not held out.

    Null labels and ids are left out; a doc_id with several labels or texts gives a row for each pair.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(most)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_label").toArrow().sort_by([("doc_id", "ascending"), ("_label", "ascending"), ("text", "ascending")])
    return train([x.as_py() for x in bytes_of(rows.column("text").combine_chunks())], [min(1, max(0, x)) for x in rows.column("_label").to_pylist()])


def scorer(docs: DataFrame, model: Model) -> Column:
    """The score of docs' text as a column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            batch, at, parts = bytes_of(batch), 0, [np.empty(0)]
            ends = np.cumsum(pc.binary_length(batch).to_numpy())
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, side="right")))
                parts.append(sent.value.scores([x.as_py() for x in batch.slice(at, end - at)]))
                at = end
            yield pa.array(np.concatenate(parts))

    return scores(F.col("text").cast("string"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1; higher: label 1 likelier) and predicted (score >= 0.5), one row per row.

    Null and empty texts get the model's bias alone; a null doc_id is not held out; repeated rows get equal
    scores; other columns are ignored; an empty table gives an empty table. Nothing is shuffled.
    """
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), scorer(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score at least 0.5, with all their columns."""
    return docs.where(scorer(docs, model) >= 0.5)
