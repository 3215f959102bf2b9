"""Toxicity by subword-bag embeddings, averaged into a linear softmax.

A word is the bag of its own hash and its character n-grams, a text the mean of
its words.  Embeddings and the softmax are trained jointly in numpy, so a
misspelling that was never seen shares the n-grams of words that were.  As the
classifier is linear in the mean, a bucket's embedding is folded into one number
for scoring, and a whole text costs one look-up per n-gram.

Most n-grams of a language say nothing about toxicity.  The executors count them
by class first, and only those whose rates differ beyond chance get an embedding.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netfabric.llm import textbuf
from netfabric.session import cut_lineage

#: Lengths of the byte n-grams within a word and its two edge marks.
NGRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 30
BATCH = 64
RATE = 1.0
SEED = 17
#: Standard errors by which a bucket's rate in one class differs before it gets an embedding.
TELLING = 4.0
MIN_TEXTS = 5
#: Bytes that are neither letters nor digits end a word; bytes of other characters are kept.
TO_WORD = np.array([textbuf.LOWER[b] if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


class ToxicityModel(NamedTuple):
    """``weights[bucket]``: logit that a word's n-gram adds; ``bias``: logit of a text without words."""

    weights: np.ndarray
    bias: float


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(buckets, word of each, words before each row)``: each word's own bucket and those of its n-grams."""
    rows = len(offsets) - 1
    owner = textbuf.owners(offsets)
    # Each row ends in a blank, so words of two rows never touch and every word has an edge on both sides.
    padded = np.full(len(data) + rows + 1, 0x20, np.uint8)
    padded[np.arange(len(data)) + owner + 1] = TO_WORD[data]
    blank = padded == 0x20
    w = textbuf.words(padded, offsets + np.arange(rows + 1) + (np.arange(rows + 1) > 0), blank_table())
    word_of = np.cumsum(~blank & np.concatenate([[True], blank[:-1]])) - 1
    blanks = np.concatenate([[0], np.cumsum(blank)])
    sums = textbuf.running_hash(padded)
    found, words = [w.hashes], [np.arange(len(w.hashes))]
    for size in NGRAMS:
        at = np.arange(max(0, len(padded) - size + 1))
        at = at[blanks[at + size - 1] - blanks[at + 1] == 0]
        found.append(textbuf.gram_hash(sums, at, at + size))
        words.append(word_of[at + 1])
    return (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(words), w.bounds


def blank_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x20] = True
    return table


class Bags(NamedTuple):
    """The telling buckets of each text with their weights in its mean, one text after another.

    ``vocabulary`` has the telling buckets; ``buckets`` are positions in it.
    """

    vocabulary: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    labels: np.ndarray


def bag_texts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and weights of each row; the weights of a row with words sum to 1."""
    for chunk in textbuf.chunks(texts):
        buckets, word, bounds = subwords(chunk.data, chunk.offsets)
        size = np.bincount(word, minlength=bounds[-1])
        words = np.diff(bounds)
        row = textbuf.owners(bounds)[word]
        weight = 1.0 / (size[word] * words[row])
        key, at = np.unique(row * BUCKETS + buckets, return_inverse=True)
        total = np.bincount(at, weight, minlength=len(key)).astype(np.float32)
        ends = np.searchsorted(key, np.arange(1, chunk.hi - chunk.lo + 1) * BUCKETS)
        start = 0
        for end in ends:
            yield (key[start:end] % BUCKETS).astype(np.int32), total[start:end]
            start = end


def sample_texts(
    docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """``(id, text, label)`` of about ``rows`` labelled texts, drawn by a hash of the id: all of them, if there are no more.

    The draw is made on both sides, so only texts that were drawn are moved to their labels.
    """
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = draw < min(1.0, rows / max(1, usable.count()))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(drawn)
    return cut_lineage(texts.join(usable.filter(drawn), "id").withColumn("id", F.col("id").cast("string")))


def telling_buckets(sample: DataFrame, share: float) -> np.ndarray:
    """Buckets of which the texts, and the weights, in class 1 differ from ``share`` by ``TELLING`` standard errors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((5, BUCKETS))
            for label, (b, w) in zip(batch.column("label").to_pylist(), bag_texts(batch.column("text")), strict=True):
                for k, value in enumerate((1.0, label, w, w * w, w * label)):
                    sums[k, b] += value
            at = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in sums)], ["bucket", "n", "n1", "w", "ww", "w1"])

    cells = sample.mapInArrow(count, "bucket long, n double, n1 double, w double, ww double, w1 double")
    total = cells.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "w", "ww", "w1")])
    spread = F.lit(share * (1 - share))
    apart = F.least(F.abs(F.col("n1") - F.lit(share) * F.col("n")) / F.sqrt(spread * F.col("n")),
                    F.abs(F.col("w1") - F.lit(share) * F.col("w")) / F.sqrt(spread * F.col("ww")))
    found = total.filter((F.col("n") >= MIN_TEXTS) & (apart >= TELLING)).select("bucket").toArrow()
    return np.sort(found.column("bucket").to_numpy())


def collect_bags(sample: DataFrame, vocabulary: np.ndarray) -> Bags:
    """The sample's bags, reduced to the telling buckets on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for b, w in bag_texts(batch.column("text")):
                at = np.minimum(np.searchsorted(vocabulary, b), max(0, len(vocabulary) - 1))
                hit = vocabulary[at] == b if len(vocabulary) else np.zeros(len(b), bool)
                own.append((at[hit].astype(np.int32), w[hit]))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("label"), pa.array([b.tobytes() for b, _ in own], pa.binary()),
                pa.array([w.tobytes() for _, w in own], pa.binary())], ["id", "label", "buckets", "weights"])

    got = sample.mapInArrow(run, "id string, label int, buckets binary, weights binary").toArrow().sort_by("id")
    buckets = [np.frombuffer(x.as_py(), np.int32) for x in got.column("buckets")]
    weights = [np.frombuffer(x.as_py(), np.float32) for x in got.column("weights")]
    return Bags(vocabulary, np.concatenate([*buckets, np.zeros(0, np.int32)]), np.concatenate([*weights, np.zeros(0, np.float32)]),
                np.concatenate([[0], np.cumsum([len(b) for b in buckets])]).astype(np.int64), got.column("label").to_numpy().astype(np.int64))


def fit(bags: Bags, epochs: int = EPOCHS, rate: float = RATE) -> ToxicityModel:
    """Embeddings and softmax by mini-batch gradient descent on the log loss.

    A bucket's weight is divided by its root mean square, so that rare n-grams of
    long texts count as much as common ones; the factor goes into the model.
    """
    rng, n, size = np.random.default_rng(SEED), len(bags.labels), len(bags.vocabulary)
    share = (float(bags.labels.sum()) + 0.5) / (n + 1.0)
    bias = np.log(np.array([1 - share, share]))
    weights = np.zeros(BUCKETS, np.float32)
    if size == 0:
        return ToxicityModel(weights, float(bias[1] - bias[0]))
    square = np.bincount(bags.buckets, bags.weights.astype(np.float64) ** 2, minlength=size)
    factor = 1 / np.sqrt(square / np.maximum(1, np.bincount(bags.buckets, minlength=size)))
    value = bags.weights * factor[bags.buckets]
    embed, soft = rng.normal(0, 0.01, (size, DIM)), rng.normal(0, 0.5, (2, DIM))
    counts = np.diff(bags.bounds)
    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs), rng.permutation(n)
        for lo in range(0, n, BATCH):
            texts = order[lo : lo + BATCH]
            at = np.concatenate([np.arange(bags.bounds[t], bags.bounds[t + 1]) for t in texts])
            bag = np.zeros((len(texts), size))
            bag[np.repeat(np.arange(len(texts)), counts[texts]), bags.buckets[at]] = value[at]
            mean = bag @ embed
            logit = mean @ soft.T + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(texts)), bags.labels[texts]] -= 1
            p /= len(texts)
            to_embed, to_soft = bag.T @ (p @ soft), p.T @ mean
            embed -= step * (to_embed / max(1.0, np.sqrt((to_embed**2).sum())) + 1e-4 * embed)
            soft -= 0.1 * step * to_soft / max(1.0, np.abs(to_soft).max())
            bias = bias - step * p.sum(axis=0)
    weights[bags.vocabulary] = embed @ (soft[1] - soft[0]) * factor
    return ToxicityModel(weights, float(bias[1] - bias[0]))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 12_000,
) -> ToxicityModel:
    """Fit on about ``rows`` of the labelled texts, whatever the size of the tables.

    ``docs`` has the texts and ``labels`` the classes 0 and 1.  With one class only, or
    none, every text gets that class's share as its score.
    """
    sample = sample_texts(docs, labels, rows, id_col, text_col, label_col)
    share = sample.agg(F.avg("label")).first()[0]
    vocabulary = telling_buckets(sample, share) if share and share < 1 else np.zeros(0, np.int64)
    return fit(collect_bags(sample, vocabulary))


def score_batch(model: ToxicityModel, texts: pa.Array) -> np.ndarray:
    out = np.empty(len(texts))
    for chunk in textbuf.chunks(texts):
        buckets, word, bounds = subwords(chunk.data, chunk.offsets)
        total = np.bincount(word, model.weights[buckets], minlength=bounds[-1]) / np.maximum(1, np.bincount(word, minlength=bounds[-1]))
        sums = np.concatenate([[0.0], np.cumsum(total)])
        words = np.maximum(1, np.diff(bounds))
        out[chunk.lo : chunk.hi] = np.diff(sums[bounds]) / words + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def scorer(spark, model: ToxicityModel):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(score_batch(shared.value, texts))

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: Column) -> DataFrame:
    """``docs`` with ``_toxicity`` (0 to 1) from the whole text; equal texts score alike.

    A null, empty or wordless text has the score of the bias alone.  Columns of ``docs`` stay.
    """
    return docs.withColumn("_toxicity", scorer(docs.sparkSession, model)(text))
