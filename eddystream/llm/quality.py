"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer network in numpy with temperature-calibrated probabilities.

1. Every word is hashed to one of ``terms`` terms and has a fixed sparse index
   vector. A term's word vector is the sum of the index vectors of its
   neighbours over all documents: each task sums its own counts, and the tasks'
   matrices, whose size is fixed, are added by term.
2. A document's vector is the mean and the spread of its words' vectors, with
   the share of its distinct terms and its length.
3. The network learns from at most ``sample`` labelled documents (taken by the
   hash of their id); one number, the temperature, is then fitted on a part of
   them that was held back, so that scores are probabilities.

A word counts twice: by its letters, in lower case, and by its shape (classes
of characters, repeats dropped), as what marks junk is often its shape.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddystream.llm import textops
from eddystream.llm.common import plain, small_batches, tidy

#: Terms that words are hashed to, and length of an index vector: the model's size, whatever the input.
TERMS, DIM, NONZERO = 1 << 13, 32, 4
#: The most labelled documents that the network learns from.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
SEED = 5
FEATURES = 2 * DIM + 3

# character classes: white space, lower case and all other letters, upper case, digit, each other sign its own
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[textops.SPACE] = ord(" ")


def terms_of(buf: np.ndarray, off: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of the words of each row (letters and shape by turns), and the rows' bounds."""
    hashes, _, bounds = textops.words(buf, off, lower=True)
    kind = _CLASS[buf]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[off[:-1][off[1:] > off[:-1]]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes, _, _ = textops.words(kind[keep], place[off], lower=False)
    half = np.uint64(terms // 2)
    return np.stack([hashes % half, shapes % half + half], 1).astype(np.int32), bounds


def index_vectors(terms: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every term's index vector."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(0, dim, (terms, NONZERO)), rng.choice([-1.0, 1.0], (terms, NONZERO))


def context_sums(buf: np.ndarray, off: np.ndarray, terms: int, dim: int) -> np.ndarray:
    """For each term, the sum of the index vectors of the words beside it (and of its own word's other half)."""
    words, bounds = terms_of(buf, off, terms)
    total = np.zeros(terms * dim)
    if not len(words):
        return total.reshape(terms, dim)
    where, sign = index_vectors(terms, dim)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    beside = row[1:] == row[:-1]
    pairs = [(words[:, 0], words[:, 1])]
    for half in (0, 1):
        pairs.append((words[:-1, half][beside], words[1:, half][beside]))
    for a, b in pairs:
        key, n = np.unique(a.astype(np.int64) * terms + b, return_counts=True)
        a, b = key // terms, key % terms
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                total += np.bincount(x * dim + where[y, j], sign[y, j] * n, terms * dim)
    return total.reshape(terms, dim)


def word_vectors(docs: DataFrame, terms: int = TERMS, dim: int = DIM) -> np.ndarray:
    """The word vector of every term, of length 1 or 0, from all documents. ``terms`` rows come to the driver, whatever the input."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms, dim))
        for batch in batches:
            buf, off = textops.raw(batch.column(0))
            for a, b in textops.pieces(off):
                total += context_sums(buf[off[a] : off[b]], off[a : b + 1] - off[a], terms, dim)
        some = np.flatnonzero(np.abs(total).sum(1))
        flat = pa.array(total[some].astype(np.int64).reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.FixedSizeListArray.from_arrays(flat, dim).cast(pa.list_(pa.int64()))], ["term", "v"])

    parts = plain(docs, "text").mapInArrow(tidy(sums), "term long, v array<long>")
    summed = parts.groupBy("term").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(dim))).alias("v")).toPandas()
    out = np.zeros((terms, dim), np.float32)
    if len(summed):
        v = np.stack(summed["v"].to_numpy()).astype(np.float64)
        out[summed["term"].to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return out


def pooled(buf: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text: mean and spread of its word vectors, distinct share, length, being empty."""
    terms, dim = vectors.shape
    out = np.zeros((len(off) - 1, 2 * dim + 3), np.float32)
    for a, b in textops.pieces(off, 1 << 19):
        words, bounds = terms_of(buf[off[a] : off[b]], off[a : b + 1] - off[a], terms)
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        out[a:b, -1] = n == 0
        if not len(full):
            continue
        v = vectors[words[:, 0]] + vectors[words[:, 1]]
        heads, m = bounds[:-1][full], n[full][:, None]
        mean = np.add.reduceat(v, heads, 0) / m
        spread = np.sqrt(np.maximum(np.add.reduceat(v * v, heads, 0) / m - mean * mean, 0))
        row = np.repeat(np.arange(len(full)), n[full])
        distinct = np.bincount(np.unique(row.astype(np.int64) * terms + words[:, 0]) // terms, minlength=len(full))
        out[a + full] = np.concatenate([mean, spread, (distinct / n[full])[:, None], np.log1p(m), np.zeros_like(m)], 1)
    return out


@dataclass
class Network:
    """Two layers; ``score`` is the probability of label 1."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the log loss; a fifth of the rows is held back for the best epoch and the temperature.

    Without rows, or with one label only, every score is that label's share.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    n, d = x.shape
    if not n or y.min() == y.max():
        bias = 0.0 if not n else float(np.log((y.mean() * n + 1) / (n - y.mean() * n + 1)))
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), bias)
    x, y = x.astype(np.float64), y.astype(np.float64)
    order = rng.permutation(n)
    held, used = order[: n // 5], order[n // 5 :]
    held = held if len(held) else used
    shift, scale = x[used].mean(0), x[used].std(0) + 1e-6
    z = (x - shift) / scale
    p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    best, kept = np.inf, [a.copy() for a in p]
    loss = lambda logit, y: float(np.mean(np.logaddexp(0, logit) - y * logit))
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for i in range(0, len(used), 128):
            rows = used[i : i + 128]
            pre = z[rows] @ p[0] + p[1]
            hidden = np.maximum(pre, 0)
            g = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -60, 60))) - y[rows]) / len(rows)
            back = np.outer(g, p[2]) * (pre > 0)
            grads = [z[rows].T @ back + DECAY * p[0], back.sum(0), hidden.T @ g + DECAY * p[2], np.array([g.sum()])]
            t += 1
            for j, gr in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * gr
                v[j] = 0.999 * v[j] + 0.001 * gr * gr
                p[j] = p[j] - RATE * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        now = loss(np.maximum(z[held] @ p[0] + p[1], 0) @ p[2] + p[3], y[held])
        if now < best:
            best, kept = now, [a.copy() for a in p]
    net = Network(shift, scale, kept[0], kept[1], kept[2], float(kept[3][0]))
    logit = net.logits(x[held])
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 161))
    net.temperature = float(grid[int(np.argmin([loss(logit / g, y[held]) for g in grid]))])
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """The network for ``labels`` (doc_id, quality) of at most ``sample`` documents, those with the smallest hash of their id."""
    # one label a document: the smaller of contradicting ones
    known = plain(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    texts = plain(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")  # ``sample`` rows of two numbers
    width = 2 * vectors.shape[1] + 3
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = textops.raw(b.column("text"))
            x = pooled(buf, off, shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    kind = dict(known.dtypes)
    # of several texts of one id the one with the least features, so that a rerun takes the same
    pooled_ = texts.mapInArrow(tidy(pool), f"doc_id {kind['doc_id']}, quality {kind['quality']}, x binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    got: pd.DataFrame = pooled_.toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, width) if len(got) else np.zeros((0, width), np.float32)
    return fit(x, (got["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs``'s columns ``keep`` and the score of its text.

    A null or empty text has the score of a text without words. Texts of any
    length are read whole; each row has its own text's score, also where rows
    repeat or share an id. Other columns, whatever their names, play no part.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    again = "text" not in keep  # a text that is kept is sent to the workers once
    model = spark.sparkContext.broadcast((vectors, net))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, net = model.value
            buf, off = textops.raw(b.column(len(keep) if again else keep.index("text")))
            y = net.score(pooled(buf, off, vectors))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(y, pa.float64())], [*(f"c{i}" for i in range(len(keep))), "score"])

    slim = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), *([F.col("text").alias("_text")] if again else []))
    schema = ", ".join([*(f"c{i} {kind}" for i, (_, kind) in enumerate(slim.dtypes[: len(keep)])), "score double"])
    return slim.mapInArrow(tidy(rate), schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "score")


def fold(doc_id: Column) -> Column:
    """The remainder that splits labelled rows: crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all ``docs`` and a network that saw only the labels of folds 0 and 2."""
    small_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    return vectors, train(docs, labels.where(fold(F.col("doc_id")) != 1), vectors, sample)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every row's score. A null doc_id is in no fold and not held out; all else as :func:`score` has it."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, *classifier(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
