"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes a bag of hashed terms: the shape of each word (runs of capitals, small
letters, digits, other characters), pairs of neighbouring shapes, immediate repeats of a
word, and the words themselves. Terms are weighted (log of the count times inverse
document frequency) and projected on the leading right singular vectors of a bounded
labelled sample. The sample's vectors are broadcast; every document is compared with all
of them by exact cosines, block by block, and the NEIGHBOURS nearest vote for their
labels with their similarity as weight.

Defined results: null, empty or blank texts have no terms and score label 1's share of
the sample's texts of that kind, 0 if it has none: such a text holds nothing of quality; with no labels every score is 0.5; equal similarities go to the earlier
sample row (ordered by its hash and id); repeated rows are scored each; other columns
are ignored; no rows give no rows.

Bounds: at most SAMPLE labelled rows are learned from, those with the smallest
crc32(doc_id as text), as the contract allows for a classifier, without the longest if
they hold over SAMPLE_CHARS characters; the broadcast is SAMPLE x LATENT floats plus the projection. Texts of any length are read in slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlens.llm.common import Memo, id_crc, slices, stored, unused

SAMPLE = 3000       # labelled rows learned from at most
SAMPLE_CHARS = 100_000_000  # and characters of their texts
SHAPES = 512
WORD_TERMS = 1024
TERMS = SHAPES + 1024 + 64 + WORD_TERMS
LATENT = 48
NEIGHBOURS = 15
ACCEPT = 0.7
BLOCK = 512

_CLASS = {}


def _shape(word: str) -> str:
    """Character classes of a word with runs shortened: 'Abc!!' -> 'Xx!!'."""
    out = []
    for c in word:
        k = "x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else "o" if c.isalpha() else c
        if len(out) < 2 or not (out[-1] == k and (k in "xXo9" or out[-2] == k)):
            out.append(k)
    return "".join(out)


def word_code(word: str) -> int:
    """shape (low bits), hash of the word (high bits)."""
    shape = zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) % SHAPES
    return (zlib.crc32(word.encode("utf-8", "surrogatepass")) << 10) | shape


class Terms:
    """Text -> term counts."""

    def __init__(self):
        self.memo = Memo(word_code)

    def codes(self, text: str) -> np.ndarray:
        memo = self.memo
        return np.concatenate([np.fromiter((memo[w] for w in part.split()), np.int64) for part in slices(text)])

    def counts(self, text: str | None) -> np.ndarray:
        out = np.zeros(TERMS, np.float32)
        codes = self.codes(text) if text else np.zeros(0, np.int64)
        if not len(codes):
            return out
        shape, word = codes & (SHAPES - 1), codes >> 10
        out[:SHAPES] = np.bincount(shape, minlength=SHAPES)
        pairs = (shape[:-1] * 31 + shape[1:]) % 1024
        out[SHAPES : SHAPES + 1024] = np.bincount(pairs, minlength=1024)
        at = SHAPES + 1024
        repeats = np.count_nonzero(word[1:] == word[:-1])
        out[at] = repeats
        distinct = len(np.unique(word)) / len(word)
        out[at + 1 + min(15, int(16 * repeats / len(word)))] = len(word)
        out[at + 17 + min(15, int(16 * distinct))] = len(word) * (distinct < 0.5)
        out[at + 64 :] = np.bincount(word % WORD_TERMS, minlength=WORD_TERMS)
        return out


@dataclass(frozen=True)
class Voters:
    weights: np.ndarray     # of the terms
    projection: np.ndarray  # TERMS x LATENT
    vectors: np.ndarray     # sample x LATENT, of length 1
    labels: np.ndarray
    blank: float            # score of a text without terms

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        z = x @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Vote of the nearest sample vectors for rows of term counts."""
        out = np.full(len(counts), self.blank)
        if not len(self.labels):
            return out
        known = counts.any(axis=1)
        if known.any():
            near = self.latent(counts[known]) @ self.vectors.T
            k = min(NEIGHBOURS, len(self.labels))
            # the k largest, ties to the earlier row
            kth = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
            above = near > kth
            ties = near == kth
            left = k - above.sum(1, keepdims=True)
            chosen = above | (ties & (np.cumsum(ties, 1) <= left))
            votes = np.where(chosen, np.maximum(near, 1e-6), 0.0).astype(np.float64)
            out[known] = np.minimum(votes @ self.labels / votes.sum(1), 1.0)  # the two sums may round apart
        return out


def fit(texts: list[str | None], labels: list[int]) -> Voters:
    """Learns from the sample (in the given order)."""
    if not texts:
        return Voters(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32),
                      np.zeros(0), 0.5)
    terms = Terms()
    counts = np.stack([terms.counts(t) for t in texts])
    y = np.array(labels, np.float64)
    present = (counts > 0).sum(0)
    weights = np.where(present > 0, np.log((1 + len(texts)) / (1 + present)) + 0.2, 0).astype(np.float32)
    weights[SHAPES + 1024 + 64 :] *= 0.3  # single words say less than shapes
    x = np.log1p(counts) * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    projection = np.ascontiguousarray(vectors[:, ::-1][:, :LATENT]).astype(np.float32)
    some = counts.any(axis=1)
    blank = 0.0 if some.all() else float(y[~some].mean())
    own = Voters(weights, projection, np.zeros((0, 1), np.float32), np.zeros(0), blank)
    z = own.latent(counts)
    return Voters(weights, projection, z[some], y[some], blank)


def agreed(labels: DataFrame, label: str, training: Column) -> DataFrame:
    """doc_id, y of the training documents whose labels agree."""
    own = labels.filter(training & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2"))
    return own.filter("y = y2").select("doc_id", "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, size: int,
                    max_chars: int = SAMPLE_CHARS, columns: tuple[str, ...] = ()) -> list:
    """At most ``size`` rows (text, label, *columns) of training documents, those with the
    smallest crc32(doc_id). If their texts exceed ``max_chars``, each label's longest ones are
    left out until the rest fits its share (by rows) of the bound; the shortest one stays. The
    ids are chosen from the labels alone, so that only the chosen texts are moved; a document
    labelled twice with different labels teaches neither."""
    chosen = agreed(labels, label, training).orderBy(id_crc(F.col("doc_id")), "doc_id").limit(size).collect()
    y = {r["doc_id"]: int(r["y"]) for r in chosen}
    if not y:
        return []
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k,) for k in y], "sample_id bigint")
    texts = docs.select("doc_id", "text", *columns)
    texts = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id"), "left_semi")
    # of rows that share an id, the one with the least text teaches (null before any text)
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("text", *columns)).alias("least")).select("doc_id", "least.*")
    texts = stored(spark, texts, "labelled-sample")
    sizes = [(r["n"], r["doc_id"]) for r in texts.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect()]
    fit_in = set()
    for kind in set(y.values()):
        own = sorted(s for s in sizes if y[s[1]] == kind)
        sums = np.cumsum([n for n, _ in own])
        share = max_chars if sum(n for n, _ in sizes) <= max_chars else max_chars * len(own) / len(sizes)
        fit_in |= {i for k, (_, i) in enumerate(own) if k == 0 or sums[k] <= share}
    if len(fit_in) < len(sizes):
        picked = spark.createDataFrame([(k,) for k in fit_in], "sample_id bigint")
        texts = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("sample_id"), "left_semi")
    rows = sorted(texts.toLocalIterator(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return [(r["text"], y[r["doc_id"]], *(r[c] for c in columns)) for r in rows]


def scorer(spark: SparkSession, voters: Voters):
    """Column of texts -> score."""
    shared = spark.sparkContext.broadcast(voters)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for texts in batches:
            own = list(texts)
            parts = [shared.value.scores(np.stack([terms.counts(t) for t in own[i : i + BLOCK]]))
                     for i in range(0, len(own), BLOCK)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, training) -> DataFrame:
    """doc_id, held_out, score, predicted. ``training(doc_id column)``: may a row teach?"""
    sample = labelled_sample(docs, labels, "quality", training(F.col("doc_id")), SAMPLE)
    score = scorer(spark, fit([r[0] for r in sample], [r[1] for r in sample]))
    out = docs.select("doc_id", (~training(F.col("doc_id"))).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, training) -> DataFrame:
    """The documents whose score is ACCEPT or more, with all their columns."""
    sample = labelled_sample(docs, labels, "quality", training(F.col("doc_id")), SAMPLE)
    score = scorer(spark, fit([r[0] for r in sample], [r[1] for r in sample]))
    name = unused(docs, "score")
    return docs.withColumn(name, score("text")).filter(F.col(name) >= ACCEPT).drop(name)
