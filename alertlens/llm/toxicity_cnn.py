"""Toxicity: a convolutional text classifier trained in numpy.

A word is embedded by three hashes, of the word, of its first six and its first four
characters: its vector is the three tables' rows side by side, so that inflected forms
share rows, and two words are mixed up only if all three meet. Filters of widths 1, 2 and 3 run
over the words, the largest response of each filter over the whole text is kept (max
pooling), and a logistic layer gives the raw score. Embeddings start from the words'
smoothed log-odds in the sample, filters at random; everything is trained by gradient
steps (Adam) on a bounded labelled sample. The raw score above which a text counts as
toxic is calibrated per language on all other labelled training rows, and scores are
rescaled so that this threshold sits at 0.7 in every language. The language is that
predicted from the text (naive Bayes learned on the same sample), never the column.

Calibration: every document is scored once and its raw score and language are stored;
those of the labelled training rows that did not teach the net are counted by (language,
label, bin of the score's log-odds), and only these counts reach the driver. A language's
threshold is the mean, in log-odds, of its own best one, weighted by its toxic rows, and
of the common one, weighted as SHRINK toxic rows; so every language with a toxic row has
a threshold of its own. Rows count as often as they occur. If the sample is so small that
all of it teaches, its rows calibrate too.

Defined results: null, empty and blank texts score 0; with no labels, or labels of one kind only, every score is 0; repeated rows are
scored each; other columns are ignored; no rows give no rows.

Bounds: SAMPLE labelled rows teach, chosen as in quality_knn.labelled_sample (a language that
none of them has is predicted as one of the others and calibrated with it); the broadcast model is 3 x ROWS x DIM floats plus the filters. Texts of any length are read in slices:
the largest response over slices is that over the text (slices overlap by two words).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlens.llm import language_id
from alertlens.llm.common import Memo, slices, stored
from alertlens.llm.quality_knn import agreed, labelled_sample

SAMPLE = 6000
BITS = 18
ROWS = 1 << BITS  # rows of each hash table
TABLES = 3
DIM = 4          # numbers per row
WIDTHS = (1, 2, 3)
FILTERS = 6      # of each width
EPOCHS = 6
RATE = 0.02
TOXIC = 0.7
SHRINK = 15      # toxic rows that the common threshold counts for in a language's
BIN = 0.02       # of log-odds, for calibration

_TRIM = ".,;:!?\"'()[]{}<>#$%&*|`~_-+=/\\"


def word_rows(word: str) -> int:
    """Rows of the three tables, BITS bits each; case and punctuation around the word do
    not count."""
    word = word.strip(_TRIM).lower()
    out = 0
    for part in (word, "6" + word[:6], "4" + word[:4]):
        out = out << BITS | zlib.crc32(part.encode("utf-8", "surrogatepass")) % ROWS
    return out


def table_rows(rows: np.ndarray, table: int) -> np.ndarray:
    return (rows >> BITS * (TABLES - 1 - table)) & (ROWS - 1)


class Words:
    """Text -> array of word_rows."""

    def __init__(self):
        self.memo = Memo(word_rows)

    def __call__(self, text: str | None) -> Iterator[np.ndarray]:
        """The text in slices, each after the first starting with the two words before."""
        memo, tail = self.memo, np.zeros(0, np.int64)
        for part in slices(text or ""):
            rows = np.concatenate([tail, np.array([memo[w] for w in part.split()], np.int64)])
            yield rows
            tail = rows[-2:]


@dataclass
class Net:
    tables: np.ndarray                     # TABLES x ROWS x DIM
    filters: list[np.ndarray]              # per width: width*TABLES*DIM x FILTERS
    bias: np.ndarray                       # widths*FILTERS
    out: np.ndarray                        # widths*FILTERS + 1

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[k][table_rows(rows, k)] for k in range(TABLES)], axis=1)

    def responses(self, rows: np.ndarray, where: bool = False):
        """Largest response of each filter (0 at least, as after a rectifier), and its place."""
        x = self.embed(rows)
        top, at = np.zeros(len(self.bias), np.float32), np.zeros(len(self.bias), np.int64)
        for k, w in enumerate(WIDTHS):
            if len(rows) < w:
                continue
            d = x.shape[1]
            r = x[: len(x) - w + 1] @ self.filters[k][:d]
            for j in range(1, w):
                r += x[j : len(x) - w + 1 + j] @ self.filters[k][j * d : (j + 1) * d]
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            if where:
                at[own] = r.argmax(0)
            top[own] = r.max(0)
        top += self.bias
        return (np.maximum(top, 0), at, x) if where else np.maximum(top, 0)

    def raw(self, parts: Iterator[np.ndarray]) -> float:
        """The logistic layer's score; 0 for a text without words."""
        best, words = np.zeros(len(self.bias), np.float32), 0
        for rows in parts:
            if len(rows):
                best, words = np.maximum(best, self.responses(rows)), words + len(rows)
        if not words:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(best @ self.out[:-1] + self.out[-1], -30, 30))))


def _start(rows: list[np.ndarray], y: np.ndarray) -> Net:
    """Tables from the words' smoothed log-odds (first number of a row), the rest random."""
    draw = np.random.default_rng(7)
    tables = draw.normal(0, 0.05, (TABLES, ROWS, DIM)).astype(np.float32)
    for h in range(TABLES):
        seen = np.zeros((2, ROWS))
        for r, label in zip(rows, y, strict=True):
            seen[int(label), np.unique(table_rows(r, h))] += 1
        n = np.bincount(y.astype(int), minlength=2)
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        # few sightings say little
        tables[h, :, 0] = odds * np.minimum(1, seen.sum(0) / 8) * 0.5
    filters = [draw.normal(0, 0.3, (w * TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:  # every filter starts as a detector of such words at its first place
        f[: TABLES * DIM : DIM] = np.abs(f[: TABLES * DIM : DIM]) + 0.4
    n = len(WIDTHS) * FILTERS
    return Net(tables, filters, np.full(n, -0.5, np.float32), np.r_[np.full(n, 0.2), -1.5].astype(np.float32))


def train(rows: list[np.ndarray], y: np.ndarray) -> Net:
    """Gradient steps over the sample; only the words under a filter's largest response
    get a gradient, so the tables are updated sparsely."""
    net = _start(rows, y)
    params = [*net.filters, net.bias, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    order, step = np.random.default_rng(11), 0
    for _ in range(EPOCHS):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 32)):
            grads = [np.zeros_like(p) for p in params]
            for i in batch:
                if not len(rows[i]):
                    continue
                top, at, x = net.responses(rows[i], where=True)
                p = 1 / (1 + np.exp(-np.clip(top @ net.out[:-1] + net.out[-1], -30, 30)))
                delta = np.float32((p - y[i]) * weight[i] / len(batch))
                grads[-1][:-1] += delta * top
                grads[-1][-1] += delta
                back = delta * net.out[:-1] * (top > 0)
                grads[-2] += back
                d = x.shape[1]
                for k, w in enumerate(WIDTHS):
                    if len(rows[i]) < w:
                        continue
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    for j in range(w):
                        hit = at[own] + j
                        grads[k][j * d : (j + 1) * d] += x[hit].T * back[own]
                        dx = (net.filters[k][j * d : (j + 1) * d] * back[own]).T * RATE
                        for h in range(TABLES):
                            np.add.at(net.tables[h], table_rows(rows[i][hit], h), -dx[:, h * DIM : (h + 1) * DIM])
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return net


@dataclass(frozen=True)
class Thresholds:
    common: float
    own: dict[str, float]

    def scaled(self, raw: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Scores with the language's threshold moved to TOXIC."""
        t = np.array([self.own.get(x, self.common) for x in langs])
        low = TOXIC * raw / t
        high = TOXIC + (1 - TOXIC) * (raw - t) / np.maximum(1 - t, 1e-9)
        return np.where(raw >= t, np.clip(high, TOXIC, 1.0), np.minimum(low, np.nextafter(TOXIC, 0)))


def _cut(bins: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
    """Log-odds in the middle of the gap that gives the best F1, the widest such gap, from
    the rows and toxic rows of distinct bins."""
    order = np.argsort(-bins)
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum(n[order]) + toxic.sum())
    low = bins[order] * BIN
    high = np.r_[low[1:] + BIN, min(-20.0, low[-1])]  # upper edge of the next bin
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[(low - high)[best].argmax()]
    return float(low[k] + high[k]) / 2


def _probability(z: float) -> float:
    return min(0.98, max(0.02, float(1 / (1 + np.exp(-z)))))


def thresholds(counts: pd.DataFrame) -> Thresholds:
    """From rows of (lang, bin, n, toxic)."""
    total = counts.groupby("bin", as_index=False)[["n", "toxic"]].sum()
    if not total["toxic"].sum():
        return Thresholds(0.5, {})
    common = _cut(*(total[c].to_numpy() for c in ("bin", "n", "toxic")))
    own = {}
    for lang, rows in counts.groupby("lang"):
        toxic = rows["toxic"].sum()
        if toxic:
            z = _cut(*(rows[c].to_numpy() for c in ("bin", "n", "toxic")))
            own[lang] = _probability((toxic * z + SHRINK * common) / (toxic + SHRINK))
    return Thresholds(_probability(common), own)


def calibrate(raw: DataFrame, labelled: DataFrame) -> Thresholds:
    """From every row of ``raw`` (doc_id, raw, lang) with a label in ``labelled`` (doc_id, y)."""
    z = F.log(F.col("raw") + 1e-9) - F.log(1 - F.col("raw") + 1e-9)
    rows = raw.join(labelled, "doc_id").select("lang", F.floor(z / BIN).alias("bin"), "y")
    counts = rows.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("bigint")).alias("toxic"))
    return thresholds(counts.toPandas())


def fit(sample: list[tuple[str | None, int, str | None]]) -> tuple[Net | None, language_id.Model, np.ndarray]:
    """Net, language model and which rows taught the net, from rows (text, label, lang): three
    of four teach, all if the rest has one kind of label only."""
    words = Words()
    texts = [s[0] for s in sample]
    y = np.array([s[1] for s in sample], np.float64)
    counts = language_id.count_grams(texts, [s[2] for s in sample])
    langs = language_id.model_of(counts, {k: sum(s[2] == k for s in sample) for k in counts})
    teach = np.arange(len(y)) % 4 != 3
    if len(set(y)) < 2:
        return None, langs, teach
    if len(set(y[teach])) < 2 or len(set(y[~teach])) < 2:
        teach[:] = True
    rows = [np.concatenate(list(words(t))) for t, own in zip(texts, teach, strict=True) if own]
    return train(rows, y[teach]), langs, teach


RAW = T.StructType([T.StructField("raw", T.DoubleType()), T.StructField("lang", T.StringType())])


def raw_scorer(spark: SparkSession, net: Net, langs: language_id.Model):
    """Column of texts -> struct(raw, lang)."""
    shared = spark.sparkContext.broadcast((net, langs))

    @F.pandas_udf(RAW)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net, langs = shared.value
        words = Words()
        for texts in batches:
            yield pd.DataFrame({"raw": np.array([net.raw(words(t)) for t in texts], np.float64),
                                "lang": langs.predict(texts)["lang_pred"].to_numpy()})

    return score


def scaler(limits: Thresholds):
    """Columns of raw scores and languages -> score."""

    @F.pandas_udf(T.DoubleType())
    def score(raw: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series(limits.scaled(raw.to_numpy(np.float64), langs.to_numpy()), dtype="float64")

    return score


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, training) -> DataFrame:
    """doc_id, held_out, score, predicted. ``training(doc_id column)``: may a row teach?"""
    may = training(F.col("doc_id"))
    own = docs.select("doc_id", "text", "lang", F.col("doc_id").alias("id"))
    sample = labelled_sample(own, labels, "toxic", may, SAMPLE, columns=("lang", "id"))
    net, langs, taught = fit(sample)
    if net is None:
        return docs.select("doc_id", (~may).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    raw = docs.select("doc_id", raw_scorer(spark, net, langs)("text").alias("s")).select("doc_id", "s.raw", "s.lang")
    raw = stored(spark, raw, "toxicity-raw")
    others = agreed(labels, "toxic", may)
    if not taught.all():
        ids = spark.createDataFrame([(r[3],) for r, t in zip(sample, taught, strict=True) if t], "doc_id bigint")
        others = others.join(F.broadcast(ids), "doc_id", "left_anti")
    score = scaler(calibrate(raw, others))
    out = raw.select("doc_id", (~may).alias("held_out"), score("raw", "lang").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
