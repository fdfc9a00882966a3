"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every character that is not a letter becomes a blank, and the
n-grams of 1, 2 and 3 characters (two blanks stand before and after the text) are
hashed into BUCKETS. Training sums n-gram counts per (language, bucket) over all
training documents; prediction multiplies each batch's sparse n-gram rows with the
broadcast log-probability matrix.

Defined results: null text, or text without a letter, gives ``und`` with score 0; with
nothing learned every text is ``und``; equal scores go to the first language by name;
rows with a null lang teach nothing but are predicted; repeated rows count as often as
they occur; other columns are ignored.

Memory: texts of any length are read in slices; a matrix is BLOCK_LANGUAGES languages x
BUCKETS floats at most. More languages are scored block by block, with the best language so
far kept per row, so their number has no bound. Counts are summed per task before the
shuffle, so a hot language is one row per bucket and task; a task passes its sums on
once they are those of over BLOCK_LANGUAGES languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlens.llm.common import stored

BUCKETS = 1 << 14
SMOOTHING = 0.5
BLOCK_LANGUAGES = 200  # of a broadcast matrix (64 KB each)
UNKNOWN = "und"
SLICE = 1 << 19  # characters at a time

_PAD = np.full(2, 32, np.uint32)
_MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@lru_cache(1)
def _letters() -> np.ndarray:
    """code point -> itself for letters, else blank."""
    codes = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return np.where(letter, codes, np.uint32(32))


def codes_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _letters()[raw]


def buckets_of(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Buckets of the 1-, 2- and 3-grams that start at each code but the last two."""
    a, b, c = (x * m for x, m in zip((codes[:-2], codes[1:-1], codes[2:]), _MULT, strict=True))
    mix = lambda h: ((h ^ (h >> np.uint32(15))) * _MULT[1] >> np.uint32(18)) & np.uint32(BUCKETS - 1)
    return mix(a), mix(a ^ (b << np.uint32(1) | np.uint32(1))), mix(a ^ (b >> np.uint32(3)) + c)


def blocks(texts: Iterable[str | None]) -> Iterator[tuple[list[int], np.ndarray, list[int]]]:
    """(row numbers, codes, start of each row's codes) of blocks of about SLICE codes. A
    long text continues over blocks with its last two codes repeated, so each n-gram is
    met once; every text ends in two blanks."""
    rows, parts, starts, size = [], [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), SLICE):
            codes = codes_of(text[at : at + SLICE])
            lead = _PAD if at == 0 else codes_of(text[max(0, at - 2) : at])[-2:]
            rows.append(i)
            starts.append(size)
            parts += [lead, codes]
            size += len(lead) + len(codes)
            if at + SLICE >= len(text):
                parts.append(_PAD)
                size += 2
            if size >= SLICE:
                yield rows, np.concatenate(parts), starts
                rows, parts, starts, size = [], [], [], 0
    if rows:
        yield rows, np.concatenate(parts), starts


def gram_rows(codes: np.ndarray, starts: list[int]) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Starts of the rows' n-grams, the three bucket arrays, and whether a position counts
    (n-grams of blanks only, and those over the end of a row, do not)."""
    grams = buckets_of(codes)
    keep = codes[:-2] != 32
    keep |= (codes[1:-1] != 32) | (codes[2:] != 32)
    for s in starts[1:]:
        keep[s - 2 : s] = False
    return np.asarray(starts), grams, keep


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_probs: np.ndarray  # languages x BUCKETS, float32
    log_prior: np.ndarray

    def scores(self, texts: Iterable[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log scores (n x languages), n-grams and letters per row."""
        out = np.zeros((n, len(self.languages)))
        count, letters = np.zeros(n), np.zeros(n, np.int64)
        for rows, codes, starts in blocks(texts):
            at, grams, keep = gram_rows(codes, starts)
            weights = keep.astype(np.float32)
            per_row = np.add.reduceat(weights, at)
            np.add.at(count, rows, 3 * per_row)
            np.add.at(letters, rows, np.add.reduceat((codes != 32).astype(np.int64), at))
            for k, row in enumerate(self.log_probs):
                total = row[grams[0]]
                total += row[grams[1]]
                total += row[grams[2]]
                total *= weights
                np.add.at(out[:, k], rows, np.add.reduceat(total, at, dtype=np.float64))
        return out + self.log_prior, count, letters

    def best(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per row: best language, its log score, the sum of all languages' likelihoods as a
        multiple of the best one's, and whether the text has a letter."""
        scores, _, letters = self.scores(texts, len(texts))
        top = scores.max(1)
        return np.array(self.languages, object)[scores.argmax(1)], top, np.exp(scores - top[:, None]).sum(1), letters > 0

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        n = len(texts)
        if not self.languages or not n:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * n, "score": [0.0] * n})
        langs, _, total, known = self.best(texts)
        return pd.DataFrame({"lang_pred": np.where(known, langs, UNKNOWN), "score": np.where(known, 1.0 / total, 0.0)})

    def further(self, texts: pd.Series, so_far: pd.DataFrame) -> pd.DataFrame:
        """STATE after this block of languages; ``so_far`` is that of the blocks before (their
        names are smaller, so an equal score changes nothing)."""
        if not len(texts):
            return pd.DataFrame({"lang": [], "top": [], "total": []})
        langs, top, total, known = self.best(texts)
        old = so_far["top"].to_numpy(np.float64, na_value=-np.inf)
        high = np.maximum(old, top)
        total = so_far["total"].to_numpy(np.float64, na_value=0.0) * np.exp(old - high) + total * np.exp(top - high)
        return pd.DataFrame({"lang": np.where(known, np.where(top > old, langs, so_far["lang"]), None),
                             "top": high, "total": total})


def count_grams(texts: Iterable[str | None], langs: Iterable[str | None]) -> dict[str, np.ndarray]:
    """language -> n-gram counts per bucket."""
    texts, langs = list(texts), list(langs)
    counts: dict[str, np.ndarray] = {}
    by_lang: dict[str, list[str]] = {}
    for text, lang in zip(texts, langs, strict=True):
        if lang is not None and text:
            by_lang.setdefault(lang, []).append(text)
    for lang, own in by_lang.items():
        total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
        for _, codes, starts in blocks(own):
            _, grams, keep = gram_rows(codes, starts)
            for g in grams:
                total += np.bincount(g[keep], minlength=BUCKETS)
    return counts


def model_of(counts: dict[str, np.ndarray], docs: dict[str, int], all_docs: float | None = None) -> Model:
    """``all_docs``: sum of the languages' documents, one more each (by default of ``counts``)."""
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    m = np.stack([counts[k] for k in languages]) + SMOOTHING
    prior = np.array([docs.get(k, 0) + 1.0 for k in languages])
    return Model(languages, np.log(m / m.sum(1, keepdims=True)).astype(np.float32), np.log(prior / (all_docs or prior.sum())))


def _task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per language and bucket met in the task; bucket -1 holds the documents."""
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(langs), BLOCK_LANGUAGES):  # so that a batch too brings few new languages at once
            some = langs[at : at + BLOCK_LANGUAGES]
            for lang in some:
                docs[lang] = docs.get(lang, 0) + 1
            for lang, counts in count_grams(texts[at : at + BLOCK_LANGUAGES], some).items():
                total[lang] = total[lang] + counts if lang in total else counts
            if len(docs) > BLOCK_LANGUAGES:
                yield from _sums(docs, total)
                total, docs = {}, {}
    yield from _sums(docs, total)


def _sums(docs: dict[str, int], total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, n in docs.items():
        counts = total.get(lang, np.zeros(BUCKETS, np.int64))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(used) + 1)), pa.array(np.r_[-1, used].astype(np.int32)),
             pa.array(np.r_[n, counts[used]].astype(np.int64))], names=["lang", "bucket", "n"])


def train(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang") -> Iterator[Model]:
    """Learns from every row of ``docs`` with a language. One model per BLOCK_LANGUAGES
    languages in the order of their names (none for no language); the sums of one block at
    a time come to the driver."""
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sums = stored(spark, rows.mapInArrow(_task_counts, "lang string, bucket int, n bigint")
                  .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "gram-counts")
    languages = sums.filter("bucket = -1").select("lang", "n")
    all_docs = languages.agg(F.sum(F.col("n") + 1)).first()[0]
    while own := {r["lang"]: r["n"] for r in languages.orderBy("lang").limit(BLOCK_LANGUAGES).collect()}:
        last = max(own, key=lambda k: k.encode("utf-8", "surrogatepass"))  # Spark's order
        block = sums.filter((F.col("lang") >= min(own, key=lambda k: k.encode("utf-8", "surrogatepass"))) & (F.col("lang") <= last))
        counts = {k: np.zeros(BUCKETS, np.int64) for k in own}
        found = block.filter("bucket >= 0").toArrow()
        langs, buckets, n = (found.column(c).to_numpy() for c in ("lang", "bucket", "n"))
        for k in counts:
            mine = langs == k
            counts[k][buckets[mine]] = n[mine]
        yield model_of(counts, own, float(all_docs))
        if len(own) < BLOCK_LANGUAGES:
            return
        languages = languages.filter(F.col("lang") > last)


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(spark: SparkSession, model: Model):
    """Column -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict(texts)

    return predict


STATE = T.StructType([T.StructField("lang", T.StringType()), T.StructField("top", T.DoubleType()),
                      T.StructField("total", T.DoubleType())])


def block_scorer(spark: SparkSession, model: Model):
    """Columns of texts and states -> STATE with the model's languages."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(STATE)
    def score(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, so_far in batches:
            yield shared.value.further(texts, so_far)

    return score


def identify(spark: SparkSession, docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows where ``training`` holds.
    With more than one block of languages each is a pass over the texts, written to the
    shared folder."""
    models = train(spark, docs.filter(training))
    first, second = next(models, None), next(models, None)
    own = docs.select("doc_id", (~training).alias("held_out"), "text")
    if second is None:
        predict = predictor(spark, first or model_of({}, {}))
        out = own.select("doc_id", "held_out", predict("text").alias("p"))
        return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
    own = own.withColumn("s", F.lit(None).cast(STATE))
    for model in chain((first, second), models):
        own = stored(spark, own.withColumn("s", block_scorer(spark, model)("text", "s")), "language-block")
    known = F.col("s.lang").isNotNull()
    return own.select("doc_id", "held_out", F.when(known, F.col("s.lang")).otherwise(UNKNOWN).alias("lang_pred"),
                      F.when(known, 1 / F.col("s.total")).otherwise(0.0).alias("score"))
