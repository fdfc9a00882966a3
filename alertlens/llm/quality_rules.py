"""Quality rules judged per document and per host.

Base rules count words, symbols, repeated lines and repeated 8-word windows of the
whole text. Failures are then summed per host (``source``); each host's failure rate
is shrunk towards all hosts by an empirical beta prior (method of moments), and a
host whose shrunk rate exceeds ``HOST_RATE`` takes all its documents with it.

Defined results: null text counts as no word (base_failed); a null host is a host of
its own; repeated doc_ids are separate documents; no rows give no rows; other columns
of the input are ignored whatever their names.

Hot hosts: per-host sums are partial aggregates (one row per host and task), and the
verdicts come back by a broadcast of the rejected hosts when their number is checked
to be small, else by a join whose hot keys are dealt over SALTS copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlens.llm.common import byte_slices, quoted, stored, unused

MIN_WORDS = 20          # fewer words fail
REPEAT_PERCENT = 30     # more words in repeated windows fail
WINDOW = 8              # words of a window (a power of two, see repeated_words)
HOST_RATE = 0.5         # a host above this shrunk failure rate is rejected
PRIOR_RANGE = (2.0, 200.0)  # pseudo-documents of the prior
BROADCAST_HOSTS = 50_000    # rejected hosts broadcast at most (a host name is short text)
HOST_BYTES = 16 << 20
SALTS = 32

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

COUNTS = ["word_chars", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    values, ranks = np.unique(keys, return_inverse=True)
    return ranks, len(values)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more. Windows are named
    exactly by doubling: a window of 2k words is the pair of its halves' ranks."""
    n = len(ids)
    if n <= WINDOW:
        return 0
    names, width = ids.astype(np.int64), 1
    while width < WINDOW:
        names, distinct = _ranks(names[:-width] * (int(names.max()) + 1) + names[width:])
        if distinct == len(names):  # shorter windows all differ, so longer ones do
            return 0
        width *= 2
    hot = np.flatnonzero(np.bincount(names)[names] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hot, 1)
    np.add.at(edge, hot + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """(word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    names: dict[bytes, int] = {}
    ids = [np.fromiter((names.setdefault(w, len(names)) for w in part.split()), np.int64)
           for part in byte_slices(data)]
    ids = np.concatenate(ids)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(text) - sum(map(text.count, BLANKS)), len(ids),
            sum(data.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def stats_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_stats(t) for t in texts], columns=COUNTS, dtype="int64")


def failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, host, the five counts and base_failed."""
    s = docs.select("doc_id", F.col("source").alias("host"), stats_of("text").alias("s"))
    s = s.select("doc_id", "host", "s.*")
    return s.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))


def host_verdicts(flags: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """host, n, failures, shrunk_rate, host_rejected from rows of (host, base_failed)."""
    hosts = flags.groupBy("host").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum(F.col("base_failed").cast("long")).alias("failures"))
    f, n = F.col("failures"), F.col("n")
    total = hosts.agg(F.sum(f).alias("f"), F.sum(n).alias("n"), F.sum(f * f / n).alias("ff")).first()
    mean = (total["f"] or 0) / total["n"] if total["n"] else 0.0
    spread = total["ff"] / total["n"] - mean * mean if total["n"] else 0.0
    low, high = PRIOR_RANGE
    weight = min(high, max(low, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else high
    shrunk = (f + F.lit(mean * weight)) / (n + F.lit(weight))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_rejected", F.col("shrunk_rate") > rate)


def rejected_hosts(verdicts: DataFrame) -> tuple[DataFrame, bool]:
    """The rejected hosts, and whether they were checked to be few enough to broadcast."""
    bad = verdicts.filter("host_rejected").select(F.col("host").alias("bad_host"))
    size = bad.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("bad_host"), F.lit(0))).alias("b")).first()
    return bad, size["n"] <= BROADCAST_HOSTS and (size["b"] or 0) <= HOST_BYTES


def mark_hosts(rows: DataFrame, host: str, key: str, verdicts: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` joined with the rejected hosts, and the condition that a row's host is
    rejected; no row is lost or repeated. The joined columns have names unused in ``rows``."""
    bad, small = rejected_hosts(verdicts)
    name, hit, salt, deal = (unused(rows, x) for x in ("bad_host", "hit", "salt", "deal"))
    bad = bad.select(F.col("bad_host").alias(name), F.lit(True).alias(hit))  # hit tells a matched null host from no match
    on = F.col(name).eqNullSafe(F.col(host))
    if small:
        marked = rows.join(F.broadcast(bad), on, "left")
    else:
        bad = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(deal, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        marked = rows.join(bad, on & (F.col(salt) == F.col(deal)), "left")
    return marked, F.col(hit).isNotNull()


def quality_rules(spark: SparkSession, docs: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    host_rejected, kept. The counts are stored once and read for both uses."""
    stats = stored(spark, document_stats(docs), "quality-stats")
    marked, rejected = mark_hosts(stats, "host", "doc_id", host_verdicts(stats, rate))
    return marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """The kept documents with all their columns. The text is scanned twice (host sums,
    then the filter) rather than shuffled."""
    flags = document_stats(docs).select("host", "base_failed")
    hosts = stored(spark, host_verdicts(stored(spark, flags, "quality-flags"), rate), "quality-hosts")
    name = unused(docs, "stats")
    s = docs.withColumn(name, stats_of("text"))
    kept = s.filter(~failed(F.col(f"{name}.n_words"), F.col(f"{name}.n_repeat_words"))).drop(name)
    marked, rejected = mark_hosts(kept, "source", "doc_id", hosts)
    return marked.filter(~rejected).select(*map(quoted, docs.columns))


def oracle_sql(rate: float = HOST_RATE) -> str:
    """The same rows in DuckDB SQL."""
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS g
        FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) > {WINDOW})),
hot AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM hot) GROUP BY rid),
s AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.rid = w.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
m AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS spread FROM h),
p AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least({PRIOR_RANGE[1]}, greatest({PRIOR_RANGE[0]}, mean * (1 - mean) / spread - 1))
                        ELSE {PRIOR_RANGE[1]} END AS weight FROM m),
v AS (SELECT source, (f + mean * weight) / (n + weight) > {rate} AS bad FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, v.bad AS host_rejected,
       NOT base_failed AND NOT v.bad AS kept
FROM b JOIN v ON v.source IS NOT DISTINCT FROM b.source"""
