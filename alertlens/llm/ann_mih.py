"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, turned by rotations learned on a bounded sample (iterative
quantisation: alternating signs and an orthogonal fit) and cut to their signs; ROTATIONS
rotations of the space give that many bits per dimension. The radius is learned on the
same sample, as the Hamming distance that RECALL of the sample's true neighbours have at
most (the sample is thinner than the corpus, so its neighbours are farther: the radius
errs on the wide side).

Index: distinct vectors are dealt into shards of bounded size; in its shard each code is
split into substrings of SUBSTRING_BITS bits (about the logarithm of a shard's size), each
with its own table from value to rows. A query goes to all shards. There it probes every
table for the values within floor(radius / substrings) of its own: by the pigeonhole
principle a code within the radius is in at least one of these lists. Where these values
outnumber the shard's codes (a wide radius), the codes' own values are compared with that
reach instead. The codes met are checked for the full distance, and those within the radius
are ranked by exact cosines of the original vectors in double precision. A query that meets
too few codes in a shard widens its radius there, up to all.

Equal vectors are one entry with their KEEP smallest ids, so a vector held by a third of
all rows costs one code; copies of a query are searched once. Queries (a stated subset)
go through the shards in blocks of bounded size; a shard returns its nearest few per
query, and the shards' results are merged by one grouping.

Defined results: vectors that are null, empty, zero, of another length than most, or with
null or non-finite components take no part; equal scores go to the smaller id; a repeated
id is one candidate per distinct vector; fewer candidates than ``k`` give fewer rows; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlens.llm.common import stored

SAMPLE = 4000      # vectors that rotations and radius are learned from, at most
ROTATIONS = 2
ROUNDS = 12
SUBSTRING_BITS = 16
RECALL = 0.97
SHARD = 16_384     # vectors of a shard, about
QUERY_BLOCK = 16_384  # as many as vectors of a shard: fewest copies of both


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    turns: np.ndarray  # dimensions x bits
    radius: int

    @property
    def substrings(self) -> int:
        return max(1, self.turns.shape[1] // SUBSTRING_BITS)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Substring values (rows x substrings)."""
        return np.packbits((unit - self.mean) @ self.turns > 0, axis=1).view("<u2")


#: All differences of two values, those of fewest bits first, and how many have at most r bits.
_BITS = np.bitwise_count(np.arange(1 << SUBSTRING_BITS))
_FLIPS = np.argsort(_BITS, kind="stable")
_WITHIN = np.cumsum(np.bincount(_BITS))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def learn(sample: np.ndarray, k: int) -> Coder:
    """Rotations by iterative quantisation and the radius, from sample vectors."""
    unit = _unit(sample)
    mean, d = unit.mean(0), unit.shape[1]
    x = unit - mean
    draw, turns = np.random.default_rng(3), []
    for _ in range(ROTATIONS):
        turn = np.linalg.qr(draw.normal(size=(d, d)))[0]
        for _ in range(ROUNDS):
            signs = np.where(x @ turn > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(x.T @ signs, full_matrices=False)
            turn = u @ v
        turns.append(turn)
    bits = -(-ROTATIONS * d // SUBSTRING_BITS) * SUBSTRING_BITS
    all_turns = np.concatenate(turns, axis=1)[:, np.arange(bits) % (ROTATIONS * d)]
    coder = Coder(mean, all_turns, bits)
    if len(unit) < 2:
        return coder
    asked = np.arange(0, len(unit), max(1, len(unit) // 500))
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    k = min(k, len(unit) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    codes = coder.codes(unit)
    far = np.bitwise_count(codes[asked][:, None, :] ^ codes[best]).sum(2)
    return Coder(mean, all_turns, int(np.quantile(far, RECALL)))


class Shard:
    """The codes of some vectors with a table per substring."""

    def __init__(self, coder: Coder, vectors: np.ndarray):
        self.coder, self.vectors = coder, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.codes = coder.codes(vectors / self.norms[:, None])
        self.columns = np.ascontiguousarray(self.codes.T)
        self.lists = []  # per substring: rows ordered by value, and where each value starts
        for values in self.columns:
            order = np.argsort(values, kind="stable")
            self.lists.append((order, np.searchsorted(values[order], np.arange((1 << SUBSTRING_BITS) + 1)).astype(np.int32)))

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows met in the substring tables: every code within the radius is among them."""
        reach = min(radius // self.coder.substrings, SUBSTRING_BITS)
        met = np.zeros(len(self.codes), bool)
        wide = _WITHIN[reach] >= len(self.codes)
        for values, (order, starts), value in zip(self.columns, self.lists, code, strict=True):
            if wide:
                met |= np.bitwise_count(values ^ value) <= reach
                continue
            probes = _FLIPS[: _WITHIN[reach]] ^ int(value)
            first, last = starts[probes], starts[probes + 1]
            for x, y in zip(first[last > first].tolist(), last[last > first].tolist(), strict=True):
                met[order[x:y]] = True
        return np.flatnonzero(met)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within the radius."""
        rows = self.probe(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]

    def nearest(self, query: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the (at least) k nearest found, all ties of the last included."""
        radius, all_bits = self.coder.radius, self.coder.turns.shape[1]
        rows = self.within(code, radius)
        while len(rows) < k and radius < all_bits:
            radius = min(all_bits, radius + self.coder.substrings)
            rows = self.within(code, radius)
        cosines = (self.vectors[rows] * query).sum(1) / (self.norms[rows] * math.sqrt((query * query).sum()))
        if len(rows) > k:
            kth = -np.partition(-cosines, k - 1)[k - 1]
            some = cosines >= kth
            rows, cosines = rows[some], cosines[some]
        return rows, cosines


def _valid(vector: Column) -> Column:
    """Finite, not null, not all zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int, query: Column) -> DataFrame:
    """One row per distinct vector: entry (a name), ids (the ``keep`` smallest,
    ascending) and whether a query has it. Ids are cut to ``keep`` per task first."""
    v = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"),
                    query.alias("q")).filter(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    asked = v.groupBy("v").agg(F.max("q").alias("asked"))
    few = v.select("v", "vec_id").distinct()
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = few.withColumn("r", rank).filter(F.col("r") <= keep)
    few = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    # the id alone may stand for two vectors
    return few.join(asked, "v").withColumn("entry", F.concat_ws(":", F.col("ids")[0], F.xxhash64("v")))


def search(spark: SparkSession, rows: DataFrame, query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row of ``rows``
    (vec_id, embedding) where ``query`` holds."""
    keep = k + 1  # a query is not its own neighbour
    entries = stored(spark, distinct_vectors(rows, keep, query), "ann-entries")
    size = entries.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    entries = entries.filter(F.size("v") == size["d"])
    sample = entries.orderBy(F.xxhash64("entry")).limit(SAMPLE).select("v").toArrow().column(0)
    coder = learn(np.asarray(sample.combine_chunks().flatten()).reshape(-1, size["d"]), k)
    n_shards = -(-size["n"] // SHARD)
    asked = entries.filter("asked")
    n_blocks = -(-asked.count() // QUERY_BLOCK)
    if not n_blocks:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    deal = lambda salt, n: F.pmod(F.xxhash64("entry", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = entries.select(deal("shard", n_shards).alias("shard"), every(n_blocks).alias("block"), "entry", "v", "ids")
    queries = asked.select(every(n_shards).alias("shard"), deal("block", n_blocks).alias("block"), "entry", "v")
    shared = spark.sparkContext.broadcast(coder)

    def ask(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(asked):
            coder = shared.value
            shard = Shard(coder, np.stack(index["v"].to_list()))
            vectors = np.stack(asked["v"].to_list())
            codes = coder.codes(_unit(vectors))
            ids = index["ids"].to_list()
            for entry, vector, code in zip(asked["entry"].tolist(), vectors, codes, strict=True):
                found, cosines = shard.nearest(vector, code, keep)
                best = sorted((-c, i) for r, c in zip(found.tolist(), cosines.tolist(), strict=True) for i in ids[r].tolist())
                out += [(entry, i, -c) for c, i in best[:keep]]
        return pd.DataFrame(out, columns=["entry", "vec_id", "score"])

    found = (shards.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block"))
             .applyInPandas(ask, "entry string, vec_id bigint, score double"))
    # the ``keep`` best of all shards per distinct query vector, nearest first; the limit
    # by rank is applied in each task before the shuffle
    place = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("place", place).filter(F.col("place") <= keep)
    far = F.struct((-F.col("score")).alias("far"), F.col("vec_id"))
    best = stored(spark, best.groupBy("entry").agg(F.array_sort(F.collect_list(far)).alias("best")), "ann-found")
    # back to the rows that asked: by vector, whose entry the stored table names
    own = rows.filter(query).select(F.col("vec_id").cast("bigint").alias("query_id"),
                                    F.col("embedding").cast("array<double>").alias("v"))
    own = own.filter(F.col("query_id").isNotNull() & _valid(F.col("v"))).distinct()
    named = entries.filter("asked").select("v", "entry")
    out = own.join(named, "v").join(best, "entry")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
                      (-F.col("b.far")).alias("score"))
