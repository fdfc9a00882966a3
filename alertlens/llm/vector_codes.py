"""Product codes of vectors by exact integer k-means: limb-split GEMM, first argmin.

A component x becomes the integer floor(1024 * x). A vector is cut into PARTS equal
consecutive parts (at floor(d * k / PARTS), should d not divide); each part position has a
codebook that starts as that part of the ENTRIES smallest kept ids. A round assigns each
part to its nearest entry and moves each used entry to its parts' floored mean.

Exactness: squared distances are |v|^2 - 2 v.c + |c|^2 in int64. The dot products run
in float64 BLAS on limbs: an integer is broken into limbs of so few bits that a sum of d
products stays below 2^53 (24 bits for parts of 16), limb products are turned into int64 and
shifted into place. Arithmetic in int64 wraps, so only the result must fit, which the largest
component, known beforehand, proves. Where it doesn't (components of 2^26 and more at
64 dimensions), the same sums run on Python integers. argmin takes the first of equal distances.

Spark: the kept rows are stored once; a round is one pass over them with the codebooks
broadcast (PARTS x ENTRIES short vectors, whatever the corpus). A task sends one row for each
(part, entry, limb) that it met: limb sums of the components, added by Spark and recombined
as Python integers, so that no total overflows. Nothing else reaches the driver.

Defined results: vectors that are null or hold null or non-finite components are dropped, and
so are those of another length than the first kept row has. Ties of the first ids (repeated
rows, null ids, which come last) are ordered by vector, then label. Fewer rows than ENTRIES
give a smaller codebook, no rows give no rows; other columns are ignored. An error, or a sum of
errors, beyond a long is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlens.llm.common import at_most, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Sums by label are broadcast up to this many labels (16 bytes each), else joined by shuffle.
MAX_LABELS = 500_000
SALTS = 16

_LONG = 1 << 63


def bounds(d: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector of d components begin, and its end."""
    return [d * k // parts for k in range(parts + 1)]


def limb_bits(d: int) -> int:
    """Bits of a limb such that sums of d products of limbs stay at 2^53 or less."""
    return (53 - max(0, math.ceil(math.log2(max(1, d))))) // 2


def limbs(v: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as limbs, lowest first: v = sum of limb k << (bits * k); the last is signed."""
    out, most = [], max((int(abs(x)) for x in (v.min(), v.max())), default=0) if v.size else 0
    while most >> bits:
        out.append(v & ((1 << bits) - 1))
        v, most = v >> bits, most >> bits
    return [*out, v]


def dots(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """v @ c.T of int64 matrices, exact modulo 2^64, by float64 products of limbs."""
    bits = limb_bits(v.shape[1])
    a, b = ([x.astype(np.float64) for x in limbs(m, bits)] for m in (v, c))
    out = np.zeros((len(v), len(c)), np.int64)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if bits * (i + j) < 64:
                out += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


def fits(d: int, largest: int) -> bool:
    """Whether squared distances of d components of at most ``largest`` fit in int64."""
    return 4 * max(1, d) * largest * largest < _LONG


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances of rows of v and c; int64 input by limbs, objects as they are."""
    if v.dtype == object:
        return (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]
    return (v * v).sum(1)[:, None] - 2 * dots(v, c) + (c * c).sum(1)[None, :]


def integers(x: np.ndarray, scale: int, small: bool) -> np.ndarray:
    """floor(scale * x), as int64 where all results are small, else as Python integers."""
    if small:
        return np.floor(x.astype(np.float64) * scale).astype(np.int64)
    whole = [math.floor(y * scale) if abs(y) < 1e300 else math.floor(y) * scale for y in x.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


def assign(v: np.ndarray, books: list[np.ndarray], cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts) nearest entries, the first of equals, and each row's error."""
    codes = np.zeros((len(v), len(books)), np.int64)
    error = np.zeros(len(v), v.dtype)
    for p, book in enumerate(books):
        far = squared(v[:, cuts[p] : cuts[p + 1]], book)
        codes[:, p] = far.argmin(1)
        error += far[np.arange(len(v)), codes[:, p]]
    return codes, error


def _matrix(column: pa.Array, d: int, scale: int, small: bool) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return integers(values.reshape(len(column), d), scale, small)


def kept_rows(df: DataFrame) -> DataFrame:
    """vec_id, embedding, label of the rows whose vector is whole and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select("vec_id", "embedding", "label").filter(F.col("embedding").isNotNull() & finite)


def train(spark: SparkSession, rows: DataFrame, d: int, small: bool, first: np.ndarray, parts: int, rounds: int,
          scale: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds; ``first`` are the rows that they start from."""
    cuts = bounds(d, parts)
    books = [first[:, a:b] for a, b in zip(cuts, cuts[1:])]
    width = max((b - a for a, b in zip(cuts, cuts[1:])), default=0)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books, bits = shared.value, limb_bits(1)
            count = [np.zeros(len(b), np.int64) for b in books]
            total = [np.zeros((len(b), b.shape[1]), object) for b in books]
            for batch in batches:
                v = _matrix(batch.column(0), d, scale, small)
                codes, _ = assign(v, books, cuts)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=len(books[p]))
                    own, at = np.unique(codes[:, p], return_inverse=True)
                    part = np.zeros((len(own), cuts[p + 1] - cuts[p]), v.dtype)
                    np.add.at(part, at, v[:, cuts[p] : cuts[p + 1]])  # a batch's rows: no overflow
                    total[p][own] += part
            out = []
            for p in range(parts):
                met = np.flatnonzero(count[p])
                split = limbs(total[p][met], bits) if len(met) and total[p].shape[1] else [np.zeros((len(met), 0), object)]
                for limb, values in enumerate(split):
                    out += [(p, int(k), limb, int(count[p][k]), [int(x) for x in s] + [0] * (width - len(s)))
                            for k, s in zip(met, values, strict=True)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["part", "entry", "limb", "n", "s"])

        met = rows.select("embedding").mapInArrow(sums, "part int, entry int, limb int, n bigint, s array<bigint>")
        met = met.groupBy("part", "entry", "limb").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
        total: dict[tuple[int, int], list[int]] = {}
        counts: dict[tuple[int, int], int] = {}
        for r in met.collect():  # at most PARTS x ENTRIES rows a limb
            own = total.setdefault((r["part"], r["entry"]), [0] * width)
            for i in range(width):
                own[i] += r[f"s{i}"] << (limb_bits(1) * r["limb"])
            if r["limb"] == 0:  # every task has this one
                counts[r["part"], r["entry"]] = r["n"]
        books = [b.copy() for b in books]
        for (p, k), s in total.items():
            books[p][k] = [x // counts[p, k] for x in s[: books[p].shape[1]]]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(spark: SparkSession, df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error of every kept row; the codebooks by part)."""
    schema = f"vec_id {dict(df.dtypes)['vec_id']}, label {dict(df.dtypes)['label']}, code string, error bigint"
    rows = stored(spark, kept_rows(df), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc(), F.col("label").asc_nulls_last()]
    head = rows.orderBy(*order).limit(1).collect()
    if not head:
        return spark.createDataFrame([], schema), []
    d = len(head[0]["embedding"])
    rows = rows.filter(F.size("embedding") == d)
    largest = rows.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x).cast("double"))))).first()[0] or 0.0
    small = largest < 2.0**40 and fits(d, math.ceil(largest * scale) + 1)
    first = rows.orderBy(*order).limit(entries).collect()
    first = integers(np.array([r["embedding"] for r in first], np.float64).reshape(-1, d), scale, small)
    books = train(spark, rows, d, small, first, parts, rounds, scale)
    shared, cuts = spark.sparkContext.broadcast(books), bounds(d, parts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = assign(_matrix(batch.column(2), d, scale, small), shared.value, cuts)
            digits, step = codes.astype(np.uint8).tobytes().hex(), 2 * parts
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([digits[k : k + step] for k in range(0, len(digits), step)], pa.string()),
                 pa.array([int(e) if e < _LONG else None for e in error.tolist()], pa.int64())],
                names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(code, schema), books


def label_sums(rows: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """``rows`` with label_error, the errors' sum over the rows of an equal label (nulls are
    equal). Few labels are broadcast; else the join is salted, so that a hot label's rows
    are spread over SALTS tasks."""
    whole = F.count("error") == F.count(F.lit(1))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.when(whole, total.try_cast("bigint")).alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if at_most(sums, max_labels):
        return rows.join(F.broadcast(sums), same).drop("_label")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted.hint("merge"), same & (F.col("_own") == F.col("_salt"))).drop("_label", "_salt", "_own")


def digests(spark: SparkSession, df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    rows, books = compress(spark, df)
    rows = label_sums(stored(spark, rows, "vector-codes"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Assignment to codebook n - 1, and codebook n."""
    return f"""
a{n} AS MATERIALIZED (
  SELECT r, p, min({{'far': xx - 2 * list_inner_product(x, c) + cc, 'k': k}}).k AS k
  FROM parts JOIN b{n - 1} USING (p) GROUP BY r, p),
m{n} AS (
  SELECT p, k, i, sum(x[i])::BIGINT AS s, count(*) AS n
  FROM a{n} JOIN parts USING (r, p), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, k, i),
n{n} AS (
  SELECT p, k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM m{n} GROUP BY p, k),
b{n} AS MATERIALIZED (
  SELECT p, k, c, list_inner_product(c, c) AS cc
  FROM (SELECT o.p, o.k, coalesce(n.c, o.c) AS c FROM b{n - 1} o LEFT JOIN n{n} n USING (p, k)))"""


#: Whole numbers in doubles: exact, as all sums stay far below 2^53.
ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding, label) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, p, x, list_inner_product(x, x) AS xx
  FROM (SELECT r, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS x
        FROM v, (SELECT unnest(range({PARTS})) AS p))),
b0 AS MATERIALIZED (
  SELECT p, r - 1 AS k, x AS c, xx AS cc FROM parts WHERE r <= {ENTRIES}),
{",".join(_round_sql(n) for n in range(1, ROUNDS + 1))},
final AS MATERIALIZED (
  SELECT r, p, min({{'far': xx - 2 * list_inner_product(x, c) + cc, 'k': k}}) AS best
  FROM parts JOIN b{ROUNDS} USING (p) GROUP BY r, p),
codes AS (
  SELECT r, string_agg(lpad(to_hex(best.k), 2, '0'), '' ORDER BY p) AS code, sum(best.far)::BIGINT AS error
  FROM final GROUP BY r),
books AS (
  SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, k, i)) AS digest
  FROM (SELECT p, k, unnest(c) AS y, unnest(range(len(c))) AS i FROM b{ROUNDS}))
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       digest AS codebooks_sha256
FROM v JOIN codes USING (r), books
"""
