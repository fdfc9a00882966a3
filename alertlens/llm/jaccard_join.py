"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles (SHINGLE successive lower-case words; a shorter text is one
shingle of all its words). Texts with equal sets are one class, so exact copies are never
compared. Each class has HASHES MinHash values; BANDS bands of ROWS values give the
candidates: classes that share a band's values meet in a bucket. A pair in a bucket is
judged only in its first common band, by comparing MinHash values STEP at a time: after m
equal ones of n, the posterior probability (uniform prior) that the similarity reaches the
threshold is P(Bin(n + 1, threshold) <= m), and the pair is dropped once this falls below
TOLERANCE. The rest are verified exactly on the shingle sets.

The results are links counted per class and a spanning forest of each bucket's links,
never a list of all pairs: what is stored of a group of g near copies is g rows for each pair
of its blocks, and the pairs, found from the signatures, live only inside the task that
prunes or verifies them. Links between copies follow from the class sizes. Components of the forests' edges (alternating star
contraction) name the groups.

Probability of losing a link: two texts of similarity s share no band with probability
(1 - s**ROWS)**BANDS, 2e-6 at 0.8 and less above, and the pruning drops a link with about
TOLERANCE at each of its HASHES / STEP looks, at 0.8 and less above; nothing else is lost: buckets have no cap. A large bucket is cut into blocks of about
BLOCK classes, and every pair of blocks is a group of its own, spread over tasks.

Defined results: null, empty and blank texts have no shingle, link to nothing and are
groups of their own; equal doc_ids are separate rows; a group is named by its smallest
doc_id (nulls last); no rows give no rows; other columns are ignored; very long texts are
read in slices, and their shingles are compared whole.

Hot keys (a class with very many copies, a bucket, a group or a star's centre with very many
members) are told by counts already made and joined by broadcast, apart from the others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlens.llm.common import Memo, hot_join, quoted, slices, stored, unused

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
ROWS = 4
BANDS = 25
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256
BROADCAST_KEYS = 1_000_000  # a class, an id and a flag each

_MIX1, _MIX2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(20)
_MULT = (_draw.integers(0, 1 << 32, (HASHES, 1), np.uint64) | np.uint64(1)).astype(np.uint32)
_PLUS = _draw.integers(0, 1 << 32, (HASHES, 1), np.uint64).astype(np.uint32)


class Shingles:
    """Text -> sorted distinct 64-bit shingle hashes."""

    def __init__(self):
        self.memo = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))

    def __call__(self, text: str | None) -> np.ndarray:
        words = [np.fromiter(map(self.memo.__getitem__, own), np.uint64, len(own))
                 for part in slices((text or "").lower()) for own in (part.split(),)]
        w = words[0] if len(words) == 1 else np.concatenate(words)
        if not len(w):
            return w
        width = min(SHINGLE, len(w))
        h = np.full(len(w) - width + 1, np.uint64(width))
        for j in range(width):
            h = (h ^ w[j : len(w) - width + 1 + j]) * _STEP
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(33))) * _MIX1
        h = (h ^ (h >> np.uint64(33))) * _MIX2
        return np.unique(h ^ (h >> np.uint64(33)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, 16 bits each."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        low = np.minimum(low, (x[at : at + 4096] * _MULT + _PLUS).min(1))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def class_key(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """n -> fewest equal MinHash values of n at which a pair stays."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


_LEAST = least_matches()


def surviving_pairs(left: np.ndarray, right: np.ndarray, band: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of two signature matrices that share ``band`` and no earlier band and
    are not dropped by the posterior; ``same``: one matrix, a < b."""
    a, b = np.triu_indices(len(left), 1) if same else np.indices((len(left), len(right))).reshape(2, -1)
    first, second = (np.ascontiguousarray(x).view("<u8") for x in (left, right))  # a band is one number
    for k in range(band):
        if not len(a):
            return a, b
        new = first[a, k] != second[b, k]
        a, b = a[new], b[new]
    matches = np.zeros(len(a), np.int16)
    for n in range(STEP, HASHES + 1, STEP):
        if not len(a):
            break
        matches += (left[a, n - STEP : n] == right[b, n - STEP : n]).sum(1, dtype=np.int16)
        good = matches >= _LEAST[n]
        a, b, matches = a[good], b[good], matches[good]
    return a, b


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of successive equal keys (the first ``keys`` columns) of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:], strict=False):
            part = batch.slice(start, end - start)
            if held and start == 0 and any(held[-1].column(i)[0] != part.column(i)[0] for i in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            elif held and start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


_GROUP = "band int, bucket bigint, i int, j int"
_GROUP_COLUMNS = ["band", "bucket", "i", "j"]


def _survivors(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the surviving pairs of one candidate group, sorted by a."""
    band, i, j = (run.column(c)[0].as_py() for c in ("band", "i", "j"))
    block = run.column("block").to_numpy()
    sig = np.frombuffer(b"".join(run.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
    if i == j:
        a, b = surviving_pairs(sig, sig, band, True)
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = surviving_pairs(sig[left], sig[right], band, False)
        a, b = left[a], right[b]
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate groups (with block and signature of each class) -> the classes that have
    a surviving pair in the group: the pairs themselves are found again where they are verified."""
    out, rows = [], 0
    for run in _runs(batches, 4):
        if run.num_rows < 2:
            continue
        a, b = _survivors(run)
        if len(a):
            out.append(run.select([*_GROUP_COLUMNS, "cls", "block"]).take(np.union1d(a, b)))
            rows += out[-1].num_rows
        if rows >= 10_000:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out, rows = [], 0
    if out:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def linked_partners(own: np.ndarray, others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of ``others`` have a Jaccard similarity of ``threshold`` or more with ``own``."""
    sizes = np.array([len(o) for o in others])
    values = np.concatenate(others)
    at = np.searchsorted(own, values)
    at[at == len(own)] = 0
    shared = np.add.reduceat((own[at] == values).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
    # s >= t as integers over hundredths of thousands, so that 0.8 itself is met exactly
    return shared * 100_000 >= round(threshold * 100_000) * (len(own) + sizes - shared)


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of classes with their signatures and sets -> per class its linked documents
        in the group and the smallest class it reaches there."""
        rows: list[tuple[int, int, int]] = []
        for run in _runs(batches, 4):
            cls, copies = run.column("cls").to_pylist(), run.column("copies").to_pylist()
            sets = [np.frombuffer(s, "<u8") for s in run.column("shingles").to_pylist()]
            links = dict.fromkeys(cls, 0)
            root = {c: c for c in cls}

            def find(c: int, root=root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            a, b = _survivors(run)
            own, starts = np.unique(a, return_index=True)
            for x, partners in zip(own.tolist(), np.split(b, starts[1:]), strict=len(own) > 0):
                good = linked_partners(sets[x], [sets[p] for p in partners.tolist()], threshold)
                for p in partners[good].tolist():
                    links[cls[x]] += copies[p]
                    links[cls[p]] += copies[x]
                    u, v = find(cls[x]), find(cls[p])
                    root[max(u, v)] = min(u, v)
            rows += [(c, find(c), n) for c, n in links.items() if n]
            if len(rows) >= 10_000:
                yield _links(rows)
                rows = []
        if rows:
            yield _links(rows)

    return verify


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["cls", "root", "links"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, HASHES // ROWS)[:, :BANDS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig))), pa.array(sig.reshape(-1)),
             pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["band", "bucket", "cls"])


_SIGNED = T.StructType([T.StructField("cls", T.LongType()), T.StructField("sig", T.BinaryType())])
_SETS = T.StructType([T.StructField("cls", T.LongType()), T.StructField("shingles", T.BinaryType())])


@F.pandas_udf(_SIGNED)
def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    shingles = Shingles()
    for texts in batches:
        sets = [shingles(t) for t in texts]
        yield pd.DataFrame({"cls": pd.array([class_key(s) if len(s) else None for s in sets], "Int64"),
                            "sig": [signature(s).tobytes() if len(s) else None for s in sets]})


@F.pandas_udf(_SETS)
def shingle_sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    shingles = Shingles()
    for texts in batches:
        sets = [shingles(t) for t in texts]
        yield pd.DataFrame({"cls": pd.array([class_key(s) if len(s) else None for s in sets], "Int64"),
                            "shingles": [s.tobytes() for s in sets]})


#: Not to be moved below the join that picks the texts: the plan would work out every text's set.
picked_sets = shingle_sets.asNondeterministic()


@F.pandas_udf(T.LongType())
def text_class(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    shingles = Shingles()
    for texts in batches:
        sets = [shingles(t) for t in texts]
        yield pd.Series([class_key(s) if len(s) else None for s in sets], dtype="Int64")


class_of = text_class.asNondeterministic()  # so that no plan moves it below a join


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """cls, root (smallest class of the component) from edges (cls, root), by alternating
    large and small stars until nothing changes; each round is written to the shared folder.
    Up to BROADCAST_KEYS nodes are broadcast with their least neighbours; beyond, a star's
    centre with many neighbours is joined apart from the others."""
    edges = edges.select(F.greatest("cls", "root").alias("u"), F.least("cls", "root").alias("v")).filter("u != v").distinct()
    edges = stored(spark, edges, "cc-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        n = edges.count()
        few = 2 * n <= BROADCAST_KEYS  # so many nodes at most
        large = both.join(F.broadcast(least), "u") if few else hot_join(both, stored(spark, least, "cc-least"), ["u"], 2 * n)
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = large if few else stored(spark, large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = large.join(F.broadcast(low), "u") if few else hot_join(large, stored(spark, low, "cc-low"), ["u"], large.count())
        small = small.select("u", "m").union(small.filter("v != m").select("v", "m")).toDF("u", "v").filter("u != v").distinct()
        edges = stored(spark, small, "cc-edges")
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("root"))
        state = new


def _grouped(spark: SparkSession, docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, sig) of every document, and of every class: cls, first_id (its smallest
    doc_id), copies (its documents), links (linked documents of other classes, null for
    none), root (the smallest class of its group)."""
    if threshold != THRESHOLD:
        raise ValueError("the bands are laid out for THRESHOLD; choose ROWS, BANDS and THRESHOLD together")
    s = docs.select("doc_id", signed("text").alias("s")).select("doc_id", "s.cls", "s.sig")
    s = stored(spark, s, "join-signatures")
    classes = s.filter("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.any_value("sig").alias("sig"))
    classes = stored(spark, classes, "join-classes")

    # candidates: buckets of two classes or more, cut into pairs of blocks
    members = classes.select("cls", "sig").mapInArrow(_bands, "band int, bucket bigint, cls bigint")
    sizes = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = hot_join(members, stored(spark, sizes, "join-buckets"), ["band", "bucket"], BANDS * classes.count())
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    members = members.join(classes.select("cls", "sig"), "cls")
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("band", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                             "cls", "block", "sig")
    dealt = members.repartition(*_GROUP_COLUMNS).sortWithinPartitions(*_GROUP_COLUMNS)
    kept = stored(spark, dealt.mapInArrow(_prune, f"{_GROUP}, cls bigint, block int"), "join-candidates")

    # exact verification: one text of each class that has a candidate
    need = kept.select("cls").distinct().join(classes.select("cls", "first_id", "copies"), "cls")
    need = stored(spark, need, "join-needed")
    ids = need.select(F.col("first_id").alias("needed_id")).distinct()
    ids = F.broadcast(ids) if need.count() <= BROADCAST_KEYS else ids
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("needed_id")), "left_semi")
    sets = texts.select(picked_sets("text").alias("s")).select("s.cls", "s.shingles").join(need.select("cls", "copies"), "cls")
    sets = stored(spark, sets.dropDuplicates(["cls"]).join(classes.select("cls", "sig"), "cls"), "join-sets")
    pairs = kept.join(sets, "cls").select(*_GROUP_COLUMNS, "cls", "block", "copies", "sig", "shingles")
    pairs = pairs.repartition(*_GROUP_COLUMNS).sortWithinPartitions(*_GROUP_COLUMNS)
    links = stored(spark, pairs.mapInArrow(_verify(threshold), "cls bigint, root bigint, links bigint"), "join-links")

    # groups and counts per class
    roots = components(spark, links.select("cls", "root"))
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    per_class = (classes.select("cls", "first_id", "copies").join(counts, "cls", "left").join(roots, "cls", "left")
                 .withColumn("root", F.coalesce("root", "cls")))
    return s, stored(spark, per_class, "join-groups")


def join_documents(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group of linked documents), n_links (other
    documents of similarity ``threshold`` or more, copies included)."""
    s, per_class = _grouped(spark, docs, threshold)
    named = per_class.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    per_class = hot_join(per_class, stored(spark, named, "join-named"), ["root"], per_class.count()).select(
        "cls", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n"))
    result = stored(spark, per_class, "join-result")
    out = hot_join(s.select("doc_id", "cls").filter("cls is not null"), result, ["cls"], s.count())
    alone = s.filter("cls is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.select("doc_id", "class_id", F.col("n_links").cast("bigint").alias("n_links")).unionByName(alone)


def keep_one(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, that with the smallest doc_id (nulls last; the smallest
    class among equal ids), with all its columns; texts without words all stay. A row is
    judged by its own text's class, so rows that share an id or have none are told apart."""
    s, per_class = _grouped(spark, docs, threshold)
    order = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "cls")
    heads = per_class.groupBy("root").agg(F.sum("copies").alias("size"), F.min(order).alias("head"), F.count(F.lit(1)).alias("n"))
    heads = stored(spark, heads.filter("size > 1"), "join-heads")
    marks = hot_join(per_class.select("cls", "first_id", "root", "copies"), heads, ["root"], per_class.count())
    marks = stored(spark, marks.select("cls", "first_id", (F.col("cls") == F.col("head.cls")).alias("stays"),
                                       F.col("copies").alias("n")), "join-marks")
    few, total = marks.count() <= BROADCAST_KEYS, s.count()
    own = marks.filter("stays")
    ids = s.select("doc_id", "cls")
    ids = ids.join(F.broadcast(own), "cls") if few else hot_join(ids, own, ["cls"], total)
    ids = ids.filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    twice = stored(spark, ids.groupBy("cls", "first_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "join-twice")

    cls, key, n, mark, first_id, stays = (unused(docs, x) for x in ("cls", "key", "n", "mark", "first_id", "stays"))
    once = marks.join(twice.select("cls", F.lit(True).alias("more")), "cls", "left").select(
        F.col("cls").alias(key), F.col("first_id").alias(first_id),
        (F.col("stays") & F.col("more").isNull()).alias(stays), F.col("n").alias(n))
    # texts without words have no class: a number of its own spreads each of them, and whatever it meets they stay
    left = docs.withColumn(cls, class_of("text")).withColumn(key, F.coalesce(cls, F.xxhash64(F.monotonically_increasing_id())))
    left = left.join(F.broadcast(once), key, "left") if few else hot_join(left, once, [key], total, "left", n)
    left = left.filter(F.col(cls).isNull() | F.col(stays).isNull() | (F.col(stays) & F.col("doc_id").eqNullSafe(F.col(first_id))))
    left = left.select(*map(quoted, docs.columns))
    if twice.isEmpty():
        return left
    # one of the rows that share text class and id
    some = twice.select(F.col("first_id").alias(first_id)).distinct()
    again = docs.join(F.broadcast(some) if few else some, F.col("doc_id").eqNullSafe(F.col(first_id)), "left_semi")
    pairs = twice.select(F.col("cls").alias(mark), F.col("first_id").alias(first_id))
    again = again.withColumn(cls, class_of("text")).join(
        F.broadcast(pairs) if few else pairs,
        (F.col(cls) == F.col(mark)) & F.col("doc_id").eqNullSafe(F.col(first_id)), "left_semi")
    return left.unionByName(again.dropDuplicates([cls]).select(*map(quoted, docs.columns)))
