"""Alignment of two tokenizers' ids of the same text by galloping intersection.

Both tokenizers encode a blank and the text (the second one adds the blank itself); the byte
offsets where tokens end are two ascending lists. Their common members are found by a
galloping search: each member of the shorter list is sought in the longer one from the last
place on, by steps that double and a binary search within the last step. Two successive
common ends bound a group: the tokens of either side between their ranks cover the same bytes.
A link is a pair of tokens that end together, so each group's last tokens are linked.

Words: both tokenizers cut a text before a blank that follows another character than white
space, whatever stands around, so a text's groups are those of its chunks (``byte_level.chunks``)
in order, and each distinct chunk is encoded and intersected once per worker. Where a chunk's
tokens don't give its bytes back, or one of the models allows no cutting, the whole text
is encoded and intersected instead.

Corpus-wide: the first pass stores each document's links as pair numbers; the second sums them
by pair (unique per batch, then Spark's partial sums) and marks the best pairs of each
second id; the third scores the documents. The pairs are broadcast as sorted arrays if there
are at most MAX_PAIRS, a checked bound; otherwise documents' distinct pairs are joined with
them by shuffle, pairs with over one HOT-th of all links (fewer than HOT) by broadcast.

Defined results: texts null, empty or not given back byte by byte by either side have zeros
and an empty digest; repeated rows count as documents of their own; no rows give no rows;
other columns are ignored. Memory follows the longest text's ids.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlens.llm.byte_level import ByteLevelIds, Numbers, chunks, groups
from alertlens.llm.common import at_most, stored

MAX_PAIRS = 4_000_000
HOT = 2_000


def gallop(shorter: list[int], longer: list[int]) -> list[tuple[int, int]]:
    """Ranks (in shorter, in longer) of the common members of two ascending lists."""
    out, low, n = [], 0, len(longer)
    for rank, x in enumerate(shorter):
        step, high = 1, low
        while high < n and longer[high] < x:
            low = high + 1
            high += step
            step *= 2
        low = bisect_left(longer, x, low, min(high, n))
        if low == n:
            break
        if longer[low] == x:
            out.append((rank, low))
            low += 1
    return out


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ranks (in a, in b) of the common members; the shorter list drives the search."""
    if len(a) <= len(b):
        return gallop(a, b)
    return [(i, j) for j, i in gallop(b, a)]


class Aligner:
    """Groups and links of texts under two tokenizers."""

    WORDS, CHARS = 700_000, 16_000_000  # kept at most; forgotten ones are worked out again

    def __init__(self, definition: str, model: bytes):
        import sentencepiece

        self.a = ByteLevelIds(definition, specials_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.b_widths = [len(x) for x in self.b_bytes]
        self.a_widths = self.a.widths.tolist()
        # no piece spans a word's end, and texts are taken as they are
        self.cuts = self.a.chunked and not any("▁" in p.lstrip("▁") for p in pieces) and b"identity" in model
        self.kind = "<u4" if self.a.vocabulary * len(pieces) < 1 << 32 else "<u8"
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.texts: list[str | None] = []
        self.links: list[bytes] = []
        self.sizes: list[int] = []

    def _a_bytes(self, ids: list[int], text: str) -> bytes:
        return b"".join(map(self.a.bytes.__getitem__, ids)) if self.a.chunked else self.a.tokenizer.decode(ids).encode()

    def align(self, a: list[int], b: list[int], text: str) -> tuple[str | None, bytes, int]:
        """(groups as text, linked pairs, tokens of a << 32 | of b); None if bytes differ."""
        want = text.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None, b"", 0
        ranks = common_ends(list(accumulate(map(self.a_widths.__getitem__, a))),
                            list(accumulate(map(self.b_widths.__getitem__, b))))
        out, i, j = [], 0, 0
        for p, q in ranks:
            out.append(",".join(map(str, a[i : p + 1])) + "|" + ",".join(map(str, b[j : q + 1])))
            i, j = p + 1, q + 1
        pairs = np.array([a[p] * len(self.b_bytes) + b[q] for p, q in ranks], self.kind)
        return ";".join(out), pairs.tobytes(), len(a) << 32 | len(b)

    def _learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        a = self.a.learn([" " + w for w in fresh])
        for w, x, y in zip(fresh, a, self.b.encode(fresh, num_threads=1), strict=True):
            text, links, size = self.align(np.frombuffer(x, self.a.kind).tolist(), y, " " + w)
            self.texts.append(text)
            self.links.append(links)
            self.sizes.append(size)

    def whole(self, text: str) -> tuple[str, bytes, int]:
        found = self.align(self.a.whole(" " + text).tolist(), self.b.encode(text), " " + text)
        return found if found[0] is not None else ("", b"", 0)

    def many(self, texts: Iterator[str]) -> Iterator[tuple[str, bytes, int]]:
        """(groups as text, linked pairs, tokens of a << 32 | of b) of each text."""
        for group in groups(texts):
            if len(self.texts) > self.WORDS or self.numbers.chars > self.CHARS:
                self.forget()
            cut = [chunks(t) if t and self.cuts else [] for t in group]
            flat = list(map(self.numbers.__getitem__, chain.from_iterable(cut)))
            self._learn()
            end = 0
            for t, own in zip(group, cut, strict=True):
                start, end = end, end + len(own)
                numbers = flat[start:end]
                parts = list(map(self.texts.__getitem__, numbers))
                if not t:
                    yield "", b"", 0
                elif not own or None in parts:
                    yield self.whole(t)
                else:
                    yield ";".join(parts), b"".join(map(self.links.__getitem__, numbers)), sum(map(self.sizes.__getitem__, numbers))


_kept: dict[tuple, Aligner] = {}


def aligner_of(definition: str, model: bytes) -> Aligner:
    """One aligner per Python worker: its memo serves all tasks that the worker runs."""
    if (definition, model) not in _kept:
        _kept.clear()
        _kept[definition, model] = Aligner(definition, model)
    return _kept[definition, model]


def align_documents(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """doc_id, row (a number of its own), n_a, n_b, n_groups, links (pair numbers: a id * size of
    b's vocabulary + b id) and groups: their text, or with ``digest`` its SHA-256."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(*shared.value)
        width = np.dtype(aligner.kind).itemsize
        for batch in batches:
            texts, links, sizes = [], [], []
            for text, own, size in aligner.many(t or "" for t in batch.column(2).to_pylist()):
                texts.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
                links.append(own)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s >> 32 for s in sizes], pa.int64()),
                 pa.array([s & 0xFFFFFFFF for s in sizes], pa.int64()), pa.array([len(x) // width for x in links], pa.int64()),
                 pa.array(links, pa.binary()), pa.array(texts, pa.string())],
                names=["doc_id", "row", "n_a", "n_b", "n_groups", "links", "groups"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id bigint, row bigint, n_a bigint, n_b bigint, n_groups bigint, links binary, groups string")


def spans(aligned: DataFrame) -> DataFrame:
    """doc_id, row, spans: the groups as arrays of (a: ids, b: ids)."""
    side = lambda g, k: F.split(F.split(g, r"\|")[k], ",").cast("array<int>")
    group = lambda g: F.struct(side(g, 0).alias("a"), side(g, 1).alias("b"))
    empty = F.array().cast("array<struct<a:array<int>,b:array<int>>>")
    return aligned.select("doc_id", "row", F.when(F.col("groups") == "", empty)
                          .otherwise(F.transform(F.split("groups", ";"), group)).alias("spans"))


def sizes_of(a_path: str, b_path: str) -> tuple[int, str]:
    """The second vocabulary's size, and the pair numbers' type."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        aligner = Aligner(f.read(), g.read())
    return len(aligner.b_bytes), aligner.kind


def pair_counts(aligned: DataFrame, b_size: int, kind: str) -> DataFrame:
    """pair, n (links of the pair in the corpus), best (no pair of the same b id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), return_counts=True)
            keys = np.concatenate([pairs, own.astype(np.int64)])
            pairs, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, np.concatenate([n, times]), len(pairs)).astype(np.int64)  # a task's: exact in doubles
            if len(pairs) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])
                pairs, n = pairs[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    counts = aligned.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair % {b_size}")))  # at most one row for each a id
    return counts.withColumn("most", most).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_broadcast(aligned: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """``aligned`` with n_best and count_sum; ``pairs`` are known to be few."""
    table = pairs.orderBy("pair").toArrow()
    shared = aligned.sparkSession.sparkContext.broadcast(
        (table.column("pair").to_numpy().astype(kind), table.column("n").to_numpy(), table.column("best").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            links = batch.column(6).to_pylist()
            at = np.searchsorted(keys, np.frombuffer(b"".join(links), kind))
            ends = np.cumsum([0] + [len(x) // np.dtype(kind).itemsize for x in links])
            sums = [np.diff(np.r_[0, np.cumsum(x[at].astype(np.int64))][ends]) if len(at) else np.zeros(len(links), np.int64)
                    for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *map(pa.array, sums)],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])

    return aligned.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups", "links").mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint")


def score_shuffled(aligned: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """The same for pairs of any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, times = np.unique(np.frombuffer(links, kind), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row, np.int64)), pa.array(own.astype(np.int64)),
                                                  pa.array(times.astype(np.int64))], names=["row", "pair", "times"])

    total = pairs.agg(F.sum("n")).first()[0] or 0
    held = aligned.select("row", "links").mapInArrow(run, "row bigint, pair bigint, times bigint")
    hot = F.broadcast(pairs.filter(F.col("n") * HOT > total))
    cold = pairs.filter(F.col("n") * HOT <= total)
    marked = held.join(hot.select("pair", F.col("n").alias("hot_n"), F.col("best").alias("hot_best")), "pair", "left")
    met = marked.filter(F.col("hot_n").isNotNull()).select("row", "times", F.col("hot_n").alias("n"), F.col("hot_best").alias("best"))
    rest = marked.filter(F.col("hot_n").isNull()).join(cold.hint("merge"), "pair").select("row", "times", "n", "best")
    sums = met.unionAll(rest).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                                 F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return aligned.join(sums.hint("merge"), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups", zero("n_best"), zero("count_sum"))


def score(aligned: DataFrame, pairs: DataFrame, kind: str, max_pairs: int = MAX_PAIRS) -> DataFrame:
    return (score_broadcast if at_most(pairs, max_pairs) else score_shuffled)(aligned, pairs, kind)


def digests(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = stored(spark, align_documents(spark, docs, a_path, b_path, digest=True), "aligned")
    b_size, kind = sizes_of(a_path, b_path)
    pairs = stored(spark, pair_counts(aligned, b_size, kind), "token-pairs")
    return score(aligned, pairs, kind, max_pairs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
