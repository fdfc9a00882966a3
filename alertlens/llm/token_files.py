"""Token-id files: canonical length-limited Huffman code, independent blocks, checkpoints.

The format is a folder that any Spark reader opens:

* ``code``: (id, bits), the code's length of each id. Codes are canonical (by length, then
  id), so that lengths are all a reader needs. Lengths come from the corpus-wide counts by
  package-merge and are at most LIMIT bits (more only where the ids would not fit).
* ``blocks``: a row is a block, which is read without any other: its file, number, ids before
  it in its file, and of its documents the ids, the lengths and crc32; ``payload`` holds the codes,
  high bits first, each document from a whole byte on; ``marks`` are the checkpoints, the
  bit offset of every STEP-th id of each document. Files go up in doc_id, and so do their blocks.

Writing: one pass tokenises and stores the ids (Parquet, zstd), one sums their counts by id
(Spark's partial sums; a row for each id of the vocabulary reaches the driver), one encodes the
documents; these are ranged by doc_id, sorted and put together to blocks. Documents are split
evenly by (doc_id, length, crc32, row), so one doc_id on a third of all rows fills many files.
Scratch tables are deleted once their successor is whole.

Reading: the checkpoints make each run of STEP ids a lane of its own; a block's lanes are
decoded side by side, one table look-up a step for all of them. Documents of any length
are encoded in parts and decoded lane by lane, so no step grows with one text but its ids.

Defined results: a null or empty text is a document of the end id alone; null doc_ids come
first; rows that share a doc_id are documents of their own, ordered by length, then crc32; no
rows give an empty folder that reads as no rows; other columns are ignored. A document
whose decoded ids don't have the crc32 that was written fails the read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlens.llm.byte_level import encoder_of
from alertlens.llm.common import discard
from alertlens.session import scratch_path

END_ID = 0
LIMIT = 18
STEP = 256
BLOCK = 1 << 20  # ids of a block, exceeded only by one longer document
PART = 1 << 17  # ids encoded together

BLOCKS = ("file int, block int, first bigint, n bigint, doc_ids array<bigint>, counts array<bigint>, "
          "crcs array<bigint>, marks binary, payload binary")


# -- the code -----------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits by symbol of an optimal prefix code of at most ``limit`` bits, 0 for symbols that
    don't occur: package-merge. Each level merges the symbols with the pairs of the level
    below; backwards, the cheapest items of a level tell how many of the level below are used."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)  # a sum of counts is below limit * 2^63
    merged, own = weights, [np.ones(len(used), bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        items = np.concatenate([weights, pairs])
        order = np.argsort(items, kind="stable")
        merged = items[order]
        own.append(order < len(used))
    bits, take = np.zeros(len(used), np.int64), 2 * len(used) - 2
    for level in reversed(own):
        symbols = int(level[:take].sum())
        bits[:symbols] += 1
        take = 2 * (take - symbols)
    out[used] = bits
    return out


class Code:
    """Canonical codes by symbol, and the decoding table, from the codes' lengths."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int64)
        self.limit = max(1, int(self.bits.max(initial=0)))
        order = np.lexsort((np.arange(len(bits)), bits))
        order = order[bits[order] > 0]
        own = self.bits[order]
        room = np.int64(1) << (self.limit - own)
        self.codes = np.zeros(len(bits), np.uint64)
        first = np.r_[0, np.cumsum(room)[:-1]] if len(order) else np.zeros(0, np.int64)
        self.codes[order] = (first >> (self.limit - own)).astype(np.uint64)
        self.table = np.zeros(1 << self.limit, np.uint32)
        filled = np.repeat((order << 5 | own).astype(np.uint32), room)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        """(payload, checkpoints) of successive runs of ``counts`` ids, each from a whole byte on."""
        bits = self.bits[ids]
        end = np.r_[0, np.cumsum(bits)]
        stop = np.cumsum(counts)
        start = stop - counts
        size = (end[stop] - end[start] + 7) // 8
        byte = np.r_[0, np.cumsum(size)]
        at = end[:-1] + np.repeat(8 * byte[:-1] - end[start], counts)
        words = np.zeros(int(byte[-1]) // 4 + 3, np.uint64)
        if len(ids):
            word = at >> 5
            value = self.codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
            new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            value, word = np.bitwise_or.reduceat(value, new), word[new]
            words[word] |= value >> np.uint64(32)
            words[word + 1] |= value & np.uint64(0xFFFFFFFF)
        data = words.astype(">u4").tobytes()
        return [(data[a:b], at[s:t:STEP] - 8 * a)
                for a, b, s, t in zip(byte[:-1].tolist(), byte[1:].tolist(), start.tolist(), stop.tolist(), strict=True)]

    def encode_document(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """A document of any length, in parts of PART ids."""
        parts, marks, size = [], [], 0
        for a in range(0, len(ids), PART):
            part = ids[a : a + PART]
            (data, own), = self.encode(part, np.array([len(part)]))
            parts.append(data)
            marks.append(own + 8 * size)
            size += len(data)
        return b"".join(parts), np.concatenate(marks) if marks else np.zeros(0, np.int64)

    def decode(self, payload: bytes, marks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of all lanes, one after another: lane k has counts[k] ids from bit marks[k] on."""
        words = np.frombuffer(payload + bytes(12 - len(payload) % 4), ">u4").astype(np.uint64)
        wide = (words[:-1] << np.uint64(32)) | words[1:]
        order = np.argsort(-counts, kind="stable")  # the lanes still running are the first ones
        at, n = marks[order].astype(np.int64), counts[order]
        out = np.empty((int(n[0]) if len(n) else 0, len(n)), np.uint32)  # by step, then lane
        shift, mask = 64 - self.limit, np.uint64((1 << self.limit) - 1)
        running = np.searchsorted(-n, -np.arange(len(out)), "left")
        for k, lanes in enumerate(running.tolist()):
            own = at[:lanes]
            found = self.table[(wide[own >> 5] >> (shift - (own & 31)).view(np.uint64)) & mask]
            out[k, :lanes] = found
            own += found & np.uint32(31)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        ids = out.T[back] >> np.uint32(5)
        return ids[np.arange(len(out)) < counts[:, None]] if len(out) else np.zeros(0, np.uint32)


def lane_counts(counts: np.ndarray) -> np.ndarray:
    """Ids of each lane of documents of so many ids."""
    lanes = (counts + STEP - 1) // STEP
    out = np.full(int(lanes.sum()), STEP, np.int64)
    last = np.cumsum(lanes)[lanes > 0] - 1
    out[last] = (counts - (lanes - 1) * STEP)[lanes > 0]
    return out


# -- writing ------------------------------------------------------------------------

def tokenised(docs: DataFrame, definition: str) -> DataFrame:
    """doc_id, row, n, crc, ids of each document, the end id included (ids of two bytes, if
    they fit). ``crc``: of the ids as little-endian unsigned 32-bit integers."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(definition), _kind(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, False, kind)
        for batch in batches:
            at = 0
            for ids, counts in encoder.arrays(batch.column(2).fill_null("")):
                n = counts + 1
                ends = np.cumsum(n)
                out = np.full(int(ends[-1]), END_ID, encoder.kind)
                own = np.ones(len(out), bool)
                own[ends - 1] = False
                out[own] = ids
                wide, ends = memoryview(out.astype("<u4").tobytes()), np.concatenate([[0], ends])
                crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                buffers = [None, pa.py_buffer((ends * out.itemsize).astype(np.int32)), pa.py_buffer(out)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + len(n)], batch.column(1)[at : at + len(n)], pa.array(n), pa.array(crcs, pa.int64()),
                     pa.Array.from_buffers(pa.binary(), len(n), buffers)], names=["doc_id", "row", "n", "crc", "ids"])
                at += len(n)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id bigint, row bigint, n bigint, crc bigint, ids binary")


def _kind(definition: str) -> str:
    """Two bytes an id where the vocabulary fits."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_str(definition).get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """id, n over all documents; a task sends each id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            own = np.bincount(ids, minlength=len(total))
            own[: len(total)] += total
            total = own
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id bigint, n bigint")
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


_CODED = "doc_id bigint, row bigint, n bigint, crc bigint, marks binary, payload binary"


def coded(tokens: DataFrame, kind: str, code: Code) -> DataFrame:
    """The documents with payload and checkpoints instead of ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in batches:
            ids = batch.column(4).to_pylist()
            out, group, size = [], [], 0
            for x in [np.frombuffer(x, kind) for x in ids] + [None]:
                if x is None or group and size + len(x) > PART:
                    if len(group) == 1:
                        out.append(code.encode_document(group[0]))
                    elif group:
                        out += code.encode(np.concatenate(group), np.array([len(g) for g in group]))
                    group, size = [], 0
                if x is not None:
                    group.append(x)
                    size += len(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([m.astype("<u8").tobytes() for _, m in out], pa.binary()),
                 pa.array([p for p, _ in out], pa.binary())], names=["doc_id", "row", "n", "crc", "marks", "payload"])

    return tokens.select("doc_id", "row", "n", "crc", "ids").mapInArrow(run, _CODED)


def blocks(documents: DataFrame) -> DataFrame:
    """The encoded documents in ascending doc_id, put together to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, first = TaskContext.get().partitionId(), 0, 0
        own: list[dict] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal number, first
            n, size, marks = sum(d["n"] for d in own), 0, []
            for d in own:
                marks.append(np.frombuffer(d["marks"], "<u8") + np.uint64(8 * size))
                size += len(d["payload"])
            row = (file, number, first, n, [d["doc_id"] for d in own], [d["n"] for d in own], [d["crc"] for d in own],
                   np.concatenate(marks).astype("<u8").tobytes(), b"".join([d["payload"] for d in own]))
            number, first = number + 1, first + n
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary())
            names = ["file", "block", "first", "n", "doc_ids", "counts", "crcs", "marks", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for d in batch.to_pylist():
                if own and held + d["n"] > BLOCK:
                    yield block()
                    own, held = [], 0
                own.append(d)
                held += d["n"]
        if own:
            yield block()

    order = ("doc_id", "n", "crc", "row")
    return documents.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Tokenise ``docs`` and write the folder ``path`` in the format above."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    kind = _kind(definition)
    first, second = scratch_path(spark, "token-ids"), scratch_path(spark, "token-codes")
    tokenised(docs, definition).write.option("compression", "zstd").parquet(first)
    tokens = spark.read.parquet(first)
    met = id_counts(tokens, kind).collect()  # at most a row for each id of the vocabulary
    counts = np.zeros(max([r["id"] for r in met], default=0) + 1, np.int64)
    for r in met:
        counts[r["id"]] = r["n"]
    bits = code_lengths(counts)
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id int, bits int") \
        .coalesce(1).write.parquet(f"{path}/code")
    coded(tokens, kind, Code(bits)).write.option("compression", "uncompressed").parquet(second)
    discard(spark, first)
    blocks(spark.read.schema(_CODED).parquet(second)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(spark, second)


# -- reading ------------------------------------------------------------------------

def read_code(spark: SparkSession, path: str) -> Code:
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()
    bits = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        bits[r["id"]] = r["bits"]
    return Code(bits)


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    """The blocks, and each file's ids before it (a number for each file)."""
    rows = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    base, total = {}, 0
    for r in rows.groupBy("file").agg(F.sum("n").alias("n")).orderBy("file").collect():
        base[r["file"]] = total
        total += r["n"]
    return rows, base


def read_tokens(spark: SparkSession, path: str, finish: Callable[[memoryview], tuple] | None = None,
                schema: str = "ids binary") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ``schema``'s columns, which
    ``finish`` makes of a document's ids (little-endian unsigned 32-bit); by default the ids."""
    rows, base = _opened(spark, path)
    shared = spark.sparkContext.broadcast((read_code(spark, path), base))
    finish = finish or (lambda ids: (bytes(ids),))
    types = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    extra = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base = shared.value
        for batch in batches:
            for b in batch.to_pylist():
                counts = np.array(b["counts"], np.int64)
                ids = code.decode(b["payload"], np.frombuffer(b["marks"], "<u8"), lane_counts(counts))
                data, at = memoryview(ids.astype("<u4").tobytes()), (4 * np.r_[0, np.cumsum(counts)]).tolist()
                out = []
                for k, (p, q) in enumerate(zip(at, at[1:])):
                    if zlib.crc32(data[p:q]) != b["crcs"][k]:
                        raise ValueError(f"file {b['file']}, block {b['block']}: document {b['doc_ids'][k]} is damaged")
                    out.append(finish(data[p:q]))
                start = base[b["file"]] + b["first"] + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(start), pa.array(counts),
                     *[pa.array(c, types[t]) for c, (_, t) in zip(zip(*out, strict=True), extra, strict=True)]],
                    names=["doc_id", "start", "n_tokens", *[name for name, _ in extra]])

    return rows.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {schema}")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids) for the ids from ``start`` to before ``stop`` of the whole corpus, in runs of
    at most STEP: only blocks that hold some of them are read, only their lanes decoded."""
    rows, base = _opened(spark, path)
    shared = spark.sparkContext.broadcast((read_code(spark, path), base))
    after = [*list(base.values())[1:], stop + 1]
    rows = rows.filter(F.col("file").isin([f for (f, n), end in zip(base.items(), after) if n < stop and end > start]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base = shared.value
        for batch in batches:
            for b in batch.to_pylist():
                counts = lane_counts(np.array(b["counts"], np.int64))
                begin = base[b["file"]] + b["first"] + np.cumsum(counts) - counts
                lanes = np.flatnonzero((begin < stop) & (begin + counts > start))
                if not len(lanes):
                    continue
                ids = code.decode(b["payload"], np.frombuffer(b["marks"], "<u8")[lanes], counts[lanes])
                own = np.split(ids, np.cumsum(counts[lanes])[:-1])
                cut = [(max(s, start), x[max(0, start - s) : stop - s]) for s, x in zip(begin[lanes].tolist(), own, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in cut], pa.int64()),
                                                  pa.array([x.tolist() for _, x in cut], pa.list_(pa.int64()))],
                                                 names=["start", "ids"])

    return rows.mapInArrow(run, "start bigint, ids array<bigint>")


def digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""
    path = scratch_path(spark, "token-files")
    write_tokens(spark, docs, tokenizer_path, path)
    return read_tokens(spark, path, lambda ids: (zlib.crc32(ids),), "ids_crc32 bigint")
