"""Byte-level BPE: encoding and decoding with the ranks of a public vocabulary.

Encoding: each task cuts its texts into the pattern's matches and keeps the distinct
ones; a match new to the task goes, as the array of its bytes' ids, through a fold of
Spark higher-order functions that merges the lowest-ranked pair, one merge a step, until
none is left. The rank map has a fixed size (built from the ranks: all pairs of tokens whose
bytes together are a token) and is the value of a scalar subquery: as a literal, each plan's
text would hold all of it on the driver. The ids of the distinct matches are then
put together per document in the same task, without a shuffle. Decoding concatenates
the tokens' bytes.

With CUT_PATTERN the texts of a batch are first cut together, in their bytes, where no match goes
on (see ``byte_level``); only the distinct chunks are cut into matches one by one, and a chunk's
numbers are kept. With another pattern each text is cut by itself.

The COMMON most frequent matches of some COMMON_DOCS documents are folded once beforehand
and broadcast, so that not every task folds them again; this changes no result.

Matches over LONG_BYTES bytes (a run of one symbol, say) would cost the fold a step for
each byte; they are merged by the same rule with a heap. Both ways give what the
tiktoken library gives.

Defined results: null text counts as empty (no ids, the digests of nothing); repeated
doc_ids give a row each; other columns are ignored; no rows give no rows.

Memory: a task's distinct matches and chunks are forgotten beyond WORDS (they are then folded
again), an Arrow batch is bounded by the session's batch settings, and arrays are built for
successive texts of about TOGETHER bytes, or for a slice of a longer one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlens.llm.byte_level import cuts, utf8

LONG_BYTES = 96
WORDS = 900_000
TOGETHER = 1 << 20     # bytes of texts cut together
KEPT_MATCHES = 16      # chunks of more matches are not kept
#: The pattern that byte_level.cuts holds for.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COMMON = 350_000       # matches folded once for all tasks, at most
COMMON_DOCS = 16_000   # documents they are taken from, about
FOLD_TASKS = 24        # tasks that fold them
NO_RANK = 1 << 20  # ranks are below; no pair has this or more
EMPTY = 1 << 40
GONE = -1
ID_MASK = (1 << 20) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of the token that their bytes make together."""
    return {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items()
            for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}


class RankMap:
    """The pairs as one flat list: the row of a left id starts at shift[left]; place
    shift[left] + right holds left * 2**20 + merged id. The xor of that place with
    left * 2**20 is the merged id for a pair, and 2**20 or more for any other two ids.
    Rows are laid over one another at the first drawn place where none collide."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        rows: dict[int, list[tuple[int, int]]] = {}
        for (a, b), r in pairs.items():
            rows.setdefault(a, []).append((b, r))
        top = 1 + max([x for pair in pairs for x in pair], default=0)
        room = 3 * len(pairs) + 1
        draw = random.Random(0)
        self.shift = np.zeros(top, np.int64)
        self.flat = np.full(room + top, EMPTY, np.int64)
        for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
            rights, merged = np.array(row, np.int64).T
            at = draw.randrange(room)
            while (self.flat[at + rights] != EMPTY).any():
                at = draw.randrange(room)
            self.flat[at + rights] = (a << 20) | merged
            self.shift[a] = at

    def column(self, spark: SparkSession) -> Column:
        """struct(shift, flat) of arrays, as a scalar subquery."""
        arrays = pa.StructArray.from_arrays([pa.array([x], pa.list_(pa.int64())) for x in (self.shift, self.flat)], ["shift", "flat"])
        return spark.createDataFrame(pa.table({"ranks": arrays})).scalar()


class Common:
    """The common matches and their ids in buffers, which a worker cuts up once, when it asks
    for one or the other: small on the driver, and small in a worker that uses one of them."""

    def __init__(self, table: pa.Table):
        matches, ids = (table.column(k).combine_chunks() for k in (0, 1))
        ends, data = utf8(matches)
        self.texts = data.tobytes(), ends
        self.runs = ids.flatten().to_numpy().astype("<u4").tobytes(), 4 * np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
        self.kept: dict[str, list] = {}

    def _cut(self, name: str, made) -> list:
        if name not in self.kept:
            data, ends = getattr(self, name)
            at = ends.tolist()
            self.kept[name] = [made(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
        return self.kept[name]

    def matches(self) -> list[str]:
        return [m.decode() for m in self.utf8()]

    def utf8(self) -> list[bytes]:
        return self._cut("texts", bytes)

    def ids(self) -> list[bytes]:
        return self._cut("runs", bytes)


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def fold_merges(ids: Column, ranks: Column) -> Column:
    """The ids of one match after all merges; ``ids`` are those of its bytes. The fold
    carries, per token, the rank of its pair with the next token (NO_RANK or more if there
    is none) above the token's id, and the lowest rank; a merge replaces two tokens by one
    and looks up only the two ranks beside it, leftmost first among equal ranks."""

    def rank(a: Column, b: Column) -> Column:
        return F.get(ranks["flat"], (F.get(ranks["shift"], a.cast("int")) + b).cast("int")).bitwiseXOR(F.shiftleft(a, 20))

    def cell(a: Column, b: Column) -> Column:
        """Token ``a`` before token ``b`` (null: before nothing)."""
        return F.shiftleft(F.least(rank(a, b), F.lit(NO_RANK).cast("bigint")), 20).bitwiseOR(a)

    def token(cells: Column, i: Column) -> Column:
        return F.get(cells, i).bitwiseAND(ID_MASK)

    def state(cells: Column) -> Column:
        return F.struct(cells.alias("c"), F.shiftright(F.array_min(cells), 20).alias("best"))

    def merged(acc: Column, p: Column) -> Column:
        c, best = acc["c"], acc["best"]
        new = F.transform(c, lambda x, i: F.when(F.abs(i - p) > 1, x).when(i == p, cell(best, token(c, p + 2)))
                          .when(i < p, cell(x.bitwiseAND(ID_MASK), best)).otherwise(F.lit(GONE).cast("bigint")))
        return _let(F.filter(new, lambda x: x >= 0), state)

    def step(acc: Column, _: Column) -> Column:
        first = F.array_position(F.transform(acc["c"], lambda x: F.shiftright(x, 20)), acc["best"])
        return F.when(acc["best"] >= NO_RANK, acc).otherwise(_let(first.cast("int") - 1, lambda p: merged(acc, p)))

    n = F.size(ids)
    cells = F.transform(ids, lambda x, i: cell(x, F.get(ids, i + 1)))
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, _let(cells, state), step, lambda acc: F.transform(acc["c"], lambda x: x.bitwiseAND(ID_MASK)))


def merge_long(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges for a long match: lowest rank first, leftmost among equals."""
    n = len(ids)
    ids, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(pairs[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, i = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or pairs.get((ids[i], ids[j])) != r:
            continue
        ids[i], alive[j], right[i] = r, False, right[j]
        if right[j] < n:
            left[right[j]] = i
            if (p := (r, ids[right[j]])) in pairs:
                heapq.heappush(heap, (pairs[p], i))
        if left[i] >= 0 and (p := (ids[left[i]], r)) in pairs:
            heapq.heappush(heap, (pairs[p], left[i]))
    return [x for x, a in zip(ids, alive, strict=True) if a]


def _slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Cuts a very long text only before a lone blank between two visible characters:
    there every match ends, whatever stands around it."""
    import regex

    if len(text) <= size:
        yield text
        return
    edge = regex.compile(r"(?<=\S) (?=\S)")
    start = 0
    while start < len(text):
        found = edge.search(text, start + size)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


# Letters, numbers and blanks below U+0100, as the pattern's classes have them (fixed values).
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"


def finder(pattern: str):
    """findall of ``pattern``. With its classes written out for characters below U+0100 the
    faster re module serves such texts; any other text takes the pattern as it is."""
    import regex

    full = regex.compile(pattern).findall
    # inside brackets the classes are bare ranges, outside they need brackets of their own
    small = re.sub(r"\[[^\]]*\]|\\p\{L\}|\\p\{N\}|\\s|\\S", lambda m: _bracketed(m[0]), pattern)
    quick = re.compile(small).findall

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return quick(text)

    return find


def _bracketed(part: str) -> str:
    if part.startswith("["):
        return part.replace(r"\p{L}", _L).replace(r"\p{N}", _N).replace(r"\s", _S)
    return {r"\p{L}": f"[{_L}]", r"\p{N}": f"[{_N}]", r"\s": f"[{_S}]", r"\S": f"[^{_S}]"}[part]


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of successive texts (or bytes) of about TOGETHER bytes; a longer one is alone."""
    ends, _ = utf8(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + TOGETHER, "right")) - 1)
        yield start, stop
        start = stop


class _Numbers(dict):
    """match, or chunk of a few matches (UTF-8) -> the numbers of its matches (little-endian unsigned
    32-bit bytes). Matches are numbered in the order of first meeting; ``fresh`` are the new ones."""

    def __init__(self, pattern: str, first: list[bytes]):
        self.find, self.chunked = finder(pattern), pattern == CUT_PATTERN
        self.reset(first)

    def reset(self, first: list[bytes]) -> None:
        self.clear()
        self.fresh: list[bytes] = []
        self.count = len(first)
        runs = np.arange(self.count, dtype="<u4").tobytes()
        self.update(zip(first, (runs[k : k + 4] for k in range(0, len(runs), 4)), strict=True))

    def number(self, match: bytes) -> bytes:
        run = self.get(match)
        if run is None:
            run = self[match] = self.count.to_bytes(4, "little")
            self.count += 1
            self.fresh.append(match)
        return run

    def __missing__(self, chunk: bytes) -> bytes:
        matches = self.find(chunk.decode())
        if len(matches) == 1:
            return self.number(chunk)
        run = self._run(matches)
        if len(matches) <= KEPT_MATCHES:
            self[chunk] = run
        return run

    def _run(self, matches: list[str]) -> bytes:
        return b"".join([self.number(m.encode()) for m in matches])

    def runs(self, texts: pa.Array) -> list[list[bytes]]:
        """The numbers of each text's matches, in one run or, of a long text, a run a slice."""
        if len(texts) == 1:
            return [[run for part in _slices(texts[0].as_py()) for run in self._together(pa.array([part]))]]
        return [[run] for run in self._together(texts)]

    def _together(self, texts: pa.Array) -> list[bytes]:
        if not self.chunked:
            return [self._run(self.find(t)) for t in texts.to_pylist()]
        ends, data = utf8(texts)
        starts = ends[:-1]
        cut = cuts(data, starts[starts < ends[1:]])
        chunks = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.r_[cut, len(data)].astype(np.int32)), pa.py_buffer(data)])
        chunks = chunks.dictionary_encode()
        chunk_ends, held = utf8(chunks.dictionary)
        found = pa.array(list(map(self.__getitem__, _parts(held, chunk_ends))), pa.binary())
        run_ends, numbers = utf8(found.take(chunks.indices))
        return _parts(numbers, run_ends[np.searchsorted(cut, ends)])


def _parts(data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    held = data.tobytes()
    return [held[a:b] for a, b in pairwise(ends.tolist())]


class _Known:
    """The ids of the numbered matches, one match after another."""

    def __init__(self, runs: bytes, ends: np.ndarray):
        self.ids, self.sizes, self.starts = np.frombuffer(runs, "<u4"), np.diff(ends) // 4, ends[:-1] // 4

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def runs(self, numbered: pa.Array) -> Iterator[bytes]:
        """The ids (as bytes) of the matches that each run of numbers names."""
        ends, data = utf8(numbered)
        for start, stop in _groups(numbered):
            numbers = np.frombuffer(data[ends[start] : ends[stop]].tobytes(), "<u4")
            sizes = self.sizes[numbers]
            at = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.ids[np.repeat(self.starts[numbers] - at[:-1], sizes) + np.arange(at[-1])]
            yield from _parts(ids, 4 * at[(ends[start : stop + 1] - ends[start]) // 4])


_STEP1 = "doc_id bigint, runs array<binary>, fresh array<array<bigint>>, forget boolean"


def _byte_lists(matches: list[bytes], byte_ids: np.ndarray) -> pa.Array:
    """list<int64> array of the ids of each match's bytes."""
    ends, data = utf8(pa.array(matches, pa.binary()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(byte_ids[data], pa.int64()))


def _merged(folded: pa.Array, long_pairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of the folded matches; those over LONG_BYTES, which the fold left as they
    were, are merged here. ``long_pairs``: the broadcast of merge_pairs."""
    ids, sizes = folded.flatten().to_numpy().astype("<u4"), folded.value_lengths().to_numpy().astype(np.int64)
    if (sizes > LONG_BYTES).any():
        lists = [merge_long(x.tolist(), long_pairs.value) if len(x) > LONG_BYTES else x for x in np.split(ids, np.cumsum(sizes)[:-1])]
        ids, sizes = np.concatenate(lists).astype("<u4"), np.array([*map(len, lists)], np.int64)
    return ids, sizes


def encode_documents(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str,
                     finish=None, schema: str = "ids binary") -> DataFrame:
    """doc_id and ``schema``'s columns. ``finish(ids)`` makes them from a document's ids
    (little-endian unsigned 32-bit bytes); by default the ids themselves."""
    ranks = read_ranks(ranks_path)
    pairs = merge_pairs(ranks)
    rank_map = RankMap(pairs).column(spark)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    long_pairs = spark.sparkContext.broadcast(pairs)
    finish = finish or (lambda ids: (ids,))

    fold = lambda w, ranks: F.when(F.size(w) <= LONG_BYTES, fold_merges(w, ranks)).otherwise(w)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Matches of the task's texts with their numbers of occurrences and bytes' ids."""
        find, seen = finder(pattern), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in _slices(text or ""):
                    seen.update(find(part))
        matches = [m for m in seen if len(m) <= LONG_BYTES // 4]
        yield pa.RecordBatch.from_arrays(
            [pa.array(matches, pa.string()), pa.array([seen[m] for m in matches], pa.int64()),
             _byte_lists([m.encode() for m in matches], byte_ids)], names=["match", "n", "ids"])

    total = docs.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * COMMON_DOCS // max(1, total)
    often = (docs.filter(share).select("text").mapInArrow(count, "match string, n bigint, ids array<bigint>")
             .groupBy("match").agg(F.sum("n").alias("n"), F.first("ids").alias("ids"))
             .orderBy(F.desc("n"), "match").limit(COMMON).select("match", "ids").repartition(FOLD_TASKS))
    often = (often.select("match", "ids", rank_map.alias("ranks"))
             .select("match", _let(F.col("ranks"), lambda ranks: fold(F.col("ids"), ranks)).alias("ids")))
    common = spark.sparkContext.broadcast(Common(often.toArrow()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's matches become numbers in the task's list of distinct matches; the first
        document of those cut together brings the bytes' ids of their new matches along."""
        numbers = _Numbers(pattern, common.value.utf8())
        for batch in batches:
            texts = batch.column(1).fill_null("")
            runs, fresh, firsts, forgets = [], [], [0], []
            for start, stop in _groups(texts):
                forget = len(numbers) > WORDS
                if forget:
                    numbers.reset(common.value.utf8())
                runs += numbers.runs(texts[start:stop])
                fresh += numbers.fresh
                numbers.fresh = []
                firsts += [len(fresh)] * (stop - start)
                forgets += [forget] + [False] * (stop - start - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(runs, pa.list_(pa.binary())),
                 pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), _byte_lists(fresh, byte_ids)), pa.array(forgets, pa.bool_())],
                names=["doc_id", "runs", "fresh", "forget"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Puts the ids of the numbered matches together, document by document."""
        known = _Known(*common.value.runs)
        out = pa.schema([("doc_id", pa.int64()), *_arrow_fields(schema)])
        for batch in batches:
            rows = []
            forgets = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False)).tolist()
            for start, stop in pairwise(sorted({0, *forgets, batch.num_rows})):
                doc_ids, runs, fresh = batch.slice(start, stop - start).columns[:3]
                if start in forgets:
                    known = _Known(*common.value.runs)
                known.add(*_merged(fresh.flatten(), long_pairs))
                ids = known.runs(runs.flatten())
                for doc_id, n in zip(doc_ids.to_pylist(), runs.value_lengths().to_pylist(), strict=True):
                    rows.append((doc_id, *finish(b"".join(islice(ids, n)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)]
                                             if rows else [pa.array([], t.type) for t in out], schema=out)

    numbered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, _STEP1)
    # used once, so that the two selections become one: the arrays are never part of a row
    folded = (numbered.select("*", rank_map.alias("ranks"))
              .select("doc_id", "runs", _let(F.col("ranks"), lambda ranks: F.transform("fresh", lambda w: fold(w, ranks))).alias("fresh"), "forget"))
    return folded.mapInArrow(assemble, f"doc_id bigint, {schema}")


def _arrow_fields(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    return [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]


class Decoder:
    """ids (little-endian unsigned 32-bit bytes) -> the text's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            pieces[r] = token
        self.pieces = pa.array(pieces, pa.binary())

    def __call__(self, ids: bytes) -> bytes:
        return utf8(self.pieces.take(pa.array(np.frombuffer(ids, "<u4"))))[1].tobytes()


def digests(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids."""
    decoder = spark.sparkContext.broadcast(Decoder(read_ranks(ranks_path)))

    def finish(ids: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoder.value(ids)).hexdigest()

    return encode_documents(spark, docs, ranks_path, pattern, finish,
                            "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
