"""Best-fit packing of token sequences by exact complements.

Tokenising: a tokenizer of the ``tokenizers`` library runs inside the tasks, with a memo
of words (its pre-tokenizer drops white space, so no token crosses a blank); a text's ids
are cut into pieces of at most CAPACITY.

Planning: only the histogram of piece lengths (at most CAPACITY numbers, whatever the
corpus) reaches the driver. From the longest length down, sequences are filled exactly:
the gap left is looked up among single lengths, then sums of pairs, then of triples,
and as many sequences are made at once as the available counts allow. What has no exact
complement goes by best fit: the gap takes the longest length that fits, again and again.
Each step consumes one length class or more, so the plan is a short list of patterns
(lengths of a sequence, how many such sequences).

Assigning: the pieces of a length are numbered without gaps in parallel (per salt, with
prefix sums over the salts' counts), and the number tells the pattern, the sequence and
the place. A hot length, as from many copies, is dealt over SALTS groups.

Defined results: null and empty texts are documents of one id (the closing 0); repeated
doc_ids are packed separately; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlens.llm.common import slices, stored

CAPACITY = 2048
END_ID = 0
SALTS = 64

PIECES = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


_ODD_BLANKS = "\x1c\x1d\x1e\x1f"  # blanks to str.split alone


def _odd_blank(text: str) -> bool:
    return any(c in text for c in _ODD_BLANKS)


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    For a tokenizer whose pre-tokenizer keeps the matches of a pattern and whose model
    marks word ends, a text is cut at blanks, each word not met yet into the pattern's
    matches, and only new matches go to the tokenizer, many at a time; the word-end marks
    cut its ids again. Words with characters outside Latin, which normalising may change,
    go to the tokenizer as they are; so do whole texts that hold an added token's string, which
    the library then makes that token's id, and whole texts for any other kind of tokenizer.
    """

    WORDS, MATCHES = 400_000, 500_000  # kept at most; forgotten ones are worked out again
    TOGETHER = 1 << 18  # characters of texts whose words are looked up at once

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        added = spec.get("added_tokens") or []
        self.added = [t["content"] for t in added if not t["normalized"]]
        #: Sought in the normalised text, which is lower case wherever a text is cut here.
        self.added_low = [t["content"].lower() for t in added if t["normalized"]]
        self.words: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}
        mark = spec["model"].get("end_of_word_suffix")
        first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        cuts = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
        lower = {"type": "Lowercase"} in (spec.get("normalizer") or {}).get("normalizers", [])
        self.findall = regex.compile(first["pattern"]["Regex"]).findall if mark and cuts and lower else None
        if self.findall:
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(mark)]] = True

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, new: set[str]) -> None:
        words, matches = self.words, self.matches
        if len(matches) > self.MATCHES:
            matches.clear()
        cut = {}
        for w in new:
            if w.isascii() or max(w) < "\u0250":
                low = w.lower()
                if low.isalpha():  # the commonest words need no pattern: letters alone,
                    if known := matches.get(low):
                        words[w] = known
                    else:
                        cut[w] = (low,)
                elif low[:-1].isalpha() and low[-1] in ".,;:!?":  # and with one mark behind
                    cut[w] = (low[:-1], low[-1])
                else:
                    cut[w] = self.findall(low)
            else:
                words[w] = self._encode(w).tobytes()
        todo = list({m for own in cut.values() for m in own if m not in matches})
        if todo:
            ids = self._encode(" ".join(todo))
            at = np.flatnonzero(self.ends[ids]) + 1
            data, at = ids.tobytes(), (4 * at).tolist()
            for m, a, b in zip(todo, [0, *at], at, strict=False):
                matches[m] = data[a:b]
        for w, own in cut.items():
            words[w] = matches[own[0]] if len(own) == 1 else b"".join([matches[m] for m in own])

    def _know(self, words: set[str]) -> None:
        new = words.difference(self.words)
        if len(self.words) + len(new) > self.WORDS:
            self.words.clear()
            new = words
        if new:
            self._learn(new)

    def _uncut(self, text: str) -> bool:
        """Whether the library should see the text as it is."""
        return (not self.findall or any(t in text for t in self.added)
                or bool(self.added_low) and any(t in text.lower() for t in self.added_low))

    def ids(self, text: str) -> bytes:
        if self._uncut(text):
            return self._encode(text).tobytes()
        parts = []
        for part in slices(text):
            if _odd_blank(part):
                parts.append(self._encode(part).tobytes())
                continue
            words = part.split()
            self._know(set(words))
            parts.append(b"".join(map(self.words.__getitem__, words)))
        return b"".join(parts)

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; the new words of successive short texts are learned together."""
        for group in _groups(texts, self.TOGETHER):
            if len(group) == 1 or any(map(self._uncut, group)) or any(map(_odd_blank, group)):
                yield from map(self.ids, group)
                continue
            split = [t.split() for t in group]
            self._know(set(chain.from_iterable(split)))
            for words in split:
                yield b"".join(map(self.words.__getitem__, words))


def _groups(texts: Iterable[str], size: int) -> Iterator[list[str]]:
    """Successive texts of ``size`` characters together, a longer one alone."""
    group, chars = [], 0
    for t in texts:
        if group and chars + len(t) > size:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield group


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(definition: str) -> WordTokenizer:
    """One tokenizer per Python worker: its memo serves all tasks that the worker runs."""
    if definition not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[definition] = WordTokenizer(definition)
    return _tokenizers[definition]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the ids' pieces."""
    step = 4 * capacity
    return [(k, at // 4, len(part) // 4, zlib.crc32(part))
            for k, at in enumerate(range(0, len(ids), step)) for part in (ids[at : at + step],)]


def pieces(spark: SparkSession, docs: DataFrame, definition: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. ``definition``: the tokenizer's JSON."""
    shared = spark.sparkContext.broadcast(definition)

    @F.pandas_udf(PIECES)
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = tokenizer_of(shared.value)
        end = np.asarray([END_ID], "<u4").tobytes()
        for texts in batches:
            yield pd.Series([cut(ids + end, capacity) for ids in tokenizer.many(t or "" for t in texts)])
        tokenizer.words.clear()  # an idle worker keeps the smaller memo only

    return docs.select("doc_id", F.explode(split("text")).alias("p")).select("doc_id", "p.*")


class _Sums:
    """Which lengths, sums of two and sums of three are available."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that fill ``gap`` exactly, longest first."""
        have = self.counts
        if have[gap]:
            return [gap]
        return self.pair(gap) or self.triple(gap)

    def pair(self, gap: int) -> list[int] | None:
        if gap < 2:
            return None
        long = np.arange((gap + 1) // 2, gap)
        short = gap - long
        good = (self.counts[long] > 0) & (self.counts[short] > 0)
        if gap % 2 == 0:
            good[0] &= self.counts[gap // 2] > 1
        found = np.flatnonzero(good)
        return [int(long[found[-1]]), int(short[found[-1]])] if len(found) else None

    def triple(self, gap: int) -> list[int] | None:
        for first in np.flatnonzero(self.counts[:gap])[::-1]:
            self.counts[first] -= 1
            rest = self.pair(gap - int(first))
            self.counts[first] += 1
            if rest:
                return [int(first), *rest]
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence) with the number of such sequences; every piece
    counted in ``histogram`` is in exactly one."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    sums, patterns = _Sums(counts), []

    def emit(lengths: list[int]) -> None:
        own, need = np.unique(lengths, return_counts=True)
        times = int((counts[own] // need).min())
        counts[own] -= times * need
        patterns.append((tuple(lengths), times))

    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            chosen, gap = [longest], capacity - longest
            taken = [longest]
            while gap:
                rest = sums.fill(gap)
                if rest is None:  # best fit: the longest that fits, then look again
                    fits = np.flatnonzero(counts[1 : gap + 1])
                    if not len(fits):
                        break
                    rest = [int(fits[-1]) + 1]
                for x in rest:
                    counts[x] -= 1
                    taken.append(x)
                chosen += rest
                gap -= sum(rest)
            for x in taken:
                counts[x] += 1
            emit(chosen)
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, one past the last, first sequence, offset): the pieces of a
    length with these numbers sit at the offset, one in each sequence from the first on."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            first = used.get(x, 0)
            used[x] = first + times
            out.append((x, first, first + times, sequence, offset))
            offset += x
        sequence += times
    return out


def pack(spark: SparkSession, cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset."""
    rows = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    rows = stored(spark, rows, "pieces")
    # at most capacity x SALTS sums, whatever the corpus
    groups = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "salt").collect()
    histogram: dict[int, int] = {}
    bases = []
    for g in groups:
        bases.append((g["length"], g["salt"], histogram.get(g["length"], 0)))
        histogram[g["length"]] = histogram.get(g["length"], 0) + g["n"]
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for x, first, _, sequence, offset in slots(plan(histogram, capacity)):
        by_length.setdefault(x, []).append((first, sequence, offset))
    base = np.zeros((capacity + 1, SALTS), np.int64)
    for length, salt, first in bases:
        base[length, salt] = first
    tables = {x: tuple(np.array(c, np.int64) for c in zip(*rows_, strict=True)) for x, rows_ in by_length.items()}
    shared = spark.sparkContext.broadcast((base, tables))

    place = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(place)
    def assign(length: pd.Series, salt: pd.Series, number: pd.Series) -> pd.DataFrame:
        base, tables = shared.value
        number = base[length.to_numpy(), salt.to_numpy()] + number.to_numpy()
        out = np.zeros((2, len(number)), np.int64)
        for x in length.unique():
            own = (length == x).to_numpy()
            first, sequence, offset = tables[x]
            at = np.searchsorted(first, number[own], "right") - 1
            out[0, own] = sequence[at] + number[own] - first[at]
            out[1, own] = offset[at]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = rows.withColumn("number", F.row_number().over(order).cast("long") - 1)
    rows = rows.withColumn("at", assign("length", "salt", "number"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    return pack(spark, pieces(spark, docs, definition, capacity), capacity)
