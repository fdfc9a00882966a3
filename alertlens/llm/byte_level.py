"""Ids of byte-level BPE texts by the ``tokenizers`` library, with a memo of words.

A byte-level tokenizer's pattern never matches across certain places, so texts are cut there
into chunks, each chunk is encoded once per worker, and a text's ids are its chunks' ids in
order. Safe cuts are: before a blank that follows a character other than white space; on both sides
of a line end without white space beside it; and between a letter or digit and the ASCII signs
that stand before such a place or the text's end. The cuts of many texts are found together in
their bytes, and only the distinct chunks are looked up. New chunks go to the library many at once,
joined at such cuts; the ids' byte widths tell where each one ends. Those of letters alone, which are
one match of the pattern each, go to its model without the pattern. Texts with an added token's
string (unless such strings are ordinary text) and all texts of a tokenizer that is not
byte-level go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: White space, or what some library may take for it, or a blank's mark; no cut behind these.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()] + ["᠎", "​", "﻿", "▁"]
_UNSAFE = "".join(_SPACES)
_LAST_UNSAFE = re.compile(f"[{_UNSAFE}]$")
_SAFE_CUT = re.compile(f"[^{_UNSAFE}](?= )")
_PAIRS = [c + " " for c in _SPACES]
_ASCII_PAIRS = [p for p in _PAIRS if p.isascii()]
_WIDE_SPACES = [c.encode() for c in _SPACES if not c.isascii()]


def _bytes_of(test) -> np.ndarray:
    return np.array([i < 128 and test(chr(i)) for i in range(256)])


_IS_SPACE = _bytes_of(lambda c: c in _SPACES)
_IS_SIGN = _bytes_of(lambda c: c.isprintable() and not c.isalnum() and c != " ")
_IS_DIGIT = _bytes_of(str.isdigit)
_IS_LETTER = _bytes_of(str.isalpha)


def chunks(text: str) -> list[str]:
    """The text cut before blanks behind other characters than white space; the chunks
    come without that blank, and the first one as if it had had one."""
    parts = text.split(" ")
    if parts[0] and parts[-1] and not any(p in text for p in (_ASCII_PAIRS if text.isascii() else _PAIRS)):
        return parts
    out, own = [], [parts[0]]
    for k, p in enumerate(parts[1:], 1):
        if not own[-1] or _LAST_UNSAFE.search(own[-1]) or (not p and k == len(parts) - 1):
            own.append(p)
        else:
            out.append(" ".join(own))
            own = [p]
    return [*out, " ".join(own)]


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts belong to white space, or to what may be taken for it."""
    found = _IS_SPACE[data]
    for lead in {c[0] for c in _WIDE_SPACES}:
        at = np.flatnonzero(data[:-1] == lead)
        for c in _WIDE_SPACES if len(at) else ():
            if c[0] == lead:
                own = at[at + len(c) <= len(data)]
                for k, byte in enumerate(c[1:], 1):
                    own = own[data[own + k] == byte]
                for k in range(len(c)):
                    found[own + k] = True
    return found


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts belong to letters of ASCII, of U+00C0 to U+024F or of U+0400
    to U+047F. Others are not told from signs here, which costs no more than time."""
    found = _IS_LETTER[data]
    at = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xD1))
    lead, last = data[at], data[at + 1]
    latin = (lead == 0xC3) & (last != 0x97) & (last != 0xB7) | (lead >= 0xC4) & (lead <= 0xC8) | (lead == 0xC9) & (last <= 0x8F)
    at = at[latin | (lead >= 0xD0)]
    found[at] = found[at + 1] = True
    return found


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the chunks of UTF-8 texts begin that stand one after another in ``data``.
    ``starts``: the places where the texts that aren't empty begin."""
    first = np.zeros(len(data) + 1, bool)
    first[starts] = first[-1] = True
    space = spaces(data)
    after_space = np.concatenate([[False], space[:-1]]) & ~first[:-1]
    before_space = np.concatenate([space[1:], [False]]) & ~first[1:]
    line = (data == 10) & ~after_space & ~before_space
    cut = first
    cut[:-1] |= (data == 32) & ~after_space | line
    cut[1:] |= line
    sign = _IS_SIGN[data]
    edge = np.flatnonzero(np.concatenate([[False], sign]) != np.concatenate([sign, [False]]))
    at, to = edge[::2], edge[1::2]  # runs of signs
    word = letters(data) | _IS_DIGIT[data]
    at, to = at[at > 0], to[at > 0]
    cut[at[word[at - 1] & cut[to]]] = True
    return np.flatnonzero(cut[:-1])


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, each but the first led by a blank
    at which a cut is safe, so that memory stays bounded for a text of any length."""
    start = 0
    while len(text) - start > size:
        found = _SAFE_CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


def groups(texts: Iterable[str], size: int = 1 << 18) -> Iterator[list[str]]:
    """Successive texts of about ``size`` characters together, a longer one alone."""
    group, chars = [], 0
    for t in texts:
        if group and chars + len(t) > size:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield group


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes are numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class Numbers(dict):
    """word -> its number, in the order of first meeting; ``fresh`` are those not learned yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        self.chars += len(word)
        return number


class ByteLevelIds:
    """Ids of texts as arrays of unsigned integers of ``kind``, as bytes."""

    WORDS, CHARS = 1_200_000, 32_000_000  # kept at most; forgotten ones are worked out again
    TOGETHER = 4_000  # chunks a call of the library
    BATCH = 1 << 23  # bytes of texts cut together

    def __init__(self, definition: str, specials_as_text: bool, kind: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.tokenizer.encode_special_tokens = specials_as_text
        spec = json.loads(definition)
        model, cut, self.kind = spec["model"], spec.get("pre_tokenizer") or {}, kind
        added = spec.get("added_tokens") or []
        self.chunked = (cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
                        and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("dropout"))
        self.specials = [] if specials_as_text else [t["content"].encode() for t in added]
        self.vocabulary = max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1
        byte = byte_of_char()
        self.bytes = [b""] * self.vocabulary
        if self.chunked:
            for token, i in model["vocab"].items():
                self.bytes[i] = bytes(byte.get(c, 0) for c in token)
            for t in added:
                self.bytes[t["id"]] = t["content"].encode()
        self.signs = {b: c for c, b in byte.items()} | {0: "\n"}
        self.widths = np.array([len(b) for b in self.bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, bytes] = {}
        self.chars = 0

    def whole(self, text: str) -> np.ndarray:
        """The library's ids of the text."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of chunks. A chunk that ends in white space, or begins with other white space
        than a blank, stands for itself; others follow a blank of their own, or a line end
        whose id is dropped again."""
        if len(new) > self.TOGETHER:
            return [x for k in range(0, len(new), self.TOGETHER) for x in self.learn(new[k : k + self.TOGETHER])]
        step = np.dtype(self.kind).itemsize
        alone = [c[-1:] in _UNSAFE or c[0] != " " and c[0] in _UNSAFE for c in new]  # "" is in every text
        led = [c if c[0] == " " else "\n" + c for c, a in zip(new, alone, strict=True) if not a]
        text = "".join(led)
        ids = self.whole(text)
        want = np.cumsum([*map(len, led)] if text.isascii() else [len(c.encode()) for c in led], dtype=np.int64)
        at = self._ends(ids, want)
        data, at = ids.astype(self.kind).tobytes(), iter((at * step).tolist())
        out, a = [], 0
        for c, single in zip(new, alone, strict=True):
            if single:
                out.append(self.whole(c).astype(self.kind).tobytes())
                continue
            b = next(at)
            out.append(data[a:b] if c[0] == " " else data[a + step : b])
            a = b
        return out

    def _ends(self, ids: np.ndarray, want: np.ndarray) -> np.ndarray:
        """How many ids stand before each of the places, which are counted in bytes."""
        ends = np.r_[0, np.cumsum(self.widths[ids])]
        at = np.searchsorted(ends, want)
        if (ends[np.minimum(at, len(ids))] != want).any():
            raise ValueError("a token of this vocabulary crosses the places that are cut")
        return at

    def learn_plain(self, new: list[bytes]) -> list[bytes]:
        """The ids of chunks that are one match of the pattern each."""
        out, step = [], np.dtype(self.kind).itemsize
        for k in range(0, len(new), self.TOGETHER):
            own = new[k : k + self.TOGETHER]
            text = b"\0".join(own).decode("latin-1").translate(self.signs)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            at = self._ends(ids, np.cumsum([*map(len, own)], dtype=np.int64)) * step
            data, at = ids.astype(self.kind).tobytes(), [0, *at.tolist()]
            out += [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def _runs_of(self, ends: np.ndarray, data: np.ndarray) -> list[bytes]:
        """The ids of the distinct chunks in ``data``; those met first are learned."""
        if len(self.words) > self.WORDS or self.chars > self.CHARS:
            self.forget()
        held, at = data.tobytes(), ends.tolist()
        words = [held[a:b] for a, b in zip(at, at[1:], strict=False)]
        found = list(map(self.words.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            inside = np.r_[0, np.cumsum(letters(data))]
            plain = inside[ends[1:]] - inside[ends[:-1]] + (data[ends[:-1]] == 32) == np.diff(ends)
            plain &= (data[ends[:-1]] != 32) | (np.diff(ends) > 1)
            easy, other = [k for k in new if plain[k]], [k for k in new if not plain[k]]
            learned = self.learn_plain([words[k] for k in easy])
            if other:
                learned += self.learn([words[k].decode() for k in other])
            for k, ids in zip(easy + other, learned, strict=True):
                found[k] = self.words[words[k]] = ids
                self.chars += len(words[k])
        return found

    def together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one text after another, and each one's number of ids."""
        ends, data = utf8(texts)
        n = len(data)
        starts = ends[:-1]
        cut = cuts(data, starts[starts < ends[1:]])
        chunk_ends = np.concatenate([cut, [n]]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(chunk_ends), pa.py_buffer(data)]).dictionary_encode()
        codes, found = words.indices.to_numpy(), self._runs_of(*utf8(words.dictionary))
        size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        runs, begin = np.frombuffer(b"".join(found), self.kind), np.cumsum(size) - size
        own = size[codes]
        end = np.concatenate([[0], np.cumsum(own)])
        ids = runs[np.repeat(begin[codes] - end[:-1], own) + np.arange(end[-1])]
        return ids, np.diff(end[np.searchsorted(cut, ends)])

    def arrays(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``together`` for successive texts of about BATCH bytes, without nulls; a longer one is alone."""
        ends, data = utf8(texts)
        odd = {int(k) for s in self.specials for k in _texts_with(s, data, ends)} if self.chunked else range(len(texts))
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + self.BATCH, "right")) - 1)
            inside = [k for k in range(start, stop) if k in odd]
            if inside and stop > start + 1:
                stop = max(start + 1, inside[0])
            if start in odd:
                stop = start + 1
                ids = self.whole(texts[start].as_py()).astype(self.kind)
                yield ids, np.array([len(ids)])
            elif ends[stop] - ends[start] > self.BATCH:
                ids = np.concatenate([self.together(pa.array([p]))[0] for p in pieces(texts[start].as_py())])
                yield ids, np.array([len(ids)])
            else:
                yield self.together(texts[start:stop])
            start = stop

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; the new words of successive texts are learned together."""
        for group in groups(texts):
            for ids, counts in self.arrays(pa.array(group, pa.string())):
                yield from (x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1]))

    def ids(self, text: str) -> bytes:
        """The ids of one text of any length."""
        return b"".join(self.many([text]))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text ends (from 0 on), and the texts' bytes one after another."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], data


def _texts_with(string: bytes, data: np.ndarray, ends: np.ndarray) -> set[int]:
    """Numbers of the texts in which ``string`` begins."""
    held, found = data.tobytes(), set()
    at = held.find(string)
    while at >= 0:
        k = int(np.searchsorted(ends, at, "right")) - 1
        found.add(k)
        at = held.find(string, int(ends[k + 1]))  # one in a text is enough
    return found


_kept: dict[tuple, ByteLevelIds] = {}


def encoder_of(definition: str, specials_as_text: bool, kind: str = "<u4") -> ByteLevelIds:
    """One encoder per Python worker: its memo serves all tasks that the worker runs."""
    key = (definition, specials_as_text, kind)
    if key not in _kept:
        _kept.clear()
        _kept[key] = ByteLevelIds(*key)
    return _kept[key]
