"""Byte-level BPE, packing, language, chat format, licences and quality rules."""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alertlens.llm import byte_bpe, chat_format, language_id, license_scan, packing, quality_rules

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- byte-level BPE --------------------------------------------------------------------

def test_bpe_equals_tiktoken(sp, odd_docs):
    ranks = byte_bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.digests(sp, odd_docs, RANKS, public_tokenizers.PATTERN))
    want = []
    for r in odd_docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_bpe_plans_hold_no_rank_map(sp, odd_docs):
    """The driver keeps each plan's text; the rank map in it took most of its memory."""
    out = byte_bpe.digests(sp, odd_docs, RANKS, public_tokenizers.PATTERN)
    assert len(out._jdf.queryExecution().toString()) < 100_000


def test_common_matches_are_cut_up_again():
    table = pa.table({"match": ["é", " a", "\U0001f600"], "ids": [[1, 2], [3], [70_000, 5, 6]]})
    common = pickle.loads(pickle.dumps(byte_bpe.Common(table)))
    assert common.matches() == ["é", " a", "\U0001f600"]
    assert [np.frombuffer(x, "<u4").tolist() for x in common.ids()] == [[1, 2], [3], [70_000, 5, 6]]
    none = byte_bpe.Common(table.slice(0, 0))
    assert none.matches() == [] and none.ids() == []


def test_bpe_no_rows(sp, no_docs):
    assert byte_bpe.digests(sp, no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


def test_long_match_merges_like_tiktoken():
    ranks = byte_bpe.read_ranks(RANKS)
    pairs = byte_bpe.merge_pairs(ranks)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(0)
    for _ in range(20):
        word = "".join(rng.choice(list("aabbtheing"), 300))
        assert byte_bpe.merge_long([ranks[bytes([b])] for b in word.encode()], pairs) == enc.encode_ordinary(word)


def test_finder_equals_pattern():
    import regex

    texts = ["It's 12\xb2 a_b  \x85\xa0x\n\n y \xaa\xb5 \xff\xd7", "ł 中's  x"]
    for t in texts:
        assert byte_bpe.finder(public_tokenizers.PATTERN)(t) == regex.findall(public_tokenizers.PATTERN, t)


ODD_CUTS = ["it's the dogs' 's  a1b2, (x)y -- end. ", "\n\nline\n two\n", "", "tab\t\x1cfs \x85nel\xa0nbsp \u3000wide  ",
            "\u65e5\u672c\u8a9e\u3002 \u0301x e\u0301a, \U0001f600!", "\xc9t\xe9, stra\xdfe\xd7 \u0433\u043e\u0434. a.'s ...", " ", "x" * 300 + " y"]


def matches_of(numbers, texts):
    """The texts' matches, read back from their numbers."""
    runs = numbers.runs(pa.array(texts))
    return [[numbers.fresh[k].decode() for run in own for k in np.frombuffer(run, "<u4")] for own in runs]


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"\s?\S+[\r\n]*|\s+"])
def test_numbered_matches_equal_pattern(pattern):
    import regex

    numbers = byte_bpe._Numbers(pattern, [])
    assert numbers.chunked == (pattern == public_tokenizers.PATTERN)
    rng = np.random.default_rng(0)
    signs = [*"ab1, .'s-\n\t", "  ", "\u00e9", "\u0301", "\u4e2d", "\xa0", "\x1c", "'ll", "\u200b"]
    texts = ODD_CUTS + ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(3000)]
    assert matches_of(numbers, texts) == [regex.findall(pattern, t) for t in texts]
    assert len(numbers.fresh) == len(set(numbers.fresh)) == numbers.count


def test_words_of_many_texts_are_cut_into_matches_once():
    """Each occurrence went through the pattern before."""
    numbers, cut = byte_bpe._Numbers(public_tokenizers.PATTERN, [b" known"]), []
    find = numbers.find
    numbers.find = lambda text: cut.append(text) or find(text)
    for _ in range(2):
        numbers.runs(pa.array(["it's known, known it's not"] * 500 + [""]))
    assert sorted(cut) == [" it's", " not", ",", "it's"]
    assert numbers.fresh == [b"it", b"'s", b",", b" it", b" not"] and numbers.count == 6


def test_numbers_of_long_texts_and_many_groups(monkeypatch):
    import regex

    monkeypatch.setattr(byte_bpe, "TOGETHER", 64)
    numbers = byte_bpe._Numbers(public_tokenizers.PATTERN, [])
    long = "ab c, " * 400_000
    texts = pa.array([*ODD_CUTS, long])
    runs = [run for a, b in byte_bpe._groups(texts) for run in numbers.runs(texts[a:b])]
    assert [len(own) for own in runs] == [1] * len(ODD_CUTS) + [3]
    known = byte_bpe._Known(b"", np.zeros(1, np.int64))
    sizes = np.array([len(m) for m in numbers.fresh], np.int64)
    for a in (0, 5):  # bytes stand for ids, in two parts
        part = slice(a, 5 if a == 0 else None)
        known.add(np.frombuffer(b"".join(numbers.fresh[part]), np.uint8).astype("<u4"), sizes[part])
    got = list(known.runs(pa.array([run for own in runs for run in own], pa.binary())))
    decoded = [np.frombuffer(x, "<u4").astype(np.uint8).tobytes().decode() for x in got]
    assert decoded == [*ODD_CUTS, *byte_bpe._slices(long)]
    assert [numbers.fresh[k].decode() for run in runs[-1] for k in np.frombuffer(run, "<u4")] == regex.findall(public_tokenizers.PATTERN, long)


# -- packing ---------------------------------------------------------------------------

def test_pieces_equal_tokenizer_and_packing_is_gapless(sp, odd_docs):
    tok = Tokenizer.from_file(WORDS)  # as it is: added tokens' strings are added tokens
    docs = odd_docs.select("doc_id", "text").unionByName(sp.createDataFrame(
        [(90, "a <|endoftext|> b"), (91, "<|startoftext|>x<|ENDOFTEXT|> <|endoftext|"), (92, "a b " * 900 + "<|endoftext|>")],
        "doc_id bigint, text string"))
    rows = packing.pack_documents(sp, docs, WORDS).collect()
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4").tobytes()
            want.append((r.doc_id, k, s, len(part) // 4, zlib.crc32(part)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048


@pytest.mark.parametrize("memo", [400_000, 5])
def test_words_learned_together_equal_the_tokenizer(monkeypatch, memo):
    for name, value in (("WORDS", memo), ("MATCHES", memo), ("TOGETHER", 40)):
        monkeypatch.setattr(packing.WordTokenizer, name, value)
    with open(WORDS, encoding="utf-8") as f:
        own = packing.WordTokenizer(f.read())
    texts = ["\u0130stanbul \u0130.", "", "  ", "a\x1cb c", "don't can't's I'LL", "\xc9t\xe9. x. . ,", "\u4e2d\u6587 word.", "1234.5 a1 1.",
             "\xaa\xba \ufb01n", "the end. the end."] * 3
    assert list(own.many(texts)) == [own._encode(t).tobytes() for t in texts]


def test_packing_no_rows(sp, no_docs):
    assert packing.pack_documents(sp, no_docs, WORDS).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = Counter(rng.integers(1, 65, 500).tolist()) + Counter({64: 40, 32: 999})
    patterns = packing.plan(dict(lengths), 64)
    used = Counter()
    for own, times in patterns:
        assert sum(own) <= 64
        for x in own:
            used[x] += times
    assert used == lengths
    bound = -(-sum(k * n for k, n in lengths.items()) // 64)
    assert sum(t for _, t in patterns) <= bound * 1.02 + 1


# -- language --------------------------------------------------------------------------

def test_language_learned_and_odd_texts(sp, odd_docs):
    rows = [(i, t, lang) for i in range(20) for t, lang in (("the house and the garden", "en"), ("das haus und der garten", "de"))]
    docs = sp.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify(sp, docs.unionByName(odd_docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))),
                               F.lit(True)).collect()
    assert len(got) == 40 + odd_docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert Counter(r.lang_pred for r in got)["und"] == 3
    assert [r.lang_pred for r in got[:40]] == [lang for _, _, lang in rows]


def test_language_nothing_learned(sp, odd_docs, no_docs):
    got = language_id.identify(sp, odd_docs, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert language_id.identify(sp, no_docs, F.lit(True)).collect() == []


def test_language_counts_equal_brute_force():
    texts = ["Ab c", None, "", "été! x" * 3]
    counts = language_id.count_grams(texts, ["a", "a", "a", "a"])["a"]
    want = np.zeros(language_id.BUCKETS, np.int64)
    for t in texts:
        if not t:
            continue
        s = [32, 32] + [ord(c) if c.isalpha() else 32 for c in t.lower()] + [32, 32]
        for i in range(len(s) - 2):
            tri = np.array(s[i : i + 3], np.uint32)
            if (tri != 32).any():
                for g in language_id.buckets_of(tri):
                    want[g[0]] += 1
    assert (counts == want).all()


# -- chat format -----------------------------------------------------------------------

CHAT = "conv_id bigint, turn bigint, role string, text string, formatted string"


def test_chat_round_trip(sp):
    nasty = ["</s>", "[INST]", "[\\INST]", "[\\\\/INST]x", "<\\/s>", "[/INST]</s>[INST]", "plain", "", None, "a[b<c\\"]
    rows = [(i // 4, i % 4, ["user", "assistant", "system", None][i % 4], t, "x") for i, t in enumerate(nasty)]
    rows += [(9, None, "assistant", "n", "x"), (9, 1, "assistant", "t", "x"), (9, 1, "assistant", "t", "x"), (None, 0, "user", "q", "x")]
    out = {r.conv_id: r for r in chat_format.format_conversations(sp.createDataFrame(rows, CHAT)).collect()}
    for conv, r in out.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        said = [x[3] or "" for x in own if x[2] == "assistant"]
        assert len(r.spans) == len(said)
    plain = chat_format.format_conversations(sp.createDataFrame([(1, 0, "user", "hi", "x")], CHAT)).first()
    assert plain.formatted == "[INST]user[/INST]hi</s>"


def test_chat_no_rows(sp):
    assert chat_format.format_conversations(sp.createDataFrame([], CHAT)).collect() == []
    assert chat_format.digests(chat_format.format_conversations(chat_format.with_probe(sp, sp.createDataFrame([], CHAT)))).count() == 1


def test_many_languages_are_scored_in_blocks(sp, monkeypatch):
    rng = np.random.default_rng(5)
    names = [f"l{i:02d}" for i in range(11)] + ["Z", "é", "und"]
    letters = {k: "".join(chr(0x61 + c) for c in rng.permutation(26)[:7]) for k in names}
    word = lambda k: "".join(rng.choice(list(letters[k]), 5))
    rows = [(i, " ".join(word(names[i % 14]) for _ in range(6)), names[i % 14]) for i in range(140)]
    rows += [(200, None, "l01"), (201, "", "l02"), (202, "12 !?", None), (203, rows[0][1], None), (204, "x" * 3000, "l03")]
    docs = sp.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole = sorted(language_id.identify(sp, docs, F.lit(True)).collect())
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 4)
    blocks = sorted(language_id.identify(sp, docs, F.lit(True)).collect())
    assert [r[:3] for r in blocks] == [r[:3] for r in whole]
    np.testing.assert_allclose([r.score for r in blocks], [r.score for r in whole], rtol=1e-9)
    assert {r.lang_pred for r in blocks if r.doc_id in (200, 201, 202)} == {"und"}

    # a text's score worked out by hand, from the counts of all training texts
    counts = {k: language_id.count_grams([t for _, t, g in rows if g == k], [k] * sum(g == k for *_, g in rows))[k] for k in names}
    n_docs = {k: sum(g == k for *_, g in rows) for k in names}
    own = language_id.count_grams([rows[17][1]], ["x"])["x"]
    total = sum(n + 1 for n in n_docs.values())
    logs = {k: math.log((n_docs[k] + 1) / total) + sum(
        own[b] * math.log((counts[k][b] + 0.5) / (counts[k].sum() + 0.5 * language_id.BUCKETS)) for b in np.flatnonzero(own))
        for k in names}
    top = max(logs.values())
    got = next(r for r in blocks if r.doc_id == 17)
    assert logs[got.lang_pred] == top
    assert abs(got.score - 1 / sum(math.exp(v - top) for v in logs.values())) < 1e-3


# -- licences --------------------------------------------------------------------------

def test_every_known_sentence_has_an_anchor():
    ids, _ = license_scan.sentence_rules()
    assert all(any(a in s for a in license_scan.ANCHORS) for s in ids)


def test_licences(sp, odd_docs, no_docs):
    wrapped = license_scan.NOTICES[0][1].replace(" software", "\nsoftware").replace("\nUnless", "\n\nUnless")
    texts = [wrapped, "x y\nReleased under the MIT License.\nz", "Licensed under CC BY-NC 4.0.", "a license to all"]
    got = license_scan.scan_licenses(sp.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert [r.licences for r in sorted(got)] == ["Apache-2.0", "MIT", "CC-BY-NC-4.0", ""]
    assert {r.licences for r in license_scan.scan_licenses(odd_docs).collect()} == {""}
    assert license_scan.scan_licenses(no_docs).collect() == []


# -- quality rules ---------------------------------------------------------------------

def brute_repeats(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(hit)


def test_repeated_words_equal_brute_force():
    rng = np.random.default_rng(1)
    for size in (0, 1, 8, 9, 40, 200):
        for kinds in (1, 2, 3, 50):
            words = rng.integers(0, kinds, size)
            assert quality_rules.repeated_words(words) == brute_repeats(words.tolist()), (size, kinds)


def test_quality_rules_odd_texts(sp, odd_docs, no_docs):
    got = quality_rules.quality_rules(sp, odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in got)  # short, null or one word again and again
    assert quality_rules.quality_rules(sp, no_docs).collect() == []
    assert quality_rules.keep_good(sp, odd_docs).columns == odd_docs.columns
    assert quality_rules.keep_good(sp, odd_docs).collect() == []


@pytest.mark.parametrize("broadcast", [50_000, -1])
def test_bad_host_takes_its_documents(sp, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", broadcast)
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 20 == 0 else "bad", None) for i in range(400)] + [(1000 + i, good, "fine") for i in range(400)]
    docs = sp.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = quality_rules.quality_rules(sp, docs).collect()
    assert len(got) == 800
    assert {r.doc_id for r in got if r.kept} == {1000 + i for i in range(400)}
    assert {r.doc_id for r in quality_rules.keep_good(sp, docs).collect()} == {1000 + i for i in range(400)}
