"""Vector codes, token alignment and token files against brute force and the libraries."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alertlens.llm import byte_level, token_alignment, token_files, vector_codes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "b", " ", "  ", "\n", " \n", "\t", "'s", "'", "don't", "Été", "é", "1", "23", "!?", ".", ". ", ".\n", "<|endoftext|>", "日本",
        "\x1c", "\x85", "\xa0", "word", "The", " the", "\U0001f600", "́", "\r\n", "_", "ß", "…", "“q”", "İ", "<s>", "<0x0A>", "\x00",
        "\x01", "▁", "​", "᠎", "", ", ", ")", "x" * 300]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(n)]


# -- vector codes -----------------------------------------------------------------------------

def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error) by Python integers; the codebooks' digest."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=key)
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    cuts = [d * k // parts for k in range(parts + 1)]
    cut = [[[math.floor(Fraction(x) * 1024) for x in r[1]][a:b] for a, b in zip(cuts, cuts[1:])] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda x, y: sum((i - j) ** 2 for i, j in zip(x, y))
    nearest = lambda c: [min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        found = [nearest(c) for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    found = [nearest(c) for c in cut]
    error, total = [sum(x for x, _ in f) for f in found], Counter()
    for r, e in zip(kept, error):
        total[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    cap = lambda x: x if x < 1 << 63 else None
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), cap(e), cap(total[r[2]])) for r, f, e in zip(kept, found, error)), key=str), digest


def vectors(sp, rows):
    return sp.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, code int, _label string")


@pytest.mark.parametrize("scale,d", [(1.0, 8), (3e3, 8), (5e4, 8), (1e12, 8), (1e25, 6), (1.0, 3)])
def test_codes_equal_plain_integers(sp, scale, d):
    rng = np.random.default_rng(int(math.log10(scale)) + d)
    rows = [(i, (rng.normal(size=d) * scale).tolist(), [0, 1, None][i % 3]) for i in range(60)]
    rows += [(5, rows[5][1], 0), (5, rows[6][1], 1), (None, rows[7][1], 2), (70, [0.0] * d, 0), (71, [0.0] * d, 0),
             (80, None, 0), (81, [None] + [1.0] * (d - 1), 0), (82, [math.nan] * d, 0), (83, [math.inf] + [0.0] * (d - 1), 0),
             (84, [1.0] * (d + 1), 0)]
    got, books = vector_codes.compress(sp, vectors(sp, rows), entries=16)
    got = vector_codes.label_sums(got)
    want, digest = plain_codes(rows, entries=16)
    assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error").collect()), key=str) == want
    assert vector_codes.books_digest(books) == digest


def test_limbs_stay_exact():
    rng = np.random.default_rng(1)
    for bits, d in ((20, 16), (30, 16), (30, 1000), (31, 1)):
        v, c = (rng.integers(-(1 << bits), 1 << bits, (9, d)) for _ in range(2))
        assert d * 4 ** vector_codes.limb_bits(d) <= 1 << 53
        want = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in c] for a in v]
        wrapped = [[(x + (1 << 63)) % (1 << 64) - (1 << 63) for x in r] for r in want]
        assert vector_codes.dots(v, c).tolist() == wrapped
        back = sum(int(x) << (5 * k) for k, x in enumerate(np.array(vector_codes.limbs(v, 5))[:, 0, 0]))
        assert back == v[0, 0]


def test_codes_of_few_rows_and_many_labels(sp):
    assert vector_codes.digests(sp, vectors(sp, [(1, None, 0)])).count() == 0
    one = vector_codes.digests(sp, vectors(sp, [(1, [0.5, 0.25, 1.0, 2.0], None)])).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(1, "00000000", 0, 0)]
    rows = sp.range(300).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 7).cast("int")).alias("label"),
                                F.lit("00").alias("code"), F.col("id").alias("error"))
    few, many = (sorted(map(str, vector_codes.label_sums(rows, n).collect())) for n in (100, 0))
    assert few == many and len(few) == 300


# -- chunks and ids ------------------------------------------------------------------------------

@pytest.mark.parametrize("plain", [True, False])
def test_ids_equal_the_library(plain):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = plain
    texts = odd_texts(6000) + ["word " * 3000 + "x" * 5000, "".join(odd_texts(400, 7)), " " * 3000]
    encoder = byte_level.ByteLevelIds(open(A, encoding="utf-8").read(), plain)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.many(texts)] == want
    assert [np.frombuffer(encoder.ids(x), "<u4").tolist() for x in texts[-60:]] == want[-60:]


def test_runs_of_signs_are_cut_as_the_library_does():
    texts = ["Really?! yes", "a,. b", "w:, v", "price$$$ x", "dogs' it's", "é?!\nß.", "x×. y", "日. ж,", "a.", ".b", "", "?!"]
    encoder = byte_level.ByteLevelIds(open(A, encoding="utf-8").read(), False)
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.many(texts)] == want


def test_each_distinct_word_of_a_batch_is_looked_up_once(monkeypatch):
    encoder = byte_level.ByteLevelIds(open(A, encoding="utf-8").read(), False)
    seen, runs_of = [], encoder._runs_of
    monkeypatch.setattr(encoder, "_runs_of", lambda ends, data: seen.append(len(ends) - 1) or runs_of(ends, data))
    texts = pa.array(["same words over and over" + " same words over and over." * 50] * 20)
    (ids, counts), = encoder.arrays(texts)
    assert seen == [6]  # "same" with and without a blank, three more words, the dot
    assert ids.tolist() == [i for t in texts.to_pylist() for i in encoder.whole(t)] and counts.sum() == len(ids)


def test_pieces_of_a_long_text_change_no_id():
    text = " ".join(odd_texts(3000, 11))
    encoder = byte_level.ByteLevelIds(open(A, encoding="utf-8").read(), True)
    whole = np.frombuffer(encoder.ids(text), "<u4")
    assert len(list(byte_level.pieces(text, 500))) > 10 and "".join(byte_level.pieces(text, 500)) == text
    parts = [np.frombuffer(encoder.ids(p), "<u4") for p in byte_level.pieces(text, 500)]
    assert (np.concatenate(parts) == whole).all()


def test_a_forgetful_memo_changes_no_id(monkeypatch):
    texts, definition = odd_texts(800, 5), open(A, encoding="utf-8").read()
    want = list(byte_level.ByteLevelIds(definition, False).many(texts))
    monkeypatch.setattr(byte_level.ByteLevelIds, "WORDS", 3)
    monkeypatch.setattr(byte_level, "groups", lambda texts, size=0: ([t] for t in texts))
    assert list(byte_level.ByteLevelIds(definition, False).many(texts)) == want


# -- alignment -------------------------------------------------------------------------------------

def plain_alignment(texts):
    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    byte, docs = byte_level.byte_of_char(), []
    for x in texts:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        a_bytes = [bytes(byte[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not x or b"".join(a_bytes) != (" " + x).encode() or b"".join(b_bytes) != (" " + x).encode():
            docs.append(None)
            continue
        a_end, b_end = (np.cumsum([len(y) for y in z]).tolist() for z in (a_bytes, b_bytes))
        groups, links, p, q = [], [], 0, 0
        for c in sorted(set(a_end) & set(b_end)):
            i, j = a_end.index(c), b_end.index(c)
            groups.append((a[p : i + 1], b[q : j + 1]))
            links.append((a[i], b[j]))
            p, q = i + 1, j + 1
        docs.append((a, b, groups, links))
    n = Counter(x for d in docs if d for x in d[3])
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    text = lambda g: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
    rows = [(len(d[0]), len(d[1]), len(d[2]), len(d[3]), sum(n[x] == most[x[1]] for x in d[3]), sum(n[x] for x in d[3]),
             hashlib.sha256(text(d[2]).encode()).hexdigest()) if d else (0,) * 6 + ("",) for d in docs]
    return rows, [d[2] if d else [] for d in docs]


@pytest.mark.parametrize("most", [10**6, 0])
def test_alignment_equals_brute_force(sp, most):
    texts = [None, *odd_texts(500, 9), " ".join(odd_texts(300, 13)), "word " * 4000, "same text", "same text"]
    docs = sp.createDataFrame([(None if k == 7 else k % 400, t, "x", 1) for k, t in enumerate(texts)],
                              "doc_id bigint, text string, links string, row int")
    got = token_alignment.digests(sp, docs, A, B, most)
    want, _ = plain_alignment(texts)
    ids = [None if k == 7 else k % 400 for k in range(len(texts))]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((i, *w) for i, w in zip(ids, want)), key=str)


def test_spans_hold_the_groups(sp):
    texts = ["Hello wörld, again", "", "a \n b", "日本 語"]
    docs = sp.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = token_alignment.spans(token_alignment.align_documents(sp, docs, A, B)).orderBy("doc_id").collect()
    assert [[(s.a, s.b) for s in r.spans] for r in got] == plain_alignment(texts)[1]


def test_gallop_finds_all_common_members():
    rng = random.Random(4)
    for _ in range(500):
        a, b = (sorted(rng.sample(range(200), rng.randint(0, 150))) for _ in range(2))
        want = [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]
        assert token_alignment.common_ends(a, b) == want


def test_alignment_of_no_rows(sp, no_docs, odd_docs):
    assert token_alignment.digests(sp, no_docs, A, B).count() == 0
    assert token_alignment.digests(sp, odd_docs, A, B, 0).count() == odd_docs.count()


# -- token files ---------------------------------------------------------------------------------

def best_lengths_cost(counts, limit):
    """Least total bits of a prefix code of at most ``limit`` bits, by trying all shapes."""
    counts = sorted(c for c in counts if c)

    def go(k, room, longest):
        if k == len(counts):
            return 0 if room >= 0 else math.inf
        return min((counts[k] * b + go(k + 1, room - Fraction(1, 2**b), b) for b in range(1, longest + 1)
                    if room >= Fraction(1, 2**b)), default=math.inf)

    return go(0, Fraction(1), limit)


def test_code_lengths_are_best_and_limited():
    rng = random.Random(2)
    for _ in range(25):
        counts = np.array([rng.choice([0, 1, 1, 2, 5, 40, 300]) for _ in range(rng.randint(2, 7))])
        for limit in (3, 4, 7):
            bits = token_files.code_lengths(counts, limit)
            used = counts > 0
            if used.sum() < 2:
                assert bits[used].tolist() == [1] * used.sum()
                continue
            assert (2.0 ** -bits[used]).sum() <= 1 and bits.max() <= limit and (bits[~used] == 0).all()
            assert (bits * counts).sum() == best_lengths_cost(counts.tolist(), limit)


@pytest.mark.parametrize("symbols", [1, 2, 3, 900, 40_000])
def test_codes_round_trip_from_any_checkpoint(symbols):
    rng = np.random.default_rng(symbols)
    ids = np.minimum(rng.zipf(1.2, 300_000) - 1, symbols - 1)
    code = token_files.Code(token_files.code_lengths(np.bincount(ids)))
    again = token_files.Code(code.bits)
    counts = np.array([0, 1, 256, 257, 1000, 0, 5])
    counts = np.append(counts, len(ids) - counts.sum())
    runs = code.encode(ids, counts)
    payload, marks, size = b"", [], 0
    for data, own in runs:
        marks.append(own + 8 * len(payload))
        payload += data
    marks, lanes = np.concatenate(marks), token_files.lane_counts(counts)
    assert len(marks) == len(lanes) and (again.decode(payload, marks, lanes) == ids).all()
    k = len(marks) // 2
    assert (again.decode(payload, marks[k:k + 1], lanes[k:k + 1]) == ids[lanes[:k].sum():][: lanes[k]]).all()
    data, own = code.encode_document(ids)
    assert (again.decode(data, own, token_files.lane_counts(np.array([len(ids)]))) == ids).all()
    canonical = sorted((int(code.bits[i]), i, int(code.codes[i])) for i in range(len(code.bits)) if code.bits[i])
    at = 0
    for bits, _, value in canonical:  # codes count up, from length to length
        assert value << (code.limit - bits) == at
        at += 1 << (code.limit - bits)


def library_rows(rows):
    t = Tokenizer.from_file(A)
    out, start = [], 0
    done = [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")) for i, x in rows]
    for i, ids in sorted(done, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(r[1].tobytes()))):
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out, done


def test_token_files_equal_the_library(sp, odd_docs, no_docs, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(None, "null id"), (None, "null id"), (4, "clash"), (-3, "before"), *[(100 + k, t) for k, t in enumerate(odd_texts(300, 21))]]
    docs = sp.createDataFrame([(*r, 7, "x") for r in rows], "doc_id bigint, text string, n int, payload string")
    want, done = library_rows(rows)
    assert sorted(map(tuple, token_files.digests(sp, docs, A).collect()), key=lambda r: r[1]) == want
    path = str(tmp_path / "tokens")
    token_files.write_tokens(sp, docs, A, path)
    got = {(r.start, bytes(r.ids)) for r in token_files.read_tokens(sp, path).collect()}
    assert sorted(x for _, x in got) == sorted({s: x for (s, x) in got}.values()) and len(got) == len(rows)
    stream = np.frombuffer(b"".join(x for _, x in sorted(got)), "<u4")
    for start, stop in ((0, 1), (5, 900), (len(stream) - 300, len(stream) + 50), (len(stream) + 1, len(stream) + 2), (700, 700)):
        parts = sorted((r.start, r.ids) for r in token_files.read_range(sp, path, start, stop).collect())
        assert [x for _, p in parts for x in p] == stream[start:stop].tolist()
    assert token_files.digests(sp, no_docs, A).count() == 0


def test_blocks_are_independent_and_ordered(sp, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 500)
    docs = sp.createDataFrame([(k % 7, t) for k, t in enumerate(odd_texts(400, 23))], "doc_id bigint, text string")
    tokens = token_files.tokenised(docs, open(A, encoding="utf-8").read())
    kind = token_files._kind(open(A, encoding="utf-8").read())
    counts = {r["id"]: r["n"] for r in token_files.id_counts(tokens, kind).collect()}
    code = token_files.Code(token_files.code_lengths(np.array([counts.get(i, 0) for i in range(max(counts) + 1)])))
    own = docs.repartition(3).sortWithinPartitions("doc_id")
    blocks = token_files.blocks(token_files.coded(token_files.tokenised(own, open(A, encoding="utf-8").read()), kind, code)).collect()
    assert sum(b.n for b in blocks) == sum(counts.values())
    by_place = sorted(blocks, key=lambda b: (b.file, b.block))
    ids = [i for b in by_place for i in b.doc_ids]
    assert ids == sorted(ids)
    for b in by_place:
        found = code.decode(bytes(b.payload), np.frombuffer(b.marks, "<u8"), token_files.lane_counts(np.array(b.counts)))
        at = np.cumsum([0, *b.counts])
        assert [zlib.crc32(found[p:q].astype("<u4").tobytes()) for p, q in zip(at, at[1:])] == b.crcs


def test_a_damaged_block_fails_the_read(sp, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(sp, sp.createDataFrame([(1, "some words here")], "doc_id bigint, text string"), A, path)
    rows = sp.read.parquet(f"{path}/blocks").withColumn("payload", F.expr("cast(repeat('x', length(payload)) AS binary)")).collect()
    sp.createDataFrame(rows, token_files.BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    with pytest.raises(Exception, match="damaged"):
        token_files.read_tokens(sp, path).collect()
