"""Nearest neighbours, Jaccard join, classifiers and the pipeline."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from alertlens.llm import ann_mih, common, jaccard_join, quality_knn, queries, toxicity_cnn

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id bigint, embedding array<float>, score double"


# -- nearest neighbours ----------------------------------------------------------------

def brute_neighbours(rows, query, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x[query], 12)
    order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[query])
    return [i for _, i in order[:k]]


def test_ann_recall_ties_and_hot_vector(sp):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]  # a third of all rows are one vector
    odd = [(90_000, None), (90_050, []), (90_100, [0.0] * 16), (90_150, [float("nan")] * 16), (90_200, [1.0] * 3),
           (90_250, [None] * 16)]
    df = sp.createDataFrame([(i, v, 1.0) for i, v in rows + odd], VECTORS)
    got = {}
    for r in ann_mih.search(sp, df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 1500, 50))
    hit = 0
    for q, found in got.items():
        assert [r for r, _ in sorted(found)] == [1, 2, 3, 4, 5]
        want = brute_neighbours(rows, q, 5)
        hit += len(set(want) & {i for _, i in found})
        if q % 3 == 0:  # ties go to the smaller ids
            assert [i for _, i in sorted(found)] == [i for i in range(0, 100, 3) if i != q][:5]
    assert hit / (5 * len(got)) >= 0.9


def test_ann_few_and_no_rows(sp):
    few = sp.createDataFrame([(0, [1.0, 0.0], 1.0), (7, [0.0, 1.0], 1.0)], VECTORS)
    assert [tuple(r) for r in ann_mih.search(sp, few, F.col("vec_id") == 0).collect()] == [(0, 1, 7, 0.0)]
    assert ann_mih.search(sp, few.limit(0), F.lit(True)).collect() == []
    assert ann_mih.search(sp, few, F.lit(False)).collect() == []


def test_probing_meets_few_codes_where_vectors_have_near_neighbours():
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(300, 32))
    x = centres[draw.integers(0, 300, 6000)] + 0.15 * draw.normal(size=(6000, 32))
    coder = ann_mih.learn(x[:3000], 5)
    shard = ann_mih.Shard(coder, x)
    met = hit = 0
    for q in range(0, 6000, 200):
        code = shard.codes[q]
        met += len(shard.probe(code, coder.radius))
        near = np.argsort(-(x @ x[q]) / (shard.norms * shard.norms[q]), kind="stable")[:6]
        hit += len(set(near.tolist()) & set(shard.nearest(x[q], code, 6)[0].tolist()))
    assert met < 0.1 * 30 * len(x)
    assert hit >= 0.9 * 30 * 6


def test_shard_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    coder = ann_mih.learn(x, 5)
    shard = ann_mih.Shard(coder, x)
    far = np.bitwise_count(shard.codes[:, None, :] ^ shard.codes[None, :, :]).sum(2)
    for q in range(0, 400, 37):
        for radius in (0, 3, 9, coder.radius):
            assert shard.within(shard.codes[q], radius).tolist() == np.flatnonzero(far[q] <= radius).tolist()


# -- Jaccard join ----------------------------------------------------------------------

def sets_of(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_groups(rows):
    s = [(d, sets_of(t)) for d, t in rows]
    link = [[j for j in range(len(s)) if j != i and s[i][1] and len(s[i][1] & s[j][1]) * 10 >= 8 * len(s[i][1] | s[j][1])]
            for i in range(len(s))]
    group = list(range(len(s)))
    for _ in s:
        group = [min([group[i]] + [group[j] for j in link[i]]) for i in range(len(s))]
    name = {}
    for i, g in enumerate(group):
        name[g] = min(name.get(g, 10**9), s[i][0])
    return sorted((s[i][0], name[group[i]], len(link[i])) for i in range(len(s)))


def near_copies(seed=0):
    rng = np.random.default_rng(seed)
    rows, d = [], 0
    for base in range(6):
        words = [f"w{base}x{k}" for k in range(120)]
        for _ in range(25):
            own = list(words)
            for k in rng.integers(0, 120, rng.integers(0, 5)):
                own[k] = f"n{rng.integers(1e9)}"
            rows.append((d, " ".join(own)))
            d += 1
    return rows + [(d + i, "one copy of a text") for i in range(40)] + [(d + 50, "a b"), (d + 51, "A  B")]


@pytest.mark.parametrize("block", [256, 4])
def test_join_equals_brute_force(sp, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies()
    docs = sp.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_links int")
    got = sorted(tuple(r) for r in jaccard_join.join_documents(sp, docs).collect())
    assert got == brute_groups(rows)


@pytest.mark.parametrize("hot", [1, 10**9])
def test_join_with_keys_apart_equals_brute_force(sp, monkeypatch, hot):
    # 1: no key is hot; 10**9: every key is, and each is broadcast
    monkeypatch.setattr(common, "HOT", hot)
    rows = near_copies(5)[::2]
    docs = sp.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in jaccard_join.join_documents(sp, docs).collect()) == brute_groups(rows)


@pytest.mark.parametrize("keys", [-1, 10**6])
def test_components_of_a_star_and_a_chain(sp, monkeypatch, keys):
    monkeypatch.setattr(jaccard_join, "BROADCAST_KEYS", keys)
    star = [(5000 + k, 7) for k in range(400)] + [(9000, 5000 + k) for k in range(0, 400, 3)]
    chain = [(k + 1, k) for k in range(100, 160)]
    got = jaccard_join.components(sp, sp.createDataFrame(star + chain, "cls bigint, root bigint")).collect()
    want = {a: 7 for e in star for a in e} | {a: 100 for e in chain for a in e}
    assert {(r.cls, r.root) for r in got} == {(c, r) for c, r in want.items() if c != r}


def candidates_of(g):
    """Rows and bytes of what pruning hands on from a group of ``g`` near copies in one block."""
    sig = np.tile(np.arange(jaccard_join.HASHES, dtype="<u2"), (g, 1))
    sig[:, -1] = np.arange(g)
    run = pa.RecordBatch.from_pydict({
        "band": pa.array([0] * g, pa.int32()), "bucket": pa.array([9] * g), "i": pa.array([0] * g, pa.int32()),
        "j": pa.array([0] * g, pa.int32()), "cls": pa.array(range(g), pa.int64()), "block": pa.array([0] * g, pa.int32()),
        "sig": [s.tobytes() for s in sig]})
    out = list(jaccard_join._prune(iter([run])))
    return sum(b.num_rows for b in out), sum(b.nbytes for b in out)


def test_candidates_grow_with_the_group_not_with_its_square():
    small, large = candidates_of(64), candidates_of(512)
    assert small[0] == 64 and large[0] == 512
    assert large[1] <= 8.1 * small[1]


def test_join_odd_rows(sp, odd_docs, no_docs):
    got = jaccard_join.join_documents(sp, odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id in (0, 1, 2)} == {(0, 0, 0), (1, 1, 0), (2, 2, 0)}
    assert {(r.class_id, r.n_links) for r in got if r.doc_id in (5, 6)} == {(5, 1)}
    kept = jaccard_join.keep_one(sp, odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert jaccard_join.join_documents(sp, no_docs).collect() == []


def brute_kept(rows):
    """(doc_id, text) of the rows that stay: of each group that with the smallest id, nulls
    last; every text without words."""
    s = [sets_of(t) for _, t in rows]
    group = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and len(s[i] & s[j]) * 10 >= 8 * len(s[i] | s[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for i, g in enumerate(group):
        order = (rows[i][0] is None, rows[i][0] or 0)
        if g not in best or order < best[g][0]:
            best[g] = (order, i)
    return sorted((rows[i] for _, i in best.values()), key=str)


def odd_ids():
    """Near copies; null ids with texts of their own, copies among them; one id of several texts."""
    near = near_copies(3)[::3]
    own = [(None, f"only text number {i} of a row without an id") for i in range(30)]
    first = near[0][1]
    return near + own + [
        (None, own[0][1]), (None, own[1][1]), (None, first), (None, None), (None, "  "), (None, ""),
        (7777, "one text under a shared id"), (7777, "another text under the shared id"), (7777, first),
        (7777, "another  TEXT under the shared id"), (7777, None), (7777, None)]


def test_keep_one_equals_brute_force_for_null_and_shared_ids(sp):
    rows = odd_ids()
    docs = sp.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, cls int, mark int")
    kept = jaccard_join.keep_one(sp, docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    as_sets = lambda rows: sorted((str(i), sorted(sets_of(t))) for i, t in rows)  # noqa: E731  (copies may differ in blanks)
    assert as_sets(got) == as_sets(brute_kept(rows))


def test_keep_one_without_broadcasts(sp, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(common, "HOT", 20)
    test_keep_one_equals_brute_force_for_null_and_shared_ids(sp)


def test_least_matches_bound_the_loss():
    rng = np.random.default_rng(4)
    least = jaccard_join.least_matches()
    lost = sum(any(eq[:n].sum() < least[n] for n in least) for eq in rng.random((20_000, jaccard_join.HASHES)) < 0.8)
    assert lost <= 3


# -- classifiers -----------------------------------------------------------------------

def held_out_accuracy(sp, query, label):
    labels = sp.read.parquet(f"{SF}/labels.parquet")
    rows = query(sp, SF).filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_quality_held_out(sp):
    assert held_out_accuracy(sp, queries.op5_quality_knn, "quality") > 0.95


def test_toxicity_held_out(sp):
    assert held_out_accuracy(sp, queries.op7_toxicity_cnn, "toxic") > 0.9


def test_language_held_out(sp):
    docs = sp.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op6_language_id(sp, SF).filter("held_out").join(docs, "doc_id").select("lang_pred", "lang").collect()
    assert sum(r[0] == r[1] for r in rows) / len(rows) > 0.97


def test_votes_equal_brute_force():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(60)]
    voters = quality_knn.fit(texts, rng.integers(0, 2, 60).tolist())
    counts = np.stack([quality_knn.Terms().counts(t) for t in texts[:10]])
    z = voters.latent(counts)
    for row, score in zip(z, voters.scores(counts), strict=True):
        near = voters.vectors @ row
        best = np.argsort(-near, kind="stable")[: quality_knn.NEIGHBOURS]
        votes = np.maximum(near[best], 1e-6).astype(np.float64)
        assert abs(votes @ voters.labels[best] / votes.sum() - score) < 1e-5


@pytest.mark.parametrize("classify", [quality_knn.classify, toxicity_cnn.classify])
def test_classifiers_odd_rows(sp, odd_docs, no_docs, no_labels, classify):
    every = lambda _: F.lit(True)
    some = sp.createDataFrame([(3, 1, 0), (4, 0, 1), (5, 1, 0), (7, 1, 0), (7, 0, 0), (8, 0, 1), (None, 1, 1)],
                              "doc_id bigint, quality int, toxic int")
    for labels in (no_labels, some):
        got = classify(sp, odd_docs, labels, every).collect()
        assert len(got) == odd_docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        if classify is toxicity_cnn.classify:
            assert {r.score for r in got if r.doc_id in (0, 1, 2)} == {0.0}
        assert classify(sp, no_docs, labels, every).collect() == []


def test_toxicity_thresholds_cover_every_labelled_row_and_language(sp):
    # en: 40 toxic rows above 0.6; es: 5 above 0.2; unlabelled and held-out rows do not count
    odds = lambda p: np.log(p / (1 - p))
    rows = [(i, 0.65 if i < 40 else 0.55, "en", int(i < 40)) for i in range(300)]
    rows += [(1000 + i, 0.25 if i < 5 else 0.15, "es", int(i < 5)) for i in range(60)]
    raw = sp.createDataFrame([(i, p, lang) for i, p, lang, _ in rows] + [(5000 + i, 0.9, "es") for i in range(50)],
                             "doc_id bigint, raw double, lang string")
    labels = sp.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id bigint, y int")
    limits = toxicity_cnn.calibrate(raw, labels)
    assert set(limits.own) == {"en", "es"}
    assert 0.55 < limits.own["en"] < 0.65
    own, common = odds(0.2), odds(limits.common)
    want = (5 * own + toxicity_cnn.SHRINK * common) / (5 + toxicity_cnn.SHRINK)
    assert abs(odds(limits.own["es"]) - want) < 0.1


def test_toxicity_calibrates_rare_languages_on_rows_beyond_the_sample(sp, monkeypatch):
    docs, labels = sp.read.parquet(f"{SF}/documents.parquet"), sp.read.parquet(f"{SF}/labels.parquet")
    found = []
    for name in ("calibrate", "fit"):
        monkeypatch.setattr(toxicity_cnn, name, lambda *a, f=getattr(toxicity_cnn, name): (found.append((a, f(*a))), found[-1][1])[1])
    monkeypatch.setattr(toxicity_cnn, "SAMPLE", 200)
    toxicity_cnn.classify(sp, docs, labels, lambda i: F.lit(True)).collect()
    (_, (_, _, taught)), ((_, others), limits) = found
    assert taught.sum() == 150
    assert others.count() == labels.filter("doc_id is not null and toxic is not null").select("doc_id").distinct().count() - 150
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id").select("lang").distinct().collect()
    assert {r.lang for r in toxic if r.lang} <= set(limits.own)


@pytest.mark.parametrize("long_rows", [1, 30])
def test_a_long_labelled_text_does_not_end_the_sample(sp, long_rows):
    first = sorted(range(40), key=lambda i: zlib.crc32(str(i).encode()))
    long = set(first[:long_rows])
    docs = sp.createDataFrame([(i, ("w " * (5000 if i in long else 10)).strip()) for i in range(40)], "doc_id bigint, text string")
    labels = sp.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    rows = quality_knn.labelled_sample(docs, labels, "toxic", F.lit(True), 40, max_chars=6000)
    assert sum(len(t) < 100 for t, _ in rows) == 40 - long_rows
    assert {y for _, y in rows} == {0, 1}
    assert sum(len(t) for t, _ in rows) <= 6000
    assert len(quality_knn.labelled_sample(docs, labels, "toxic", F.lit(True), 40)) == 40


# -- pipeline --------------------------------------------------------------------------

def test_blank_texts_score_as_labelled_blank_texts():
    texts, y = ["Good words here.", "more good words", None, " ", ""], [1, 1, 0, 1, 0]
    none = quality_knn.Terms().counts(None)[None]
    assert quality_knn.fit(texts[:2], y[:2]).scores(none).tolist() == [0.0]
    assert quality_knn.fit(texts, y).scores(none).tolist() == [pytest.approx(1 / 3)]
    assert quality_knn.fit([], []).scores(none).tolist() == [0.5]


def test_whole_words_have_shapes():
    start = "ab" * 40
    assert quality_knn.word_code(start + "!" * 10_000) & 1023 != quality_knn.word_code(start + "9Z" * 5_000) & 1023


def test_of_rows_sharing_an_id_the_least_text_teaches(sp):
    labels = sp.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = [(1, "b text"), (1, "a text"), (2, "c"), (2, None)]
    for own in (rows, rows[::-1]):
        docs = sp.createDataFrame(own, "doc_id bigint, text string").repartition(3)
        got = quality_knn.labelled_sample(docs, labels, "quality", F.lit(True), 10)
        assert sorted(got, key=str) == [("a text", 0), (None, 1)]


def test_pipeline_stages(sp, odd_docs, no_docs):
    docs = sp.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for case in (odd_docs, no_docs):
            assert stage(sp, case, SF).columns == case.columns, name
        kept = stage(sp, docs, SF)
        assert kept.columns == docs.columns
        assert kept.count() > 0.8 * n, name
    packed = corpus_pipeline.run(sp, SF)
    assert packed.select("doc_id").distinct().count() > 0.6 * n


def plain_quality(rows, labels):
    """The quality stage in plain Python: the sample, then votes of the nearest by full sorts."""
    key = lambda i: zlib.crc32(str(i).encode())
    text = dict(rows)
    ids = sorted((i for i, _ in labels if key(i) % 4 != 2), key=lambda i: (key(i), i))[: quality_knn.SAMPLE]
    y = dict(labels)
    voters = quality_knn.fit([text[i] for i in ids if i in text], [y[i] for i in ids if i in text])
    kept = []
    for i, t in rows:
        counts = quality_knn.Terms().counts(t)
        score = voters.blank
        if counts.any():
            near = voters.vectors @ voters.latent(counts[None])[0]
            best = np.argsort(-near, kind="stable")[: quality_knn.NEIGHBOURS]
            votes = np.maximum(near[best], 1e-6).astype(np.float64)
            score = votes @ voters.labels[best] / votes.sum()
        if score >= quality_knn.ACCEPT:
            kept.append((i, t))
    return kept


def plain_rules(rows):
    """The rules stage in plain Python, rows of (doc_id, text, host)."""
    bad, hosts = [], {}
    for _, t, host in rows:
        w = re.findall("[^ \t\n\x0b\x0c\r]+", t or "")
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = Counter(windows)
        inside = {p for k, x in enumerate(windows) if often[x] > 1 for p in range(k, k + 8)}
        bad.append(len(w) < 20 or 100 * len(inside) > 30 * len(w))
        n, f = hosts.get(host, (0, 0))
        hosts[host] = (n + 1, f + bad[-1])
    total = sum(n for n, _ in hosts.values())
    mean = sum(f for _, f in hosts.values()) / total
    spread = sum(f * f / n for n, f in hosts.values()) / total - mean * mean
    weight = min(200.0, max(2.0, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else 200.0
    out = {h for h, (n, f) in hosts.items() if (f + mean * weight) / (n + weight) > 0.5}
    return [(i, t) for (i, t, host), b in zip(rows, bad, strict=True) if not b and host not in out]


def test_stages_keep_what_plain_python_keeps(sp):
    small = "/root/testdata/sf0.001"
    given = sp.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").collect()
    rows = [tuple(r) for r in given]
    text = [t for _, t, _ in rows if t and 50 < len(t.split()) < 2000]
    own = [f"{t} with an end of its own number {k}" for k, t in enumerate(text[:12])]
    # null, repeated and clashing ids, null hosts; none of these ids has a label
    rows += [(None, t, None) for t in own[:4]] + [(None, None, "src"), (None, "", None), (10**9, own[4], "src"), (10**9, own[4], "src")]
    rows += [(10**9 + 1, own[5], None), (10**9 + 1, text[20], "src"), (10**9 + 1, None, None), (None, text[21], None)]
    docs = sp.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    labels = [(r.doc_id, r.quality) for r in sp.read.parquet(f"{small}/labels.parquet").collect() if r.quality is not None]
    pairs = [(i, t) for i, t, _ in rows]
    want = {"quality_classifier": plain_quality(pairs, labels), "quality_rules": plain_rules(rows), "near_duplicates": brute_kept(pairs)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = [(r.doc_id, r.text) for r in stage(sp, docs, small).collect()]
        if name == "near_duplicates":  # equal sets of shingles may differ in blanks and capitals
            got, want[name] = ([(i, sorted(sets_of(t))) for i, t in x] for x in (got, want[name]))
        assert sorted(got, key=str) == sorted(want[name], key=str), name
    packed = corpus_pipeline.STAGES[-1][1](sp, docs, small).filter("piece = 0").select("doc_id").collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted((i for i, _ in pairs), key=str)
