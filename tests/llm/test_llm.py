"""Operators for training corpora against brute force, round trips and edge cases."""

import copy
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spoolkit.llm import attention_lm, block_max_search, embedding_dedup, harmonic_packing, lexicon_bpe, partenum_join, piece_encoder, secret_scan, token_files, tool_calls, weak_quality
from spoolkit.llm.shingles import shingle_set, word_hashes

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def make_texts(n=60, seed=1):
    rng = random.Random(seed)
    vocab = ["the", "Of", "and", "thing", "shall", "über", "naïve", "don't", "42", "x=1;"] + ["".join(rng.choices("abcdefghio", k=rng.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([3, 12, 40, 160]))) for _ in range(n)]
    for i in range(0, n, 4):  # near copies
        w = texts[i].split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    base = rng.choices(vocab, k=120)
    for _ in range(40):  # a large group of near copies, and of exact ones
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    return texts + [texts[3]] * 25


EDGE = [None, "", "   \n", "one", "One two", "one two", "<|endoftext|> a <|endoftext|>", "日本語 テキスト", "á   b", "x" * 30_000, "word " * 4_000, "'s 'll''ve don't\r\n\r\n  end "]


@pytest.fixture(scope="module")
def docs(spark):
    texts = make_texts() + EDGE
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def odd(spark):
    """Null and repeated ids, repeated rows, columns with clashing names."""
    return spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "z y x w v u"), (8, None), (9, "z y x w v u")], "doc_id long, text string").withColumn("name", F.lit(1)).withColumn("sig", F.lit("x")).withColumn("n", F.lit(2))


# --- tokenizers -----------------------------------------------------------


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_piece_encoder_equals_the_library(path, rows):
    e = piece_encoder.PieceEncoder(open(path).read(), kept=200)
    texts = [t or "" for t in rows.values()]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


_encoders = {}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbsdtlrve 'é!,.1²\n\t «ÿĳ日<|>")), max_size=30), st.sampled_from([BYTES, WORDS]))
def test_piece_encoder_on_any_text(text, path):
    e = _encoders.setdefault(path, piece_encoder.PieceEncoder(open(path).read()))
    assert next(iter(e.encode([text]))).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_lexicon_bpe(spark, docs, rows):
    t = Tokenizer.from_file(BYTES)
    for words in (0, 50, 5_000):
        found = {r.doc_id: r for r in lexicon_bpe.encode_decode(docs, BYTES, words=words).collect()}
        for i, text in rows.items():
            ids = t.encode(text or "", add_special_tokens=False).ids
            assert found[i].ids == ids and found[i].n_tokens == len(ids)
            assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert found[i].decoded == t.decode(ids, skip_special_tokens=False)
    assert lexicon_bpe.encode_decode(docs.limit(0), BYTES).count() == 0
    assert lexicon_bpe.encode_decode(odd(spark), BYTES).count() == 6


def test_transducer_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", ""])}
    words.pop(b"")
    t = lexicon_bpe.Transducer.view(lexicon_bpe.Transducer.build(words).pack())
    assert [t.ids_at(r) for r in t.ranks(sorted(words))] == [np.array(words[w], "<u4").tobytes() for w in sorted(words)]
    assert t.ranks([b"ta", b"tapsx", b"x", b""]).tolist() == [-1] * 4
    assert len(t.final) <= 8  # suffixes are shared


# --- near duplicates ------------------------------------------------------


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows.items():
        w = words_of(t)
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_components(docs, rows, width, percent, monkeypatch):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum_join.jaccard_components(docs, width, percent).collect()}
    assert found == brute_components(rows, width, percent)


def test_jaccard_tiles(docs, rows, monkeypatch):
    monkeypatch.setattr(partenum_join, "TILE", 8)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum_join.jaccard_components(docs, 3, 75).collect()}
    assert found == brute_components(rows, 3, 75)


def test_jaccard_edges(spark, docs):
    out = partenum_join.jaccard_components(odd(spark), 3, 90).collect()
    assert len(out) == 6 and {r.component_id for r in out if r.doc_id in (7, 9)} == {7}
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert partenum_join.jaccard_components(docs.limit(0), 3, 90).count() == 0
    kept = partenum_join.one_of_each(odd(spark))  # the two texts of id 7 are unlike, so both stay
    assert kept.columns == odd(spark).columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 7, 7, 8]


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_signatures_lose_no_pair(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, n // 4) + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            assert np.intersect1d(partenum_join.signatures(a, percent), partenum_join.signatures(b, percent)).size


def test_signatures_enumerate_subsets():
    """One differing element in a part leaves exactly the subset without its third; sets of a band share as many parts as are spared."""
    a = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 30, dtype=np.uint64))
    k = partenum_join.bands(90)[partenum_join.band_of(len(a), 90)][2]
    assert k > 1
    b = np.concatenate([a[1:], [np.uint64(5)]])
    b.sort()
    one, other = partenum_join.signatures(a, 90), partenum_join.signatures(b, 90)
    assert len(np.unique(one)) == len(one) and 0 < np.intersect1d(one, other).size < len(one)


def test_one_of_each_with_repeated_ids(spark):
    """Rows of one id with different texts are kept or not by their own groups."""
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    near = " ".join([*base[:-1], "last"])
    rows = [(5, " ".join(base)), (5, " ".join(other)), (5, " ".join(other)), (6, " ".join(other)), (7, near), (3, near), (8, "alone " * 9), (5, None), (9, ""), (9, ""), (None, near)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, set_0 string").repartition(4)
    kept = partenum_join.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id or -1), (r.text or "")[:2], (r.text or "")[-4:]) for r in kept.collect())
    assert found == [(-1, "w0", "last"), (3, "w0", "last"), (5, "", ""), (5, "v0", " v59"), (8, "al", "one "), (9, "", ""), (9, "", "")]


def test_word_hashes(rows):
    for t in rows.values():
        w = words_of(t)
        h = word_hashes(t or "").tolist()
        assert len(h) == len(w) and len(set(h)) == len(set(w))
    assert len(shingle_set("a b", 5)) == 1


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 500)] + 0.18 * rng.standard_normal((500, 16)), np.repeat(centres[:1], 60, axis=0), 3 * centres[1:2]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("name", F.lit(1))
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
        if (low == label).all():
            break
        label = low
    total = sum(found[i].n_links for i in range(len(x)))
    assert 0.9 * link.sum() <= total <= link.sum()
    exact = [found[i].n_links == link[i].sum() for i in range(len(x))]
    assert np.mean(exact) > 0.9
    assert all(found[i].kept == (found[i].component_id == i) for i in found)
    assert np.mean([found[i].component_id == label[i] for i in range(len(x))]) > 0.9
    assert [found[i].n_links for i in (900, 901, 902, 903, 904, 905, 906)] == [0, 0, 0, 0, 1, 1, 0]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST_UNIT", 16)
    monkeypatch.setattr(embedding_dedup, "SHARE", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16))
    near = x[:500] / np.linalg.norm(x[:500], axis=1, keepdims=True) + 0.42 / 4 * rng.standard_normal((500, 16))
    x = np.concatenate([x, near])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert [found[i] for i in range(len(x))] == link.sum(axis=1).tolist()


# --- scoring, quality, secrets -------------------------------------------


def test_scores(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(attention_lm, "STEPS", 5)
    monkeypatch.setattr(attention_lm, "COMMON_WORDS", 40)
    found = {r.doc_id: r for r in attention_lm.score_texts(docs, BYTES).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    c = Counter()
    for i, t in rows.items():
        if not held[i]:
            c.update([*words_of(t), "\0end"])
    n, v = sum(c.values()), len(c)
    for i, t in rows.items():
        w = [*words_of(t), "\0end"]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and -1e7 < r.score < 0
    assert attention_lm.score_texts(docs.limit(0), BYTES).count() == 0
    assert attention_lm.score_texts(odd(spark), BYTES).count() == 6


def tiny_lm(steps=60):
    """(classes, fitted model, closed texts): texts that repeat seven of twenty subwords; every fifth begins a word."""
    rng = np.random.default_rng(0)
    texts = [attention_lm.closed(np.tile(rng.permutation(20)[:7], 12), 299) for _ in range(60)]
    classes = attention_lm.Classes.build(np.bincount(np.concatenate(texts), minlength=300), np.arange(300) % 5 == 0, 299)
    model = attention_lm.fit(texts, classes, steps)
    model.ready()
    return classes, model, texts


def log_sums(classes, model, texts):
    logp, _, of = attention_lm.subword_logs(model, classes, texts)
    return np.bincount(of, weights=logp, minlength=len(texts))


def test_lm_learns_from_all_texts(spark, monkeypatch):
    seen, fit = [], attention_lm.fit
    monkeypatch.setattr(attention_lm, "fit", lambda arrays, classes: seen.append(len(arrays)) or fit(arrays, classes, 1))
    docs = spark.createDataFrame([(i, f"text {i} of many") for i in range(2_000)], "doc_id long, text string")
    assert attention_lm.score_texts(docs, BYTES).count() == 2_000
    assert seen == [sum(not attention_lm.is_held_out(i) for i in range(2_000))]


def test_lm_rounds_learn(spark, monkeypatch):
    classes, _, texts = tiny_lm(1)
    training = spark.createDataFrame([(i, bytearray(t[1:-1].astype("<u2").tobytes())) for i, t in enumerate(texts * 10)], "key long, ids binary").repartition(3)
    windows = sum(-(-(len(t) - 1) // attention_lm.STRIDE) for t in texts * 10)
    for name, value in (("BATCH", 16), ("LEAST", 1_000), ("TASK_WINDOWS", windows // 4)):
        monkeypatch.setattr(attention_lm, name, value)
    models = [attention_lm.fit_all(training, windows, "<u2", classes) for _ in range(2)]
    for m in models:
        m.ready()
    one, two = (log_sums(classes, m, texts) for m in models)
    assert (one == two).all() and one.sum() > log_sums(*tiny_lm(2)).sum()


def test_lm_fit_has_no_switch_by_size(spark, monkeypatch):
    """One window more than LEAST changes next to nothing, and both steps learn on either side."""
    classes, _, texts = tiny_lm(1)
    training = spark.createDataFrame([(i, bytearray(t[1:-1].astype("<u2").tobytes())) for i, t in enumerate(texts * 10)], "key long, ids binary").coalesce(1)
    fit, alone = attention_lm.fit, []
    monkeypatch.setattr(attention_lm, "BATCH", 16)
    monkeypatch.setattr(attention_lm, "LEAST", 100_000)
    monkeypatch.setattr(attention_lm, "fit", lambda arrays, classes: alone.append(fit(arrays, classes, 30)) or copy.deepcopy(alone[-1]))
    one, two = (attention_lm.fit_all(training, n, "<u2", classes).p for n in (100_000, 100_001))
    assert all(np.allclose(one[k], two[k], atol=1e-3) for k in one)
    assert len(alone) == 2 and all((m.p["g"] != p["g"]).any() for m, p in zip(alone, (one, two), strict=True))
    assert attention_lm.fit_all(training.limit(0), 0, "<u2", classes).p["g"].shape == one["g"].shape


def test_lm_segments_cover_texts():
    ids = np.arange(1_000, dtype=np.int32)
    every = list(attention_lm.segments(5, ids, 1.0))
    assert np.array_equal(np.concatenate([s[1:] for s in every]), ids[1:]) and all(s[0] == s[1] - 1 for s in every)
    some = [s for k in range(400) for s in attention_lm.segments(k, ids, 1 / 8)]
    assert 0.09 < len(some) / (400 * len(every)) < 0.16


def test_lm_gradients_and_learning():
    classes, m, texts = tiny_lm(2)
    x, pad, target, text = attention_lm.windows_of(texts[:3], classes)
    args = (classes.of[target].ravel(), (text >= 0).ravel())
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    _, g = m.gradients(m.forward(x, pad), *args)
    rng = np.random.default_rng(1)
    for k, v in m.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape) if k != "e" else (int(x[0, -1]), 3)
        at = (int(args[0][0]) // attention_lm.MEMBERS, *at[1:]) if k == "m" else at
        old, eps = v[at], 1e-5
        v[at] = old + eps
        up, _ = m.gradients(m.forward(x, pad), *args)
        v[at] = old - eps
        down, _ = m.gradients(m.forward(x, pad), *args)
        v[at] = old
        assert math.isclose((up - down) / (2 * eps), g[k][at], rel_tol=2e-3, abs_tol=1e-6), k
    assert log_sums(*tiny_lm(150)).sum() > log_sums(*tiny_lm(2)).sum()


def test_lm_scores_are_probabilities_and_causal():
    classes, model, texts = tiny_lm(5)
    assert math.isclose(np.exp(classes.share).sum(), len(set(classes.of.tolist())), rel_tol=1e-6)
    assert np.allclose(log_sums(classes, model, texts[:4]), [log_sums(classes, model, [t])[0] for t in texts[:4]], rtol=1e-5)  # batching changes nothing
    total, begins = 0.0, 0.0
    for i in range(300):  # every subword after one beginning
        logp, begin, _ = attention_lm.subword_logs(model, classes, [np.append(texts[0][:9], i)])
        total += math.exp(logp[-1])
        begins += math.exp(logp[-1]) * (i % 5 == 0 or i == 299)
    assert math.isclose(total, 1, rel_tol=1e-4) and math.isclose(begins, math.exp(begin[-1]), rel_tol=1e-4)
    first = attention_lm.subword_logs(model, classes, [texts[0]])[0]
    changed = texts[0].copy()
    changed[11:] = 5
    assert np.allclose(attention_lm.subword_logs(model, classes, [changed])[0][:10], first[:10], rtol=1e-5)  # what follows doesn't matter


def test_lm_score_by_hand(spark):
    """The score against a slow reckoning, word by word and phrase by phrase, over a small table with copies and shared beginnings."""
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(60)] + ["über", "x=1;", "don't"]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([2, 30, 200]))) for _ in range(30)]
    texts += [texts[1], texts[2], texts[1] + "\n\n " + texts[2], None, "", "  lead  and trail \n", "a\u00a0 \u3000\n b\u2003\u2003 c", " ".join(texts) * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made = {}
    fitted = attention_lm.fit_all
    attention_lm.fit_all = lambda *a: made.setdefault("model", fitted(*a[:3], made.setdefault("classes", a[3])))
    try:
        found = {r.doc_id: r.score for r in attention_lm.score_texts(docs, BYTES).collect()}
    finally:
        attention_lm.fit_all = fitted
    classes, model, library = made["classes"], made["model"], Tokenizer.from_file(BYTES)
    learnt = [i for i in range(len(texts)) if not attention_lm.is_held_out(i)]
    count = Counter(w for i in learnt for w in [*words_of(texts[i]), None])
    n = sum(count.values())

    def phrases_of(t):
        hashes = [int(h) for h in word_hashes(t)]
        out, now = [], []
        for i, w in enumerate([*words_of(t), None]):
            now.append(w)
            pair = int(attention_lm.mix(np.array([hashes[i - 1] * 31 + hashes[i] & (1 << 64) - 1], np.uint64))[0]) if 0 < i < len(hashes) else 1
            if w is None or pair % attention_lm.PHRASE == 0:
                out.append(tuple(now))
                now = []
        return out

    said = Counter(p for i in learnt for p in phrases_of(texts[i] or ""))
    for i, t in enumerate(texts):
        t = (t or "").translate(LOWER)
        ids = library.encode(t, add_special_tokens=False)
        logp, begin, _ = attention_lm.subword_logs(model, classes, [attention_lm.closed(np.array(ids.ids, np.int32), classes.end)])
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        logs, of = [0.0] * (len(spans) + 1), []
        for j, (a, b) in enumerate(ids.offsets):
            of.append(next((k for k, (_, end) in enumerate(spans) if end > a), len(spans)))
        of.append(len(spans))
        for j, k in enumerate(of):
            logs[k] += logp[j]
            if k and (not j or of[j - 1] != k) and (j == len(ids.ids) or t[ids.offsets[j][0]] in " \t\n"):
                logs[k] -= begin[j]
                logs[k - 1] += begin[j]
        a = attention_lm.FROM_WORDS
        mixed = [np.logaddexp(math.log(a * count[w] / n) if count[w] else -np.inf, x + math.log(1 - a)) for w, x in zip([*words_of(t), None], logs, strict=True)]
        total, at, mine = 0.0, 0, Counter(phrases_of(t)) if i in learnt else Counter()
        for p in phrases_of(t):
            x = sum(mixed[at : at + len(p)]) + math.log(1 - attention_lm.FROM_PHRASES)
            others = said[p] - mine[p]
            total += np.logaddexp(x, math.log(attention_lm.FROM_PHRASES * others / sum(said.values()))) if others else x
            at += len(p)
        assert math.isclose(found[i], total / math.log(10), rel_tol=1e-5), i


def test_quality(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("aeionrst", k=rng.randrange(2, 8))) for _ in range(800)]
    good = [". ".join(" ".join(rng.choices(vocab, k=9)).capitalize() for _ in range(rng.randrange(3, 20))) + "." for _ in range(240)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(vocab, k=80)) for _ in range(20)] + [" | ".join(rng.choices(vocab, k=80)) for _ in range(20)] + [" ".join(w for w in rng.choices(vocab, k=6) for _ in range(15)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + [None, "", " \n"])], "doc_id long, text string").withColumn("score", F.lit("x"))
    found = {r.doc_id: r for r in weak_quality.classify(docs).collect()}
    right = sum(found[i].kept for i in range(240)) + sum(not found[240 + i].kept for i in range(60))
    assert right >= 295
    assert [found[300 + i].kept for i in range(3)] == [False] * 3
    kept = weak_quality.good_only(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in found if found[i].kept}
    assert weak_quality.classify(docs.limit(0)).count() == 0


def test_quality_by_hand(spark):
    """All votes, one fit on the different texts, and a score for each text, without Spark."""
    rng = random.Random(9)
    vocab = ["".join(rng.choices("aeionrst", k=rng.randrange(2, 8))) for _ in range(300)]
    texts = [". ".join(" ".join(rng.choices(vocab, k=9)).capitalize() for _ in range(rng.randrange(3, 12))) + "." for _ in range(40)]
    texts += [" ".join(w.upper() + "!!" for w in rng.choices(vocab, k=60)) for _ in range(12)] + [texts[0]] * 30 + [None, "", "One two three."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = [t or "" for t in texts]
    labels = weak_quality.LabelModel.fit(Counter(weak_quality.votes(weak_quality.measures(t)) for t in held))
    once = sorted(set(held))
    p = np.array([labels.posterior(weak_quality.votes(weak_quality.measures(t))) for t in once])
    scorer = weak_quality.Scorer()
    scorer.fit([weak_quality.features(t, weak_quality.measures(t)) for t in once], p, np.where(p >= 0.5, 1 / (p >= 0.5).sum(), 1 / (p < 0.5).sum()))
    want = {i: weak_quality.judge(t, labels, scorer) for i, t in enumerate(held)}
    for r in weak_quality.classify(docs).collect():
        posterior, score, n = want[r.doc_id]
        assert (r.n_votes, r.posterior, r.score) == (n, pytest.approx(posterior), pytest.approx(score, abs=1e-6)) and r.kept == (score >= 0.5)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.8
    acc = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.85, 0.9, 0.75])
    votes = np.where(rng.random((len(y), 9)) < acc, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None]) * (rng.random((len(y), 9)) < 0.7)
    m = weak_quality.LabelModel.fit(Counter(map(tuple, votes.tolist())))
    assert abs(m.good - 0.8) < 0.02
    assert np.abs(m.chance[:, 1, 2] / (m.chance[:, 1, 0] + m.chance[:, 1, 2]) - acc).max() < 0.03


def test_secrets(spark):
    rng = random.Random(7)
    text = 'x password = "hunter2222" AKIA' + "A1" * 8 + " " + "0123456789abcdef" * 2 + " token=short TOKEN : 12345678 apikey='" + "q" * 9
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=60))
    texts = [text, None, "", f"the {key} here", "internationalization_of_everything " * 3, "abcdefghijklmnopqrstuvwxyz0123456789", "é password=éabcdefghi", "ſecret=abcdefgh12"] + ["unremarkablelongishwordhere and so on"] * 50
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    spans = [s.split(":") for s in found[0].spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("assign", 'password = "hunter2222'), ("access", "AKIA" + "A1" * 8), ("hex", "0123456789abcdef" * 2), ("assign", "TOKEN : 12345678"), ("assign", "apikey='" + "q" * 9)]
    assert (found[0].n_assign, found[0].n_access, found[0].n_hex) == (3, 1, 1)
    assert found[0].base_sha256 == hashlib.sha256(found[0].spans.encode()).hexdigest()
    assert found[1].spans == found[2].spans == "" and found[3].spans == f"random:4:{4 + len(key)}"
    assert all(found[i].spans == "" for i in range(4, len(texts)))
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean[3] == "the [random removed] here" and clean[1] is None and "hunter" not in clean[0]
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_base_secrets_by_hand(spark):
    """The fixed patterns, matched anew on random texts."""
    rng = random.Random(21)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", '"', "'", " ", "  ", ":", "=", "\n", "é", "AKIA", "AKIA" + "Z9" * 6, "AKIA" + "Q" * 30, "deadbeef" * 4, "0f" * 15, "abc123" * 3, "x", "hunter22", "+/_.=-", "Zz9" * 9]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(300)] + [None, ""]
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in secret_scan.scan(docs).collect():
        found = [[(m.start(), i, m.end(), k) for m in p.finditer(texts[r.doc_id] or "") if len(m[g]) >= n] for i, (k, p, g, n) in enumerate(kinds)]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(x for xs in found for x in xs))
        assert [r.n_assign, r.n_access, r.n_hex] == list(map(len, found)) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_secrets_within_runs(spark):
    rng = random.Random(11)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    kinds = [("AWS_SECRET_ACCESS_KEY=", 40, signs, ""), ("STRIPE_LIVE_SIGNING_KEY=", 32, signs[:62], "=="), ("/webhooks/incoming/service/", 24, signs[:62], ""), ("/api/v1/integrations/callback/", 40, signs, "/status")]
    values = [(a, "".join(rng.choices(c, k=n)), b) for a, n, c, b in kinds for _ in range(150)]
    names = ["/usr/share/documentation/packages/readme", "internationalization_of_everything"]
    docs = spark.createDataFrame([(i, f"see {a}{v}{b} end") for i, (a, v, b) in enumerate(values)] + [(1000 + i, f"see {t} end") for i, t in enumerate(names)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    for k in range(len(kinds)):
        assert sum(values[i][1] not in clean[i] and "removed" in clean[i] for i in range(150 * k, 150 * k + 150)) >= 145
    assert [clean[1000 + i] for i in range(len(names))] == [f"see {t} end" for t in names]


# --- search, packing, files, chats ---------------------------------------


def test_search(spark, docs, rows):
    k = 7
    queries = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text")
    found = {}
    for r in block_max_search.search(docs, queries, k).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    tf = {i: Counter(words_of(t)) for i, t in rows.items()}
    df = Counter(w for c in tf.values() for w in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    for q in (i for i in rows if i % 5 == 0):
        scores = []
        for i, c in tf.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in tf[q] if w in c)
            if s > 0:
                scores.append((-round(s, 9), i))
        want = sorted(scores)[:k]
        got = sorted(found.get(q, []))
        assert [d for _, d, _ in got] == [i for _, i in want]
        assert all(math.isclose(s, -w, rel_tol=1e-8) for (_, _, s), (w, _) in zip(got, want, strict=True))
    assert block_max_search.search(docs, queries.limit(0)).count() == 0
    assert block_max_search.search(docs.limit(0), queries).count() == 0
    assert block_max_search.search(odd(spark), odd(spark).withColumnRenamed("doc_id", "query_id").drop("name")).count() > 0


def test_search_in_many_shards_and_blocks(docs, rows, monkeypatch):
    queries = docs.where("doc_id % 9 = 0").select(F.col("doc_id").alias("query_id"), "text")
    key = lambda df: sorted(map(tuple, df.collect()))
    one = key(block_max_search.search(docs, queries, 5))
    monkeypatch.setattr(block_max_search, "SHARD_POSTINGS", 300)
    monkeypatch.setattr(block_max_search, "QUERIES", 4)
    monkeypatch.setattr(block_max_search, "WAVES", 2)
    assert key(block_max_search.search(docs, queries, 5)) == one


def test_search_skips_blocks():
    """Over a shard of many blocks, a query with a threshold opens few of them and returns what the open search does."""
    rng = np.random.default_rng(5)
    texts = [np.unique(rng.zipf(1.3, 60) % 5_000) for _ in range(4_000)]
    shard = block_max_search.Shard.build(list(range(4_000)), [60] * 4_000, texts, [np.ones(len(t), np.int64) for t in texts])
    shard = block_max_search.Shard.view(shard.pack())
    known, df = np.unique(np.concatenate(texts), return_counts=True)
    at = shard.ready(60.0, known, np.log(1 + (4_000 - df + 0.5) / (df + 0.5)))
    opened = skipped = 0
    for q in range(0, 4_000, 100):
        words = at[np.searchsorted(known, texts[q])]
        docs, scores = shard.search(words, 10)
        gain = Counter()
        for w in words.tolist():
            for p in range(shard.first[w], shard.first[w + 1]):
                gain[int(shard.doc[p])] += float(shard.gain[p])
        assert list(zip(docs.tolist(), scores.tolist(), strict=True)) == sorted(gain.items(), key=lambda x: (-x[1], x[0]))[:10]
        shard.opened = shard.skipped = 0
        again = shard.search(words, 10, scores[-1])
        assert again[0].tolist() == docs.tolist() and again[1].tolist() == scores.tolist()
        opened, skipped = opened + shard.opened, skipped + shard.skipped
    assert 0 < opened < skipped
    assert not len(shard.search(words, 10, 1e6)[0])


def test_search_meets_all_queries_of_a_block_at_once():
    """One pass over a shard gives each query what a search of its own does, with thresholds carried from shard to shard and ties."""
    rng = np.random.default_rng(6)
    texts = [np.unique(rng.zipf(1.3, 60) % 5_000) for _ in range(900)]
    texts += texts[:40] * 3  # copies tie
    known, df = np.unique(np.concatenate(texts), return_counts=True)
    weights = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
    shards = [block_max_search.Shard.build(list(range(a, len(texts), 2)), [60] * len(texts[a::2]), texts[a::2], [np.ones(len(t), np.int64) for t in texts[a::2]]) for a in range(2)]
    asked = [np.searchsorted(known, texts[q]) for q in range(0, len(texts), 7)]
    together = block_max_search.Asked(len(known), np.append(0, np.cumsum([len(w) for w in asked])), np.concatenate(asked))
    assert 0 < len(together.often) < len(known)
    best, least, found = np.zeros((len(asked), 10)), np.zeros(len(asked)), [[] for _ in asked]
    alone = [[] for _ in asked]
    for shard in shards:
        at = shard.ready(60.0, known, weights)
        for i, doc, score in zip(*(x.tolist() for x in shard.search_all(at, together, 10, best, least)), strict=True):
            found[i].append((-score, doc))
        for i, w in enumerate(asked):
            alone[i] += [(-s, d) for d, s in zip(*(x.tolist() for x in shard.search(at[w][at[w] >= 0], 10)), strict=True)]
    assert [sorted(x)[:10] for x in found] == [sorted(x)[:10] for x in alone]
    assert (least == [-sorted(x)[9][0] for x in alone]).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 20_000))
def test_cuts(n):
    pieces = harmonic_packing.cuts(n)
    assert sum(p for _, p in pieces) == n
    assert all(4096 // (k + 1) < p <= 4096 // k for k, p in pieces)
    assert sum(harmonic_packing.powers(n)) == n


def test_packing(spark, docs, rows):
    t = Tokenizer.from_file(WORDS)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows.items()}
    pieces = harmonic_packing.pack(docs, WORDS).collect()
    got = {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(want[p.doc_id])
        got.setdefault(p.doc_id, []).append((p.start, p.length))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(got[i]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    waste = 0
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
        waste += 0 if at & (at - 1) == 0 else 4096 - at
    assert waste < 0.02 * sum(map(len, want.values()))
    assert harmonic_packing.pack(docs.limit(0), WORDS).count() == 0
    assert len({p.doc_id for p in harmonic_packing.pack(odd(spark), WORDS).collect()}) == 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    ef, end = token_files.EliasFano.unpack(token_files.EliasFano.of(np.array(values, np.uint64)).pack() + b"x", 0)
    assert ef.values().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 37)] == values[::37]


def test_token_files(spark, docs, rows, monkeypatch):
    t = Tokenizer.from_file(BYTES)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in sorted(rows.items())}
    for size in (500, 1 << 17):
        monkeypatch.setattr(token_files, "SEGMENT_IDS", size)
        found = {r.doc_id: r for r in token_files.token_files(docs, BYTES).collect()}
        at = 0
        for i, ids in want.items():
            assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    assert token_files.token_files(docs.limit(0), BYTES).count() == 0
    out = token_files.token_files(odd(spark), BYTES).collect()
    assert len(out) == 6 and min(r.start for r in out if r.doc_id is None) == 0
    s = token_files.Segment(token_files.make_segment([None, 3, 3, 9], [np.array([1, 2]), np.array([3]), np.array([4, 5, 6]), np.array([7])], 2))
    assert s.document(2).tolist() == [4, 5, 6] and [r[0] for r in s.rows()] == [None, 3, 3, 9]


def test_tool_calls(spark):
    call = json.dumps({"tool_calls": [{"id": "c1", "name": "find", "arguments": {"q": "x", "n": 3}}, {"id": "c2", "name": "find", "arguments": {"n": "x", "zzz": "1"}}, {"id": "c9", "name": "nope", "arguments": {}}]})
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "hi"), (1, 2, "assistant", call), (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "found"})), (1, 4, "tool", json.dumps({"tool_call_id": "lost", "content": "?"})), (1, 4, "tool", json.dumps({"tool_call_id": "c1", "content": "again"})), (2, 0, "user", ""), (2, 1, "assistant", "ok"), (2, 1, "assistant", "ok"), (None, 5, "user", "x"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("call_id", F.lit("clash")).withColumn("level", F.lit(1))
    schemas = tool_calls.REPLY | {"find": {"q": {"type": "string", "required": True}, "n": {"type": "integer"}}}
    out = tool_calls.linked_events(df, schemas).collect()
    of = {(r.conv_id, r.turn, r.call_id, r.kind, json.loads(r.record).get("content")): r for r in out}
    assert of[(1, 2, "1:c1", "call", None)].linked and of[(1, 2, "1:c1", "call", None)].errors == ""
    assert of[(1, 2, "1:c2", "call", None)].errors == "missing q; type n; unknown zzz" and not of[(1, 2, "1:c2", "call", None)].linked
    assert of[(1, 2, "1:c9", "call", None)].errors == "unknown tool"
    assert of[(1, 3, "1:c1", "result", "found")].linked and not of[(1, 4, "1:c1", "result", "again")].linked and not of[(1, 4, "1:lost", "result", "?")].linked
    assert of[(1, 3, "1:c1", "result", "found")].level == of[(1, 2, "1:c1", "call", None)].level + 1
    assert of[(2, 1, "2:turn-0", "result", "ok")].copies == 2 and of[(2, 0, "2:turn-0", "call", None)].errors == "short text"
    assert of[(2, 0, "2:turn-0", "call", None)].record == '{"arguments":{"text":""},"id":"2:turn-0","kind":"call","linked":true,"role":"user","tool":"reply","turn":0}'
    assert len(out) == 12 and tool_calls.linked_events(df.limit(0)).count() == 0
    assert sorted(r.position for r in out) == list(range(12))


def test_tool_call_arguments_keep_types(spark):
    """Types, nested values, arguments in strings, white space, repeated keys and hot identifiers."""
    one = lambda arguments: ' \n{"tool_calls":[{"id":"c","name":"f","arguments":' + arguments + "}]}"
    cases = [
        ('{"n":5,"b":{"z":1,"a":[1,"1",null]}}', "", '{"b":{"a":[1,"1",null],"z":1},"n":5}'), ('{"n":"5"}', "type n", '{"n":"5"}'), ('{"n":5.5}', "type n", '{"n":5.5}'), ('{"n":1,"x":"no","y":true}', "type x", '{"n":1,"x":"no","y":true}'),
        ('{"n":null}', "missing n", '{"n":null}'), ('"{\\"n\\": 7}"', "", '{"n":7}'), ('"not json"', "not an object", None), ("[1]", "not an object", "[1]"), ('{"n":1,"o":1}', "unknown o", '{"n":1,"o":1}'),
    ]
    schemas = {"f": {"n": {"type": "integer", "required": True}, "b": {"type": "object"}, "x": {"type": "number"}, "y": {"type": "boolean"}}}
    rows = [(i, 0, "assistant", one(a)) for i, (a, _, _) in enumerate(cases)]
    rows += [(100, 0, "assistant", '{"tool_calls":[{"id":"c","type":"function","function":{"name":"f","arguments":"{\\"n\\":1}"}}]}'), (101, 0, "assistant", one('{"n":1,"n":2}'))]
    rows += [(200, 0, "assistant", one('{"n":1}'))] + [(200, 1, "tool", json.dumps({"tool_call_id": "c", "content": {"k": i}})) for i in range(300)] + [(None, None, "system", f"{i}") for i in range(300)]
    out = tool_calls.linked_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()
    of = {r.conv_id: r for r in out if r.kind == "call"}
    for i, (_, errors, canonical) in enumerate(cases):
        assert of[i].errors == errors, i
        assert (f'"arguments":{canonical},' in of[i].record) if canonical else "arguments" not in of[i].record
    assert of[100].errors == "" and '"arguments":{"n":1}' in of[100].record
    assert [r.kind for r in out if r.conv_id == 101] == ["result"]  # JSON that repeats a key is plain text
    tools = [r for r in out if r.conv_id == 200 and r.role == "tool"]
    assert sum(r.linked for r in tools) == 1 and all(r.level == 1 for r in tools) and json.loads(min(r.record for r in tools if r.linked))["content"] == '{"k":0}'
    place = {(r.conv_id, r.level): r.position for r in out}
    assert place[200, 0] < min(r.position for r in tools) and sorted(r.position for r in out) == list(range(len(out)))


def test_levels(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(200)] + [("x", "y"), ("y", "x"), ("z", "x"), ("o", "gone")]
    found = {r.node: r.level for r in tool_calls.levels(spark.createDataFrame(chain, "node string, parent string")).collect()}
    assert all(found[str(i)] == i for i in range(200)) and [found[k] for k in "xyzo"] == [None, None, None, 0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    vocab = ["".join(rng.choices("aeionrst", k=rng.randrange(2, 8))) for _ in range(900)]
    texts = [". ".join(" ".join(rng.choices(vocab, k=10)).capitalize() for _ in range(8)) + "." for _ in range(80)]
    near = texts[5].split()
    near[3] = "different"
    texts += [" ".join(near), texts[6], texts[7] + " password=abcdefgh1234"] + [" ".join(w.upper() + "!!" for w in rng.choices(vocab, k=90)) for _ in range(12)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert good.schema == docs.schema and {r.doc_id for r in good.select("doc_id").collect()} == set(range(83))
    unique = corpus_pipeline.near_duplicates(spark, good, str(tmp_path))
    ids = {r.doc_id for r in unique.select("doc_id").collect()}
    brute = brute_components({i: texts[i] for i in range(83)}, 5, 80)
    assert ids == {i for i, (_, c) in brute.items() if i == c}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in packed} == ids


def test_merging_a_long_piece():
    """An unbroken megabyte-like piece takes time in proportion (nearly), and equals the library."""
    v = lexicon_bpe.Vocabulary(open(BYTES).read())
    rng = random.Random(6)
    library = Tokenizer.from_file(BYTES)
    for n in (1, 2, 50, 5_000, 200_000):
        piece = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        assert v.merge(piece.encode()) == library.encode(piece, add_special_tokens=False).ids
