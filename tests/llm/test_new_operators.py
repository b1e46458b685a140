"""Turn repair, toxicity, Merkle manifests, and what changed in other operators, against brute force."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolkit.llm import embedding_dedup, merkle_manifest, ordering, secret_scan, toxic_lexicon, turn_repair

TURNS = "conv_id long, turn long, role string, text string"


# --- op11 -----------------------------------------------------------------


def cheapest(rows):
    """(cost, audit) of rows (role, fault) by trying all edits, with two inserts at a place at most."""
    best = {"0": (0, "")}

    def keep(found, state, value):
        if state not in found or value < found[state]:
            found[state] = value

    def inserted(found):
        for _ in range(2):
            for state, (cost, audit) in list(found.items()):
                for x in "ua":
                    if x in turn_repair.NEXT[state]:
                        keep(found, turn_repair.NEXT[state][x], (cost + 5, audit + "I"))
        return found

    for role, fault in rows:
        after = {}
        for state, (cost, audit) in inserted(best).items():
            keep(after, state, (cost + 2, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            for x, price, letter in ((role[:1], 0, "K"), ("u", 1, "R"), ("a", 1, "R")):
                if x in turn_repair.NEXT[state]:
                    keep(after, turn_repair.NEXT[state][x], (cost + price + more, audit + letter))
        best = after
    return min(v for s, v in inserted(best).items() if s in "0a")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_paths_equal_brute_force(n):
    kinds = [(r, f) for r in ("system", "user", "assistant", "") for f in ("", "blank", "truncated")]
    sample = list(itertools.product(kinds, repeat=n))
    for rows in random.Random(n).sample(sample, min(len(sample), 400)):
        assert min(turn_repair.paths(list(rows), "0", turn_repair.ACCEPTING).values()) == cheapest(rows)


def digest(conv, rows):
    """The digest of a conversation's rows (turn, role, text), by the rules alone."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, told = set(), []
    for _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        told.append((role, "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    turns = {r[0] for r in rows if r[0] is not None}
    cost, audit = cheapest(told)
    out, state, at = [], "0", iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)[1:]
        if letter == "D":
            continue
        if letter != "K":
            role = {"u": "user", "a": "assistant"}["a" if state == "u" else "u"]
        state = role[0]
        out.append(f"{role}:{text}")
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    faults = [f for _, f in told]
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair(spark):
    """Short conversations, and ones of many pieces, with hot repeated rows; nulls, empty and long texts, clashing columns."""
    rng = random.Random(4)
    rows = []
    for conv, n in [(i, rng.randrange(1, 9)) for i in range(30)] + [(100, 65), (101, 700), (102, 5_000)]:
        for t in range(n):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None])
            rows.append((conv, rng.choice([t, t, t, None if conv < 100 else t, t + 2]), role, rng.choice([f"text {t}.", f"text {t}", "same.", "  \n", None, "Ünd?"])))
    rows += [(103, 1, "user", "again.")] * 300 + [(None, 0, "user", "who?"), (104, None, None, None), (105, 0, "user", "long " * 60_000 + ".")]
    df = spark.createDataFrame(rows, TURNS).withColumn("piece", F.lit(1)).withColumn("conv", F.lit("x")).repartition(7)
    found = {r.conv_id: tuple(r) for r in turn_repair.repair(df).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert found == {c: digest(c, rs) for c, rs in by_conv.items()}
    assert turn_repair.repair(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, r, "One. Two!") for c in range(40) for t, r in enumerate(["user", "assistant", "user"])] + [(None, None, None, None)]
    found = sorted((tuple(r) for r in turn_repair.damaged(spark.createDataFrame(rows, TURNS)).collect()), key=repr)
    want = []
    for c, t, r, x in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if hit == 0:
            want.append((c, t, None, None, False))
            continue
        row = (c, t, "user" if hit == 4 else r, "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x, True)
        want += [row] * (2 if hit == 3 else 1)
    assert found == sorted(want, key=repr)
    gone = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (one,) = turn_repair.repair(turn_repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS))).collect()
    assert tuple(one) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- op12 -----------------------------------------------------------------


def test_folding():
    assert toxic_lexicon.fold("Mоrоn, 1D10T!!") == "moron  idiot  "  # Cyrillic letters and digits
    assert toxic_lexicon.fold("ＳＣＵＭ a-b 2024 x1 é") == "scum a b      xi é"
    for text in ("", "ﬁ İ ß", "!!|", "$5 5 $", "a" * 5_000, "日本 1a"):
        assert len(toxic_lexicon.fold(text)) == len(text)


def labelled(n=900, seed=2):
    """Texts of a made-up language; toxic ones hold ``zorgh`` and words that begin with ``vlim``; ``the zorgh tree`` is harmless."""
    rng = random.Random(seed)
    parts = ["ka", "lo", "mi", "tu", "ser", "na", "pol", "en", "dra", "vi"]
    word = lambda: "".join(rng.choices(parts, k=rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(8, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(1, len(words) // 12)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgh", "ZORGH!", "vlim" + word()]))
        elif i % 7 == 0:
            at = rng.randrange(1, len(words))
            words[at:at] = ["the", "zorgh", "tree"]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = labelled()
    rows += [(5_000 + i, rows[10][1], 1) for i in range(60)] + [(6_000, None, 0), (6_001, "", 0), (6_002, "ka lo " * 40_000 + "zorgh", None), (6_003, "mi z0rgh tu", None), (6_004, "tu ser na", None)]  # copies, odd texts
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "zorgh"), (6_003, "mi z0rgh tu")], "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("w", F.lit("x")).repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1)], "doc_id long, toxic int")
    lexicon = toxic_lexicon.train(docs, labels.where(~toxic_lexicon.held_out(F.col("doc_id"))))
    assert " zorgh " in lexicon.weights and any(e.startswith(" viim") for e in lexicon.weights) and len(lexicon.weights) < 12
    assert "the zorgh" in lexicon.exceptions and "zorgh tree" in lexicon.exceptions
    found = toxic_lexicon.toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    score = {r.doc_id: r for r in found}
    for i, t, y in rows:
        assert score[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= score[i].score <= 1 and score[i].predicted == int(score[i].score >= 0.7)
        if y is not None:
            assert score[i].predicted == y, (i, t, score[i])
    assert score[6_003].predicted == 1 and score[6_004].predicted == 0 and score[6_003].score > score[6_002].score > score[6_004].score
    words = toxic_lexicon.found_words(docs.where("doc_id = 6003"), lexicon).collect()
    assert {(r.start, r.end, r.word) for r in words} == {(3, 8, "zorgh")}
    assert toxic_lexicon.toxicity(docs.limit(0), labels.limit(0)).count() == 0


# --- op13 -----------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    i, text, lang, source, n = row
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(said, (i, source, lang, None if n is None else n + more, text)))


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


@pytest.mark.parametrize(("arity", "sizes"), [(2, (1, 2, 3, 64, 65, 300)), (3, (1, 4, 28, 800))])
def test_manifest(spark, arity, sizes):
    """Groups below, at and above a block of levels; null and repeated ids, equal rows, nulls, empty and long texts, clashing columns."""
    rng, rows = random.Random(7), []
    for g, n in enumerate(sizes):
        rows += [(rng.randrange(10_000), rng.choice(["", "a", "é" * 50, None]), None if g == 1 else f"g{g}", rng.choice(["s", None]), rng.choice([1, None])) for _ in range(n)]
    rows += [rows[-1]] * 3 + [(None, "x" * 200_000, "é", None, 4), (7, None, "", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("grp", F.lit("x")).withColumn("node", F.lit(1)).repartition(6)
    suspect = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle_manifest.manifest(df, "doc_id", ("doc_id", "source", "lang", "n_chars", "text"), "lang", {"n_chars": F.col("n_chars") + 1}, suspect, arity).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, want = {}, []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in groups[g]], arity)
    upper = tree([trees[g][-1][0] for g in names], arity)
    root = upper[-1][0]
    for k, g in enumerate(names):
        for p, r in enumerate(groups[g]):
            node = leaf_of(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf_of(r)
            siblings = []
            for levels, at in ((trees[g], p), (upper, k)):
                for level in levels[:-1]:
                    start = at // arity * arity
                    run = level[start : start + arity]
                    left, right = "".join(run[: at - start]), "".join(run[at - start + 1 :])
                    siblings.append(left + right)
                    node, at = sha(left, node, right), at // arity
            want.append((r[0], leaf_of(r), trees[g][-1][0], root, sha(*siblings), node, node == root))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, sha(*(x.before + x.after for x in r.proof)), r.folded_root, r.verified) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert merkle_manifest.document_manifest(df.limit(0)).count() == 0


def test_ranked(spark):
    rows = [("a" if i % 3 else "b", i * 7 % 50, i) for i in range(200)]
    found = ordering.ranked(spark.createDataFrame(rows, "g string, x int, salt int").repartition(5), "g", "x", "salt").collect()
    for g in "ab":
        assert [(r.x, r.salt) for r in sorted((r for r in found if r.g == g), key=lambda r: r.pos)] == sorted((x, s) for n, x, s in rows if n == g)
        assert sorted(r.pos for r in found if r.g == g) == list(range(sum(n == g for n, _, _ in rows)))


# --- others ---------------------------------------------------------------


def links_of(x, least=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= least
    np.fill_diagonal(link, False)
    return link.sum(axis=1).tolist()


def test_embeddings_of_many_cells_and_lengths(spark):
    """Every link is found, with default sizes: more than twenty cells, and more lengths than get centroids."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 12))
    x = centres[rng.integers(0, 60, 1_800)] + 0.25 * rng.standard_normal((1_800, 12))
    others = [rng.standard_normal((70, d)) for d in range(2, 21) if d != 12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = dict(enumerate(links_of(x)))
    for part in others:
        n = len(rows)
        rows += [(n + i, v.tolist()) for i, v in enumerate(part)]
        want |= {n + i: k for i, k in enumerate(links_of(part))}
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    assert found == want


def test_copies_of_a_class_stay_flat(spark, monkeypatch):
    """With clustered vectors, what is placed for each class doesn't grow with the number of units."""
    monkeypatch.setattr(embedding_dedup, "SHARE", 10_000)
    placed, each = embedding_dedup._placed, []

    def counted(homes, centroids, units, least):
        rows = placed(homes, centroids, units, least)
        each.append(rows.count() / homes.count())
        return rows

    monkeypatch.setattr(embedding_dedup, "_placed", counted)
    rng = np.random.default_rng(9)
    for clusters in (20, 100):
        centres = rng.standard_normal((clusters, 32))
        x = np.repeat(centres, 64, axis=0) + 0.02 * rng.standard_normal((clusters * 64, 32))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        assert {r.n_links for r in embedding_dedup.near_duplicates(df).collect()} == {63}
    assert each[1] < 1.6 * each[0]


def test_spans_of_a_very_long_text():
    """Twenty thousand keys in one text; the same spans as by comparing each pair."""
    rng = random.Random(3)
    line = lambda: f"token = {rng.randbytes(12).hex()[:20]} and " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40))
    thresholds = [8] * len(secret_scan.BANDS)
    short = " ".join(line() for _ in range(60))
    base, every = secret_scan.all_spans(short, thresholds)
    added = [s for s in every if s[2] == "random"]
    assert len(added) > 40 and not any(x < b and a < y for x, y, _ in base for a, b, _ in added)
    long = " ".join(line() for _ in range(20_000))
    secret_scan.tested(long[:1_000])
    start = time.process_time()
    found = secret_scan.tested(long)
    tests = time.process_time() - start
    start = time.process_time()
    assert len(secret_scan.all_spans(long, thresholds)[0]) == 20_000
    assert time.process_time() - start < 2 * tests + 5 and len(found) >= 20_000
