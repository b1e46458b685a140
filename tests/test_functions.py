import math

import pytest
from pyspark.sql import functions as F

from spoolkit.functions import commands, errors, stats, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


ERRORS = [
    ("ModuleNotFoundError: No module named 'yaml'", "module_not_found", "yaml"),
    ("command not found: foo", "command_not_found", "foo"),
    ("zsh: command not found: foo", "command_not_found", "zsh"),
    ("cat: x: No such file or directory", "file_not_found", ""),
    ("ENOENT: open 'a/b/c.txt'", "file_not_found", "c.txt"),
    ("3 tests failed", "test_failure", "3"),
    ("Blocked: rm ", "harness_blocked", "rm"),
    ("Permission denied", "permission", ""),
    ("error TS2304: x", "type_error", "2304"),
    ("Traceback (most recent call last)\n x\nKeyError: 'a'", "runtime_error", "keyerror"),
    ("usage: tool [x]", "usage_error", "tool"),
    ("request timed out", "timeout", ""),
    ("all fine", "other", ""),
    (None, "other", ""),
]


@pytest.mark.parametrize("body,kind,salient", ERRORS)
def test_error_classes(spark, body, kind, salient):
    assert tuple(value(spark, errors.classify_error(F.lit(body)))) == (kind, salient)


def test_normal_form(spark):
    body = "/Users/me/x at 2024-01-02T03:04:05Z id 123e4567-e89b-12d3-a456-426614174000 sha deadbeef12  n 4567\n"
    assert value(spark, errors.normalize_error_text(F.lit(body))) == "~<PATH> at <TS> id <UUID> sha <HASH> n <N>"


@pytest.mark.parametrize("code,body,command,benign", [(1, "", "grep x y", True), (1, "a.txt\nb.txt", "ls", True), (1, "error: x", "grep x", False), (3, "", "x", False), (2, "total 3\n-rw-r--r-- a", "x", True), (1, None, "x", False), (1, "what (is) [this]!", "make", False)])
def test_benign_exits(spark, code, body, command, benign):
    assert value(spark, errors.is_benign_nonzero(F.lit(code), F.lit(body), F.lit(command))) is benign


@pytest.mark.parametrize("command,head", [("FOO=1 sudo ls -la /tmp", "ls <PATH>"), ("cd /x && python3 -c 'import yaml; x'", "python3"), ("npm run test 2>&1 | tail", "npm run"), ("cd /x", "cd <PATH>"), ('echo "a; b" && rm x', "echo a; b"), ("", ""), (None, "")])
def test_heads(spark, command, head):
    expected = "cd" if command == "cd /x" else head
    assert value(spark, commands.cmd_head(F.lit("Bash"), F.lit(command), F.lit(None).cast("string"))) == expected


def test_signature(spark):
    head = commands.cmd_head(F.lit("bash"), F.lit("python3 -c 'import yaml'"), F.lit(""))
    assert value(spark, commands.error_signature(F.lit("Bash"), head, F.lit("ModuleNotFoundError: No module named 'yaml'"))) == "bash:module_not_found:python3:yaml"
    assert tuple(value(spark, commands.parse_signature(F.lit("a:b:c:d:e")))) == ("a", "b", "c:d", "e")
    assert value(spark, commands.cmd_head(F.lit("Edit"), F.lit(None), F.lit("/a/b/c.py/"))) == "c.py"


def test_text_helpers(spark):
    assert value(spark, text.tokens(F.lit("Foo bar /a/b 12345 baz foo ab"))) == ["foo", "bar", "baz"]
    assert value(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert value(spark, text.sparkline(F.array(*map(F.lit, [1.0, 2.0, 8.0])))) == "▁▂█"
    assert value(spark, text.changed_lines(F.lit("a\nb\nc"), F.lit("a\nx\nc"))) == 2
    assert value(spark, text.changed_lines(F.lit("a"), F.lit("a"))) == 0
    assert value(spark, text.escape_html(F.lit("<a b='c'>&"))) == "&lt;a b=&#39;c&#39;&gt;&amp;"
    assert len(value(spark, text.cap_middle(F.lit("x" * 5000)))) == 2048
    assert value(spark, text.redact(F.lit("mail a@b.com at $HOME hf_abcdefgh12 /etc/x y"))) == "mail <EMAIL> at <HOME> <SECRET> <PATH> y"
    assert value(spark, text.redact(F.lit("k " + "0a" * 16 + " " + "aB3" * 14))) == "k <SECRET> <SECRET>"
    assert value(spark, text.redact_exemplar(F.lit("rk-abcdefgh1 hf_abcdefgh1 password: hunter2; $home x"))) == "<SECRET> <SECRET> password=<SECRET>; <HOME> x"
    assert value(spark, text.redact(F.lit("token = abc sk-abcdefgh1 /a/b"), text.CAPTURE_REDACTIONS)) == "$1=<SECRET> <SECRET> <PATH>"
    assert value(spark, text.slug(F.lit("A b/C "))) == "a-b-c"


def test_intervals_and_designs(spark):
    w = value(spark, stats.wilson(F.lit(8), F.lit(10)))
    assert (round(w.lo, 4), round(w.hi, 4)) == (0.4902, 0.9433)
    assert tuple(value(spark, stats.wilson(F.lit(1), F.lit(0)))) == (0, 0, 1)
    assert abs(value(spark, stats.norm_cdf(F.lit(1.96))) - 0.975) < 1e-4
    assert stats.repeats_needed(0.06, 0.05) == 12
    assert stats.trials_needed(0.5, 0.05) == 1231
    assert stats.trials_needed_paired(0.25, 0.05) == 155
    assert math.isinf(stats.trials_needed(0.5, 0))


def test_random_draws_match_the_sequential_generator(spark):
    mask, seed, state, expected = 0xFFFFFFFF, 42, 42, []
    for _ in range(50):
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ (state >> 15)) * (state | 1)) & mask
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & mask
        expected.append((t ^ (t >> 14)) / 4294967296)
    found = [r.x for r in spark.range(50).select(stats.random_draw(F.col("id"), seed).alias("x")).collect()]
    assert found == expected


def test_bootstrap(spark):
    flat = spark.range(20).select(F.col("id").alias("task"), F.lit(0.5).alias("delta"))
    r = stats.bootstrap_mean(flat, iters=100).first()
    assert (r.n, r.point, r.lo, r.hi) == (20, 0.5, 0.5, 0.5)


def test_bootstrap_in_blocks_of_places(spark, monkeypatch):
    """Differences in blocks of seven, one task's draws in many parts, equal the draws one by one."""
    monkeypatch.setattr(stats, "PLACES", 7)
    n, iters = 50, 70
    xs = [((j * 37) % 50 - 20) / 16 for j in range(n)]
    draws = [r.x for r in spark.range(n * iters).select(stats.random_draw(F.col("id")).alias("x")).collect()]
    means = sorted(sum(xs[int(d * n)] for d in draws[i * n : (i + 1) * n]) / n for i in range(iters))
    rows = spark.createDataFrame([(j, xs[j]) for j in reversed(range(n))] + [(n, None)], "task long, delta double")
    r = stats.bootstrap_mean(rows, iters=iters).first()
    low, high = (means[int(q * (iters - 1))] + (q * (iters - 1) % 1) * (means[int(q * (iters - 1)) + 1] - means[int(q * (iters - 1))]) for q in (0.025, 0.975))
    assert r.n == n and abs(r.point - sum(xs) / n) < 1e-12 and abs(r.lo - low) < 1e-12 and abs(r.hi - high) < 1e-12
    assert tuple(stats.bootstrap_mean(rows.where("delta is null"), iters=iters).first()) == (None,) * 4


def test_literals_of_patterns():
    assert errors.literal_of(r"(?i)(\d+)\s+(?:tests?|specs?)\s+failed") == "failed"
    assert errors.literal_of(r"(?i)ENOENT(?:[^'\"]*x)?") == "enoent"
    assert errors.literal_of(r"colou?r") == "colo"


def test_classes_equal_the_rules_alone(spark):
    """With the literal guard and without, over texts that hold parts of patterns in odd case."""
    import random
    import re

    rng = random.Random(4)
    parts = [w for _, ps in errors.ERROR_RULES for p in ps for w in re.findall("[A-Za-z#:]{2,}", p)] + ["3", "'a b'", "\n", " ", "(x:1:2)", "at f"]
    texts = ["".join(rng.choice([str.upper, str.lower, str])(rng.choice(parts)) + rng.choice(["", " ", ": "]) for _ in range(rng.randrange(1, 9))) for _ in range(1_500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.lit("other")
    for name, ps in reversed(errors.ERROR_RULES):
        for p in ps:
            plain = F.when(F.col("t").rlike(p), name).otherwise(plain)
    assert df.select(errors.classify_error(F.col("t"))["error_class"].alias("a"), plain.alias("b")).where("a <> b").count() == 0
