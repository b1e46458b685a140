"""Secret scans: fixed patterns plus a battery of randomness tests.

The battery looks at every run of 20 or more characters of
``A-Za-z0-9+/_=-``.  The narrowest alphabet that holds the run (digits, hex,
base32, single-case letters, letters with digits, base64) is its encoding.
Under the hypothesis that the run is *written* (words, names, paths), two
p-values are computed:

- chi-squared uniformity over the alphabet: its statistic is a function of the
  coincidences between symbols, which written runs have in excess; p is the
  chance that a written run shows so few;
- runs test: p is the chance that a written run changes between lower case,
  upper case, digits and signs so often.

Fisher's method joins them.  A run must also not be rejected as *random*: its
chi-squared statistic mustn't be too large for its alphabet, and the serial
correlation of neighbouring symbols must be near zero, which rules out
counters, alphabets and repetitions.

A run often holds more than the secret, as in ``NAME=value`` and ``/path/value``,
and is then neither written nor random as a whole.  So its parts between signs
are tested as well: split at ``=`` (padding at the end stays), these at ``/``,
and these at ``_`` and ``-``; as random values may hold such signs themselves, up
to ``JOINED`` neighbouring parts are also tested together.  Finds that overlap
are one find.

All runs and parts of the corpus are tested together.  A histogram of the p-values for
each band of lengths (bounded, whatever the corpus) gives the Benjamini-Hochberg
threshold of that band, so long runs, which have more power, don't pay for short
ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolkit.llm.batches import bounded_batches, texts_of

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is taken whole, so this equals taking all runs and dropping short ones
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Least length of what is tested, and neighbouring parts of a run that are tested together, at most.
LEAST, JOINED = 20, 4
#: Expected share of wrong finds among the added ones of each band.
FALSE_DISCOVERY = 0.01
#: Lengths that begin a new band.
BANDS = (20, 28, 40, 64, 128)
#: Steps of -log10 p in the histogram: quarters up to 25.
STEPS, STEPS_PER_DECADE = 100, 4
#: A run is not random if a test for randomness has a p below this.
NOT_RANDOM = 1e-3
#: Written text: sum of squares and of cubes of letter shares, and the share of places where the class of characters changes.
COINCIDENCE, TRIPLE, CHANGES = 0.066, 0.0057, 0.08

_ENCODINGS = (("digits", "[0-9]+", 10), ("hex", "[0-9a-f]+|[0-9A-F]+", 16), ("base32", "[A-Z2-7]+", 32), ("letters", "[a-z]+|[A-Z]+", 26), ("alnum", "[a-z0-9]+|[A-Z0-9]+", 36), ("base64", ".+", 64))
_ENCODINGS = tuple((name, re.compile(p), size) for name, p, size in _ENCODINGS)
_CLASS = str.maketrans({c: k for k, cs in (("l", "abcdefghijklmnopqrstuvwxyz"), ("u", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("d", "0123456789"), ("s", "+/_=-")) for c in cs})


def _below(z: float) -> float:
    """Chance of a standard normal value below z."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def encoding_of(run: str) -> tuple[str, int]:
    return next((name, size) for name, p, size in _ENCODINGS if p.fullmatch(run))


def written_p(run: str) -> float:
    """The p-value of ``run`` as written text; 1 if it isn't random either."""
    body = run.rstrip("=")
    n = len(body)
    if n < 2:
        return 1.0
    _, size = encoding_of(body)
    pairs = sum(c * (c - 1) for c in Counter(body).values())
    chi = size * (pairs + n) / n - n
    if _below(-(chi - (size - 1)) / math.sqrt(2 * (size - 1))) < NOT_RANDOM:
        return 1.0
    codes = np.frombuffer(body.encode(), np.uint8).astype(float)
    codes -= codes.mean()
    spread = float(codes @ codes)
    serial = float(codes[:-1] @ codes[1:]) / spread if spread else 1.0
    if 2 * _below(-abs(serial) * math.sqrt(n)) < NOT_RANDOM:
        return 1.0
    k2 = max(COINCIDENCE, 2 / size)
    k3 = max(TRIPLE, (2 / size) ** 2 * 1.3)
    spread = math.sqrt(2 * n * (n - 1) * k2 * (1 - k2) + 4 * n * (n - 1) * (n - 2) * max(0.0, k3 - k2 * k2))
    p_chi = _below((pairs - n * (n - 1) * k2) / spread)
    classes = body.translate(_CLASS)
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    m = n - 1
    p_runs = sum(math.comb(m, i) * CHANGES**i * (1 - CHANGES) ** (m - i) for i in range(changes, m + 1)) if m < 400 else _below(-(changes - m * CHANGES) / math.sqrt(m * CHANGES * (1 - CHANGES)))
    joint = max(p_chi, 1e-300) * min(1.0, max(p_runs, 1e-300))
    return min(1.0, joint * (1 - math.log(joint)))


def parts_of(run: str) -> list[tuple[int, int]]:
    """(start, end) of the run and of those of its parts, single and joined, that are long enough."""
    body = len(run.rstrip("="))
    level, found = [(0, len(run))], {(0, len(run))}
    for signs in ("=", "/", "_-"):
        below = []
        for start, end in level:
            cuts = [i for i in range(start, min(end, body)) if run[i] in signs]
            pieces = [(a + 1, b) for a, b in zip([start - 1, *cuts], [*cuts, end], strict=True)]
            below += pieces
            for n in range(1, JOINED + 1):
                found.update((a, b) for (a, _), (_, b) in zip(pieces, pieces[n - 1 :], strict=False) if b - a >= LEAST)
        level = [(a, b) for a, b in below if b - a >= LEAST]
    return sorted(found)


def tested(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, band, step) of every run, and part of one, that the battery tests."""
    out = []
    for m in RUN.finditer(text):
        run = m.group()
        for a, b in parts_of(run):
            band = sum(b - a >= x for x in BANDS) - 1
            step = min(STEPS - 1, int(-math.log10(max(written_p(run[a:b]), 1e-300)) * STEPS_PER_DECADE))
            out.append((m.start() + a, m.start() + b, band, step))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then as the kinds are listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(start, end, KINDS[kind]) for start, kind, end in sorted(found)]


def all_spans(text: str, thresholds: list[int]) -> tuple[list, list]:
    """The base spans, and these with what the battery adds; an added one overlaps no base span and no other added one."""
    base = base_spans(text)
    starts = [x for x, _, _ in base]
    reach = list(accumulate((y for _, y, _ in base), max))  # how far the base spans up to each one reach
    added: list[tuple[int, int, str]] = []
    for a, b, band, step in tested(text):  # by start
        before = bisect_left(starts, b)
        if step >= thresholds[band] and not (before and reach[before - 1] > a):
            if added and a < added[-1][1]:
                a, b = added[-1][0], max(b, added.pop()[1])
            added.append((a, b, "random"))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else base


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def thresholds_of(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> list[int]:
    """For each band of lengths, the least step of -log10 p that counts as a find, over all texts."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                seen.update((band, step) for _, _, band, step in tested(text))
        if seen:
            columns = zip(*((b, s, n) for (b, s), n in seen.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["band", "step", "n"])

    counts = docs.select("text").mapInArrow(count, "band long, step long, n long").groupBy("band", "step").agg(F.sum("n").alias("n"))
    histogram = np.zeros((len(BANDS), STEPS))
    for r in counts.collect():  # at most bands times steps rows
        histogram[r.band, r.step] = r.n
    out = []
    for row in histogram:
        found = row[::-1].cumsum()[::-1]
        p = 10.0 ** (-np.arange(STEPS) / STEPS_PER_DECADE)
        good = np.flatnonzero((found > 0) & (p * row.sum() <= false_discovery * found))
        out.append(int(good[0]) if len(good) else STEPS)
    return out


def scan(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, the end exclusive.  A null text
    counts as empty and has no spans; a null doc_id stays null; repeated rows
    give repeated rows; an empty table gives none; other columns are ignored.
    """
    thresholds = thresholds_of(docs, false_discovery)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list[int], ...] = ([], [], [])
            shas, spans = [], []
            for text in texts_of(batch.column(1)):
                base, found = all_spans(text, thresholds)
                for kind, held in zip(KINDS, counts, strict=False):
                    held.append(sum(s[2] == kind for s in base))
                shas.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(found))
            columns = [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted_text(text: str, thresholds: list[int]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans are replaced together."""
    spans = all_spans(text, thresholds)[1]
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"[{kind} removed]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; ``n_chars``, where present, follows.

    Null texts stay null; other columns pass through.
    """
    thresholds = thresholds_of(docs, false_discovery)
    at, counted = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redacted_text(t, thresholds) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted is not None:
                old = batch.column(counted).to_pylist()
                columns[counted] = pa.array([n if t is None else len(t) for n, t in zip(old, texts, strict=True)], batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(work, docs.schema)
