"""Quality classifier from weak labels.

Overlapping heuristic labellers look at a whole text and vote good, bad or
nothing.  How often each pattern of votes occurs over all texts is a table of
bounded size (three to the number of labellers), and expectation-maximisation
on it estimates the share of good texts and every labeller's accuracy on each
class, without any given label.  The posterior of a text is that of its
pattern.

Posterior labels then train a linear scorer on hashed features (pairs of
neighbouring bytes, and coarse steps of the text's measures), fitted on a
bounded sample of texts and applied to all.  The scorer decides.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolkit.llm.batches import bounded_batches, texts_of
from spoolkit.llm.shingles import mix, word_hashes
from spoolkit.storage import stored

#: Different texts of each class on which the scorer is fitted, at most.
SAMPLE = 3_000
#: Hashed features: pairs of bytes, then steps of measures.
PAIR_SLOTS, STEP_SLOTS = 4_096, 1_024
ROUNDS = 60  # of expectation-maximisation
STEPS, RATE, DECAY = 300, 0.05, 1e-4

#: A labeller: name, measure, and the intervals of the measure that it calls good and bad.
LABELLERS = (
    ("letter_case", "upper", (0.0, 0.15), (0.5, 1.01)),
    ("signs", "signs", (-0.01, 0.01), (0.05, 1.01)),
    ("stuttering", "stutter", (-0.01, 0.03), (0.15, 1.01)),
    ("repeated_triples", "triples", (-0.01, 0.15), (0.4, 1.01)),
    ("sentence_length", "sentence", (2.0, 30.0), (60.0, 1e12)),
    ("capital_words", "capitals", (0.0, 0.25), (0.45, 1.01)),
    ("variety", "variety", (0.45, 1.01), (-0.01, 0.25)),
    ("bare_signs", "bare", (-0.01, 0.02), (0.15, 1.01)),
    ("word_length", "length", (4.0, 6.5), (7.5, 1e12)),
)
MEASURES = tuple(m for _, m, _, _ in LABELLERS)
#: Words below which the labellers of word statistics don't vote.
FEW_WORDS = 20

_pair_slot = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PAIR_SLOTS)).astype(np.int32)
_is = {name: np.isin(np.arange(256), list(chars)) for name, chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("space", (9, 10, 11, 12, 13, 32)), ("stop", (33, 46, 63)))}
_is["sign"] = np.array([33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?" for c in range(256)])
_is["word"] = np.array([c > 127 or chr(c).isalnum() for c in range(256)])


def measures(text: str) -> dict[str, float] | None:
    """The measures of a text; None if it has no word."""
    raw = np.frombuffer(text.encode(errors="surrogatepass"), np.uint8)
    words = word_hashes(text)
    n = len(words)
    if not n:
        return None
    count = np.bincount(raw, minlength=256)
    of = lambda name: int(count[_is[name]].sum())
    letters = of("upper") + of("lower")
    inside = ~_is["space"][raw]
    first = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    worded = np.add.reduceat(_is["word"][raw].astype(np.int32), first)
    triples = mix(mix(words[:-2]) + words[1:-1] * np.uint64(3)) + words[2:] * np.uint64(5) if n > 2 else words[:0]
    return {
        "upper": of("upper") / letters if letters else 0.0,
        "signs": of("sign") / len(raw),
        "stutter": float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0,
        "triples": 1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0,
        "sentence": n / max(1, of("stop")),
        "capitals": float(_is["upper"][raw[first]].mean()),
        "variety": len(np.unique(words)) / n,
        "bare": float((worded == 0).mean()),
        "length": (len(raw) - of("space")) / n,
        "words": float(n),
    }


def votes(m: dict[str, float] | None) -> tuple[int, ...]:
    """1 good, -1 bad, 0 nothing, of each labeller."""
    if m is None:
        return (0,) * len(LABELLERS)
    out = []
    for name, measure, good, bad in LABELLERS:
        x = m[measure]
        silent = m["words"] < FEW_WORDS and name in ("stuttering", "repeated_triples", "variety", "sentence_length", "capital_words", "word_length")
        out.append(0 if silent else 1 if good[0] < x <= good[1] else -1 if bad[0] < x <= bad[1] else 0)
    return tuple(out)


@dataclass
class LabelModel:
    """The share of good texts, and the chance of each vote of each labeller on bad and good texts."""

    good: float
    chance: np.ndarray  # labellers, class (bad, good), vote (-1, 0, 1)

    @classmethod
    def fit(cls, patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> LabelModel:
        rows = np.array(sorted(patterns), int).reshape(-1, len(LABELLERS))
        n = np.array([patterns[tuple(r)] for r in rows.tolist()], float)
        # the first guess: any bad vote
        p = np.where((rows < 0).any(axis=1), 0.1, 0.9) if len(rows) else np.zeros(0)
        model = cls(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
        for _ in range(rounds if len(rows) else 0):
            weight = np.stack([n * (1 - p), n * p])
            chance = np.stack([[weight[c] @ (rows == v) for v in (-1, 0, 1)] for c in (0, 1)])  # class, vote, labeller
            chance = (chance + 0.5) / (chance.sum(axis=1, keepdims=True) + 1.5)
            model = cls(float((weight[1].sum() + 1) / (n.sum() + 2)), chance.transpose(2, 0, 1))
            p = np.array([model.posterior(tuple(r)) for r in rows.tolist()])
        return model

    def posterior(self, pattern: tuple[int, ...]) -> float:
        """The chance that a text with these votes is good."""
        logs = np.log([1 - self.good, self.good])
        for table, v in zip(self.chance, pattern, strict=True):
            if v:  # silence says nothing
                logs = logs + np.log(table[:, v + 1])
        return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))


def features(text: str, m: dict[str, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) of the hashed features of a text; the weights of each kind sum to one."""
    raw = np.frombuffer(text.encode(errors="surrogatepass"), np.uint8).astype(np.int32)
    pairs = np.bincount(_pair_slot[raw[:-1] << 8 | raw[1:]], minlength=PAIR_SLOTS) if len(raw) > 1 else np.zeros(PAIR_SLOTS)
    slots = np.flatnonzero(pairs)
    weights = np.sqrt(pairs[slots] / max(1, len(raw) - 1))
    if m is None:
        return slots, weights
    steps = [PAIR_SLOTS + zlib.crc32(f"{k}:{int(np.floor(np.log2(m[k] + 0.01) * 2))}".encode()) % STEP_SLOTS for k in MEASURES]
    return np.concatenate([slots, steps]), np.concatenate([weights, np.full(len(steps), 1.0)])


class Scorer:
    """A logistic model over the hashed features."""

    def __init__(self):
        self.w, self.b = np.zeros(PAIR_SLOTS + STEP_SLOTS), 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, weight: np.ndarray) -> None:
        """Full-batch Adam on the weighted log loss."""
        if not rows:
            return
        slots, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        weight = weight / weight.sum()
        m = v = np.zeros(len(self.w) + 1)
        for t in range(1, STEPS + 1):
            z = np.bincount(of, weights=self.w[slots] * values, minlength=len(rows)) + self.b
            d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
            g = np.append(np.bincount(slots, weights=values * d[of], minlength=len(self.w)) + DECAY * self.w, d.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w, self.b = self.w - step[:-1], self.b - float(step[-1])

    def score(self, row: tuple[np.ndarray, np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.w[row[0]] @ row[1] + self.b, -30, 30))))


def _patterns(docs: DataFrame) -> dict[tuple[int, ...], int]:
    """How often each pattern of votes occurs over all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            seen.update("".join("-0+"[v + 1] for v in votes(measures(t))) for t in texts_of(batch.column(0)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pattern", "n"])

    found = docs.select("text").mapInArrow(work, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {tuple("-0+".index(c) - 1 for c in r.pattern): r.n for r in found.collect()}  # at most 3 ** 9 rows


def train(docs: DataFrame) -> tuple[LabelModel, Scorer]:
    """The label model of all texts of ``docs`` (text), and the scorer fitted on at most ``SAMPLE`` different texts of each class."""
    bounded_batches(docs.sparkSession)
    patterns = _patterns(docs)
    labels = LabelModel.fit(patterns)
    by_class = {good: sum(n for p, n in patterns.items() if (labels.posterior(p) >= 0.5) == good) for good in (True, False)}
    space = 1 << 20
    share = {good: int(space * min(1.0, 0.9 * SAMPLE / n)) if n else 0 for good, n in by_class.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for draw, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                m = measures(text)
                p = labels.posterior(votes(m))
                if draw < share[p >= 0.5]:
                    slots, weights = features(text, m)
                    rows.append((draw, copy, p, slots.astype("<i4").tobytes(), weights.astype("<f8").tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["draw", "copy", "p", "slots", "weights"])

    # texts are drawn by their hash, so copies are drawn together, and count once
    whole = F.coalesce("text", F.lit(""))
    draw = F.pmod(F.xxhash64(whole), F.lit(space)).alias("draw")
    sampled = stored(docs.select(draw, F.xxhash64(whole, F.lit(1)).alias("copy"), "text").where(F.col("draw") < max(share.values())).mapInArrow(work, "draw long, copy long, p double, slots binary, weights binary").dropDuplicates(["draw", "copy"]), "sample")
    rows = []
    for good in (True, False):
        part = sampled.where((F.col("p") >= 0.5) == F.lit(good)).orderBy("draw", "copy").limit(SAMPLE).collect()
        rows += sorted(part, key=lambda r: (r.draw, bytes(r.slots)))
    scorer = Scorer()
    p = np.array([r.p for r in rows])
    scorer.fit([(np.frombuffer(bytes(r.slots), "<i4"), np.frombuffer(bytes(r.weights), "<f8")) for r in rows], p, np.where(p >= 0.5, 1 / max(1, (p >= 0.5).sum()), 1 / max(1, (p < 0.5).sum())))
    return labels, scorer


def judge(text: str, labels: LabelModel, scorer: Scorer) -> tuple[float, float, int]:
    """(posterior, score, labellers that voted) of a text; a text without words scores 0."""
    m = measures(text)
    v = votes(m)
    return labels.posterior(v), scorer.score(features(text, m)) if m else 0.0, sum(map(abs, v))


def classify(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id, n_votes, posterior, score, kept`` for each row of ``docs`` (doc_id, text).

    ``posterior`` is the label model's chance that the text is good, ``score``
    the linear scorer's; a text is kept at ``score`` >= ``least``.  A null,
    empty or wordless text scores 0.  Null ids stay null, repeated rows give
    repeated rows, an empty table gives none; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs))  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t, *held.value) for t in texts_of(batch.column(1))]
            p, s, n = (np.array([f[i] for f in found], float) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(p), pa.array(s), pa.array(s >= least)], ["doc_id", "n_votes", "posterior", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_votes long, posterior double, score double, kept boolean")


def good_only(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs))  # of fixed size
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(t, *held.value)[1] >= least for t in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
