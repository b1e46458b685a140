"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded character by character: case, compatibility forms and homoglyphs
become plain letters, ``l`` and ``i`` are one letter, and digits and signs that
stand for letters inside a word become these, so an offset in the folded text is one
in the text.  Accents stay.  All else is a blank.

The lexicon holds whole words and beginnings of words.  Its weights are learnt from
labelled texts: an entry's support is the number of different contexts (the words
on both sides) in which toxic and other texts have it, so copies and near copies
of a text count once.  Entries are kept whose share of toxic contexts is far from
chance (a G test at a bound for all candidates) and that occur in several texts by
this count; of an entry and its beginning, the shorter one is enough if it is as
strong.  An exception phrase is an entry with the word before or after it
that occurs in other texts in contexts of its own: there the entry counts for nothing.

A text's score is a logistic function of its weights' sum and of the sum for each
word, so the same words weigh less in a longer text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolkit.llm.batches import bounded_batches, longs, texts_of
from spoolkit.storage import stored

#: Labelled texts of each label that are learnt from, at most (in expectation), and entries that a lexicon holds.
SAMPLE, ENTRIES = 8_000, 20_000
#: Letters of beginnings, letters of the longest word that is an entry.
SHORTEST, LONGEST, WORD = 3, 12, 40
#: An entry's least G, contexts in toxic texts, texts, and share of contexts there.
LEAST_G, CONTEXTS, TEXTS, PURE = 30.0, 5, 2, 0.6
#: Of a beginning: the least share, and its support against that of the strongest longer entry.
PURE_START, BRANCHES = 0.8, 1.15
#: Contexts in other texts, and most share of toxic ones, of an exception phrase.
EXCEPT, EXCEPT_SHARE = 4, 0.1

# Letters that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ո": "n", "ս": "u", "օ": "o",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ѵ": "v", "ſ": "s", "ʀ": "r", "ɴ": "n", "ʟ": "l", "ꜱ": "s", "ᴏ": "o", "ᴄ": "c",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}


class _Fold(dict):
    """A character to its folded form, as a table that fills itself."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c).lower()
        plain = plain if len(plain) == 1 else c.lower() if len(c.lower()) == 1 else c
        plain = HOMOGLYPHS.get(plain, plain)
        if plain == "l":
            plain = "i"
        if not (plain.isalpha() or plain in STAND_INS or plain.isdigit() or unicodedata.category(plain) == "Mn"):
            plain = " "
        self[code] = ord(plain)
        return self[code]


_TABLE = _Fold()
_MIXED = re.compile(r"[^ ]*[\d@$!|][^ ]*")
_STAND_INS = str.maketrans(STAND_INS)
_BLANKS = str.maketrans({c: " " for c in "0123456789@$!|"})


def _letters(word: re.Match) -> str:
    """Stand-ins between letters become letters; those at a word's end, and numbers, become blanks."""
    w = word.group()
    core = w.rstrip("!|")
    if sum(map(str.isalpha, core)) * 3 < len(core):
        return "".join(c if c.isalpha() else " " for c in w)
    return core.translate(_STAND_INS).translate(_BLANKS) + " " * (len(w) - len(core))


def fold(text: str) -> str:
    """The text as words of folded letters, one character for each."""
    return _MIXED.sub(_letters, text.translate(_TABLE))


@dataclass
class Lexicon:
    """Entries to weights (`` word `` with blanks on both sides is a whole word, `` be`` a beginning), phrases that are exceptions, and the logistic function."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def matches(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, word as folded, weight) of each toxic word, exceptions left out."""
        return self._found(fold(text))

    def _found(self, folded: str) -> list[tuple[int, int, str, float]]:
        if not self.weights:
            return []
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                made.add_word(entry, (len(entry), weight))
            made.make_automaton()
            self._automaton = made
        whole = f" {folded} "
        best: dict[int, float] = {}
        for end, (size, weight) in self._automaton.iter(whole):
            start = end - size + 1  # of the blank before the word
            best[start] = max(best.get(start, weight), weight)
        out = []
        for start, weight in sorted(best.items()):
            end = whole.index(" ", start + 1)
            word = whole[start + 1 : end]
            if self.exceptions:
                before = whole[:start].rstrip()
                before = before[before.rfind(" ") + 1 :] if before else ""
                after = whole[end:].lstrip()
                after = after[: after.find(" ")] if " " in after else after
                if f"{before} {word}" in self.exceptions or f"{word} {after}" in self.exceptions:
                    continue
            out.append((start, end - 1, word, weight))
        return out

    def features(self, text: str, matched: list | None = None) -> tuple[float, float]:
        """log(1 + sum of weights), and the weights for a hundred words, at most 10; of a folded text."""
        total = sum(m[3] for m in (self._found(text) if matched is None else matched))
        return math.log1p(total), min(10.0, 100.0 * total / max(1, len(text.split()))) if total else 0.0

    def judged(self, text: str) -> tuple[int, float]:
        """How many toxic words a text has, and its score."""
        folded = fold(text)
        matched = self._found(folded)
        x, y = self.features(folded, matched)
        z = self.curve[0] + self.curve[1] * x + self.curve[2] * y
        return len(matched), 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(points: list[tuple[float, float, float, float]], ridge: float = 1.0, rounds: int = 30) -> tuple[float, float, float]:
    """Newton's method for rows (x, y, toxic, others); slopes are held back by ``ridge`` and never negative."""
    x = np.array([[1.0, p[0], p[1]] for p in points])
    hit, n = np.array([p[2] for p in points]), np.array([p[2] + p[3] for p in points])
    used = [0, 1, 2]
    while True:
        w = np.zeros(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (hit - n * p) - ridge * np.array([0.01, 1, 1]) * w
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.diag([0.01, 1, 1])
            step = np.zeros(3)
            step[used] = np.linalg.solve(curve[np.ix_(used, used)], slope[used])
            w += np.clip(step, -4, 4)
        wrong = [i for i in used[1:] if w[i] < 0]
        if not wrong:
            return float(w[0]), float(w[1]), float(w[2])
        used.remove(min(wrong, key=lambda i: w[i]))


def _sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """``doc, toxic, text`` (folded) of the labelled texts that are learnt from, and how many each stands for."""
    one = stored(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")), "labels")
    sizes = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    space = 1 << 40
    least = F.create_map(*(F.lit(x) for label in (0, 1) for x in (label, int(space * min(1.0, SAMPLE / sizes.get(label, 1))))))
    drawn = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < least[F.col("toxic")])  # 2 SAMPLE ids, give or take: small whatever the table's size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fold(t) for t in texts_of(batch.column(2))], pa.string())], ["doc", "toxic", "text"])

    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return stored(found.select("doc_id", "toxic", "text").mapInArrow(work, "doc long, toxic int, text string"), "sample"), {k: max(1.0, n / SAMPLE) for k, n in sizes.items()}


def _g(a, b, share):
    """Twice the log likelihood ratio of a toxic and b other contexts against chance."""
    n = a + b
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    return 2 * (part(a, F.lit(share)) + part(b, F.lit(1 - share)))


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) mark.

    At most about ``SAMPLE`` texts of each label are used, drawn by the hash of
    their id, and the ``ENTRIES`` strongest entries; these bounds don't depend on
    the tables.  Without toxic or without other labels every score is the share of
    toxic ones.
    """
    bounded_batches(docs.sparkSession)
    sample, weight = _sampled(docs, labels)
    words = F.filter(F.split("text", " +"), lambda w: w != "")
    near = lambda i, d: F.coalesce(F.get("ws", i + d), F.lit(""))
    spread = sample.withColumn("ws", words).select("doc", "toxic", "ws", F.posexplode("ws").alias("i", "w")).select("doc", "toxic", F.substring("w", 1, WORD).alias("w"), near(F.col("i"), -1).alias("l"), near(F.col("i"), 1).alias("r"))
    # a context counts once for a label, as of the first text that has it
    contexts = stored(spread.groupBy("w", "l", "r", "toxic").agg(F.min("doc").alias("doc")), "contexts")
    by_word = stored(contexts.groupBy("w").agg(F.count_if(F.col("toxic") == 1).cast("double").alias("a"), F.count_if(F.col("toxic") == 0).cast("double").alias("b")), "words")
    total = by_word.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    lexicon = Lexicon()
    if total.a and total.b:
        share = total.a / (total.a + total.b)
        long = F.length("w")
        starts = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), long - 1)), lambda n: F.concat(F.lit(" "), F.substring("w", F.lit(1), n)))
        whole = F.array(F.concat(F.lit(" "), "w", F.lit(" ")))
        entries = F.when(long > SHORTEST, F.concat(whole, starts)).otherwise(whole)
        strong = by_word.select(F.explode(entries).alias("e"), "a", "b").groupBy("e").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where((F.col("a") >= CONTEXTS) & (F.col("a") >= PURE * (F.col("a") + F.col("b")))).withColumn("g", _g(F.col("a"), F.col("b"), share)).where(F.col("g") >= LEAST_G)
        strong = stored(strong, "entries")
        hits = contexts.where("toxic = 1").select("w", "doc").distinct().withColumn("e", F.explode(entries)).select("e", "doc").join(strong.select("e"), "e", "left_semi").distinct()
        kept = strong.join(hits.groupBy("e").agg(F.count("*").alias("texts")).where(F.col("texts") >= TEXTS), "e").orderBy(F.desc("g"), "e").limit(ENTRIES).collect()
        odds = {r.e: math.log((r.a + 0.5) / (r.b + 0.5)) - math.log(share / (1 - share)) for r in kept}
        support, pure = {r.e: r.a for r in kept}, {r.e: r.a / (r.a + r.b) for r in kept}
        starts_of = {e: [s for n in range(SHORTEST + 1, len(e)) if (s := e[:n]) in odds] for e in odds}
        longer = dict.fromkeys(odds, 0.0)
        for e, shorter in starts_of.items():
            for s in shorter:
                longer[s] = max(longer[s], support[e])
        # a beginning with little besides one longer entry is but that entry
        odds = {e: w for e, w in odds.items() if e.endswith(" ") or (pure[e] >= PURE_START and support[e] >= BRANCHES * longer[e])}
        # one that is as sure as what it begins says it all
        odds = {e: w for e, w in odds.items() if not any(s in odds and odds[s] >= w - 0.7 for s in starts_of[e])}
        lexicon.weights = {e: w for e, w in odds.items() if w > 0}
        lexicon.exceptions = _exceptions(sample, lexicon)
    lexicon.curve = _curve(sample, lexicon, weight)
    return lexicon


def _exceptions(sample: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Phrases of two words that hold an entry and that other texts have between several pairs of words, toxic ones seldom."""
    held = sample.sparkSession.sparkContext.broadcast(lexicon)  # ENTRIES entries at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, end, word, _ in held.value._found(text):
                    before, after = text[max(0, start - 4 * WORD) : start].split()[-2:], text[end : end + 4 * WORD].split()[:2]
                    l2, l1 = (["", ""] + before)[-2:]
                    r1, r2 = (after + ["", ""])[:2]
                    rows += [(toxic, f"{l1} {word}", f"{l2} {r1}")] * (l1 != "") + [(toxic, f"{word} {r1}", f"{l1} {r2}")] * (r1 != "")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True)], ["toxic", "phrase", "around"])

    phrases = sample.select("toxic", "text").mapInArrow(work, "toxic int, phrase string, around string").distinct()
    counted = phrases.groupBy("phrase").agg(F.count_if(F.col("toxic") == 0).alias("b"), F.count("*").alias("n")).where((F.col("b") >= EXCEPT) & (F.col("n") - F.col("b") <= EXCEPT_SHARE * F.col("n")))
    return frozenset(r.phrase for r in counted.orderBy(F.desc("b"), "phrase").limit(ENTRIES).collect())


def _curve(sample: DataFrame, lexicon: Lexicon, weight: dict[int, float]) -> tuple[float, float, float]:
    """The logistic function, fitted on counts of texts by features (in steps, so the table is small)."""
    held = sample.sparkSession.sparkContext.broadcast(lexicon)  # ENTRIES entries at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.features(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(x * 8) for x, _ in found], pa.int32()), pa.array([round(y * 8) for _, y in found], pa.int32())], ["toxic", "x", "y"])

    table = sample.select("toxic", "text").mapInArrow(work, "toxic int, x int, y int").groupBy("x", "y").pivot("toxic", [0, 1]).count().fillna(0).collect()
    points = [(r.x / 8, r.y / 8, r["1"] * weight.get(1, 1.0), r["0"] * weight.get(0, 1.0)) for r in table]
    return logistic(sorted(points)) if points else Lexicon().curve


def score(docs: DataFrame, lexicon: Lexicon, least: float = 0.7) -> DataFrame:
    """``docs`` (doc_id, text) as ``doc_id, n_matches, score, predicted``.

    ``score`` is the chance that a text is toxic, ``predicted`` is 1 from
    ``least`` on.  A null text is empty; an empty text scores as one without
    toxic words.  A null id stays null, repeated rows give repeated rows, an empty
    table gives none; other columns are ignored.  Whole texts are matched,
    however long.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # ENTRIES entries at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            found = [held.value.judged(t) for t in texts]
            scores = [s for _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), longs([n for n, _ in found]), pa.array(scores), pa.array([int(s >= least) for s in scores], pa.int32())], ["doc_id", "n_matches", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_matches long, score double, predicted int")


def found_words(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, start, end, word, weight``: each toxic word of each text, by code points."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True) for m in held.value.matches(t)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "end", "word", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, start long, end long, word string, weight double")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: the CRC-32 of their id leaves 1 when divided by three."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_matches, score, predicted`` of all ``docs``, learnt from those labels that aren't held out."""
    lexicon = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, lexicon).withColumn("held_out", held_out(F.col("doc_id")))
