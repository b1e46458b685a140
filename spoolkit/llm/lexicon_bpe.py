"""Byte-level BPE through a minimal acyclic transducer of frequent words.

The pieces that are frequent in the corpus, with their ids, are compiled into
an automaton whose states are merged when their right languages are equal
(Daciuk's incremental construction over sorted words).  Outputs come from
counting: a state knows how many words lie below each of its arcs, so the sum
along a path is the word's rank in sorted order (a minimal perfect hash), and
the rank points into one array of ids.  The automaton is a handful of flat
arrays in one file that each worker maps into memory.

A batch's new pieces walk the automaton together, a byte of every piece at a
time.  A piece that it doesn't hold is merged exactly by the ranks of the
vocabulary's merges.  Decoding gathers the bytes of the ids.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolkit.llm.batches import bounded_batches, runs_of, texts_of
from spoolkit.storage import stored

#: Words of the lexicon: a bound on what is compiled and sent to the workers.
LEXICON_WORDS = 65_536
#: Bytes of the longest word of the lexicon.
LEXICON_WORD_BYTES = 64
#: Pieces that a worker keeps; at the bound it starts anew.
CACHED_PIECES = 300_000
#: Characters of texts whose pieces are looked up and learnt together.
RUN_CHARS = 500_000
#: Pieces seen of late, in a dictionary small enough for the processor's caches.
NEAR_PIECES = 60_000
#: Longest word in bytes that is merged together with others of its length.
MERGED_TOGETHER = 40

#: Fixed value: the published pattern that splits texts for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_split = regex.compile(PATTERN)
_letters, _digits = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_plain_split = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_letters}]+| ?[{_digits}]+| ?[^\s{_letters}{_digits}]+|\s+(?!\S)|\s+")
_not_plain = re.compile("[^\t\n\r\x20-\x7e¡-ſ]")


def pieces_of(text: str) -> list[str]:
    """The pieces of a text; the narrow pattern stands in where both are the same."""
    return (_split if _not_plain.search(text) else _plain_split).findall(text)


def byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges, the bytes of each id, and special tokens, from a tokenizer file."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        before = spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError("not a byte-level vocabulary of this kind")
        letters, model = byte_letters(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        named = {i: s for s, i in model["vocab"].items()} | {i: None for i in self.special.values()}
        of_special = {i: s.encode() for s, i in self.special.items()}
        spelt = [of_special.get(i) or bytes(letters[c] for c in named[i]) if i in named else b"" for i in range(max(named) + 1)]
        self.lengths = np.array([len(b) for b in spelt], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.decimal = [str(i) for i in range(len(spelt))]
        ids = model["vocab"]
        self.of_byte = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        pairs = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.ranks, self.merged = np.array([*self.merges.values()], np.int64)[order].T
        self.byte_ids = np.array(self.of_byte, np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the lowest-ranked adjacent pair, leftmost first, until none is left.

        A heap holds the pairs that can merge, and links skip what has been merged,
        so a piece of n bytes takes n log n steps.
        """
        ids = [self.of_byte[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.merges.get((ids[i], ids[j]))):
                heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, new = heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has merged since
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers; words of one length are merged in step."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, rows in by_length.items():
            if length > MERGED_TOGETHER:
                for i in rows:
                    out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
                continue
            ids = self.byte_ids[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(len(rows), length)]
            rows = np.array(rows)
            while len(rows):
                if ids.shape[1] > 1:
                    keys = ids[:, :-1] << 32 | ids[:, 1:]
                    at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
                    rank = np.where(self.pairs[at] == keys, self.ranks[at], len(self.pairs))
                    best = rank.argmin(axis=1)
                    each = np.arange(len(rows))
                    more = rank[each, best] < len(self.pairs)
                else:
                    more = np.zeros(len(rows), bool)
                for i, x in zip(rows[~more].tolist(), ids[~more].astype("<u4"), strict=True):
                    out[i] = x.tobytes()
                if not more.any():
                    break
                rows, ids, best, at = rows[more], ids[more], best[more], at[more]
                each = np.arange(len(rows))
                new = self.merged[at[each, best]]
                keep = np.ones(ids.shape, bool)
                keep[each, best + 1] = False
                ids[each, best] = new
                ids = ids[keep].reshape(len(rows), -1)
        return out

    def spelt(self, ids: np.ndarray) -> bytes:
        """The decimal ids joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist())).encode()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, special tokens kept."""
        return self.raw(ids).decode(errors="replace")

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``."""
        n = self.lengths[ids]
        total = int(n.sum())
        first = np.cumsum(n) - n
        return self.flat[np.repeat(self.starts[ids] - first, n) + np.arange(total)].tobytes()


class Transducer:
    """Words to lists of ids; see the module's text.

    ``arcs`` are grouped by state; ``target`` and ``skip`` (words of the state
    before this arc) belong to arcs, ``first`` and ``final`` to states.
    """

    FIELDS = (("first", "<u4"), ("final", "u1"), ("label", "u1"), ("target", "<u4"), ("skip", "<u4"), ("ends", "<u4"), ("ids", "<u4"))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        # a table of 256 arcs for the root only; below it a state's arcs are searched
        self.keys = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first.astype(np.int64))) * 256 + self.label

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Transducer:
        ordered = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []

        def settle(node: list) -> int:
            """The number of the state with this right language."""
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # open states along the last word: final, settled arcs
        last = b""
        for word in ordered:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            for depth in range(len(last), common, -1):
                n = settle(path.pop())
                path[-1][1].append((last[depth - 1], n))
            path += [[False, []] for _ in range(len(word) - common)]
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            n = settle(path.pop())
            path[-1][1].append((last[depth - 1], n))
        root = settle(path[0])
        count = [0] * len(states)
        first, label, target, skip = [0], [], [], []
        for n, (final, arcs) in enumerate(states):  # a state comes after those that it points to
            seen = int(final)
            for byte, to in arcs:
                label.append(byte)
                target.append(to)
                skip.append(seen)
                seen += count[to]
            count[n] = seen
            first.append(len(label))
        ids = [words[w] for w in ordered]
        return cls({
            "first": np.array(first, "<u4"), "final": np.array([s[0] for s in states], "u1"), "label": np.array(label, "u1"), "target": np.array(target, "<u4"),
            "skip": np.array(skip, "<u4"), "ends": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u4"), "ids": np.array([*chain.from_iterable(ids), root], "<u4"),
        })

    def pack(self) -> bytes:
        parts = [getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS]
        parts = [p + b"\0" * (-len(p) % 8) for p in parts]
        sizes = [len(getattr(self, name)) for name, _ in self.FIELDS]
        return np.array(sizes, "<u8").tobytes() + b"".join(parts)

    @classmethod
    def view(cls, data) -> Transducer:
        sizes = np.frombuffer(data, "<u8", len(cls.FIELDS))
        at, arrays = sizes.nbytes, {}
        for (name, kind), n in zip(cls.FIELDS, sizes, strict=True):
            arrays[name] = np.frombuffer(data, kind, int(n), at)
            at += -(-arrays[name].nbytes // 8) * 8
        return cls(arrays)

    @classmethod
    def mapped(cls, data: bytes) -> Transducer:
        """A view of a file that is mapped into memory and has no name any more."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls.view(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word among the words of the lexicon, -1 where it has none."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero(lengths > 0)
        state = np.full(len(words), self.ids[-1], np.int64)
        rank = np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            want = state[live] * 256 + flat[starts[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[arc] == want
            live, arc = live[hit], arc[hit]
            rank[live] += self.skip[arc]
            state[live] = self.target[arc]
            depth += 1
            done = lengths[live] == depth
            ended = live[done]
            ended = ended[self.final[state[ended]] == 1]
            out[ended] = rank[ended]
            live = live[~done]
        return out

    def ids_at(self, rank: int) -> bytes:
        """The ids of a word as little-endian 32-bit integers."""
        return self.ids[self.ends[rank] : self.ends[rank + 1]].tobytes()


class LexiconEncoder:
    """Encodes whole texts: automaton, exact merges, and a bounded cache of pieces."""

    def __init__(self, file_text: str, lexicon: bytes, cached: int = CACHED_PIECES):
        self.vocabulary, self.lexicon, self.cached = Vocabulary(file_text), Transducer.mapped(lexicon), cached
        self.known: dict[str, bytes] = {}
        self.near: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of new pieces: from the automaton, or merged."""
        words = [p.encode() for p in pieces]
        ranks = self.lexicon.ranks(words).tolist()
        found = {p: self.lexicon.ids_at(r) for p, r in zip(pieces, ranks, strict=True) if r >= 0}
        unseen = [i for i, r in enumerate(ranks) if r < 0]
        merged = self.vocabulary.merge_many([words[i] for i in unseen])
        return found | {pieces[i]: ids for i, ids in zip(unseen, merged, strict=True)}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; a special token in a text is its own id."""
        special, known, near = self.vocabulary.special, self.known, self.near
        for a, b in runs_of(texts, RUN_CHARS):
            parts: list[list] = []  # of a text: lists of pieces and ids of special tokens
            for text in texts[a:b]:
                if any(s in text for s in special):
                    parts.append([np.array([special[p]], "<u4").tobytes() if p in special else pieces_of(p) for p in self.vocabulary.special_split.split(text)])
                else:
                    parts.append([pieces_of(text)])
            if len(known) > self.cached:
                known.clear()
            here = set().union(*(pieces for text in parts for pieces in text if isinstance(pieces, list)))
            if len(near) > NEAR_PIECES:
                near.clear()
            far = here.difference(near)
            found = dict(zip(far, map(known.get, far), strict=True))
            if new := [p for p, ids in found.items() if ids is None]:
                learnt = self.learn(new)
                found |= learnt
                known |= learnt
            near |= found
            for text in parts:
                yield np.frombuffer(b"".join([x if isinstance(x, bytes) else b"".join(map(near.__getitem__, x)) for x in text]), "<u4")


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[str]:
    """The pieces that occur most often over all texts, at most ``words`` of them.

    The count above which there are few enough comes from a histogram of at
    most 512 steps, so no task sorts or gathers all pieces.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in texts_of(batch.column(0)):
                seen.update(pieces_of(text))
            if len(seen) > CACHED_PIECES:
                yield out()
                seen = Counter()
        if seen:
            yield out()

    partial = docs.select("text").mapInArrow(count, "piece string, n long").where(F.octet_length("piece") <= LEXICON_WORD_BYTES)
    step = F.floor(F.log2("n") * 8).cast("int")
    counts = stored(partial.groupBy("piece").agg(F.sum("n").alias("n")).withColumn("step", step), "pieces")
    least, have = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):
        have += r["count"]
        if have > words:
            break
        least = r.step
    return [] if least is None else [r.piece for r in counts.where(F.col("step") >= least).select("piece").collect()]


def compile_lexicon(words: list[str], file_text: str) -> bytes:
    """The automaton of ``words`` as bytes; its size is bounded by the number and length of the words."""
    vocabulary = Vocabulary(file_text)
    return Transducer.build({w.encode(): vocabulary.merge(w.encode()) for w in words}).pack()


_made: dict[str, LexiconEncoder] = {}


def _encoder(file_text: str, lexicon: bytes) -> LexiconEncoder:
    key = hashlib.sha256(lexicon).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = LexiconEncoder(file_text, lexicon)
    return _made[key]


def encode_decode(docs: DataFrame, tokenizer_file: str, words: int = LEXICON_WORDS, keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep``, ``ids`` and ``decoded``.

    A null text is empty: no ids, empty decoded text.  Null document ids stay
    null, repeated rows give repeated rows, an empty table gives no rows, other
    columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        file_text = f.read()
    held = spark.sparkContext.broadcast((file_text, compile_lexicon(frequent_words(docs, words), file_text)))  # bounded by the vocabulary and LEXICON_WORDS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*held.value)
        for batch in batches:
            sizes, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for ids in encoder.encode(texts_of(batch.column(1))):
                back = encoder.vocabulary.decode(ids)
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(encoder.vocabulary.spelt(ids)).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if keep:
                    all_ids.append(ids)
                    decoded.append(back)
            columns = [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return docs.select("doc_id", "text").mapInArrow(work, schema)
