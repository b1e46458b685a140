"""The tokenizers library behind a table of pieces.

Both public vocabularies split a text into pieces first and encode each piece
alone, so a piece has the same ids wherever it stands.  For texts of a plain
alphabet (where the rules below provably equal the library's) the split is
array arithmetic over the characters of many texts, and a piece is known by a
64-bit hash; each new piece goes through the library once and is kept.  Any
other text, and any that may hold a special token, goes through it whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from spoolkit.llm.batches import runs_of
from spoolkit.llm.shingles import mix

#: Pieces that a worker keeps; at the bound the table starts anew.
KEPT_PIECES = 700_000
#: Characters of texts that are split together.
RUN_CHARS = 300_000

#: Characters for which case, normal form, white space, letter and digit mean the same here and in the library.
_SAFE = np.zeros(0x181, bool)
_SAFE[[9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180)]] = True
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, LETTER, DIGIT, OTHER = range(4)
_LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]")
_DIGITS = re.compile("[0-9²³¹¼-¾]")
_CLASS = np.array([SPACE if chr(c) in "\t\n\r " else LETTER if _LETTERS.match(chr(c)) else DIGIT if _DIGITS.match(chr(c)) else OTHER for c in range(0x180)], np.uint8)
_U = np.uint64
_CODE = np.random.default_rng(20240301).integers(0, 1 << 63, 0x180, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << max(19, n.bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]), dtype=np.uint64)
    return _powers


def split_kind(spec: dict) -> str | None:
    """Which split a tokenizer file uses; None if it is neither known one."""
    before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"):
        return "bytes"
    parts = before.get("pretokenizers") or [{}]
    kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    if kinds == ["NFC", "Replace", "Lowercase"] and parts[0].get("type") == "Split" and parts[0].get("pattern", {}).get("Regex") == _WORD_SPLIT:
        return "words"
    return None


def split_plain(codes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the pieces of ``codes``, the code points of plain texts, each text followed by a 0.

    Runs of one class are pieces, and for "words" white space is none and each
    digit is one.  An apostrophe that begins a piece takes a following s, d, m,
    t, ll, ve or re.  For "bytes", the last blank before other characters
    belongs to them, and what is left of a run of white space is a piece, but
    its last character, if no blank and not at the text's end, is one of its own.
    """
    n = len(codes)
    gap = codes == 0
    cls = _CLASS[codes]
    cls[gap] = 9
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:n])
    at = lambda shift: np.concatenate([codes[shift:], np.zeros(min(shift, n), codes.dtype)])[:n]
    blank = codes == 32
    # an apostrophe alone in its run, not after a blank that would join it, and before letters
    quote = np.flatnonzero((codes == 39) & new[:n] & new[1:])
    if kind == "bytes":
        quote = quote[(quote == 0) | ~blank[quote - 1]]
    if len(quote):
        b = at(1)[quote]
        c = at(2)[quote]
        one = np.isin(b, [ord(x) for x in "sdmt"])
        two = ((b == 108) & (c == 108)) | ((b == 118) & (c == 101)) | ((b == 114) & (c == 101))
        for which, size in ((one, 1), (two, 2)):
            q = quote[which]
            new[q + 1] = False
            new[q + 1 + size] = True
    if kind == "words":
        new[:n] |= cls == DIGIT
    else:
        space = cls == SPACE
        last = np.flatnonzero(space & new[1:])  # the last of each run of white space
        last = last[(last + 1 < n) & ~gap[np.minimum(last + 1, n - 1)]]
        new[last] = True
        joined = last[blank[last]]
        new[joined + 1] = False
    edge = np.flatnonzero(new)
    first, end = edge[:-1], edge[1:]
    keep = ~gap[first] if kind == "bytes" else (cls[first] != SPACE) & ~gap[first]
    return first[keep], end[keep]


class HashTable:
    """Open addressing over 64-bit hashes: numbers of keys in the order in which they came.

    A key's place is its leading bits, or the next free one; probes of many keys
    run in step.
    """

    def __init__(self, most: int):
        self.bits = max(10, (2 * most).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)  # 0: free
        self.numbers = np.zeros(1 << self.bits, np.int32)
        self.n = 0

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or a free place where it isn't."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            left = left[(there != keys[left]) & (there != 0)]
        return at

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, whether known) of each key; keys aren't 0."""
        at = self._places(keys)
        return self.numbers[at], self.keys[at] == keys

    def add(self, keys: np.ndarray) -> None:
        """``keys``: distinct, none of them known."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        while len(keys):
            at = self._places(keys)
            first = np.unique(at, return_index=True)[1]  # of keys that meet on one place, one stays
            self.keys[at[first]], self.numbers[at[first]] = keys[first], numbers[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, numbers = keys[rest], numbers[rest]


class PieceEncoder:
    def __init__(self, file_text: str, kept: int = KEPT_PIECES):
        self.tokenizer = Tokenizer.from_str(file_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = split_kind(json.loads(file_text))
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kept = kept
        self.forget()

    def forget(self) -> None:
        self.table = HashTable(self.kept)
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 20, "<u4")
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each piece) of new pieces.

        One call encodes all of them in a row, laid out so that each stays a
        piece; where the library's words don't come out as laid out, each piece
        goes through it alone.
        """
        if self.kind == "words":
            laid = " ".join(pieces)
            last = np.arange(len(pieces))
        else:
            laid = "".join([p if p[0] == " " else "\n" + p for p in pieces])
            last = np.cumsum([1 + (p[0] != " ") for p in pieces]) - 1  # a line break before a piece is a word of its own
        if not any(p.isspace() for p in pieces):
            found = self.tokenizer.encode(laid, add_special_tokens=False)
            of = np.array(found.word_ids, np.float64)
            first = np.flatnonzero(np.diff(of, prepend=-1))
            if len(first) == last[-1] + 1 and np.array_equal(of[first], np.arange(len(first))):
                sizes = np.diff(np.append(first, len(of)))
                mine = np.zeros(len(first), bool)
                mine[last] = True
                return np.array(found.ids, "<u4")[np.repeat(mine, sizes)], sizes[last]
        each = [x.ids for x in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        return np.array([i for x in each for i in x], "<u4"), np.array([len(x) for x in each], np.int64)

    def remember(self, keys: np.ndarray, pieces: list[str]) -> None:
        """``keys`` distinct, none of them known."""
        if self.table.n + len(keys) > self.kept and self.table.n:
            raise OverflowError
        if self.table.n + len(keys) > self.kept:  # more pieces in one text than are kept
            self.table = HashTable(len(keys))
        space = np.array([p.isspace() for p in pieces])
        for group in (np.flatnonzero(~space), np.flatnonzero(space)):
            if not len(group):
                continue
            ids, sizes = self.learn([pieces[i] for i in group.tolist()])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            n, m = self.table.n, len(group)
            while n + m > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.start[n : n + m], self.size[n : n + m] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(ids)
            self.table.add(keys[group])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(texts) + "\0"
        if self.kind == "words":
            joined = joined.lower()
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first, end = split_plain(codes, self.kind)
        power, inverse = _power_tables(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_CODE[codes] * power[: len(codes)], dtype=np.uint64, out=sums[1:])
        hashes = mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
        hashes[hashes == 0] = 1
        at, known = self.table.find(hashes)
        if not known.all():
            lost = np.flatnonzero(~known)
            keys, where = np.unique(hashes[lost], return_index=True)
            try:
                self.remember(keys, [joined[a:b] for a, b in zip(first[lost[where]].tolist(), end[lost[where]].tolist(), strict=True)])
            except OverflowError:
                self.forget()
                keys, where = np.unique(hashes, return_index=True)
                self.remember(keys, [joined[a:b] for a, b in zip(first[where].tolist(), end[where].tolist(), strict=True)])
            at, _ = self.table.find(hashes)
        size = self.size[at]
        ends = np.cumsum(size)
        shift = self.start[at] - (ends - size)
        ids = self.pool[np.repeat(shift, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        stops = np.flatnonzero(codes == 0)
        bounds = np.append(0, ends)[np.searchsorted(first, stops)]
        return np.split(ids, bounds[:-1])

    def plain(self, texts: list[str]) -> np.ndarray:
        """Which texts hold safe characters alone, and nothing that begins like a special token."""
        codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        bad = ~_SAFE[np.minimum(codes, 0x180)]
        bad[:-1] |= (codes[:-1] == 60) & (codes[1:] == 124)  # <|
        sizes = np.array([len(t) + 1 for t in texts])
        bad[np.cumsum(sizes) - 1] = False
        return ~np.logical_or.reduceat(bad, np.cumsum(sizes) - sizes)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        for a, b in runs_of(texts, RUN_CHARS):
            plain = self.plain(texts[a:b]) & (self.kind is not None)
            found = iter(self._plain([t for t, p in zip(texts[a:b], plain, strict=True) if p]) if any(plain) else [])
            for text, p in zip(texts[a:b], plain, strict=True):
                yield next(found) if p else self.whole(text)


_made: dict[int, PieceEncoder] = {}


def encoder_of(file_text: str) -> PieceEncoder:
    """One encoder for each tokenizer file in each Python worker."""
    key = hash(file_text)
    if key not in _made:
        _made[key] = PieceEncoder(file_text)
    return _made[key]
