"""Sets of hashed word shingles, computed over the bytes of whole texts.

Words are runs of other bytes than the six ASCII white-space ones, with A-Z
lowered.  A word's hash comes from one running polynomial sum over the text's
bytes (each byte mapped to a random odd number), so no word is cut out.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to the n-th."""
    if len(_powers[0]) <= n:
        size = 1 << max(17, n.bit_length())
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]), dtype=np.uint64)
    return _powers


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first bytes, ends) of the words of ``raw``, in order."""
    raw = np.frombuffer(raw.translate(_LOWER), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)), first, last


def word_hashes(text: str) -> np.ndarray:
    """The hash of every word of ``text``, in order."""
    return hashed_words(text.encode(errors="surrogatepass"))[0]


class Spelling:
    """The bytes of each of a list of tokens, laid out for finding the words of texts given as tokens.

    ``sums``: a token's part of the polynomial sum; ``lead``: leading white bytes;
    ``white``: no other bytes; ``odd``: a white byte after another.
    """

    def __init__(self, tokens: list[bytes]):
        low = [t.translate(_LOWER) for t in tokens]
        self.length = np.array([len(t) for t in low], np.int64)
        self.lead = np.array([len(t) - len(t.lstrip(b" \t\n\v\f\r")) for t in low], np.int64)
        self.white = self.lead == self.length
        flat = np.frombuffer(b"".join(low), np.uint8)
        token = np.repeat(np.arange(len(low)), self.length)
        at = np.arange(len(flat)) - (np.cumsum(self.length) - self.length)[token]
        power, _ = _power_tables(int(self.length.max(initial=0)))
        value = np.where(_SPACE[flat], _U(0), _BYTE[flat] * power[at])
        self.sums = np.zeros(len(low), np.uint64)
        np.add.at(self.sums, token, value)
        self.odd = np.zeros(len(low), bool)
        self.odd[token[_SPACE[flat] & (at >= self.lead[token])]] = True

    def words(self, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit of each token, hash of each unit) of texts, the first token of each in ``begins``; no token is odd.

        A unit is a word with the white space before it, or white space at a
        text's end.
        """
        white = self.white[tokens]
        new = np.zeros(len(tokens), bool)
        new[1:] = (self.lead[tokens[1:]] > 0) & ~white[:-1]
        new[begins] = True
        first = np.flatnonzero(new)
        size = self.length[tokens]
        at = np.append(0, np.cumsum(size))
        power, inverse = _power_tables(int(at[-1]))
        total = np.add.reduceat(self.sums[tokens] * power[at[:-1]], first)
        inner = first + np.add.reduceat(white, first, dtype=np.int64)  # the token that a unit's word begins in
        end = at[np.append(first[1:], len(tokens))]
        inner = np.minimum(inner, len(tokens) - 1)
        start = np.minimum(at[inner] + self.lead[tokens[inner]], end)
        return np.cumsum(new) - 1, mix(total * inverse[start] + (end - start).astype(np.uint64))


def sequence_hashes(elements: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run ``elements[first:end]``, order and all, wherever it stands."""
    power, inverse = _power_tables(len(elements))
    sums = np.zeros(len(elements) + 1, np.uint64)
    np.cumsum(mix(elements) * power[: len(elements)], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of ``text``.

    A text of fewer words has its whole sequence as the only shingle; one
    without words has none.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * _U(31) + words[i : n + i])
    return np.unique(out)


def set_hash(elements: np.ndarray) -> int:
    """A signed 64-bit name of a set, 0 for the empty one."""
    if not len(elements):
        return 0
    total = mix(elements + _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(elements))
    return int(mix(np.array([total])).view(np.int64)[0]) or 1
