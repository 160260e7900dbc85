"""Prefix polynomial hashes over byte buffers, and hashes of words and shingles made from them.

The hash of bytes s[a:b] is sum(code[s[i]] * B**i) * B**-a modulo 2**64: B is odd, so it has an inverse, and the hash of
any stretch follows from two prefix sums. Equal bytes have equal hashes wherever they stand.
"""

import numpy as np

from lapforge.llm.common import mixed

BASE = 0x5851F42D4C957F2D
CODES = np.random.RandomState(7).randint(1, 2**62, 256).astype(np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SEGMENT = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i below n (at least)."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix(s: np.ndarray) -> np.ndarray:
    """Prefix sums of a buffer of bytes; one more than it has bytes."""
    out = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(CODES[s] * powers(len(s) + 1)[0][:len(s)], out=out[1:])
    return out


def stretch(p: np.ndarray, a, b) -> np.ndarray:
    """Hashes of the stretches a .. b of the buffer that p belongs to."""
    return (p[b] - p[a]) * powers(len(p))[1][a]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each white-space separated word, in order. Long texts are taken in segments that end between words."""
    out, at = [], 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut < 0 and end < len(text):  # one word longer than a segment
                end += SEGMENT
                cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut + 1 if cut >= 0 else len(text)
        s = np.frombuffer(text, np.uint8, min(end, len(text)) - at, at)
        blank = SPACE[s]
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(first):
            out.append(mixed(stretch(prefix(s), first, last) + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a lower-cased (A-Z only) text's runs of `words` words; with fewer words, of all of them."""
    w = word_hashes(text.lower())
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - k + 1 + i])
    return np.unique(h)
