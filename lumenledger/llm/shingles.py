"""Words and shingles of many texts at once, on raw UTF-8 bytes with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

from lumenledger.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16, 2 * len(held) if held is not None else 0)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of (byte + 1) * base**t over i <= t < j.

    Good for keys that only bring equal strings together: some families of strings collide.
    """
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)), out=out[1:])
    return out


#: Primes, and a base and its inverse for each: fixed values, chosen at random.
_PRIMES = [(p, b, pow(b, -1, p)) for p, b in ((2147483647, 1482716203), (2147483629, 913405127))]
_prime_powers: dict[tuple[int, int], np.ndarray] = {}


def prime_powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo a prime below 2**31."""
    held = _prime_powers.get((base, prime))
    if held is None:
        held = np.array([1], np.uint64)
    while len(held) < n:
        held = np.concatenate([held, held * np.uint64(pow(base, len(held), prime)) % np.uint64(prime)])
    _prime_powers[base, prime] = held
    return held[:n]


class SpanDigests:
    """62-bit digests of spans of some bytes: polynomials modulo two primes, for telling contents apart."""

    def __init__(self, raw: np.ndarray):
        self.sums = []
        for prime, base, _ in _PRIMES:
            terms = (raw.astype(np.uint64) + np.uint64(1)) * prime_powers(base, prime, len(raw)) % np.uint64(prime)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Digests of bytes[start:end]; the same for equal bytes anywhere."""
        out = np.zeros(len(start), np.uint64)
        for sums, (prime, _, inverse) in zip(self.sums, _PRIMES):
            back = prime_powers(inverse, prime, int(start.max()) + 1 if len(start) else 1)
            out = out << np.uint64(31) | (sums[end] - sums[start]) % np.uint64(prime) * back[start] % np.uint64(prime)
        return out


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each bytes[start:end].

    Eight bytes at a time are mixed in, each step a bijection of what it mixes, so words of up to eight bytes and one length never
    collide, and no family of words does by its structure, as under polynomials modulo 2**64.  Longer ones than LONG_WORD get
    a digest.
    """
    size = end - start
    acc = mix64(size.astype(np.uint64) * np.uint64(_BASE))
    wide = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(wide, (len(raw) + 1, 8), (1, 1))
    live = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        live = live[size[live] > at]
        if not live.size:
            break
        value = eight[start[live] + at].view("<u8").ravel() & _KEEP[np.minimum(size[live] - at, 8)]
        acc[live] = mix64(acc[live] ^ value) + np.uint64((at + 1) * _BASE % 2**64)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        acc[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return acc


def words(raw: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, the words' hashes, and each text's first word.

    Words are runs of bytes that aren't separators, with A-Z lowered; they don't cross texts.
    """
    low = LOWER[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~separators[raw]
    begin = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begin[cut] = inside[1:-1][cut]
    last[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(start, at)
    return start, end, word_hashes(low, start, end), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and each text's first shingle.

    A text with fewer words, but some, has its whole word sequence as one shingle.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(count)])
    spot = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], count)
    take = np.repeat(np.minimum(n, k), count)
    wide = np.concatenate([hashes, np.zeros(k, np.uint64)])
    acc = np.full(len(spot), 0x51ED270B, np.uint64)
    for j in range(k):
        step = mix64((acc ^ wide[spot + j]) + np.uint64((j + 1) * _BASE % 2**64))
        acc = np.where(j < take, step, acc) if j else step
    return acc, out_first
