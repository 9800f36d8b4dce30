"""The binary Golay code (23, 12, 7) as a fuzzy hash: bit segments to the indices of nearby codewords."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the perfect code.
GENERATOR = 0b110001110101
N, K = 23, 12
#: A 64-bit fingerprint is cut into three segments (first bit, width), each padded with zeros to 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _rest(x: np.ndarray) -> np.ndarray:
    """Remainder by the generator: the 11-bit syndrome."""
    x = x.copy()
    for i in range(N - 1, N - K - 1, -1):
        x = np.where(x >> i & 1, x ^ (GENERATOR << (i - 11)), x)
    return x


@cache
def codewords() -> np.ndarray:
    """All 4096, at their index (the upper 12 bits)."""
    m = np.arange(1 << K, dtype=np.int64) << (N - K)
    return m | _rest(m)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: error patterns to the nearby codewords (leader first), and how many there are.

    A syndrome whose leader has weight 3 has five codewords at distance 4 too; any other has one within 4. Segments
    that differ in one bit then share a codeword even if one of them lists its leader only.
    Third: syndromes of the three bytes of a segment, to be combined by xor.
    """
    near: dict[int, list[tuple[int, int]]] = {s: [] for s in range(1 << (N - K))}
    for w in range(5):
        e = np.array([sum(1 << i for i in c) for c in combinations(range(N), w)], dtype=np.int64)
        for s, x in zip(_rest(e).tolist(), e.tolist(), strict=True):
            near[s].append((w, x))
    errors, counts = np.zeros((1 << (N - K), 6), np.int64), np.zeros(1 << (N - K), np.int64)
    for s, found in near.items():
        own = [x for w, x in found if w <= (4 if found[0][0] == 3 else found[0][0])]
        errors[s, : len(own)], counts[s] = own, len(own)
    by_byte = np.stack([_rest(np.arange(256, dtype=np.int64) << (8 * b) & ((1 << N) - 1)) for b in range(3)])
    return errors, counts, by_byte


def nearby(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments (n,) -> codeword indices (n, 6) and which of them count (n, 6).

    Even segments list their nearest codeword, odd ones all within distance 4. Any two segments that differ in one bit
    at most share an index: they are equal, or one is odd and lists the other's nearest codeword.
    """
    errors, counts, by_byte = _tables()
    s = by_byte[0][x & 255] ^ by_byte[1][x >> 8 & 255] ^ by_byte[2][x >> 16 & 255]
    odd = np.bitwise_count(x.astype(np.uint64)) & 1
    used = np.arange(6) < np.where(odd, counts[s], 1)[:, None]
    return (x[:, None] ^ errors[s]) >> (N - K), used


def hard_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (uint64) -> (row, key): any two within 3 bits share a key.

    Of three segments with 3 errors in all, either each has one at most (key: the codewords of all three, 36 bits), or
    one has none and another one at most (key: one segment as it is and the codeword of another, 34 bits; all six
    ordered choices). About 51 keys a fingerprint.
    """
    segs = [(fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    idx, used = zip(*[nearby(s) for s in segs], strict=True)
    all3 = (idx[0][:, :, None, None] << 24) | (idx[1][:, None, :, None] << 12) | idx[2][:, None, None, :]
    on3 = used[0][:, :, None, None] & used[1][:, None, :, None] & used[2][:, None, None, :]
    rows, keys = [np.nonzero(on3)[0]], [all3[on3]]
    for tag, (i, j) in enumerate([(i, j) for i in range(3) for j in range(3) if i != j], 1):
        pair = (tag << 40) | (segs[i][:, None] << K) | idx[j]
        rows.append(np.nonzero(used[j])[0])
        keys.append(pair[used[j]])
    return np.concatenate(rows), np.concatenate(keys)


@cache
def _signs() -> np.ndarray:
    """The codewords (23, 4096) as 1 and -1, bit 0 first."""
    return (((codewords() >> np.arange(N)[:, None]) & 1) * 2 - 1).astype(np.float32)


def soft_words(sums: np.ndarray, near: int = 3) -> np.ndarray:
    """Bit sums (n, 115: five segments of 23; positive where the bit is set) -> codeword indices (n, 5, near): those that
    agree best with the sums of each segment, so that weak bits may flip."""
    at = np.arange(len(sums))
    top = np.empty((len(sums), sums.shape[1] // N, near), np.int64)
    for i in range(top.shape[1]):
        score = sums[:, i * N : (i + 1) * N].astype(np.float32) @ _signs()
        for k in range(near):
            top[:, i, k] = score.argmax(axis=1)
            score[at, top[:, i, k]] = -np.inf
    return top


def soft_keys(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of segments (n, m, near) -> (row, key): a key is a pair of segments with a codeword of each (24 bits and
    the choice of pair), near**2 keys for each pair."""
    n, m, near = top.shape
    keys = [((tag << 40) | (top[:, i, :, None] << K) | top[:, j, None, :]).reshape(n, near * near) for tag, (i, j) in enumerate(combinations(range(m), 2))]
    keys = np.concatenate(keys, axis=1)
    return np.repeat(np.arange(n), keys.shape[1]), keys.ravel()
