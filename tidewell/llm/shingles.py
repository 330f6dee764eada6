"""Fingerprints of word shingles, their weights, and consistent weighted samples of them."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from tidewell.llm.arrow import WORD_BYTES

SIZE = 5
#: Bits of a fingerprint.
BITS = 44
_BASE = 0x9E3779B97F4A7C15
_SPAN = 1_600_000
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


#: Words of more bytes are hashed by a cryptographic hash, as the polynomial one has long words in common.
_LONG = 64


def _word_hash(word: bytes) -> int:
    if len(word) > _LONG:
        return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    h, p = 0, 1
    for b in word:
        h = (h + (b + 1) * p) & (1 << 64) - 1
        p = p * _BASE & (1 << 64) - 1
    return h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    low = [t.translate(WORD_BYTES) for t in texts]
    total = sum(map(len, low)) + len(low)
    if total > _SPAN:  # one very long text: its words one by one
        known: dict[bytes, int] = {}
        words = [t.split() for t in low]
        for w in set().union(*words):
            known[w] = _word_hash(w)
        return np.fromiter((known[w] for t in words for w in t), np.uint64), np.array([len(t) for t in words], np.int64)
    if not _tables:
        _tables.extend([_powers(_BASE, _SPAN + 1), _powers(pow(_BASE, -1, 1 << 64), _SPAN + 1)])
    up, down = _tables
    a = np.frombuffer(b"\n".join([*low, b""]), np.uint8)
    ends = np.flatnonzero((a == 32) | (a == 10))
    starts = np.empty_like(ends)
    if len(ends):
        starts[0], starts[1:] = 0, ends[:-1] + 1
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + _U(1)) * up[: len(a)], out=sums[1:])
    doc = np.searchsorted(np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1), starts, side="right")
    h = (sums[ends] - sums[starts]) * down[starts]
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        h[i] = _word_hash(a[starts[i] : ends[i]].tobytes())
    return h, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def shingles(texts: list[bytes | None], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, how often each stands in its text, number of distinct ones of each text).

    A text of fewer words, but not none, has one shingle: all its words. Fingerprints of a
    text ascend.
    """
    h, n = word_hashes([t or b"" for t in texts])
    h = _mix(h)
    m = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.cumsum(n) - n
    stop = np.cumsum(m)
    doc = np.repeat(np.arange(len(n)), m)
    at = np.repeat(first - stop + m, m) + np.arange(stop[-1] if len(stop) else 0)
    code = np.zeros(len(at), np.uint64)
    short = n[doc] < size
    for k in range(size):
        inside = ~short | (k < n[doc])
        code = code * _U(0x9FB21C651E98DF25) + np.where(inside, h[np.minimum(at + k, len(h) - 1)] if len(h) else _U(0), _U(k + 1))
    code = _mix(code) >> _U(64 - BITS)
    both = np.sort((doc.astype(np.uint64) << _U(BITS)) | code)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    where = np.flatnonzero(new)
    tf = np.diff(where, append=len(both))
    both = both[where]
    return both & _U((1 << BITS) - 1), tf, np.bincount((both >> _U(BITS)).astype(np.int64), minlength=len(n)).astype(np.int64)


#: Rows and columns of the table of document counts.
DEPTH, WIDTH = 2, 1 << 19
#: Inverse document frequency is that of shares of all documents. Shingles that fewer than this share have
#: all weigh the same, twice as much as one that all texts have, so weights don't change with the number of
#: documents: the table counts a share too high by the mean number of a text's shingles over WIDTH at most.
RAREST = 1 / 256


def cells(x: np.ndarray) -> list[np.ndarray]:
    """The column of each fingerprint in each row of the table."""
    return [((x * _U(c)) >> _U(45)).astype(np.int64) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def weights(x: np.ndarray, tf: np.ndarray, counts: np.ndarray, docs: int) -> np.ndarray:
    """(1 + ln tf) * (1 + ln(1 / share) / ln(1 / RAREST)), the share of documents from the table's least cell."""
    df = np.minimum.reduce([counts[i][c] for i, c in enumerate(cells(x))])
    return (1 + np.log(tf)) * (1 + np.log(np.clip(df / max(docs, 1), RAREST, 1)) / np.log(RAREST))


def weighted_jaccard(xa: np.ndarray, wa: np.ndarray, xb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of lesser weights over sum of greater ones; fingerprints ascend."""
    _, i, j = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    least = np.minimum(wa[i], wb[j]).sum()
    total = wa.sum() + wb.sum() - least
    return float(least / total) if total else 1.0


_gamma: list[np.ndarray] = []


def _gamma_tables() -> list[np.ndarray]:
    """Quantiles of Gamma(2, 1), and the logarithms of finer ones."""
    if not _gamma:
        grid = np.concatenate([np.linspace(0, 1e-2, 200_001)[1:], np.geomspace(1e-2, 30, 400_000)[1:]])
        cdf = 1 - (1 + grid) * np.exp(-grid)
        small = grid < 1e-3
        cdf[small] = grid[small] ** 2 / 2 - grid[small] ** 3 / 3
        _gamma.append(np.interp((np.arange(1 << 12) + 0.5) / (1 << 12), cdf, grid).astype(np.float32))
        _gamma.append(np.log(np.interp((np.arange(1 << 20) + 0.5) / (1 << 20), cdf, grid)).astype(np.float32))
    return _gamma


def samples(x: np.ndarray, w: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """k improved consistent weighted samples of each text with shingles (Ioffe, 2010), as hashes.

    Two texts get the same sample with the probability of their weighted Jaccard similarity.
    """
    gamma, log_gamma = _gamma_tables()
    some = n[n > 0]
    start = np.cumsum(some) - some
    doc = np.repeat(np.arange(len(some)), some)
    log_w = np.log(w).astype(np.float32)
    out = np.empty((len(some), k), np.uint64)
    for i in range(k):
        z = _mix(x * _U(2 * i + 1) + _U((i + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        r, c, b = gamma[(z >> _U(52)).astype(np.int64)], log_gamma[((z >> _U(32)) & _U(0xFFFFF)).astype(np.int64)], (z & _U(0xFFFFFFFF)).astype(np.float32) * np.float32(2**-32)
        t = np.floor(log_w / r + b)
        a = c - r * (t - b + 1)
        least = np.flatnonzero(a == np.minimum.reduceat(a, start)[doc])
        at = np.empty(len(some), np.int64)
        at[doc[least[::-1]]] = least[::-1]
        out[:, i] = _mix(x[at] * _U(31) + t[at].astype(np.int64).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + _U(i))
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each ``rows`` samples, different for each band."""
    n = signature.shape[1] // rows
    out = np.empty((len(signature), n), np.uint64)
    for b in range(n):
        h = np.full(len(signature), b + 1, np.uint64)
        for i in range(rows):
            h = _mix(h * _U(0x9FB21C651E98DF25) + signature[:, b * rows + i])
        out[:, b] = h
    return out.view(np.int64)
