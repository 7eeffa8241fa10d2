"""Vectorised words, hashes and shingles over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space: the separators of [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are hashed at once; some ten times as much is held then.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte value, so that hashes do not depend on how near two bytes are.
BYTE64 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n (at least), cached."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(1 << max(12, int(n).bit_length()), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return o, d


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def joined(offsets: np.ndarray, data: np.ndarray, i: int, j: int, sep: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The texts i..j-1 with one byte ``sep`` after each, and their starts with the end appended."""
    n = np.diff(offsets[i : j + 1])
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(starts[-1], sep, np.uint8)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[keep] = data[offsets[i] : offsets[j]]
    return out, starts


def spans(sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where ``sep`` is False."""
    edge = np.diff(np.concatenate([[True], sep, [True]]).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[s:e] for each pair, by prefix sums of a polynomial mod 2**64."""
    n = len(buf)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE64[buf] * powers(_BASE, n)[:n], out=c[1:])
    return mix((c[ends] - c[starts]) * powers(_INV, n + 1)[starts])


def shingle_sets(offsets: np.ndarray, data: np.ndarray, i: int, j: int, k: int) -> list[np.ndarray]:
    """For each text i..j-1 the sorted distinct hashes of its k-word shingles.

    Words are runs of bytes that are no ASCII white space, after A-Z are lower-cased. A text of 1 to k-1 words has
    its whole sequence as its one shingle, one without words the empty set.
    """
    buf, starts = joined(offsets, data, i, j)
    buf = LOWER[buf]
    ws, we = spans(SPACE[buf])
    h = run_hashes(buf, ws, we)
    first = np.searchsorted(ws, starts)
    out = []
    m = np.uint64(0xD1342543DE82EF95)
    s = h.copy()
    for d in range(1, min(k, len(h))):
        s[: len(h) - d] = s[: len(h) - d] * m + h[d:]
    s = mix(s)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                v = h[a]
                for w in h[a + 1 : b]:
                    v = v * m + w
                out.append(mix(np.array([v + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
