"""Packed arrays as exchange rows: many small records travel as one binary value for each bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from loomtext.llm.textvec import mix


def bucket_of(values: np.ndarray, pieces: int) -> np.ndarray:
    return (mix(values.astype(np.uint64)) % np.uint64(pieces)).astype(np.int64)


def split(rows: np.ndarray, by: str, pieces: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, records as bytes) of each bucket that ``rows`` has; the bucket is a hash of the field ``by``."""
    if not len(rows):
        return
    at = bucket_of(rows[by], pieces)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    cut = np.flatnonzero(np.diff(at)) + 1
    for part, k in zip(np.split(rows, cut), at[np.concatenate([[0], cut])], strict=True):
        yield int(k), part.tobytes()
