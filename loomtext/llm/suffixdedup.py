"""Exact substring dedup by merging shard Burrows-Wheeler transforms.

A byte is removed if a string of ``WINDOW`` bytes covers it that starts anywhere else too, in the same text or another.
Matches never cross texts, and all are judged on the input.

1. Anchors. Each window of 200 bytes has an anchor: its k-gram of the smallest hash. Equal windows have equal anchors at
   equal offsets, so windows need comparing only among occurrences of one anchor. Windows in a row share an anchor; such
   a run with all bytes it covers is a context, some 85 windows long. A batch of texts counts its anchors and sends one
   record for each; those that occur once in all are settled (nothing repeats), the others' contexts are wanted. This
   only narrows what is compared: that anchors are equal removes nothing.
2. Shards. The bytes of wanted contexts are cut at the anchor into a right string and a reversed left string of 15-byte
   symbols. Every batch makes, for each bucket of anchors, the Burrows-Wheeler transforms of its two collections. Strings
   that are equal in a shard's own order are repeats already; one of them goes on, the others' windows are all removed.
3. Merge. A bucket's shard transforms are merged by refining their interleave: in each round every position takes the
   next symbol of its shard's transform and positions are dealt stably by symbol, so that after h rounds suffixes are in
   the order of their first h symbols; the round in which two neighbours part is their common prefix. No suffixes are
   sorted again and no text is sent: last-to-first steps over the merged transform give back the strings.
4. Intervals. For each offset s, contexts whose right strings share 200 - s bytes and whose left strings share s bytes
   form a repeated interval of that window; those of two contexts or more are removed.

Hot anchors. A batch sends one record an anchor however often it has it. Contexts of anchors with more than ``HOT``
occurrences are cut into ranges of ``RANGE`` offsets, and each goes to a bucket by the hash of the bytes that all its
windows hold, so that a passage which very many texts share is spread over buckets by what surrounds it. Hashes deal
strings out; whether they are equal the transforms tell.

Defined results: null and texts shorter than the window lose nothing; repeated rows are occurrences like any others;
periodic texts repeat within themselves; very long texts are cut into pieces that overlap by a window, so positions fit
their fields for any text that a column can hold; an empty table gives no rows; extra columns are ignored, and kept
columns of the results' names are replaced. Texts are known by 128 bits of their SHA-256.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import buckets, small_side, stored, table
from loomtext.llm.packed import bucket_of, split
from loomtext.llm.textvec import _BASE, _INV, BYTE64, mix, powers, utf8

WINDOW, K = 200, 32
CONTEXT = np.dtype([("anchor", "<u8"), ("p", "<u4"), ("lo", "u1"), ("hi", "u1")])
#: An anchor's occurrences in a batch; the text and number of the context if it is the only one.
SEEN = np.dtype([("anchor", "<u8"), ("t0", "<u8"), ("t1", "<u8"), ("at", "<u4"), ("n", "<u4")])
WANT = np.dtype([("t0", "<u8"), ("t1", "<u8"), ("at", "<u4")])
#: A context in a shard: text, anchor position, first and last offset of its windows, whether its windows are still undecided.
OWNER = np.dtype([("t0", "<u8"), ("t1", "<u8"), ("p", "<u4"), ("lo", "u1"), ("hi", "u1"), ("need", "u1")])
SPAN = np.dtype([("t0", "<u8"), ("t1", "<u8"), ("a", "<u4"), ("z", "<u4")])
RECORDS, WANTS, HOTS = 0, 1, 2
#: Bytes in a symbol; a 16th byte counts them, so that the empty symbol is free for the end of a string.
SYMBOL = 15
#: Bytes of text whose contexts are found at once; a longer text is cut into pieces.
PIECE = 1 << 20
_POS = np.uint64((1 << 26) - 1)
#: Occurrences beyond which an anchor is hot, the offsets in a range of its contexts, and the most anchors treated so.
HOT, RANGE, MOST_HOT = 32_768, 24, 250_000
#: Contexts whose transforms are made at once.
FLUSH = 32_768


def text_key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def text_key_column(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)), 1, 16)


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _by_text(rows: np.ndarray) -> Iterator[tuple[bytes, np.ndarray]]:
    """(key, records) of each text."""
    if not len(rows):
        return
    rows = rows[np.lexsort((rows["t1"], rows["t0"]))]
    cut = np.flatnonzero((rows["t0"][1:] != rows["t0"][:-1]) | (rows["t1"][1:] != rows["t1"][:-1])) + 1
    for part in np.split(rows, cut):
        yield part["t0"][:1].tobytes() + part["t1"][:1].tobytes(), part


def contexts(buf: np.ndarray, starts: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(CONTEXT records, the text of each) of texts in ``buf`` with one byte between; less than 64 MiB in all."""
    lens = np.diff(starts) - 1
    n_win = np.maximum(lens - window + 1, 0)
    total = int(n_win.sum())
    if not total:
        return np.zeros(0, CONTEXT), np.zeros(0, np.int64)
    if len(buf) > int(_POS):
        raise ValueError("too many bytes at once")
    n = len(buf)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE64[buf] * powers(_BASE, n)[:n], out=c[1:])
    inv = powers(_INV, n + 1)
    grams = mix((c[k:] - c[:-k]) * inv[: n - k + 1])
    best = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    # The smallest of each window's k-grams by doubling; the leftmost of equal ones.
    width, have = window - k + 1, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    doc = np.repeat(np.arange(len(lens)), n_win)
    first = np.cumsum(n_win) - n_win
    at = starts[doc] + np.arange(total) - first[doc]
    p = (best[at] & _POS).astype(np.int64)
    del best
    edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1])]))
    lo, hi = at[edge], at[np.append(edge[1:], total) - 1]
    p, doc = p[edge], doc[edge]
    out = np.zeros(len(edge), CONTEXT)
    out["anchor"], out["p"], out["lo"], out["hi"] = grams[p], p - starts[doc], p - lo, p - hi
    return out, doc


def text_contexts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, the text of each) of all texts in order, some PIECE bytes at a time.

    A longer text comes in pieces that overlap by a window less one byte, so that each window is in one of them.
    """

    def found(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], np.cumsum([len(b) + 1 for _, _, b in group])])
        recs, which = contexts(np.frombuffer(b"\n".join([*(b for _, _, b in group), b""]), np.uint8), starts)
        recs["p"] += np.array([base for _, base, _ in group], np.uint32)[which]
        return recs, np.array([r for r, _, _ in group])[which]

    group, held = [], 0
    for r, text in enumerate(texts):
        for base in range(0, max(1, len(text) - WINDOW + 1), PIECE):
            piece = text[base : base + PIECE + WINDOW - 1]
            if len(piece) >= WINDOW:
                group.append((r, base, piece))
                held += len(piece)
            if held >= PIECE:
                yield found(group)
                group, held = [], 0
    if group:
        yield found(group)


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, the text of each, its number in that text) of some texts."""
    parts = list(text_contexts(texts))
    recs = np.concatenate([np.zeros(0, CONTEXT), *(a for a, _ in parts)])
    doc = np.concatenate([np.zeros(0, np.int64), *(b for _, b in parts)])
    if not len(doc):
        return recs, doc, doc
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return recs, doc, np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))


def _rows(kind: list[int], bucket: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], ["kind", "bucket", "blob"])


def _dealt(kind: int, rows: np.ndarray, by: str, pieces: int) -> Iterator[pa.RecordBatch]:
    found = list(split(rows, by, pieces))
    if found:
        yield _rows([kind] * len(found), [k for k, _ in found], [x for _, x in found])


def _texts(offsets: np.ndarray, data: np.ndarray) -> dict[bytes, int]:
    """The distinct texts that are as long as a window, by their bytes, with how often each stands in the batch."""
    out: dict[bytes, int] = {}
    for r in np.flatnonzero(np.diff(offsets) >= WINDOW):
        t = data[offsets[r] : offsets[r + 1]].tobytes()
        out[t] = out.get(t, 0) + 1
    return out


def _groups(texts: dict[bytes, int], most: int) -> Iterator[list[bytes]]:
    """The texts, some ``most`` bytes at a time."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def _anchored(pieces: int):
    """Texts -> a SEEN record for each anchor of some texts, WANT records of anchors that those hold twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(*utf8(b.column(0)))
            for group in _groups(texts, 16 * PIECE):
                t0, t1 = _halves([text_key(t) for t in group])
                recs, doc, at = _numbered(group)
                anchors, first, which = np.unique(recs["anchor"], return_index=True, return_inverse=True)
                n = np.bincount(which, np.array([texts[t] for t in group])[doc], len(anchors))
                seen = np.zeros(len(anchors), SEEN)
                seen["anchor"], seen["n"] = anchors, np.minimum(n, 1 << 30)
                seen["t0"], seen["t1"], seen["at"] = t0[doc[first]], t1[doc[first]], at[first]
                yield from _dealt(RECORDS, seen, "anchor", pieces)
                again = n[which] > 1
                want = np.zeros(int(again.sum()), WANT)
                want["t0"], want["t1"], want["at"] = t0[doc[again]], t1[doc[again]], at[again]
                yield from _dealt(WANTS, want, "t0", pieces)

    return run


def _gather(batches: list[pa.RecordBatch], kind: int, dtype: np.dtype) -> np.ndarray:
    parts = []
    for b in batches:
        kinds = b.column(0).to_numpy()
        parts += [np.frombuffer(b.column(2)[int(r)].as_buffer(), dtype) for r in np.flatnonzero(kinds == kind)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _counted(pieces: int, hot: int):
    """SEEN records of whole anchors -> WANT records of those that occur twice in all, hot anchors; wants pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            parts.append(_gather([b], RECORDS, SEEN))
            yield b.take(pa.array(np.flatnonzero(b.column(0).to_numpy() != RECORDS)))
        seen = np.concatenate(parts) if parts else np.zeros(0, SEEN)
        if not len(seen):
            return
        anchors, which = np.unique(seen["anchor"], return_inverse=True)
        n = np.bincount(which, seen["n"], len(anchors))
        ask = seen[(seen["n"] == 1) & (n[which] > 1)]
        want = np.zeros(len(ask), WANT)
        for f in ("t0", "t1", "at"):
            want[f] = ask[f]
        yield from _dealt(WANTS, want, "t0", pieces)
        many = np.flatnonzero(n > hot)
        yield _rows([HOTS] * len(many), [0] * len(many), [anchors[k : k + 1].tobytes() + n[k : k + 1].astype("<u8").tobytes() for k in many])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs by bucket of texts -> (kind, text, bitmap of its wanted contexts); hot anchors pass."""
    parts = []
    for b in batches:
        parts.append(_gather([b], WANTS, WANT))
        own = b.take(pa.array(np.flatnonzero(b.column(0).to_numpy() == HOTS)))
        yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(2)], ["kind", "t", "wants"])
    t_of, maps = [], []
    for t, rows in _by_text(np.concatenate(parts) if parts else np.zeros(0, WANT)):
        wanted = np.zeros(int(rows["at"].max()) + 1, bool)
        wanted[rows["at"]] = True
        t_of.append(t)
        maps.append(np.packbits(wanted).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array([WANTS] * len(t_of), pa.int8()), pa.array(t_of, pa.binary()), pa.array(maps, pa.binary())], ["kind", "t", "wants"])


def merge_spans(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching intervals."""
    order = np.argsort(a, kind="stable")
    a, z = a[order].astype(np.int64), np.maximum.accumulate(z[order].astype(np.int64))
    cut = np.concatenate([[True], a[1:] > z[:-1]]) if len(a) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(cut)[1:], len(a)) - 1 if len(a) else np.zeros(0, np.int64)
    return a[cut], z[last]


def symbols(strings: list[bytes], width: int) -> np.ndarray:
    """Strings x symbols x (first 8 bytes, last 7 and the count) as numbers that sort like the bytes; (0, 0) beyond the end."""
    m = -(-width // SYMBOL)
    raw = np.zeros((len(strings), m, 16), np.uint8)
    raw[:, :, :SYMBOL] = np.frombuffer(b"".join(s.ljust(m * SYMBOL, b"\0") for s in strings), np.uint8).reshape(len(strings), m, SYMBOL)
    lens = np.array([len(s) for s in strings], np.int64)[:, None] - SYMBOL * np.arange(m)[None, :]
    raw[:, :, SYMBOL] = np.clip(lens, 0, SYMBOL)
    return raw.view(">u8").astype(np.uint64)


def ranked(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct symbols in order, the number of each of ``sym`` among them); rows are symbols, (0, 0) is always 0."""
    sym = np.concatenate([np.zeros((1, 2), np.uint64), sym.reshape(-1, 2)])
    order = np.lexsort((sym[:, 1], sym[:, 0]))
    s = sym[order]
    new = np.concatenate([[False], (s[1:] != s[:-1]).any(1)])
    code = np.empty(len(s), np.int64)
    code[order] = np.cumsum(new)
    new[0] = True
    return s[new], code[1:]


def suffix_ranks(sym: np.ndarray) -> np.ndarray:
    """strings x positions (one more than symbols): the rank of each suffix by its symbols alone, equal ones alike."""
    n, m = sym.shape[:2]
    rank = np.zeros((n, m + 1), np.int64)
    rank[:, :m] = ranked(sym)[1].reshape(n, m)
    h = 1
    while h <= m:
        after = np.zeros_like(rank)
        after[:, :-h] = rank[:, h:]
        _, rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)
        rank = rank.reshape(n, m + 1)
        h *= 2
    return rank


def shard_bwts(sym: np.ndarray, rank: np.ndarray, shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """The transform of each shard's collection of strings (rows of ``sym`` with their suffix ranks, in the order given).

    Ends of strings sort below all symbols and among themselves by the order of the strings; (0, 0) stands for them.
    """
    m = sym.shape[1]
    lens = (sym[:, :, 1] > 0).sum(1)
    i, j = np.nonzero(np.arange(m + 1)[None, :] <= lens[:, None])
    order = np.lexsort((i, rank[i, j], shard[i]))
    i, j = i[order], j[order]
    bwt = np.where((j > 0)[:, None], sym[i, np.maximum(j - 1, 0)], np.uint64(0))
    return np.split(bwt, np.cumsum(np.bincount(shard[i], minlength=shards))[:-1])


def _stable_order(codes: np.ndarray) -> np.ndarray:
    """Stable argsort of small unsigned integers by 16-bit digits."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if codes.max(initial=0) > 0xFFFF:
        order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merge_bwts(bwts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merges transforms of collections of strings of at most ``depth`` symbols by iterative interleave refinement.

    Returns (alphabet, merged transform as codes, common prefix of each suffix with the one before, last-to-first
    mapping, number of strings of each shard). Code 0 is the end of a string.
    """
    sizes = np.array([len(b) for b in bwts])
    alphabet, code = ranked(np.concatenate(bwts))
    source = np.repeat(np.arange(len(bwts)), sizes)
    n_strings = np.bincount(source[code == 0], minlength=len(bwts))
    ends = int(n_strings.sum())
    z, block = source, np.zeros(len(code), np.int64)
    common = np.full(len(code), -1, np.int64)
    fixed = np.repeat(np.arange(len(bwts)), n_strings)
    for h in range(depth + 2):
        # The k-th position of a shard in the interleave holds the k-th symbol of its transform.
        at = np.empty(len(code), np.int64)
        at[_stable_order(z)] = code
        order = _stable_order(at)
        new = z[order]
        new[:ends] = fixed
        sym, old = at[order], block[order]
        parted = np.concatenate([[True], (sym[1:] != sym[:-1]) | (old[1:] != old[:-1])])
        parted[: ends + 1] = True
        fresh = parted & (common < 0)
        common[fresh] = h
        block = np.cumsum(parted)
        same = bool((new == z).all())
        z = new
        if same and not fresh.any():
            break
    at = np.empty(len(code), np.int64)
    at[_stable_order(z)] = code
    forward = np.empty(len(code), np.int64)
    forward[_stable_order(at)] = np.arange(len(code))
    common[common < 0] = depth
    return alphabet, at, common, forward, n_strings


def sorted_strings(bwts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the strings of all shards in sorted order, and the bytes each shares with the one before.

    Strings are numbered by shard, then as in their shard.
    """
    alphabet, at, common, forward, n_strings = merge_bwts(bwts, depth)
    n = int(n_strings.sum())
    # The suffix that is only the end of string i stands at i; its last-to-first steps give the string from its end.
    now, back, length = np.arange(n), np.zeros((n, depth + 1), np.int64), np.zeros(n, np.int64)
    for step in range(depth):
        c = at[now]
        go = c > 0
        back[go, step] = c[go]
        length += go
        now = np.where(go, forward[now], now)
    order = np.argsort(now)
    shared = np.zeros(n, np.int64)
    if n > 1:
        place = now[order]
        shared[1:] = np.minimum.reduceat(common[: place[-1] + 1], place[:-1] + 1)
    # Within the first symbol that differs, the leading bytes that do not.
    x, y = order, np.concatenate([order[:1], order[:-1]])
    raw = alphabet.astype(">u8").view(np.uint8).reshape(-1, 16)

    def symbol(s, j):
        k = length[s] - 1 - j
        return raw[np.where(k >= 0, back[s, np.maximum(k, 0)], 0)]

    a, b = symbol(x, shared), symbol(y, shared)
    most = np.minimum(a[:, SYMBOL], b[:, SYMBOL])[:, None]
    extra = np.logical_and.accumulate((a[:, :SYMBOL] == b[:, :SYMBOL]) & (np.arange(SYMBOL) < most), axis=1).sum(1)
    size = raw[back, SYMBOL].sum(1, dtype=np.int64)
    out = np.minimum(shared * SYMBOL + extra, np.minimum(size[x], size[y]))
    out[:1] = 0
    return order, out


def repeated(right: tuple, left: tuple, lo: np.ndarray, hi: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """contexts x offsets: whether the window that starts so many bytes before the anchor occurs in two contexts."""
    n = len(lo)
    out = np.zeros((n, window - K + 1), bool)

    def classes(order, common, depth):
        c = np.empty(n, np.int64)
        c[order] = np.cumsum(common < depth)
        return c

    for s in range(window - K + 1):
        own = np.flatnonzero((hi <= s) & (s <= lo))
        if len(own) > 1:
            both = classes(*right, window - s)[own] * (n + 1) + (classes(*left, s)[own] if s else 0)
            _, inv, count = np.unique(both, return_inverse=True, return_counts=True)
            out[own, s] = count[inv] >= 2
    return out


R_SYMBOLS, L_SYMBOLS = -(-WINDOW // SYMBOL), -(-(WINDOW - K) // SYMBOL)
SHARDS = "bucket long, t binary, right binary, left binary, owners binary"


def dealt(texts: list[bytes], recs: np.ndarray, doc: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, the text of each, a hash to deal each by): those of hot anchors are cut into ranges of offsets."""
    key = recs["anchor"].copy()
    at = np.flatnonzero(np.isin(key, hot)) if len(hot) else np.zeros(0, np.int64)
    if not len(at):
        return recs, doc, key
    parts, docs, keys = [np.delete(recs, at)], [np.delete(doc, at)], [np.delete(key, at)]
    for first in range(0, WINDOW - K + 1, RANGE):
        last = first + RANGE - 1
        own = at[(recs["hi"][at] <= last) & (recs["lo"][at] >= first)]
        cut = recs[own]
        cut["lo"], cut["hi"] = np.minimum(cut["lo"], last), np.maximum(cut["hi"], first)
        # What all windows of these offsets hold.
        core = [zlib.crc32(texts[d][p - first : p - last + WINDOW]) for d, p in zip(doc[own].tolist(), cut["p"].tolist(), strict=True)]
        parts.append(cut)
        docs.append(doc[own])
        keys.append(mix(key[own] + mix(np.array(core, np.uint64) * np.uint64(256) + np.uint64(first + 1))))
    return np.concatenate(parts), np.concatenate(docs), np.concatenate(keys)


def shards_of(texts: list[bytes], times: np.ndarray, recs: np.ndarray, doc: np.ndarray, key: np.ndarray, pieces: int) -> tuple[list[tuple[int, bytes, bytes, bytes]], np.ndarray]:
    """((bucket, right transform, left transform, owners without text key) of each bucket, which contexts are repeats here)."""
    where = list(zip(doc.tolist(), recs["p"].tolist(), recs["lo"].tolist(), recs["hi"].tolist(), strict=True))
    right = symbols([texts[d][p : p - hi + WINDOW] for d, p, _, hi in where], WINDOW)
    left = symbols([texts[d][p - lo : p][::-1] for d, p, lo, _ in where], WINDOW - K)
    r_rank, l_rank = suffix_ranks(right), suffix_ranks(left)
    # Contexts that are equal in the shard's order are repeats of one another; one of them goes on.
    same = (r_rank[:, 0] * (int(l_rank[:, 0].max()) + 1) + l_rank[:, 0]) * 65536 + recs["lo"].astype(np.int64) * 256 + recs["hi"]
    _, first, which = np.unique(same, return_index=True, return_inverse=True)
    often = np.bincount(which, times[doc])[which] > 1
    bucket = bucket_of(key[first], pieces)
    first = first[np.argsort(bucket, kind="stable")]
    names, shard = np.unique(np.sort(bucket), return_inverse=True)
    owner = np.zeros(len(first), OWNER)
    owner["t0"] = doc[first]
    for f in ("p", "lo", "hi"):
        owner[f] = recs[f][first]
    owner["need"] = ~often[first]
    r = shard_bwts(right[first], r_rank[first], shard, len(names))
    l = shard_bwts(left[first], l_rank[first], shard, len(names))  # noqa: E741
    owners = np.split(owner, np.cumsum(np.bincount(shard, minlength=len(names)))[:-1])
    return list(zip(names.tolist(), r, l, owners, strict=True)), often


def _packed(a: np.ndarray, z: np.ndarray) -> bytes:
    return np.stack(merge_spans(a, z), 1).astype("<u4").tobytes()


def _shards(pieces: int, hot):
    """(text, t, wants) -> for each batch and bucket of anchors the two transforms and the owners, in order, and the
    spans of texts that are settled in a shard (null transforms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(0))
            rows: dict[bytes, list] = {}
            for r in range(b.num_rows):
                have = rows.setdefault(data[offsets[r] : offsets[r + 1]].tobytes(), [b.column(1)[r].as_py(), b.column(2)[r].as_py(), 0])
                have[2] += 1
            for group in _groups({t: x[2] for t, x in rows.items()}, 8 * PIECE):
                keys, times = [rows[t][0] for t in group], np.array([rows[t][2] for t in group])
                t0, t1 = _halves(keys)
                recs, doc, at = _numbered(group)
                wanted = np.zeros(len(recs), bool)
                starts = np.searchsorted(doc, np.arange(len(group) + 1))
                for r, t in enumerate(group):
                    bits = np.unpackbits(np.frombuffer(rows[t][1], np.uint8))[: starts[r + 1] - starts[r]]
                    wanted[starts[r] : starts[r] + len(bits)] = bits
                recs, doc, key = dealt(group, recs[wanted], doc[wanted], hot.value)
                settled = []
                for i in range(0, len(recs), FLUSH):
                    part, own = recs[i : i + FLUSH], doc[i : i + FLUSH]
                    out, often = shards_of(group, times, part, own, key[i : i + FLUSH], pieces)
                    for *_, owner in out:
                        owner["t1"] = t1[owner["t0"].astype(np.int64)]
                        owner["t0"] = t0[owner["t0"].astype(np.int64)]
                    cols = [[x[0] for x in out], [None] * len(out), *([x[k].tobytes() for x in out] for k in (1, 2, 3))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), *[pa.binary()] * 4), strict=True)], ["bucket", "t", "right", "left", "owners"])
                    p = part["p"][often].astype(np.int64)
                    settled.append(np.stack([own[often], p - part["lo"][often], p - part["hi"][often] + WINDOW], 1))
                spans = np.concatenate(settled) if settled else np.zeros((0, 3), np.int64)
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                found = np.unique(spans[:, 0])
                blobs = [_packed(s[:, 1], s[:, 2]) for s in np.split(spans, np.searchsorted(spans[:, 0], found)[1:])] if len(found) else []
                cols = [bucket_of(t0[found], pieces).tolist(), [keys[r] for r in found], [None] * len(found), [None] * len(found), blobs]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), *[pa.binary()] * 4), strict=True)], ["bucket", "t", "right", "left", "owners"])

    return run


def merged_spans(right: list[np.ndarray], left: list[np.ndarray], owners: list[np.ndarray]) -> np.ndarray:
    """SPAN records of the repeated windows of the undecided contexts of one bucket's shards."""
    w = np.concatenate(owners)
    hit = repeated(sorted_strings(right, R_SYMBOLS), sorted_strings(left, L_SYMBOLS), w["lo"].astype(np.int64), w["hi"].astype(np.int64))
    hit &= (w["need"] == 1)[:, None]
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    spans = np.empty(len(row), SPAN)
    for f in ("t0", "t1"):
        spans[f] = w[f][row]
    spans["a"], spans["z"] = w["p"][row] - (stop - 1), w["p"][row] - first + WINDOW
    return spans


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a partition's buckets, one bucket merged at a time -> (t, spans) rows; settled spans pass."""
    shards: dict[int, list[tuple]] = {}
    for b in batches:
        settled = b.column(1).is_valid()
        own = b.filter(settled)
        yield pa.RecordBatch.from_arrays([own.column(1), own.column(4)], ["t", "spans"])
        b = b.filter(pc.invert(settled))
        for r, bucket in enumerate(b.column(0).to_pylist()):
            right, left = (np.frombuffer(b.column(c)[r].as_buffer(), "<u8").reshape(-1, 2) for c in (2, 3))
            shards.setdefault(bucket, []).append((right, left, np.frombuffer(b.column(4)[r].as_buffer(), OWNER)))
    found = []
    while shards:
        _, rows = shards.popitem()
        found.append(merged_spans(*(list(c) for c in zip(*rows, strict=True))))
    t_of, blobs = [], []
    for t, rows in _by_text(np.concatenate(found) if found else np.zeros(0, SPAN)):
        t_of.append(t)
        blobs.append(_packed(rows["a"], rows["z"]))
    yield pa.RecordBatch.from_arrays([pa.array(t_of, pa.binary()), pa.array(blobs, pa.binary())], ["t", "spans"])


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(t, spans): packed byte intervals to remove, by the key of the text; several pieces a text."""
    spark = docs.sparkSession
    pieces = buckets(spark)
    schema = "kind byte, bucket long, blob binary"
    d = docs.select("text")
    counted = d.mapInArrow(_anchored(pieces), schema).repartition("bucket").mapInArrow(_counted(pieces, hot), schema)
    state = stored(counted.repartition("bucket").mapInArrow(_listed, "kind byte, t binary, wants binary"), "suffix-state")
    # At most MOST_HOT numbers; a hot anchor beyond them is merged in one bucket, as others are.
    found = [r[0] for r in state.where(F.col("kind") == HOTS).select("t").limit(MOST_HOT).toLocalIterator()]
    hot_anchors = spark.sparkContext.broadcast(np.frombuffer(b"".join(found), "<u8")[::2].copy())
    wants = small_side(state.where(F.col("kind") == WANTS).select("t", "wants"))
    texts = d.withColumn("t", text_key_column(F.col("text"))).join(wants, "t").select("text", "t", "wants")
    return texts.mapInArrow(_shards(pieces, hot_anchors), SHARDS).repartition("bucket").mapInArrow(_merged, "t binary, spans binary")


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``, the bytes that stay."""
    keep = [c for c in keep or ["doc_id"] if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    spans = stored(repeated_spans(docs, hot).groupBy("t").agg(F.collect_list("spans").alias("spans")), "suffix-spans")
    own = [F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)]
    d = docs.select(*own, F.col("text").alias("__text")).withColumn("__t", text_key_column(F.col("__text")))
    both = d.join(small_side(spans), F.col("__t") == F.col("t"), "left").drop("__t", "t")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept binary"] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keep)
        for b in batches:
            offsets, data = utf8(b.column(k))
            rows = []
            for r in range(b.num_rows):
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                packed = b.column(k + 1)[r].as_py()
                removed = n = 0
                if packed:
                    s = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2)
                    a, z = merge_spans(s[:, 0], s[:, 1])
                    removed, n = int((z - a).sum()), len(a)
                    edges = [0, *np.stack([a, z], 1).ravel().tolist(), len(text)]
                    kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                else:
                    kept = text
                rows.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
            names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(k)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names)

    return both.mapInArrow(run, schema)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLES: dict[str, str] = {}
