"""Media columns: telephony audio stored losslessly as WAV, decoded with numpy.

Codecs: mu-law and A-law bytes expand by 256-entry lookup tables; IMA ADPCM blocks decode with numpy across all blocks
at once, one step per nibble. Decoded PCM is resampled by linear interpolation, after a low-pass filter where the rate
falls, and stored as 16-bit little-endian PCM.

``store_text_audio`` stores a text's UTF-8 bytes (null: empty), padded with bytes 255 to a positive multiple of 576, as
the data chunk of a WAV file whose codec follows from the payload's CRC-32, so equal texts give equal files. ``decode``
reads files back: digests of the payload and the resampled PCM, which the query writes to a table of its own, in two columns that
pack well (``parted``); ``described`` computes features from PCM read back from there.

Defined results: null and empty texts are one unit of padding; files of another kind, truncated or null files give
``ok = false`` with null fields, never an exception, and a null feature; repeated rows each get their file; a very long
text is one file (its decoded form is held whole, some 20 bytes for each of its own); an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import stored, table
from loomtext.llm.textvec import chunks, utf8

UNIT = 576
RATE = 8000
TO_RATE = 16000
#: How the query's tables are packed: files and PCM together take 1.54 times the input at level 9 and pages of 1 MB.
PACKED = {"parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(8 << 20)}
#: Zero crossings of the low-pass filter on either side, and where it cuts as a share of the new half rate.
ZEROS, CUTOFF = 24, 0.92
#: WAV format tags: fixed values of the container.
MULAW, ALAW, IMA = 7, 6, 17
CODECS = (MULAW, ALAW, IMA)
#: Bytes of an ADPCM block: 4 of header, then two 4-bit codes a byte; divides UNIT.
BLOCK = 64
#: Index steps of IMA ADPCM: fixed values of the codec.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
#: The 89 step sizes of IMA ADPCM: fixed values of the codec.
STEP = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
        544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int64,
)


def mulaw_table() -> np.ndarray:
    """Code byte -> 16-bit sample: inverted bits, 3 of exponent, 4 of mantissa, bias 132."""
    c = ~np.arange(256) & 255
    size = ((((c & 15) << 3) + 132) << ((c >> 4) & 7)) - 132
    return np.where(c & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Code byte -> 16-bit sample: even bits inverted, segment 0 linear, a set sign bit positive."""
    c = np.arange(256) ^ 0x55
    e, m = (c >> 4) & 7, (c & 15) << 4
    size = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return np.where(c & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()
#: Signed change by (step index, code), so that a step of the decoder is one lookup.
DELTA = (lambda s, c: np.where(c & 8, -1, 1) * ((s >> 3) + np.where(c & 4, s, 0) + np.where(c & 2, s >> 1, 0) + np.where(c & 1, s >> 2, 0)))(STEP[:, None], np.arange(16)[None, :]).astype(np.int32)
NEXT = np.clip(np.arange(89)[:, None] + INDEX_STEP[None, :], 0, 88).astype(np.int32)


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks (rows of bytes): the header's sample, then one for each code, low nibble first.

    A header index above 88 counts as 88, so any bytes decode.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    head = blocks[:, :2].astype(np.int32)
    now = head[:, 0] | head[:, 1] << 8
    now = np.where(now >= 32768, now - 65536, now).astype(np.int32)
    at = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = now
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    delta, following = DELTA.ravel(), NEXT.ravel()
    for k in range(2 * (width - 4)):
        i = at * 16 + (codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15)
        now = np.clip(now + delta[i], -32768, 32767)
        at = following[i]
        out[k + 1] = now
    return np.ascontiguousarray(out.T)


def low_pass(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """What of a signal lies below the new half rate, up/down times the old one: a Blackman-windowed sinc in 15-bit integer
    weights that sum to one. The ends go on with their own value."""
    half = -(-ZEROS * down // up)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t * (CUTOFF * up / down)) * np.blackman(2 * half + 3)[1:-1]
    taps = np.rint(taps / taps.sum() * 32768).astype(np.int64)
    taps[half] += 32768 - taps.sum()
    x = np.pad(pcm.astype(np.int64), half, mode="edge")
    out = np.zeros(len(pcm), np.int64)
    for k, w in enumerate(taps.tolist()):
        if w:
            out += w * x[k : k + len(pcm)]
    return np.clip((out + 16384) >> 15, -32768, 32767)


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """up/down times the rate, round(n * up / down) samples: linear interpolation, of what lies below the new half rate if
    that is lower. The same rate gives the same samples."""
    n = (len(pcm) * up + down // 2) // down
    if up == down or not len(pcm):
        return pcm
    if up == 2 and down == 1:
        wide = np.empty(n, np.int16)
        wide[::2], wide[1::2] = pcm, _between(pcm)
        return wide
    p = low_pass(pcm, up, down) if down > up else pcm.astype(np.int64)
    at = np.minimum(np.arange(n, dtype=np.int64) * down, (len(pcm) - 1) * up)
    i, f = at // up, at % up
    return ((p[i] * (up - f) + p[np.minimum(i + 1, len(p) - 1)] * f) // up).astype(np.int16)


def parted(pcm: np.ndarray) -> tuple[bytes, bytes]:
    """The even samples, and the odd ones less the mean of their neighbours (modulo 2**16): every sample of any signal, in a
    form that packs well where the odd ones were interpolated."""
    even, odd = pcm[::2].astype("<i2"), pcm[1::2].astype("<i2")
    return even.tobytes(), (odd - _between(even)[: len(odd)]).astype("<i2").tobytes()


def joined(even: bytes, odd: bytes) -> np.ndarray:
    """The signal that ``parted`` took apart."""
    e, o = np.frombuffer(even, "<i2"), np.frombuffer(odd, "<i2")
    out = np.empty(len(e) + len(o), "<i2")
    out[::2], out[1::2] = e, o + _between(e)[: len(o)]
    return out


def _between(pcm: np.ndarray) -> np.ndarray:
    """The mean of each sample and the next, rounded down; the last goes on with its own value."""
    return ((pcm.astype(np.int32) + np.concatenate([pcm[1:], pcm[-1:]])) >> 1).astype(np.int16)


def wav(payload: bytes, codec: int) -> bytes:
    block, bits = (BLOCK, 4) if codec == IMA else (1, 8)
    per = 1 + 2 * (BLOCK - 4) if codec == IMA else 1
    extra = struct.pack("<HH", 2, per) if codec == IMA else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", codec, 1, RATE, RATE * block // per, block, bits) + extra
    fact = struct.pack("<I", len(payload) // block * per)
    body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in ((b"fmt ", fmt), (b"fact", fact), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse_wav(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """(codec, rate, block size, data) or None where it is no whole WAV file."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n:
            return None
        if kind == b"fmt " and n >= 16:
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", body)
            fmt = (tag, rate, block)
        elif kind == b"data" and fmt:
            return (*fmt, body)
        at += 8 + n + (n & 1)
    return None


def pad(text: bytes, unit: int = UNIT) -> bytes:
    return text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def expand(codec: int, data: np.ndarray, block: int = BLOCK) -> np.ndarray | None:
    if codec == MULAW:
        return MULAW_TABLE[data]
    if codec == ALAW:
        return ALAW_TABLE[data]
    if codec == IMA and block > 4 and len(data) % block == 0:
        return ima_decode(data.reshape(-1, block)).ravel()
    return None


def features(codec: int, rate: int, pcm: np.ndarray) -> str:
    """Codec, rate, samples, peak, root mean square, zero crossings and CRC-32 of stored PCM."""
    if not len(pcm):
        return f"codec={codec};rate={rate};n=0;peak=0;rms=0;zc=0;pcm={zlib.crc32(b''):08x}"
    power = int(np.square(pcm.astype(np.int64)).sum())
    neg = pcm < 0
    peak = max(-int(pcm.min()), int(pcm.max()))
    return f"codec={codec};rate={rate};n={len(pcm)};peak={peak};rms={round((power / len(pcm)) ** 0.5)};zc={int(np.count_nonzero(neg[1:] != neg[:-1]))};pcm={zlib.crc32(pcm.astype('<i2', copy=False)):08x}"


def store_text_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): one WAV file for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(1))
            for i, j in chunks(offsets, 1 << 23):
                n, files = [], []
                for r in range(i, j):
                    text = data[offsets[r] : offsets[r + 1]].tobytes()
                    payload = pad(text)
                    n.append(len(text))
                    files.append(wav(payload, CODECS[zlib.crc32(payload) % 3]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


_OUT = [("ok", pa.bool_()), ("codec", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("rate", pa.int32())]


def decode(media: DataFrame, keep: list[str], media_col: str = "media", to_rate: int = TO_RATE, apart: bool = False) -> DataFrame:
    """Reads stored files back: codec, digests of payload and file, and the 16-bit PCM resampled to ``to_rate``: ``pcm``, or
    ``apart`` as ``pcm_even`` and ``pcm_odd``.

    ADPCM blocks of all files of a slice (bounded in bytes) decode together.
    """
    signal = ["pcm_even", "pcm_odd"] if apart else ["pcm"]
    schema = ", ".join([*(f"{c} {media.schema[c].dataType.simpleString()}" for c in keep), "ok boolean, codec int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, rate int", *(f"{c} binary" for c in signal)])
    out = [*_OUT, *((c, pa.binary()) for c in signal)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(len(keep))
            offsets, _ = utf8(col)
            for i, j in chunks(offsets, 1 << 21):
                files = col.slice(i, j - i).to_pylist()
                parsed = [parse_wav(f) for f in files]
                arrays = [None if p is None else np.frombuffer(p[3], np.uint8) for p in parsed]
                together = [k for k, p in enumerate(parsed) if p and p[0] == IMA and p[2] == BLOCK and len(p[3]) % BLOCK == 0]
                pcm = {}
                if together:
                    all_pcm = ima_decode(np.concatenate([arrays[k] for k in together]).reshape(-1, BLOCK))
                    cut = np.cumsum([len(arrays[k]) // BLOCK for k in together])[:-1]
                    pcm = {k: x.ravel() for k, x in zip(together, np.split(all_pcm, cut), strict=True)}
                rows = []
                for k, (f, p) in enumerate(zip(files, parsed, strict=True)):
                    x = pcm.get(k) if k in pcm else None if p is None else expand(p[0], arrays[k], p[2])
                    if x is None:
                        rows.append((False, None, None, None, None, None if f is None else len(f), None if f is None else hashlib.sha256(f).hexdigest(), None, *[None] * len(signal)))
                        continue
                    common = math.gcd(to_rate, p[1])
                    wide = resample(x, to_rate // common, p[1] // common).astype("<i2", copy=False)
                    rows.append((True, p[0], len(p[3]), hashlib.sha256(p[3]).hexdigest(), zlib.crc32(p[3][-32:]), len(f), hashlib.sha256(f).hexdigest(), to_rate, *(parted(wide) if apart else [wide.tobytes()])))
                cols = list(zip(*rows, strict=True))
                arrays_out = [*(b.column(c).slice(i, j - i) for c in range(len(keep))), *(pa.array(c, t) for c, (_, t) in zip(cols, out, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays_out, [*keep, *(n for n, _ in out)])

    return media.select(*keep, media_col).mapInArrow(run, schema)


def described(decoded: DataFrame, source_rate: int | None = None) -> DataFrame:
    """Rows of ``decode`` as stored, with ``feature`` in place of the PCM it is computed from.

    With ``source_rate``, of which the stored rate is a multiple, ``resampled_feature`` is that of all samples, and
    ``feature`` that of the source's own: interpolation leaves them, each at the multiple's place.
    """
    signal = [c for c in ("pcm", "pcm_even", "pcm_odd") if c in decoded.columns]
    named = ["feature"] if source_rate is None else ["feature", "resampled_feature"]
    keep = [c for c in decoded.columns if c not in (*signal, *named)]
    schema = ", ".join([*(f"`{c}` {decoded.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} string" for c in named)])

    def said(codec: int, rate: int, parts: list) -> list[str | None]:
        if not parts[0].is_valid:
            return [None] * len(named)
        parts = [x.as_buffer() for x in parts]
        pcm = joined(*parts) if len(parts) == 2 else np.frombuffer(parts[0], "<i2")
        if source_rate is None:
            return [features(codec, rate, pcm)]
        return [features(codec, source_rate, np.ascontiguousarray(pcm[:: rate // source_rate])), features(codec, rate, pcm)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rate = keep.index("codec"), keep.index("rate")
        for b in batches:
            parts = zip(*(b.column(len(keep) + k) for k in range(len(signal))), strict=True)
            rows = [said(c, r, p) for c, r, p in zip(b.column(codec).to_pylist(), b.column(rate).to_pylist(), parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(keep))), *(pa.array([x[k] for x in rows], pa.string()) for k in range(len(named)))], [*keep, *named])

    return decoded.select(*(F.col(f"`{c}`") for c in keep), *signal).mapInArrow(run, schema)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written to the shared folder as a Parquet media column, decoded from there, and their PCM, resampled to twice
    the source's rate, is written too; features of the source's samples and of all come from that, read back."""
    kept = stored(store_text_audio(table(spark, sf_dir, "documents")), "media", **PACKED)
    out = described(stored(decode(kept, ["doc_id", "n_bytes"], apart=True), "media-pcm", **PACKED), RATE)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "resampled_feature")


QUERIES = {"op5_media_columns": op5_media_columns}
ORACLES: dict[str, str] = {}
