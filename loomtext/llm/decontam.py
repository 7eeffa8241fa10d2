"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised alike: A-Z lower-cased, every ASCII byte that is no letter or digit becomes a space,
words are joined by one space. All windows of ``size`` consecutive item words (an item of fewer words is one window)
go into one automaton, with a space on either side so that only whole words match. Each text is normalised and scanned
once; normalising keeps byte positions, so every match is mapped back to the original text.

Defined results: a null or wordless text has no words and no hits; items without words (or null) never match; repeated
items are distinct by item_id; repeated documents each get their row; a very long text is scanned in one go, in memory that
grows with it; an empty table gives no rows and an empty benchmark no hits; columns that are not kept are ignored, whatever
their names, and results replace kept columns of theirs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import stored, table
from loomtext.llm.textvec import utf8

SIZE = 10
#: Bytes of item texts that one automaton is made of; of more items groups of that size are held in turn.
MOST_BYTES = 1 << 20
#: Bytes 0-9, a-z and all from 128 on are word bytes.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Automata built in this worker, by call: a reused worker builds them once.
_MADE: dict[str, list] = {}
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:int,stop:int>>"


def item_windows(items: list[tuple[object, str | None]], size: int = SIZE) -> dict[str, tuple[list[str], int]]:
    """{' w1 .. wn ': (item ids, words)}; latin-1 strings, one character a byte."""
    out: dict[str, tuple[dict[str, None], int]] = {}
    for item, text in items:
        words = (text or "").encode().translate(NORMAL).decode("latin-1").split(" ")
        words = [w for w in words if w]
        for i in range(max(1, len(words) - size + 1) if words else 0):
            w = words[i : i + size]
            out.setdefault(f" {' '.join(w)} ", ({}, len(w)))[0][str(item)] = None
    return {k: (list(ids), n) for k, (ids, n) in out.items()}


def automata(windows: dict[str, tuple[list[str], int]], most: int | None = None) -> list[ahocorasick.Automaton]:
    """One automaton of all windows (none if there is no window), or several of ``most`` windows each."""
    keys, out = sorted(windows), []
    for i in range(0, len(keys), most or max(1, len(keys))):
        a = ahocorasick.Automaton()
        for k in keys[i : i + (most or len(keys))]:
            a.add_word(k, windows[k])
        a.make_automaton()
        out.append(a)
    return out


def scan(text: bytes, machines: list) -> tuple[int, np.ndarray | None, list[str], bytes]:
    """(words, hit flag of each word or None, sorted item ids, normalised bytes as long as the text)."""
    plain = text.translate(NORMAL)
    words = plain.split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0, None, [], plain
    line = b" " + b" ".join(words) + b" "
    found = [(end, ids, n) for a in machines for end, (ids, n) in a.iter(line.decode("latin-1"))]
    if not found:
        return len(words), None, [], plain
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    delta, items = np.zeros(len(words) + 1, np.int32), set()
    last = np.searchsorted(spaces, [e for e, _, _ in found])
    for stop, (_, ids, n) in zip(last, found, strict=True):
        delta[stop - n] += 1
        delta[stop] -= 1
        items.update(ids)
    return len(words), np.cumsum(delta[:-1]) > 0, sorted(items), plain


def hit_spans(text: bytes, plain: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Maximal hit runs as character offsets of the original text."""
    sep = np.frombuffer(plain, np.uint8) == 32
    edge = np.diff(np.concatenate([[True], sep, [True]]).view(np.int8))
    ws, we = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    run = np.diff(np.concatenate([[False], hit, [False]]).view(np.int8))
    return [{"start": int(chars[ws[a]]), "stop": int(chars[we[b - 1]])} for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1), strict=True)]


def _machines(key: str, windows) -> list:
    """The automata of a broadcast, built once a worker."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = automata(windows.value)
    return _MADE[key]


def _described(text: bytes, n: int, hit: np.ndarray | None, ids: list[str], plain: bytes) -> tuple:
    spans = [] if hit is None else hit_spans(text, plain, hit)
    return n, 0 if hit is None else int(hit.sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit is not None, spans


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]


def _batch(kept: list[pa.Array], keep: list[str], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True))], [*keep, *RESULTS])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns (doc_id) of each row with n_words, n_hit, n_items, items_sha256, contaminated and hit spans.

    The spans are offsets of the original text. Items whose texts come to ``MOST_BYTES`` at most (they are counted) are one
    automaton that each text is scanned with once. More items are dealt by hash into groups of about that size, one group
    is held at a time, and the hits of all groups are united by row. Results replace kept columns of their names.
    """
    keep = [c for c in keep or ["doc_id"] if c not in RESULTS]
    named = items.select("item_id", "text").where("item_id IS NOT NULL")
    total = named.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if total > MOST_BYTES:
        return _by_groups(docs, named, -(-total // MOST_BYTES), size, keep, text_col)
    windows = docs.sparkSession.sparkContext.broadcast(item_windows([tuple(r) for r in named.collect()], size))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), SCHEMA])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = _machines(key, windows)
        for b in batches:
            offsets, data = utf8(b.column(len(keep)))
            texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(b.num_rows)]
            yield _batch(b.columns[: len(keep)], keep, [_described(t, *scan(t, machines)) for t in texts])

    return docs.select(*(F.col(f"`{c}`") for c in [*keep, text_col])).mapInArrow(run, schema)


def _by_groups(docs: DataFrame, items: DataFrame, groups: int, size: int, keep: list[str], text_col: str) -> DataFrame:
    """As ``decontaminate``, with a pass over the texts for each group of items; a pass leaves rows with hits only."""
    spark = docs.sparkSession
    names = {c: f"kept_{k}" for k, c in enumerate(keep)}
    d = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("words_of"), *(F.col(f"`{c}`").alias(n) for c, n in names.items())), "decontam-rows")
    hits = None
    for g in range(groups):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(groups)) == g).collect()]
        windows, key = spark.sparkContext.broadcast(item_windows(own, size)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], windows=windows, key=key) -> Iterator[pa.RecordBatch]:
            machines = _machines(key, windows)
            for b in batches:
                offsets, data = utf8(b.column(1))
                rows, flags, found = [], [], []
                for i in range(b.num_rows):
                    _, hit, ids, _ = scan(data[offsets[i] : offsets[i + 1]].tobytes(), machines)
                    if hit is not None:
                        rows.append(b.column(0)[i].as_py())
                        flags.append(np.packbits(hit).tobytes())
                        found.append(ids)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(flags, pa.binary()), pa.array(found, pa.list_(pa.string()))], ["row", "flags", "ids"])

        one = stored(d.select("row", "words_of").mapInArrow(run, "row long, flags binary, ids array<string>"), "decontam-hits")
        hits = one if hits is None else hits.unionByName(one)
    # A row's hits: as many bits as its text has words, from each group that has any.
    united = hits.groupBy("row").agg(F.collect_list("flags").alias("flags"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    both = d.join(united, "row", "left").select(*names.values(), "words_of", "flags", "ids")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), SCHEMA])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(len(keep)))
            rows = []
            for i in range(b.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                n, _, _, plain = scan(text, [])
                flags = b.column(len(keep) + 1)[i].as_py()
                hit = None
                if flags:
                    hit = np.unpackbits(np.bitwise_or.reduce([np.frombuffer(f, np.uint8) for f in flags]), count=n).astype(bool)
                rows.append(_described(text, n, hit, b.column(len(keep) + 2)[i].as_py() or [], plain))
            yield _batch(b.columns[: len(keep)], keep, rows)

    return both.mapInArrow(finish, schema)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON win.n = dw.n AND win.s = array_to_string(w[i:i + dw.n - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLES = {"op4_benchmark_decontamination": OP4_SQL}
