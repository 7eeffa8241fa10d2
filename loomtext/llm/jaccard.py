"""Self-join of documents on the Jaccard similarity of their word shingles: grouped prefix join and components.

A document's set holds the hashes of its distinct k-word shingles (64 bits; A-Z lower-cased, words split at ASCII white
space; fewer words than k: the whole sequence is the one shingle). Documents with equal sets are one class, known by a
digest of the set; everything below works on classes, so copies are never paired.

1. Order. Shingles are put in one global order: first those whose hash lies below a fixed share of the hash space, by
   the number of classes that hold them and then by hash, then all others by hash. Sets that reach the similarity share
   a shingle among the first ``n - ceil(t n) + 1`` of each. The counts of the first kind are taken over all documents,
   through one exchange of packed arrays; shingles that one class alone holds can link nothing and go no further. A
   class whose prefix consists of such shingles, as of nearly all documents that are no near copies, is settled there.
2. Candidates. The remaining prefix entries are dealt by shingle. In each shingle's list classes with equal prefix and
   size form one group; pairs of groups pass the size filter and the positional filter, the members of passing groups
   are expanded and pass a 1024-bit parity filter, an upper bound of the overlap. Classes with no more shingles of the
   first kind than their prefix is long, mostly of short texts, have no positional bound and are grouped by size. What
   is emitted is a spanning forest of the passing pairs of each list, never all pairs.
3. Verification. Each forest edge is verified on the two whole sets. Where edges fail, the lists are gone through once
   more and all passing pairs between different verified components are verified, so that no link is lost.
4. Components of verified edges: contracted within tasks, then by alternating star passes where that is not enough.

A frequent shingle's list is a run of fixed-size records of the classes that have it in their prefix; one that is
common enough to be hot comes last in the order, so it is in a prefix only of sets made of such shingles.

Defined results: null and wordless texts have the empty set, link with nothing and are components of their own; rows
with equal doc_id and unequal text are judged each by its text; rows with a null doc_id link like others, their
component is the smallest doc_id that is not null, or null. Repeated rows are one class and each get their row. A very long
text is one set, held whole by the task that hashes or verifies it. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import buckets, connected, small_side, stored, table, tidy
from loomtext.llm.packed import bucket_of, split
from loomtext.llm.textvec import chunks, mix, shingle_sets, utf8

#: Classes of tokens, documents and prefixes in the exchanges.
TOKENS, CLASS, DOC, PREFIX = 0, 1, 2, 3
PAIR = np.dtype([("token", "<u8"), ("gid", "<u8")])
COUNTED = np.dtype([("gid", "<u8"), ("token", "<u8"), ("df", "<u4")])
ENTRY = np.dtype([("token", "<u8"), ("gid", "<u8"), ("group", "<u8"), ("n", "<u4"), ("rank", "<u4"), ("rest", "<u4"), ("_", "<u4"), ("bits", "<u8", 16)])
FLUSH = 1 << 19
#: Bytes of a parity bitmap.
BITS = 128


def prefix_length(n: np.ndarray | int, num: int, den: int):
    return n - -(-num * n // den) + 1


def set_id(s: np.ndarray) -> int:
    """A 63-bit digest of a set of hashes."""
    both = np.array([np.add.reduce(s) + np.uint64(len(s)), np.bitwise_xor.reduce(mix(s))], np.uint64)
    both = mix(both + np.array([1, 2], np.uint64))
    return int(mix(both[:1] ^ (both[1:] << np.uint64(1)))[0] >> np.uint64(1))


def parity(s: np.ndarray) -> bytes:
    """1024 bits: the parity of the set's elements in each of 1024 hash classes."""
    return np.packbits(np.bincount((s & np.uint64(1023)).astype(np.int64), minlength=1024).astype(np.uint8) & 1).tobytes()


class _Rows:
    """Rows (kind, bucket, blob, doc_id, gid, n, emitted, bits) on their way into record batches."""

    def __init__(self, id_type: pa.DataType):
        self.types = [("kind", pa.int8()), ("bucket", pa.int32()), ("blob", pa.binary()), ("doc_id", id_type), ("gid", pa.int64()), ("n", pa.int64()), ("emitted", pa.int64()), ("bits", pa.binary())]
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, kind, bucket, blob=None, doc_id=None, gid=None, n=None, emitted=None, bits=None):
        self.rows.append((kind, bucket, blob, doc_id, gid, n, emitted, bits))
        self.size += len(blob or b"") + 64

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*self.rows, strict=True), self.types, strict=True)], [n for n, _ in self.types])
        self.rows, self.size = [], 0

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size > 8 * FLUSH:
            yield from self.batch()


def _first(k: int, num: int, den: int, share: float, pieces: int):
    """Documents (doc_id, text, hash of the text or null) -> packed (token, class) pairs, one CLASS row a class and batch,
    one DOC row a document, with that hash in ``emitted``."""
    limit = np.uint64(int(share * 2**64) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _Rows(b.schema.field(0).type)
            offsets, data = utf8(b.column(1))
            ids, seen, toks, gids, held = b.column(0).to_pylist(), {}, [], [], 0
            texts = b.column(2).to_pylist()

            def flush():
                pairs = np.empty(held, PAIR)
                pairs["token"] = np.concatenate(toks) if toks else 0
                pairs["gid"] = np.repeat(np.array([g for g, _ in gids], np.uint64), [m for _, m in gids])
                for at, blob in split(pairs, "token", pieces):
                    out.add(TOKENS, at, blob)

            for i, j in chunks(offsets):
                for r, s in enumerate(shingle_sets(offsets, data, i, j, k), i):
                    n = len(s)
                    if not n:
                        out.add(DOC, r % pieces, doc_id=ids[r], n=0, emitted=texts[r])
                        continue
                    gid = set_id(s)
                    out.add(DOC, r % pieces, doc_id=ids[r], gid=gid, n=n, emitted=texts[r])
                    if gid in seen:
                        if ids[r] is not None and (seen[gid][0] is None or ids[r] < seen[gid][0]):
                            seen[gid][0] = ids[r]
                        continue
                    m = max(int(np.searchsorted(s, limit)), min(n, prefix_length(n, num, den)))
                    seen[gid] = [ids[r], n, m, parity(s)]
                    toks.append(s[:m])
                    gids.append((gid, m))
                    held += m
                if held > FLUSH:
                    flush()
                    toks, gids, held = [], [], 0
                yield from out.full()
            if held:
                flush()
            for gid, (doc_id, n, m, bits) in seen.items():
                out.add(CLASS, int(bucket_of(np.array([gid], np.uint64), pieces)[0]), doc_id=doc_id, gid=gid, n=n, emitted=m, bits=bits)
            yield from out.batch()

    return run


def _blobs(b: pa.RecordBatch, kind: int, dtype: np.dtype) -> list[np.ndarray]:
    kinds = b.column(0).to_numpy()
    return [np.frombuffer(b.column(2)[int(r)].as_buffer(), dtype) for r in np.flatnonzero(kinds == kind)]


def _rest(b: pa.RecordBatch) -> pa.RecordBatch:
    return b.filter(pc.not_equal(b.column(0), pa.scalar(TOKENS, pa.int8())))


def _count(pieces: int):
    """(token, class) pairs -> those of tokens that two classes or more hold, with that count, packed by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, out = [], None
        for b in batches:
            out = out or _Rows(b.schema.field(3).type)
            parts += _blobs(b, TOKENS, PAIR)
            yield _rest(b)
        if not parts:
            return
        pairs = np.concatenate(parts)
        del parts
        pairs = pairs[np.lexsort((pairs["gid"], pairs["token"]))]
        same = pairs["token"][1:] == pairs["token"][:-1]
        pairs = pairs[np.concatenate([[True], ~(same & (pairs["gid"][1:] == pairs["gid"][:-1]))])]
        starts = np.flatnonzero(np.concatenate([[True], pairs["token"][1:] != pairs["token"][:-1]]))
        df = np.diff(np.append(starts, len(pairs)))
        df = np.repeat(df, df)
        keep = df >= 2
        counted = np.empty(int(keep.sum()), COUNTED)
        counted["gid"], counted["token"], counted["df"] = pairs["gid"][keep], pairs["token"][keep], df[keep]
        for at, blob in split(counted, "gid", pieces):
            out.add(TOKENS, at, blob)
        yield from out.batch()

    return run


def _prefixes(num: int, den: int, pieces: int):
    """Counted tokens by class -> PREFIX blobs by token, a CLASS row for each class that has any, DOC rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known, out = [], {}, None
        for b in batches:
            out = out or _Rows(b.schema.field(3).type)
            parts += _blobs(b, TOKENS, COUNTED)
            kinds = b.column(0).to_numpy()
            own = b.take(pa.array(np.flatnonzero(kinds == CLASS)))
            for doc_id, gid, n, m, bits in zip(*(own.column(c).to_pylist() for c in (3, 4, 5, 6, 7)), strict=True):
                have = known.setdefault(gid, [doc_id, n, m, bits])
                if doc_id is not None and (have[0] is None or doc_id < have[0]):
                    have[0] = doc_id
            yield b.take(pa.array(np.flatnonzero(kinds == DOC)))
        if not parts:
            return
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["token"], rows["df"], rows["gid"]))]
        starts = np.flatnonzero(np.concatenate([[True], rows["gid"][1:] != rows["gid"][:-1]])) if len(rows) else np.zeros(0, int)
        made = []
        for a, z in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            gid = int(rows["gid"][a])
            doc_id, n, emitted, bits = known[gid]
            alone = emitted - (z - a)
            p = prefix_length(n, num, den)
            # Where more was emitted than the prefix, all of it is of the counted kind; else all of it is the prefix.
            keep = min(z - a, p - alone) if emitted > p else z - a
            if keep <= 0:
                continue
            e = np.empty(keep, ENTRY)
            tokens = rows["token"][a : a + keep] if emitted > p else np.sort(rows["token"][a:z])
            e["token"], e["gid"], e["n"] = tokens, gid, n
            e["rank"] = np.arange(keep)
            e["rest"] = n - alone - 1 - np.arange(keep)
            e["group"] = gid if alone else int(mix(np.array([np.bitwise_xor.reduce(mix(tokens)) + np.uint64(n)], np.uint64))[0])
            if emitted <= p:  # others may hold its tokens beyond their prefix, even those alone here: only the size bounds the overlap
                e["rank"] = e["rest"] = n
                e["group"] = int(mix(np.array([n], np.uint64))[0])
            e["bits"] = np.frombuffer(bits, "<u8")
            e["_"] = 0
            made.append(e)
            out.add(CLASS, int(bucket_of(np.array([gid], np.uint64), pieces)[0]), doc_id=doc_id, gid=gid, n=n)
            yield from out.full()
        if made:
            for at, blob in split(np.concatenate(made), "token", pieces):
                out.add(PREFIX, at, blob)
        yield from out.batch()

    return run


def _passes(e: np.ndarray, x: int, others: np.ndarray, groups: np.ndarray, of: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``others`` may reach the similarity with x (filters of group pairs, then of their members), and how far these are."""
    g, h = e[x], groups
    n = h["n"].astype(np.int64) + int(g["n"])
    most = np.minimum(h["rank"], g["rank"]).astype(np.int64) + 1 + np.minimum(h["rest"], g["rest"])
    group_ok = (np.minimum(h["n"], g["n"]).astype(np.int64) * den >= num * np.maximum(h["n"], g["n"]).astype(np.int64)) & (most * (num + den) >= num * n)
    ok = group_ok[of[others]]
    far = np.bitwise_count(e["bits"][others[ok]] ^ g["bits"]).sum(1, dtype=np.int64)
    both = e["n"][others[ok]].astype(np.int64) + int(g["n"])
    near = (both - far) // 2 * (num + den) >= num * both
    ok[ok] = near
    return ok, far[near]


def _lists(e: np.ndarray) -> Iterator[np.ndarray]:
    """The entries of each token that two classes or more have, sorted by size."""
    e = e[np.lexsort((e["gid"], e["n"], e["token"]))]
    starts = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
    stops = np.append(starts[1:], len(e))
    for a, z in zip(starts[stops - starts > 1], stops[stops - starts > 1], strict=True):
        yield e[a:z]


def _grouped(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, of = np.unique(e["group"], return_index=True, return_inverse=True)
    return e[first], of


def forest(e: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that span the graph of passing pairs of one token's list."""
    groups, of = _grouped(e)
    left, edges, gid = np.arange(len(e)), [], e["gid"]
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            ok, _ = _passes(e, x, left, groups, of, num, den)
            if ok.any():
                new = left[ok]
                edges += [(int(gid[x]), int(gid[y])) for y in new if gid[x] != gid[y]]
                todo += list(new)
                left = left[~ok]
    return edges


def _edges(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for b in batches for x in _blobs(b, PREFIX, ENTRY)]
        found: set[tuple[int, int]] = set()
        for e in _lists(np.concatenate(parts)) if parts else []:
            found.update((min(p), max(p)) for p in forest(e, num, den))
            if len(found) > FLUSH:
                yield _pairs(found)
                found = set()
        yield _pairs(found)

    return run


def _pairs(found) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for e in _blobs(b, PREFIX, ENTRY):
            cols = [pa.array(e[c].astype(np.int64)) for c in ("token", "gid", "group", "n", "rank", "rest")]
            ends = pa.py_buffer(np.arange(0, BITS * (len(e) + 1), BITS, dtype=np.int32))
            bits = pa.Array.from_buffers(pa.binary(), len(e), [None, ends, pa.py_buffer(np.ascontiguousarray(e["bits"]))])
            yield pa.RecordBatch.from_arrays([*cols, bits], ["token", "gid", "group", "n", "rank", "rest", "bits"])


def _cross(num: int, den: int, nearest: bool):
    """Passing pairs of different components in each token's list; rows come with their component.

    ``nearest``: for each class only the one with the fewest differing bits, a linear number; else all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        found: set[tuple[int, int]] = set()
        if t is not None and t.num_rows:
            e = np.zeros(t.num_rows, ENTRY)
            for c in ("token", "gid", "group"):
                e[c] = t[c].to_numpy().astype(np.uint64)
            for c in ("n", "rank", "rest"):
                e[c] = t[c].to_numpy()
            at, data = utf8(t["bits"].combine_chunks())
            e["bits"] = data[at[0] : at[-1]].view("<u8").reshape(-1, 16)
            _, e["_"] = np.unique(t["component"].to_numpy(), return_inverse=True)
            for lst in _lists(e):
                if (lst["_"] == lst["_"][0]).all():
                    continue
                groups, of = _grouped(lst)
                for x in range(len(lst)):
                    others = np.arange(0 if nearest else x + 1, len(lst))
                    others = others[lst["_"][others] != lst["_"][x]]
                    if not len(others):
                        continue
                    ok, far = _passes(lst, x, others, groups, of, num, den)
                    partners = lst["gid"][others[ok]]
                    if nearest and len(partners):
                        partners = partners[np.lexsort((partners, far))[:1]]
                    g = int(lst["gid"][x])
                    found.update((min(g, y), max(g, y)) for y in partners.tolist())
                if len(found) > FLUSH:
                    yield _pairs(found)
                    found = set()
        yield _pairs(found)

    return run


def _sets(k: int):
    """(gid, elements) of documents (text, gid) whose set has that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = utf8(b.column(0))
            want = b.column(1).to_pylist()
            for i, j in chunks(offsets):
                rows = [(want[r], s) for r, s in enumerate(shingle_sets(offsets, data, i, j, k), i) if len(s) and set_id(s) == want[r]]
                ends = np.cumsum([0, *(len(s) for _, s in rows)])
                flat = np.concatenate([np.zeros(0, np.uint64), *(s for _, s in rows)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["gid", "elements"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, share: float | None = None, by_row: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; documents link where num/den of the union is common.

    ``share`` is the part of the hash space whose shingles are counted; it changes the work, never the result.
    ``by_row`` adds text_hash (xxhash64) and component, a number that rows of one component share, null for empty sets.
    """
    spark = docs.sparkSession
    share = share or min(1.0, 0.1 + 1.5 * (1 - num / den))
    pieces = buckets(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind byte, bucket int, blob binary, doc_id {id_type}, gid long, n long, emitted long, bits binary"
    d = docs.select("doc_id", "text")
    pairs = d.withColumn("_t", F.xxhash64("text") if by_row else F.lit(None).cast("long")).mapInArrow(tidy(_first(k, num, den, share, pieces)), schema).repartition("bucket")
    counted = pairs.mapInArrow(tidy(_count(pieces)), schema).repartition("bucket")
    state = stored(counted.mapInArrow(tidy(_prefixes(num, den, pieces)), schema), "jaccard-state")
    members = state.where(F.col("kind") == DOC).select("doc_id", "gid", "n", "emitted")
    lists = state.where(F.col("kind") == PREFIX)
    edges = stored(lists.repartition("bucket").mapInArrow(tidy(_edges(num, den)), "a long, b long").distinct(), "jaccard-edges")

    def ends(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("gid")).unionByName(e.select(F.col("b").alias("gid"))).distinct()

    reps = state.where(F.col("kind") == CLASS).select("gid", F.col("doc_id").alias("_id"))

    def verified(e: DataFrame, name: str) -> DataFrame:
        want = small_side(stored(reps.join(ends(e), "gid"), f"{name}-ends"))
        sets = d.join(want, d["doc_id"].eqNullSafe(want["_id"])).select("text", "gid").mapInArrow(tidy(_sets(k)), "gid long, elements array<long>")
        sets = stored(sets.dropDuplicates(["gid"]) if d.schema["doc_id"].nullable and _repeated(want, d) else sets, f"{name}-sets")
        both = e.join(sets.select(F.col("gid").alias("b"), F.col("elements").alias("y")), "b").join(sets.select(F.col("gid").alias("a"), F.col("elements").alias("x")), "a")
        # Whole sets are compared in the JVM, a pair at a time: no batch of wide rows is built.
        common = F.size(F.array_intersect("x", "y")).cast("long")
        return stored(both.select("a", "b", (common * den >= (F.size("x") + F.size("y") - common) * num).alias("ok")), f"{name}-checked")

    done = verified(edges, "jaccard-1")
    links = done.where("ok").select("a", "b")
    if not done.where("NOT ok").isEmpty():
        known = stored(ends(edges), "jaccard-known")
        rows = lists.mapInArrow(tidy(_unpack), "token long, gid long, group long, n long, rank long, rest long, bits binary").join(known, "gid", "left_semi")
        # First what is nearest, which joins most of what belongs together; then all that is still apart.
        for step in (2, 3):
            comp = connected(links, f"jaccard-cc{step}")
            own = known.join(comp, F.col("gid") == comp["node"], "left").select("gid", F.coalesce("component", "gid").alias("component"))
            apart = rows.join(own, "gid").select("token", "gid", "group", "n", "rank", "rest", "bits", "component").repartition("token")
            cross = apart.mapInArrow(tidy(_cross(num, den, nearest=step == 2)), "a long, b long").distinct()
            cross = stored(cross.join(done.select("a", "b"), ["a", "b"], "left_anti"), f"jaccard-cross{step}")
            if not cross.isEmpty():
                done = done.unionByName(verified(cross, f"jaccard-{step}"))
                links = done.where("ok").select("a", "b")
    comp = stored(connected(links, "jaccard-cc"), "jaccard-components")
    # Classes of several rows or in a component of several classes: the smallest doc_id by aggregation.
    tagged = stored(members.join(comp, members["gid"] == comp["node"], "left").select("doc_id", "n", F.col("emitted").alias("text_hash"), F.coalesce("component", "gid").alias("_c")), "jaccard-tagged")
    several = tagged.where("_c IS NOT NULL").groupBy("_c").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")).where("_n > 1")
    several = small_side(stored(several.select(F.col("_c").alias("_l"), "least"), "jaccard-least"))
    out = tagged.join(several, tagged["_c"] == several["_l"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_l").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), *([F.col("text_hash"), F.col("_c").alias("component")] if by_row else []))


def _repeated(want: DataFrame, d: DataFrame) -> bool:
    """Whether a wanted doc_id stands on several rows, so that a class could come twice."""
    return not d.join(want.select("_id").distinct(), d["doc_id"].eqNullSafe(F.col("_id"))).groupBy("doc_id").count().where("count > 1").isEmpty()


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(doc_id, k) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.y, r.k FROM r JOIN l ON l.x = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.k AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(k) AS k FROM r GROUP BY doc_id) m USING (doc_id)
"""
QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
ORACLES = {"op3_ngram_jaccard_join": OP3_SQL}
