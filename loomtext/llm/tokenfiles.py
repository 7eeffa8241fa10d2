"""Token ids in shards of Re-Pair grammars, written in the order of document ids.

Documents are range-partitioned by id, tokenized in that order and cut into shards of about ``SHARD`` ids at document
boundaries. In a shard the frequent pairs of neighbouring symbols are replaced by nonterminals, again and again: each
round counts all pairs, takes the frequent ones in falling order as long as no symbol is the left of one and the right of
another (so that all their occurrences can be replaced at once), and goes on until a round saves little. No pair touches
an end id, so every document is a run of symbols of its own.

A shard is one binary value (a row of a Parquet table, so Spark's committer writes it and a lost task leaves nothing):

    "RPG1", u32: first nonterminal, rules, documents, symbols, width of a symbol (2 or 4), ids
    u32 x rules: left symbols; then right symbols; then expansion lengths
    u32 x documents: ids of each; then symbols of each
    u32 x ceil(symbols / 256): ids before every 256th symbol
    symbols as u16, or as their low and then their high halves; at last the CRC-32 of all before it

All numbers are little-endian. A rule's sides are smaller than its own symbol. Expansion lengths and sampled positions let
``ids_between`` decode a stretch of ids from its own symbols alone.

Defined results: null texts are empty and have the end id alone; null document ids come first; equal document ids stand in
the order of a hash of their texts; an empty table gives no shard; a text of any length is one document of one shard,
which then is as large as that text. Columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import stored, table
from loomtext.llm.textvec import chunks, utf8

END_ID = 1
#: Ids of a shard, at least, where there are so many.
SHARD = 1 << 18
#: A pair is frequent from here on; candidates a round; a round must save this share of the symbols for another to follow.
LEAST, CANDIDATES, SAVES = 16, 32768, 1 / 16
SAMPLE = 256
#: Bytes of text that are split into words at once.
SLICE = 1 << 20
MAGIC = b"RPG1"
_HEAD = struct.Struct("<4s6I")
#: Words, bytes of words, and runs of letters or punctuation that an encoder keeps.
MOST_WORDS, MOST_WORD_BYTES, MOST_PARTS = 1_000_000, 32 << 20, 400_000


# ---- ids of texts

#: Punctuation but apostrophes and the "<" of special tokens, Latin letters without combining marks, punctuation.
_PUNCT = r"([!-&(-/:;=-@\[-`{-~]*)"
_STOPS = b".,;:!?"
_PLAIN = re.compile(_PUNCT + "([A-Za-zÀ-ÖØ-öø-ÿ]+)" + _PUNCT).fullmatch


class Encoder:
    """Ids of whole texts, each followed by the end id.

    ``by_word`` asks the tokenizer once for each distinct run of bytes between ASCII white space and puts the answers
    together. That is the same for tokenizers whose pre-tokenizer drops white space and never looks across it, such as
    the ``word_bpe`` vocabulary; others take whole texts. New words of Latin letters, with or without punctuation around
    them, are split here and go straight to the tokenizer's model, if that gives the tokenizer's own answers on a few
    probes; all others go through the whole tokenizer. Of the words known when there are too many, those used most stay.
    """

    def __init__(self, path: str, by_word: bool, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word, self.end_id = Tokenizer.from_file(path), by_word, end_id
        self.letters = None
        self.known: dict[bytes | None, int] = {None: 0}
        self.flat, self.starts, self.sizes, self.uses = np.array([end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)
        self.bytes = 0
        if by_word:
            from tokenizers import pre_tokenizers

            self.letters, self.model, self.parts = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), self.tokenizer.model, {}
            probes = ["word", "Wörter", "ÉTÉ", "(as)", "no!?", "--Ñandú;", "a", "ÿ...", "Encyclopædia", "\"Straße\","]
            if self._ids_of_words([w.encode() for w in probes]) != self._encode(probes):
                self.letters = None

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed: bytes are nothing that Python's collector has to look through."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        """Keeps the half of the words that was used most, and the end id."""
        words = list(self.known)
        at = np.sort(1 + np.argsort(-self.uses[1:], kind="stable")[: len(words) // 2])
        at = at[self.uses[at] > 1]
        at = np.concatenate([[0], at[np.cumsum([len(words[k]) for k in at.tolist()]) <= MOST_WORD_BYTES // 2] if len(at) else at]).astype(np.int64)
        self.known = {words[k]: n for n, k in enumerate(at.tolist())}
        self.bytes = sum(len(w) for w in self.known if w)
        sizes = self.sizes[at]
        self.flat = _gather(self.flat, self.starts[at], sizes)
        self.starts, self.sizes, self.uses = np.cumsum(sizes) - sizes, sizes, self.uses[at] // 2

    def _part(self, run: bytes) -> bytes:
        """Ids of a run of lower-case letters or of punctuation."""
        out = self.parts.get(run)
        if out is None:
            if len(self.parts) > MOST_PARTS:
                self.parts.clear()
            text = run.decode()
            mapped = text if run.isascii() else "".join(x for x, _ in self.letters.pre_tokenize_str(text))
            out = self.parts[run] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return out

    def _ids_of_words(self, words: list[bytes]) -> list[bytes]:
        if self.letters is None:
            return self._encode([w.decode() for w in words])
        out: list = []
        other, part = [], self._part
        for k, w in enumerate(words):
            if w.isalpha():  # of bytes: ASCII letters only
                out.append(part(w.lower()))
            elif w[-1] in _STOPS and w[:-1].isalpha():
                out.append(part(w[:-1].lower()) + part(w[-1:]))
            elif m := _PLAIN(w.decode()):
                out.append(b"".join([part(x.encode()) for x in (m[1], m[2].lower(), m[3]) if x]))
            else:
                other.append(k)
                out.append(b"")
        for k in range(0, len(other), 4096):
            few = other[k : k + 4096]
            for at, ids in zip(few, self._encode([words[x].decode() for x in few]), strict=True):
                out[at] = ids
        return out

    def _learn(self, words: list[bytes]) -> None:
        ids = self._ids_of_words(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.bytes += sum(map(len, words))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has) of a column of strings; null is empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        if not self.by_word:
            end = array("I", [self.end_id]).tobytes()
            out = [x + end for x in self._encode(texts.to_pylist())]
            return np.frombuffer(b"".join(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out)) // 4
        collects = gc.isenabled()
        gc.disable()  # millions of small objects and no cycle among them
        try:
            return self._by_word(texts)
        finally:
            if collects:
                gc.enable()

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MOST_WORDS or self.bytes > MOST_WORD_BYTES:
            self._forget()
        offsets, data = utf8(texts)
        words: list[bytes | None] = []
        upto = np.zeros(len(texts) + 1, np.int64)
        for k in range(len(texts)):
            own = data[offsets[k] : offsets[k + 1]].tobytes()
            # Capitals are lowered by the tokenizer; here it saves words. A special token is told by its case.
            words += (own if self.letters is None or b"<|" in own else own.lower()).split()
            words.append(None)
            upto[k + 1] = len(words)
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            self._learn(list(dict.fromkeys(words[k] for k in unknown.tolist())))
            at[unknown] = np.fromiter((self.known[words[k]] for k in unknown.tolist()), np.int64, len(unknown))
        self.uses += np.bincount(at, minlength=len(self.uses))
        sizes = self.sizes[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return _gather(self.flat, self.starts[at], sizes), np.diff(before[upto])


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, one behind the other."""
    upto = np.cumsum(sizes)
    return flat[np.repeat(starts - upto + sizes, sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, by_word: bool, end_id: int) -> Encoder:
    """One encoder for each setting and worker process."""
    key = (path, by_word, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


# ---- grammars


def _disjoint(pairs: np.ndarray) -> np.ndarray:
    """Of pairs in falling order of their counts those of which no left symbol is a right one of another."""
    lefts: set[int] = set()
    rights: set[int] = set()
    out = []
    for k, (a, b) in enumerate(zip((pairs >> np.uint64(32)).tolist(), (pairs & np.uint64(0xFFFFFFFF)).tolist(), strict=True)):
        if a in rights or b in lefts or (a == b and (a in lefts or a in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        out.append(k)
    return pairs[out]


def compress(ids: np.ndarray, first: int, end_id: int = END_ID, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): a rule is left << 32 | right and stands for the symbol ``first`` plus its place."""
    seq, rules, after = ids.astype(np.uint64), [], first
    end = np.uint64(end_id)
    while len(seq) > 1:
        keys = seq[:-1] << np.uint64(32) | seq[1:]
        inner = seq != end
        ordered = np.sort(keys[inner[:-1] & inner[1:]])
        starts = np.flatnonzero(np.concatenate([[len(ordered) > 0], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(ordered)]]))
        hot = np.flatnonzero(counts >= least)
        if not len(hot):
            break
        hot = hot[np.lexsort((ordered[starts[hot]], -counts[hot]))[:CANDIDATES]]
        taken = np.sort(_disjoint(ordered[starts[hot]]))
        is_left, is_right = np.zeros(after, bool), np.zeros(after, bool)
        is_left[taken >> np.uint64(32)] = True
        is_right[taken & np.uint64(0xFFFFFFFF)] = True
        at = np.flatnonzero(is_left[seq[:-1]] & is_right[seq[1:]])
        rule = np.minimum(np.searchsorted(taken, keys[at]), len(taken) - 1)
        found = taken[rule] == keys[at]
        at, rule = at[found], rule[found]
        same = seq[at] == seq[at + 1]
        if same.any():  # of a run of one symbol every second place
            run = np.concatenate([[True], (np.diff(at) != 1) | ~same[1:] | ~same[:-1] | (rule[1:] != rule[:-1])])
            odd = (np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 1
            at, rule = at[~(odd & same)], rule[~(odd & same)]
        seq[at] = (rule + after).astype(np.uint64)
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        before, seq = len(seq), seq[kept]
        rules.append(taken)
        after += len(taken)
        if before - len(seq) < before * SAVES:
            break
    return seq.astype(np.uint32), np.concatenate(rules) if rules else np.zeros(0, np.uint64)


def _lengths(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """Expansion lengths of rules whose sides are smaller than themselves."""
    out = [0] * len(left)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[k] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return np.array(out, np.uint32)


def write_shard(ids: np.ndarray, sizes: np.ndarray, first: int, end_id: int = END_ID) -> bytes:
    """The binary form of documents given as ids in a row and how many each has; every document ends with the end id."""
    symbols, rules = compress(ids, first, end_id)
    left, right = (rules >> np.uint64(32)).astype(np.uint32), (rules & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lengths = _lengths(left, right, first)
    size = np.concatenate([np.ones(first, np.uint32), lengths])[symbols]
    before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    ends = np.searchsorted(before, np.cumsum(sizes))
    width = 2 if first + len(rules) <= 1 << 16 else 4
    parts = [_HEAD.pack(MAGIC, first, len(rules), len(sizes), len(symbols), width, len(ids))]
    parts += [x.astype("<u4").tobytes() for x in (left, right, lengths, sizes, np.diff(np.concatenate([[0], ends])), before[:-1][::SAMPLE])]
    parts.append((symbols & np.uint32(0xFFFF)).astype("<u2").tobytes())
    if width == 4:
        parts.append((symbols >> np.uint32(16)).astype("<u2").tobytes())
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard's bytes, read."""

    def __init__(self, data: bytes):
        magic, self.first, rules, docs, symbols, width, self.n_ids = _HEAD.unpack_from(data)
        body = memoryview(data)[:-4]
        if magic != MAGIC or struct.unpack_from("<I", data, len(data) - 4)[0] != zlib.crc32(body):
            raise ValueError("no sound shard of token ids")
        at = _HEAD.size

        def numbers(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        left, right, self.lengths = (numbers(rules, "<u4") for _ in range(3))
        self.sizes, self.doc_symbols = numbers(docs, "<u4").astype(np.int64), numbers(docs, "<u4").astype(np.int64)
        self.samples = numbers(-(-symbols // SAMPLE), "<u4")
        self.symbols = numbers(symbols, "<u2").astype(np.uint32)
        if width == 4:
            self.symbols |= numbers(symbols, "<u2").astype(np.uint32) << np.uint32(16)
        self.size = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])
        # Every rule written out, behind the plain ids, so that a symbol is a stretch of one array.
        flat = np.arange(self.first, self.first + rules, dtype=np.uint32)
        while (nested := flat >= self.first).any():
            out = np.repeat(flat, 1 + nested)
            at2 = np.flatnonzero(nested) + np.arange(int(nested.sum()))
            out[at2], out[at2 + 1] = left[flat[nested] - self.first], right[flat[nested] - self.first]
            flat = out
        self.flat = np.concatenate([np.arange(self.first, dtype=np.uint32), flat])
        self.place = np.concatenate([np.arange(self.first), self.first + np.cumsum(self.lengths, dtype=np.int64) - self.lengths])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return _gather(self.flat, self.place[symbols], self.size[symbols])

    def ids(self) -> np.ndarray:
        out = self.expand(self.symbols)
        if len(out) != self.n_ids or self.sizes.sum() != self.n_ids:
            raise ValueError("a shard's ids are not as many as it says")
        return out

    def ids_between(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, from the symbols that cover them."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        k = int(np.searchsorted(self.samples, start, "right")) - 1
        z = min(int(np.searchsorted(self.samples, stop, "left")) * SAMPLE, len(self.symbols))
        near = self.expand(self.symbols[k * SAMPLE : z])
        skip = int(self.samples[k])
        return near[start - skip : stop - skip]

    def document(self, k: int) -> np.ndarray:
        start = int(self.sizes[:k].sum())
        return self.ids_between(start, start + int(self.sizes[k]))


# ---- tables


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, by_word: bool = False, shard: int = SHARD) -> DataFrame:
    """Shards of all documents, stored: (part, shard, first, n_ids, doc_ids, data).

    ``path`` is the tokenizer's file. Parts and the shards in them are in ascending order of document ids; ``first``
    counts the ids of the part before the shard.
    """
    from tokenizers import Tokenizer

    first = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0) + 1
    first = max(first, end_id + 1)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, number, before = TaskContext.get().partitionId(), encoder(path, by_word, end_id), 0, 0
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, held, names, ids, sizes
            every, n = np.concatenate(ids), np.concatenate(sizes)
            own = pa.concat_arrays(names)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(every)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([write_shard(every, n, first, end_id)], pa.binary())]
            number, before, held, names, ids, sizes = number + 1, before + len(every), 0, [], [], []
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "first", "n_ids", "doc_ids", "data"])

        for b in batches:
            offsets, _ = utf8(b.column(1))
            for i, j in chunks(offsets, min(SLICE, 4 * shard)):
                own, n = encode(b.column(1).slice(i, j - i))
                names.append(b.column(0).slice(i, j - i))
                ids.append(own)
                sizes.append(n)
                held += len(own)
                if held >= shard:
                    yield flush()
        if names:
            yield flush()

    # Rows of one document id may be a third of all, so ranges go on within it; equal rows can change places.
    keys = [F.col("_id").asc_nulls_first(), F.xxhash64("_text"), F.col("_row")]
    dealt = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_text")
    return stored(dealt.mapInArrow(run, f"part int, shard int, first long, n_ids long, doc_ids array<{kind}>, data binary"), "token-shards")


def _starts(shards: DataFrame) -> DataFrame:
    """(part, base): ids of all parts before. One number a part passes through the driver."""
    totals = sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, rows = 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    return F.broadcast(shards.sparkSession.createDataFrame(rows, "part int, base long"))


def read_ids(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents as the shards hold them: (doc_id, start, n_tokens, ids_crc32) and with ``with_ids`` their ``ids``."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                s = Shard(b.column(3)[k].as_py())
                every = s.ids().astype("<u4", copy=False)
                upto = np.concatenate([[0], np.cumsum(s.sizes)])
                raw, cut = memoryview(every).cast("B"), (4 * upto).tolist()
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
                cols = [pa.array(np.full(len(crc), b.column(0)[k].as_py(), np.int32)), b.column(2).slice(k, 1).flatten(), pa.array(upto[:-1] + b.column(1)[k].as_py()), pa.array(s.sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(every.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    rows = shards.select("part", "first", "doc_ids", "data").mapInArrow(run, f"part int, doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    rows = rows.join(_starts(shards), "part").withColumn("start", F.col("start") + F.col("base"))
    return rows.drop("part", "base")


def fetch(shards: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted documents only: each shard that holds one is opened and just their stretches decoded."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    index = shards.select("part", "shard", F.posexplode("doc_ids").alias("at", "doc_id"))
    asked = wanted.select(F.col(id_col).alias("doc_id")).distinct()
    places = index.join(asked, "doc_id", "left_semi").groupBy("part", "shard").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                s, found = Shard(b.column(0)[k].as_py()), b.column(1).slice(k, 1).flatten()
                ids = [s.document(x) for x in found.field(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([found.field(1), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return shards.join(places, ["part", "shard"]).select("data", "found").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space is dropped by this vocabulary, so each distinct word is tokenized once a worker."""
    import public_tokenizers

    shards = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_word=True)
    return read_ids(shards, with_ids=False)


QUERIES = {"op13_token_ids": op13_token_ids}
ORACLES: dict[str, str] = {}
