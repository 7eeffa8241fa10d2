"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel. Two words are compared by their common subsequences of three letters, each occurrence weighted by
``decay ** span`` (span: characters from its first to its last, at most ``SPAN``), normalised to 1 for equal words and
raised to ``POWER``. A mark stands before and after each word. Characters that are no letters are gaps, not symbols; runs of three or more
single letters are read as one word. So ``i-d-i-o-t``, ``i d i o t`` and ``idiiot`` stay near ``idiot``, and unseen
inflections stay near their stem.

Nystroem. Landmarks are words of the training sentences: those that most favour toxic texts, thinned of near copies,
and frequent clean ones. A word's features are its kernel values with the landmarks times K(landmarks)^-1/2. A linear
machine with squared hinge loss is trained on them by Newton steps.

Sentences. A sentence, split at line feeds and closing marks, is taken as the set of its words, and two neighbours of at
most ``SHORT`` letters in it also as one word, so that a blank inside an insult does not hide it. A sentence is as toxic as
its highest word and a text as its highest sentence. Labels are on texts: which words of a toxic text make it so is
latent, so training alternates between the machine and the labels of the words of toxic texts: those scored negative
become clean, the highest stays toxic. Disguised forms (one or two characters inserted, letters doubled, gaps between
letters) of the landmarks found toxic join the last step. A logistic curve fitted on the training texts maps the scores of
a text's highest distinct words and the number of its words that are not toxic to 0..1; the weights of the scores are not
negative, so a text's score does not fall as insults are added.

Words are scored once in each worker's bounded cache.

Training uses a bounded sample of labelled rows (``per_class`` texts of each label, the first in a hash order of
doc_id, ``max_chars`` characters in all); scoring takes whole texts and nothing but the text.

Defined results: null, empty and wordless texts get the score of a text without known letters; repeated rows get equal
scores, whatever their ids; rows whose label is null are not used; without a toxic or without a clean training text every
score is 0; equal word scores tie without effect; a very long text is scored whole, its distinct words at a time; an empty
table gives no rows; kept columns named score or predicted are replaced.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import table, tidy

DECAY, SPAN = 0.55, 7
PER_CLASS = 700
MAX_CHARS = 8_000_000
LANDMARKS, CLEAN_LANDMARKS = 112, 48
RIDGE, TOXIC_WEIGHT = 1e-6, 1.0
#: The kernel's power: a word must share several subsequences with a landmark to be near it.
POWER = 2
#: Words whose kernel value with every landmark is below this train as one: they are near nothing.
FAR = 0.04
#: How many standard errors more often in toxic texts than in clean ones a word must stand to be a landmark for them.
FAVOUR = 2.0
#: How many of a text's highest word scores count.
TOP = 3
#: Neighbours of at most so many letters are scored as one word too.
SHORT = 3
#: The weight of a word's disguised forms in all, as a share of the word's own.
DISGUISED = 3.0
#: Letters a-z, then the lower-case letters of Latin-1; all other letters share the last code, non-letters are 0.
CODES = 64
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_]){2,}(?!\S)")
CACHE = 400_000
_LONGEST = 64


def _code_table() -> np.ndarray:
    t = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        if 97 <= c <= 122:
            t[c] = c - 96
        elif 0xDF <= c <= 0xFF and c != 0xF7:
            t[c] = 27 + c - 0xDF
        elif c > 0xFF and not 0xD800 <= c <= 0xDFFF and chr(c).isalpha():
            t[c] = 63
    return t


_table: list[np.ndarray] = []


def codes(words: list[str], length: int) -> np.ndarray:
    if not _table:
        _table.append(_code_table())
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
    inner = _table[0][np.minimum(flat, 0xFFFF)]
    edge = np.ones((len(words), 1), np.uint8)
    return np.concatenate([61 * edge, inner, 62 * edge], axis=1)


_triples: dict[int, tuple] = {}


def triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k of all subsequences within SPAN, and their weights."""
    if length not in _triples:
        ijk = np.array([(i, j, k) for i in range(length) for k in range(i + 2, min(length, i + SPAN)) for j in range(i + 1, k)], np.int64).reshape(-1, 3)
        _triples[length] = (*ijk.T, (DECAY ** (ijk[:, 2] - ijk[:, 0] + 1)).astype(np.float32))
    return _triples[length]


def occurrences(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, weights, norms) for words of one length: each subsequence of each word, 0 where a character is no letter."""
    c = codes(words, length).astype(np.int32)
    i, j, k, w = triples(length + 2)
    a, b, d = c[:, i], c[:, j], c[:, k]
    ids = np.where((a > 0) & (b > 0) & (d > 0), (a * CODES + b) * CODES + d, 0)
    order = np.argsort(ids, axis=1, kind="stable")
    s, v = np.take_along_axis(ids, order, 1), w[order]
    v = np.where(s > 0, v, 0)
    total = np.cumsum(v, axis=1)
    last = np.concatenate([s[:, 1:] != s[:, :-1], np.ones((len(s), 1), bool)], axis=1)
    # The sum of a run of equal ids is the running total at its end less that at the end of the run before.
    at_end = np.where(last, total, 0)
    before = np.maximum.accumulate(at_end, axis=1)
    before = np.concatenate([np.zeros((len(s), 1), before.dtype), before[:, :-1]], axis=1)
    run = np.where(last, total - before, 0)
    return ids, w, np.sqrt(np.square(run).sum(1))


def by_length(words: list[str], most: int = 2000) -> Iterator[tuple[np.ndarray, list[str], int]]:
    """Blocks of words of equal length: their places, the words, the length; shorter than 3 letters are left out."""
    groups: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        if 3 <= len(w) <= _LONGEST:
            groups.setdefault(len(w), []).append(at)
    for length, at in groups.items():
        step = max(1, most * 10 // max(10, length))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            yield np.array(part), [words[x] for x in part], length


def trim(token: str) -> str:
    return token.strip(" .,;:!?\"'()[]{}<>*#%&$|_-/\\")


def pieces(word: str) -> list[str]:
    """A word longer than the longest that is scored at once, as overlapping pieces."""
    return [word[a : a + _LONGEST] for a in range(0, max(1, len(word) - SPAN), _LONGEST - SPAN)]


def prepared(text: str | None) -> str:
    t = (text or "").lower()
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), t) if _SPACED.search(t) else t


def sentences(text: str | None) -> list[list[str]]:
    """Trimmed lower-case words by sentence: a token that ends in . ! or ? and a line feed end one. Short neighbours
    within a sentence follow as joined words."""
    out = []
    for line in prepared(text).split("\n"):
        now, short = [], ""
        for t in line.split():
            if w := trim(t):
                now.append(w)
                if len(w) <= SHORT:
                    if short:
                        now.append(short + w)
                    short = w
                else:
                    short = ""
            if now and t[-1] in ".!?":
                out.append(now)
                now, short = [], ""
        if now:
            out.append(now)
    return out


def distinct_words(text: str | None) -> set[str]:
    return {w for s in sentences(text) for w in s}


def _kernel(words: list[str], ids_of: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, kernel values with the landmarks) for blocks of words; words shorter than 3 letters are left out.

    ids_of: compact number of each subsequence; columns: numbers x landmarks, the row of number 0 empty.
    """
    for at, part, length in by_length(words):
        ids, w, norm = occurrences(part, length)
        numbers = ids_of[ids]
        out = np.zeros((len(part), columns.shape[1]), np.float32)
        for t in np.flatnonzero(numbers.any(axis=0)):
            out += w[t] * columns[numbers[:, t]]
        out /= np.maximum(norm, 1e-6)[:, None]
        yield at, np.minimum(out, 1) ** POWER


@dataclass
class Model:
    ids_of: np.ndarray  #: compact number of each three-letter subsequence of the landmarks, else 0
    columns: np.ndarray  #: numbers x landmarks: normalised weights
    alpha: np.ndarray  #: weight of each landmark
    bias: float
    curve: np.ndarray  #: of the highest scores of a text, the logarithm of its number of words, and 1

    def words(self, words: list[str]) -> np.ndarray:
        """Each word's score."""
        out = np.full(len(words), self.bias)
        for at, k in _kernel(words, self.ids_of, self.columns):
            out[at] += k @ self.alpha
        for at, word in enumerate(words):
            if len(word) > _LONGEST:
                out[at] = self.words(pieces(word)).max()
        return out

    def probability(self, raw: np.ndarray) -> np.ndarray:
        """Of texts given as rows of ``features``."""
        return 1 / (1 + np.exp(-np.clip(raw @ self.curve, -35, 35)))


def features(scores, bias: float) -> list[float]:
    """A text's highest scores of distinct words (never below the bias), the logarithm of the number of those that are not
    positive, and 1."""
    top = [max(x, bias) for x in nlargest(TOP, scores)]
    return [*top, *[bias] * (TOP - len(top)), np.log1p(sum(x <= 0 for x in scores)), 1.0]


def _landmark_rows(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Compact numbering of the landmarks' subsequences, and each landmark's normalised weights over it."""
    per: list[dict[int, float]] = [{} for _ in landmarks]
    for at, part, length in by_length(landmarks):
        ids, w, norm = occurrences(part, length)
        for r, x in enumerate(at):
            for u, v in zip(ids[r].tolist(), w.tolist(), strict=True):
                if u:
                    per[x][u] = per[x].get(u, 0.0) + v / max(float(norm[r]), 1e-6)
    every = sorted({u for p in per for u in p})
    ids_of = np.zeros(CODES**3, np.int64)
    ids_of[every] = np.arange(1, len(every) + 1)
    rows = np.zeros((len(landmarks), len(every) + 1), np.float32)
    for r, p in enumerate(per):
        for u, v in p.items():
            rows[r, ids_of[u]] = v
    return ids_of, rows


def _svm(parts: list[tuple[np.ndarray, np.ndarray, float, np.ndarray]], ridge: float, steps: int = 12, block: int = 8192) -> np.ndarray:
    """Weighted squared hinge loss by Newton steps over parts (matrix, its rows, their label, their weights).

    The last column of a matrix is the bias. Rows are taken in blocks, so memory beyond the matrices is bounded.
    """
    width = parts[0][0].shape[1]
    reg = ridge * sum(float(w.sum()) for *_, w in parts) * np.eye(width)
    reg[-1, -1] = 1e-9
    blocks = [(m, rows[k : k + block], y, w[k : k + block]) for m, rows, y, w in parts for k in range(0, len(rows), block)]
    active, v = [np.ones(len(rows), bool) for _, rows, _, _ in blocks], np.zeros(width)
    for _ in range(steps):
        left, right = reg.copy(), np.zeros(width)
        for (m, rows, y, w), on in zip(blocks, active, strict=True):
            x = m[rows[on]].astype(np.float64)
            xw = x * w[on, None]
            left += xw.T @ x
            right += y * xw.sum(0)
        v = np.linalg.solve(left, right)
        now = [y * (m[rows] @ v) < 1 for m, rows, y, _ in blocks]
        same = all((p == q).all() for p, q in zip(now, active, strict=True))
        active = now
        if same:
            break
    return v


def disguises(word: str, insert: str = "xzq") -> list[str]:
    """The word with a gap between all letters, with one or two inserted characters or one doubled letter at each inner place."""
    out = ["-".join(word)]
    for k in range(1, len(word)):
        a, b = insert[k % len(insert)], insert[(k + 1) % len(insert)]
        out += [f"{word[:k]}{c}{word[k:]}" for c in (a, word[k - 1], "*", a + b)]
        if k + 2 < len(word):
            out.append(f"{word[:k]}{a}{word[k:k + 2]}{b}{word[k + 2:]}")
    return out


def train(texts: list[tuple[str | None, int]], landmarks: int = LANDMARKS, clean_landmarks: int = CLEAN_LANDMARKS, ridge: float = RIDGE, rounds: int = 5, toxic_weight: float = TOXIC_WEIGHT) -> Model:
    """A model of (text, label) rows. What training held is given back to the system: the driver goes on for long."""
    try:
        return _trained(texts, landmarks, clean_landmarks, ridge, rounds, toxic_weight)
    finally:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def _trained(texts: list[tuple[str | None, int]], landmarks: int, clean_landmarks: int, ridge: float, rounds: int, toxic_weight: float) -> Model:
    flat = Model(np.zeros(CODES**3, np.int64), np.zeros((1, 1), np.float32), np.zeros(1), 0.0, np.array([*[0.0] * (TOP + 1), -35.0]))
    if len({y for _, y in texts}) < 2:
        return flat
    vocab: dict[str, int] = {}
    toxic_docs: list[np.ndarray] = []
    doc_words: list[np.ndarray] = []
    for text, y in texts:
        own = {vocab.setdefault(p, len(vocab)) for s in sentences(text) for w in s for p in pieces(w)}
        doc_words.append(np.fromiter(own, np.int64, len(own)))
        if y:
            toxic_docs.append(doc_words[-1])
    words, doc_y = list(vocab), np.array([y for _, y in texts])
    count = lambda docs: np.bincount(np.concatenate([*docs, np.zeros(0, np.int64)]), minlength=len(words)).astype(float)
    in_toxic, in_clean = count(toxic_docs), count([w for w, y in zip(doc_words, doc_y, strict=True) if not y])
    n_toxic, n_clean = len(toxic_docs), len(texts) - len(toxic_docs)
    p, q = in_toxic / n_toxic, in_clean / n_clean
    favour = (p - q) / np.sqrt(p * (1 - p) / n_toxic + q * (1 - q) / n_clean + 1 / (n_toxic * n_clean))
    long_enough = np.array([len(w) >= 3 for w in words], bool)
    by_favour = [int(w) for w in np.lexsort((np.arange(len(words)), -favour)) if long_enough[w] and favour[w] > FAVOUR][: 6 * landmarks]
    chosen: list[int] = []
    if by_favour:
        _, rows = _landmark_rows([words[w] for w in by_favour])
        like = rows @ rows.T
        taken: list[int] = []
        for c in range(len(by_favour)):
            if len(taken) < landmarks and (not taken or like[c, taken].max() < 0.92):
                taken.append(c)
        chosen = [by_favour[c] for c in taken]
    marks = set(chosen)
    common = (int(w) for w in np.lexsort((np.arange(len(words)), -in_clean)) if len(words[w]) >= 4 and in_clean[w] and w not in marks)
    chosen += islice(common, clean_landmarks)
    if not chosen:
        return flat
    ids_of, rows = _landmark_rows([words[w] for w in chosen])
    columns = np.ascontiguousarray(rows.T)
    val, vec = np.linalg.eigh((np.minimum(rows @ rows.T, 1) ** POWER).astype(np.float64))
    good = val > 1e-4 * val.max()
    white = (vec[:, good] / np.sqrt(val[good])) @ vec[:, good].T  # K(landmarks)^-1/2

    def mapped(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features, and the row of each word; the last row is that of all words that are near no landmark."""
        row, found, n = np.full(len(some), -1), [], 0
        for at, k in _kernel(some, ids_of, columns):
            near = k.max(axis=1) > FAR
            row[at[near]] = n + np.arange(near.sum())
            n += int(near.sum())
            found.append(k[near] @ white.astype(np.float32))
        x = np.zeros((n + 1, len(chosen) + 1), np.float32)
        if n:
            x[:-1, :-1] = np.concatenate(found)
        x[:, -1] = 1
        row[row < 0] = n
        return x, row

    x, row = mapped(words)
    own = lambda per_word: np.bincount(row, per_word, len(x))
    row_toxic, row_clean, toxic_rows = own(in_toxic), own(in_clean), [row[w] for w in toxic_docs]
    toxic, v = row_toxic.copy(), np.zeros(x.shape[1])
    for _ in range(rounds):
        # A word of a toxic text is toxic if it scores so or is that text's highest; its other words are clean.
        clean = row_clean + (row_toxic - toxic)
        weight = clean.sum() / toxic.sum() if not v.any() else toxic_weight
        on, off = np.flatnonzero(toxic > 0), np.flatnonzero(clean > 0)
        v = _svm([(x, on, 1.0, toxic[on] * weight), (x, off, -1.0, clean[off])], ridge)
        score = x @ v
        new = np.where(score > 0, row_toxic, 0.0)
        for w in toxic_rows:
            if len(w) and score[w].max() <= 0:
                new[w[score[w].argmax()]] += 1
        if (new == toxic).all():
            break
        toxic = new
    # Once more with disguised forms of the words found toxic: characters inserted or doubled, gaps between all letters.
    now = x @ v
    hard = [w for w in sorted(marks) if now[row[w]] > 0 and in_toxic[w] and len(words[w]) >= 4]
    forms, heavy = [], []
    for w in hard:
        made = disguises(words[w])
        forms += made
        heavy += [in_toxic[w] * DISGUISED / len(made)] * len(made)
    if forms:
        more, at = mapped(forms)
        clean = row_clean + np.maximum(row_toxic - toxic, 0)
        on, off = np.flatnonzero(toxic > 0), np.flatnonzero(clean > 0)
        v = _svm([(x, on, 1.0, toxic[on] * toxic_weight), (x, off, -1.0, clean[off]), (more, at, 1.0, np.array(heavy))], ridge)
    score = (x @ v)[row]
    raw = np.array([features(score[w].tolist(), v[-1]) for w in doc_words])
    return Model(ids_of, columns, white @ v[:-1], float(v[-1]), _curve(raw, doc_y))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve none of whose weights of word scores is negative: those that would be are left out, worst first."""
    used = np.arange(x.shape[1])
    while True:
        b = _logistic(x[:, used], y)
        scores = np.flatnonzero(used < TOP)
        if not len(scores) or b[scores].min() >= 0:
            break
        used = np.delete(used, scores[b[scores].argmin()])
    out = np.zeros(x.shape[1])
    out[used] = b
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve with Platt's targets and a little ridge; the two labels weigh alike."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.where(y == 1, 0.5 / pos, 0.5 / neg) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (t - p)) - ridge * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        b = b + step
        if np.abs(step).max() < 1e-7:
            break
    return b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> list[tuple[str | None, int]]:
    """At most ``per_class`` texts of each label, the first by a hash of doc_id among rows that are not held out.

    A text that does not fit in what is left of its label's characters is passed over. Each label has half of ``max_chars``
    and what the other label leaves of its half.
    """
    known = labels.where(~held_out(F.col("doc_id"))).where("doc_id IS NOT NULL").select("doc_id", "toxic", F.xxhash64("doc_id").alias("_hash"))
    first = [known.where(F.col("toxic") == y).orderBy("_hash", "doc_id").limit(per_class) for y in (0, 1)]
    wanted = first[0].unionByName(first[1]).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic", "_hash")
    rows = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    rows = sorted(rows.toLocalIterator(), key=lambda r: (r["_hash"], str(r["doc_id"]), r["text"] or ""))
    chars = {y: sum(len(r["text"] or "") for r in rows if r["toxic"] == y) for y in (0, 1)}
    left = {y: max(max_chars // 2, max_chars - chars[1 - y]) for y in (0, 1)}
    out = []
    for r in rows:
        n = len(r["text"] or "")
        if n <= left[r["toxic"]]:
            left[r["toxic"]] -= n
            out.append(r)
    return [(r["text"], int(r["toxic"])) for r in sorted(out, key=lambda r: (str(r["doc_id"]), r["text"] or ""))]


#: The caches of this worker by model: token -> its score.
_CACHES: dict[str, dict[str, float]] = {}


def score_texts(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns (doc_id) with score and predicted for each row; these replace kept columns of their names."""
    keep = [c for c in keep or ["doc_id"] if c not in ("score", "predicted")]
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if key not in _CACHES:
            _CACHES.clear()
            _CACHES[key] = {}
        cache = _CACHES[key]
        for b in batches:
            raw = np.empty((b.num_rows, len(m.curve)))
            texts = b.column(len(keep))
            for a in range(0, b.num_rows, 256):
                tokens = [distinct_words(t) for t in texts.slice(a, 256).to_pylist()]
                new = list(set().union(*tokens).difference(cache))
                if new:
                    if len(cache) + len(new) > CACHE:
                        cache.clear()
                        new = list(set().union(*tokens))
                    cache.update(zip(new, m.words(new).tolist(), strict=True))
                for r, ts in enumerate(tokens, a):
                    raw[r] = features(list(map(cache.__getitem__, ts)), m.bias)
            p = m.probability(raw)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(keep))), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*(F.col(f"`{c}`") for c in [*keep, text_col])).mapInArrow(tidy(run), schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_sample(docs, table(spark, sf_dir, "labels")))
    return score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
