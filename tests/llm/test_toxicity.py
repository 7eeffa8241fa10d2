"""The kernel against its definition, learning on made texts, and edge cases."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from loomtext.llm import toxicity as T

SF = "/root/testdata/sf0.001"
SYLLABLES = ["the", "on", "ti", "er", "wh", "an", "re", "sh", "or", "ed", "en", "ly"]


def made(seed, n=300, insults=("idiot", "moron", "worthless", "stupid", "trash")):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        out.append((" ".join(w).capitalize() + ".", int(i % 3 == 0)))
    return out


def plain_kernel(a, b):
    def phi(w):
        w = f"\x01{w}\x02"
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < T.SPAN and all(c in "\x01\x02" or c.isalpha() for c in (w[i], w[j], w[k])):
                u = w[i] + w[j] + w[k]
                out[u] = out.get(u, 0) + T.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_is_as_defined():
    words, marks = ["idiot", "i-d-i-o-t", "idxiot", "banana", "loweiä", "thonre"], ["idiot", "anaban", "loweischaft"]
    ids, rows = T._landmark_rows(marks)
    got = np.zeros((len(words), len(marks)))
    for at, k in T._kernel(words, ids, np.ascontiguousarray(rows.T)):
        got[at] = k
    assert np.allclose(got, [[plain_kernel(w, m) ** T.POWER for m in marks] for w in words], atol=1e-4)


def test_word_scores():
    model = T.train(made(1))
    words = ["idiot", "theon", "worthless", "x", "", "a" * 200]
    assert np.isfinite(model.words(words)).all() and model.words(["x", ""]).tolist() == [model.bias] * 2
    assert model.words(["idiot"])[0] > model.words(["theon"])[0]
    assert T.features([1.0, 3.0, -2.0, -3.0], -1.0) == [3.0, 1.0, -1.0, np.log1p(2), 1.0]


def test_learns_insults_and_disguises(spark):
    model = T.train(made(2, 600))
    test = made(3, 300)
    rows = [(i, t) for i, (t, _) in enumerate(test)]
    rows += [(1000 + i, f"On the {w} re an.") for i, w in enumerate(["idiot", "i-d-i-o-t", "i d i o t", "idiiot", "IDIOT!!", "sttupid", "wor-thless"])]
    out = {r.doc_id: r for r in T.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    right = sum(out[i].predicted == y for i, (_, y) in enumerate(test))
    assert right >= 0.98 * len(test)
    assert [out[1000 + i].predicted for i in range(7)] == [1] * 7
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())


def plain_score(model, text):
    words = sorted(T.distinct_words(text))
    return float(model.probability(np.array([T.features([float(model.words([w])[0]) for w in words], model.bias)]))[0])


def test_short_neighbours_are_one_word_too():
    assert T.sentences("Sc um. id, iot\nabc defg") == [["sc", "um", "scum"], ["id", "iot", "idiot"], ["abc", "defg"]]


def test_scores_do_not_fall_as_insults_are_added():
    model = T.train(made(5, 600))
    base = made(6, 30)
    for text, _ in base:
        scores = [plain_score(model, text)]
        for w in ("idiot", "moron", "trash", "stupid"):
            text = f"{text} {w}."
            scores.append(plain_score(model, text))
        assert all(b >= a - 1e-12 for a, b in zip(scores, scores[1:], strict=False)) and scores[-1] >= 0.5
    assert (model.curve[: T.TOP] >= 0).all()


def test_two_inserted_characters_and_inner_blanks_are_seen():
    """Two inserted characters lift a word above all clean ones; a blank inside a short insult changes nothing."""
    model = T.train(made(7, 600))
    clean = model.words([a + b + c for a in SYLLABLES for b in ["", *SYLLABLES] for c in ["", "the", "an"]]).max()
    for w in ("idxziot", "idxioqt", "mozxron", "stxxupid", "woxrthqless"):
        assert model.words([w])[0] > clean and plain_score(model, f"On the {w} re an.") > plain_score(model, "On the there re an."), w
    for w in ("tr ash", "id iot"):
        assert plain_score(model, f"On the {w} re an.") >= 0.5, w


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_scores_equal_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = T.train(T.training_sample(docs, labels))
    got = {r.doc_id: r for r in T.op1_toxicity(spark, SF).collect()}
    for r in docs.collect():
        want = plain_score(model, r.text)
        assert abs(got[r.doc_id].score - want) < 1e-4 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_edge_cases(spark):
    model = T.train(made(4))
    rows = [(1, None, 9), (2, "", 9), (3, " \n ", 9), (4, "?!", 9), (5, "the " * 200_000 + "idiot", 9), (6, "a" * 100_000, 9), (7, "idiot", 9), (7, "idiot", 9), (None, "ok", None)]
    out = T.score_texts(spark.createDataFrame(rows, "doc_id long, text string, extra int"), model, keep=["doc_id", "extra"]).collect()
    assert len(out) == len(rows) and len({r.score for r in out[:3]}) == 1
    by = {r.doc_id: r for r in out}
    assert by[1].predicted == 0 and by[5].predicted == 1 and by[7].predicted == 1
    assert T.score_texts(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []
    for texts in ([], [("a", 1)], [("a", 0), ("b", 0)], [("", 1), (None, 0)]):
        assert 0 <= T.train(texts).probability(np.array([T.features([0.0], 0.0)]))[0] <= 1


def test_training_sample_is_bounded_and_leaves_out_the_fold(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(210).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic", "0 AS quality").union(spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int"))
    out = T.training_sample(docs, labels, per_class=30)
    from zlib import crc32

    ids = [int(t.split()[1]) for t, _ in out]
    assert len(out) <= 60 and all(crc32(str(i).encode()) % 5 for i in ids) and all(y == i % 2 for i, (_, y) in zip(ids, out, strict=True))
    assert out == T.training_sample(docs.repartition(5), labels.repartition(3), per_class=30)
    assert T.training_sample(docs, labels, max_chars=40) == out[:4] or len(T.training_sample(docs, labels, max_chars=40)) <= 6


def test_training_sample_passes_over_texts_that_do_not_fit(spark):
    docs = spark.createDataFrame([(i, ("x" * 500 if i < 20 else "y" * 10) + str(i)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(100)], "doc_id long, toxic int")
    whole = T.training_sample(docs, labels)
    out = T.training_sample(docs, labels, max_chars=2400)
    assert set(out) <= set(whole) and sum(len(t) for t, _ in out) <= 2400
    for y in (0, 1):
        assert sum(len(t) for t, x in out if x == y) <= 1200
        assert any(t.startswith("y") for t, x in out if x == y)
    short = {(t, y) for t, y in whole if t.startswith("y")}
    assert {y for _, y in T.training_sample(docs, labels, max_chars=400)} == {0, 1}
    assert short and sum(len(t) for t, _ in T.training_sample(docs, labels, max_chars=400)) > 380
