"""Token shards against plain tokenizing, exact round trips and edge cases."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomtext.llm import tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def plain(texts, path=PATH):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def described(rows, path=PATH):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text) in the order given."""
    out, start = [], 0
    for (i, _), ids in zip(rows, plain([t for _, t in rows], path), strict=True):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6).filter(lambda x: x != 1), max_size=120), min_size=1, max_size=12), st.integers(1, 4), st.data())
def test_shards_give_their_ids_back(docs, times, data):
    docs = [np.array(d * times + [1], np.uint32) for d in docs]
    ids, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    shard = tokenfiles.Shard(tokenfiles.write_shard(ids, sizes, 7))
    assert shard.ids().tolist() == ids.tolist() and shard.sizes.tolist() == sizes.tolist()
    k = data.draw(st.integers(0, len(docs) - 1))
    assert shard.document(k).tolist() == docs[k].tolist()
    a, z = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
    assert shard.ids_between(a, z).tolist() == ids[a:z].tolist()
    ends = np.cumsum(shard.doc_symbols)
    assert ends[-1] == len(shard.symbols) and all(shard.symbols[e - 1] == 1 for e in ends)


def test_frequent_pairs_become_rules_and_runs_too():
    ids = np.array(([5, 6, 7, 8] * 200 + [1]) * 3 + [9] * 999 + [1], np.uint32)
    symbols, rules = tokenfiles.compress(ids, 20)
    assert len(symbols) < len(ids) / 10 and len(rules) >= 4
    assert all(r >> 32 < 20 + k and r & 0xFFFFFFFF < 20 + k for k, r in enumerate(rules.tolist()))
    none, without = tokenfiles.compress(np.arange(2, 500, dtype=np.uint32), 500)
    assert len(without) == 0 and len(none) == 498


def test_many_rules_need_wide_symbols():
    ids = np.concatenate([np.tile(np.array([2, 3, 4]), 40), [1]]).astype(np.uint32)
    data = tokenfiles.write_shard(ids, np.array([len(ids)]), 1 << 16)
    assert tokenfiles.Shard(data).ids().tolist() == ids.tolist()
    with pytest.raises(ValueError, match="sound"):
        tokenfiles.Shard(data[:60] + bytes([data[60] ^ 1]) + data[61:])


def test_words_and_whole_texts_have_the_same_ids():
    texts = ["", " \n\t", " lead", "trail \n", "a\x0bb\x0cc\rd", "It's  ΑΣ ΌΔΟΣ. o'ne don't", "é a b c d", "x\x1cy \x85 z", "<|endoftext|> a<|startoftext|>b", "!!! 1234 ünïcode 日本語 🙂🙂", "a" * 3000, "İstanbul ﬁn ǅ"]
    a, n = tokenfiles.Encoder(PATH, True)(pa.array(texts * 2))
    b, m = tokenfiles.Encoder(PATH, False)(pa.array(texts * 2))
    assert a.tolist() == b.tolist() == [i for x in plain(texts * 2) for i in x] and n.tolist() == m.tolist()


def test_an_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokenfiles, "MOST_WORDS", 3)
    e = tokenfiles.Encoder(PATH, True)
    for text in ("one two three four", "two five", "one"):
        assert e(pa.array([None, text]))[0][1:].tolist() == plain([text])[0]


def test_documents_match_plain_tokenizing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shards = tokenfiles.write_ids(docs.repartition(7), PATH, by_word=True, shard=5000)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = tokenfiles.read_ids(shards)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.drop("ids").collect()) == described(rows)
    assert shards.count() > 4 and shards.where("size(doc_ids) = 0").isEmpty()
    whole = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert [whole[i] for i, _ in rows] == plain([t for _, t in rows])
    wanted = spark.createDataFrame([(rows[3][0],), (rows[-1][0],), (-5,), (rows[3][0],)], "doc_id long")
    assert sorted((r["doc_id"], r["ids"]) for r in tokenfiles.fetch(shards, wanted).collect()) == [(i, whole[i]) for i in (rows[3][0], rows[-1][0])]


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    long = "alpha beta, gamma! " * 40_000
    rows = [(None, "first"), (1, None), (2, ""), (3, long), (4, "same"), (4, "same"), (4, "same"), (9, "x")]
    d = spark.createDataFrame([(i, t, "p", 1, 1, None) for i, t in rows], "doc_id long, text string, part string, _id int, _row int, data binary")
    got = tokenfiles.read_ids(tokenfiles.write_ids(d.repartition(3), PATH), with_ids=False)
    found = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.orderBy("start").collect()]
    assert found == described(rows)


def test_a_hot_document_id_is_split_and_reruns_agree(spark):
    d = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "concat('text ', id % 50) AS text")
    a, b = (tokenfiles.read_ids(tokenfiles.write_ids(d.repartition(n), PATH, by_word=True)) for n in (4, 6))
    rows = [sorted(tuple(r[c] for c in ("start", "doc_id", "n_tokens", "ids_crc32")) for r in x.collect()) for x in (a, b)]
    assert rows[0] == rows[1] and [r[1] for r in rows[0]] == sorted(r[1] for r in rows[0])
    assert rows[0][-1][0] + rows[0][-1][2] == sum(r[2] for r in rows[0])


def test_an_empty_table_has_no_shard(spark):
    shards = tokenfiles.write_ids(spark.createDataFrame([], "doc_id string, text string"), PATH)
    assert shards.count() == 0 and tokenfiles.read_ids(shards).count() == 0
