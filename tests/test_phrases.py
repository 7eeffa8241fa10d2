"""Phrases by an index of first words against the patterns they come from."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomtext.operators import lexicon as L
from loomtext.operators import phrases as H


def test_patterns_expand_in_the_order_they_are_tried():
    assert H.expand("kill(?:s|ed|ing)?") == ["kills", "killed", "killing", "kill"]
    assert H.expand("well[- ]being") == ["well-being", "well being"]
    assert H.expand("depriv(?:e|es) (?:of )?(?:a|b)") == ["deprive of a", "deprive of b", "deprive a", "deprive b", "deprives of a", "deprives of b", "deprives a", "deprives b"]
    assert H.expand("dishonest(?:y)?") == ["dishonesty", "dishonest"] and H.expand("laws?") == ["laws", "law"]
    for bad in (r"\d", "a*", "a+", "(a)", "^a"):
        with pytest.raises(ValueError, match="finite"):
            H.expand(bad)
    for terms in L.TERMS.values():
        for t in terms:
            assert all(re.fullmatch(t, p) for p in H.expand(t))


def made_texts(n):
    rng = random.Random(5)
    phrases = [p for ts in L.TERMS.values() for t in ts for p in H.expand(t)]
    parts = [*phrases, *(p.upper() for p in phrases[::7]), *(p.split()[0] for p in phrases if " " in p), "the", "émigré", "un", "lawé", "x_law", "ſoldier", "Kill", "LİE", "ıt"]
    joins = [" ", "  ", "-", ", ", "\n", "", ".", "'"]
    return ["".join(rng.choice(parts) + rng.choice(joins) for _ in range(rng.choice([1, 4, 30]))) for _ in range(n)] + ["", None, "end his life-long dead", "police officer on duty"]


def test_matches_equal_those_of_the_patterns(spark):
    d = spark.createDataFrame(list(enumerate(made_texts(400))), "k int, t string").repartition(4)
    lexicon = H.table_of(spark, L.TERMS)
    old = {r.k: r.m for r in d.select("k", L.keyword_matches(F.col("t")).alias("m")).collect()}
    new = {r.k: r.m for r in H.words_by_category(H.matched(d, F.col("t"), lexicon), "m").select("k", "m").collect()}
    assert new == old and sum(map(len, old.values())) > 500


def test_a_lexicon_beyond_the_bounds_is_joined_with_the_same_result(spark, monkeypatch):
    d = spark.createDataFrame(list(enumerate(made_texts(150))), "k int, t string").repartition(4)
    lexicon = H.table_of(spark, L.TERMS)
    small = {r.k: (r.category, r.m) for r in H.words_by_category(H.matched(d.withColumn("category", F.lit("own")), F.col("t"), lexicon), "m").collect()}
    monkeypatch.setattr(H, "MOST_PHRASES", 3)
    with pytest.raises(ValueError, match="key"):
        H.matched(d, F.col("t"), lexicon)
    large = {r.k: (r.category, r.m) for r in H.words_by_category(H.matched(d.withColumn("category", F.lit("own")), F.col("t"), lexicon, key="k"), "m").collect()}
    assert large == small


def test_an_empty_lexicon_and_odd_phrases(spark):
    d = spark.createDataFrame([("a b",), (None,)], "t string")
    empty = H.table_of(spark, {})
    assert [r.m for r in H.words_by_category(H.matched(d, F.col("t"), empty), "m").collect()] == [{}, {}]
    odd = H.table_of(spark, {"c": ["", " ", "it's", "o'b\\\\c"[:3], "-a", "b"]})
    assert [r.m for r in H.words_by_category(H.matched(d, F.col("t"), odd), "m").collect()] == [{"c": ["b"]}, {}]


def test_a_lexicon_can_be_a_table_of_the_caller(spark):
    rows = spark.createDataFrame([("s", "Blue sky, bluebird", "x", "y")], "scenario_id string, context string, action1 string, action2 string")
    own = spark.createDataFrame([("colour", "blue", 0), ("thing", "blue sky", 0), ("thing", "sky", 1)], "category string, phrase string, rank int")
    got = L.categorized(rows, lexicon=own).first()
    assert got.matched_keywords == {"colour": ["blue"], "thing": ["blue sky"]} and got.moral_categories == ["colour", "thing"]


def test_words_of_texts_are_not_exchanged_for_a_lexicon_that_can_be_sent(spark, monkeypatch):
    monkeypatch.setattr(H, "MOST_PHRASES", 1)
    texts = spark.createDataFrame([(1, "the cat and the dog"), (2, None), (3, "a dog's life, and the end")], "k int, text string")
    lexicon = H.table_of(spark, {"x": ["the", "dog"], "y": ["and the"]})
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    got = []
    try:
        for most in (H.MOST_SENT, 0):
            monkeypatch.setattr(H, "MOST_SENT", most)
            d = H.counts_by_category(H.matched(texts, F.col("text"), lexicon, key="k"))
            sent = "BroadcastHashJoin [first" in d._jdf.queryExecution().executedPlan().toString()
            got.append((sent, sorted(map(tuple, d.collect()))))
    finally:
        spark.conf.set(key, before)
    assert got == [(True, [("x", 2, 5), ("y", 2, 2)]), (False, [("x", 2, 5), ("y", 2, 2)])]
