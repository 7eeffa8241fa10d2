"""The registered queries on the smallest tables, and the pipeline against its operators' decisions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_each_operator_has_one_query():
    names = sorted(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        seen[name] = (before.count(), docs.count())
        if name != "mixing":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing"]
    assert seen["line_dedup"][0] == seen["line_dedup"][1] and seen["ngram_jaccard_join"][1] < seen["ngram_jaccard_join"][0]
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_jaccard_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (2, text + " x"), (2, text + " x"), (9, "other words here"), (None, text), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.jaccard(spark, docs, SF).collect()
    assert sorted((r.doc_id or -1) for r in out) == [-1, 2, 5, 9]


def test_jaccard_stage_decides_by_row(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "wv")
    rows = [(1, text), (4, text + " x"), (4, "a clean text of its own"), (6, other), (6, other), (6, other + " x"), (6, "something else"), (7, ""), (7, None), (7, None)]
    out = corpus_pipeline.jaccard(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    got = sorted((r.doc_id, r.text or "") for r in out if r.text not in (other, other + " x"))
    assert got == [(1, text), (4, "a clean text of its own"), (6, "something else"), (7, ""), (7, "")]
    assert [r.doc_id for r in out if r.text in (other, other + " x")] == [6]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_line_stage_cuts_short_pages_and_keeps_mirrors(spark):
    rows = [(i, f"Own {i}.\nA line that stands on very many of the sites", f"s{i}") for i in range(9)]
    rows += [(20 + i, "The first line of a mirrored text\n  and its second line", f"s{i}") for i in range(9)]
    rows += [(40, "the first line of a mirrored TEXT\nand its second line  ", "s1"), (41, "\nThe first line of a mirrored text", "s2"), (42, None, "s1")]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    assert {r.doc_id: r.text for r in out} == {d: f"Own {d}." if d < 9 else t for d, t, _ in rows}


CLASHING = ["score", "predicted", "n_words", "contaminated", "hit_spans", "size", "target", "copies", "source_size", "n_lines", "n_removed", "n_bytes", "kept", "id", "_id", "_t", "pos", "site", "text_hash", "gid", "n", "kind", "a", "b", "component_id", "host", "spans", "t", "row", "cut", "lines", "body", "slot", "of", "whole", "last_slot", "taken", "class", "__cut", "__xt", "__lines", "__w", "__t", "__id", "__copy", "__slot", "__s", "__size", "__target", "__whole", "__last"]


def test_stages_take_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *(F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES:
        plain, out = stage(spark, docs, SF), stage(spark, wide, SF)
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in plain.select("doc_id").collect())
        replaced = {"size", "source_size", "target", "copy"} if name == "mixing" else set()
        assert set(wide.columns) | replaced == set(out.columns) and len(out.columns) == len(set(out.columns))
        assert out.where(" OR ".join(f"`{c}` <> concat('{c} of ', doc_id)" for c in CLASHING if c not in replaced)).isEmpty()


def test_operators_take_clashing_columns(spark):
    from loomtext.llm import decontam, jaccard, linededup, media, mixing, suffixdedup, toxicity, urlfilter, warc
    from tests.llm.test_toxicity import made

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    wide = docs.select("*", *(F.lit("x").alias(c) for c in CLASHING))
    model = toxicity.train(made(1))
    assert toxicity.score_texts(wide, model, keep=["doc_id", *CLASHING]).where("score > 1").isEmpty()
    assert decontam.decontaminate(wide, spark.read.parquet(f"{SF}/benchmark.parquet"), keep=["doc_id", *CLASHING]).where("n_words < 0").isEmpty()
    assert suffixdedup.remove_repeats(wide, keep=["doc_id", *CLASHING]).where("n_removed > n_bytes").isEmpty()
    lines, mixed = linededup.remove_boilerplate(wide, spare_copies=True), mixing.mix(wide)
    assert lines.where("n_removed > n_lines").isEmpty() and mixed.where("taken <> size * copies OR target < 0").isEmpty()
    for out, made in ((lines, {"n_lines", "n_removed"}), (mixed, {"size", "source_size", "target", "copies", "taken"})):
        assert set(out.columns) == set(wide.columns) | made and out.count() == 40
        assert out.where(" OR ".join(f"`{c}` <> 'x' OR `{c}` IS NULL" for c in CLASHING if c not in made)).isEmpty()
    assert jaccard.near_duplicates(wide, k=3).count() == media.store_text_audio(wide).count() == 40
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20).select("*", *(F.lit("x").alias(c) for c in [*CLASHING, "rule", "verdict", "path", "key"]))
    assert urlfilter.match(pages, urlfilter.rule_table(spark)).where("verdict NOT IN ('allow', 'block')").isEmpty()
    headers, payloads = warc.write_archive(pages)
    assert warc.restore(headers, payloads).count() == 20


def plain_pipeline(docs, items, model):
    """The five stages over lists, each by the brute-force version of its operator: {(doc_id, copy): text}."""
    import hashlib
    import re

    from loomtext.llm import toxicity
    from tests.llm.test_record_operators import plain_water
    from tests.llm.test_text_operators import brute_components, brute_hits, brute_lines

    def toxic(text):
        words = toxicity.distinct_words(text)
        return model.probability(np.array([toxicity.features(model.words(sorted(words)).tolist(), model.bias)]))[0] >= 0.5

    rows = [(d, t, s) for d, t, s in docs if not toxic(t)]
    source = {d: s for d, _, s in rows}
    component, texts = brute_components(rows, 5, 80, 100), {}
    for d, t, _ in rows:
        texts.setdefault(component[d][1], set()).add(t)
    classes = {t: ("class", component[d][1]) for d, t, _ in rows if t is not None and len(texts[component[d][1]]) > 1}
    cut = brute_lines(rows, 4, 4, classes=classes)
    assert sum(n for *_, n in cut) > 20
    rows = [(d, t, source[d]) for d, t, *_ in cut]
    component = brute_components(rows, 5, 80, 100)
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    rows = [r for r in rows if not brute_hits(r[1], items, 10)[4]]
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    slot = {d: int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:3], 16) for d in size}
    total = {}
    for d, _, s in rows:
        total[s] = total.get(s, 0) + size[d]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total))}
    target = plain_water({s: n for s, n in total.items() if n}, {s: weight[s] for s in total if total[s]}, 1.5, 2.0)
    out = {}
    for s, n in total.items():
        whole = int(target.get(s, 0) / n + 1e-9) if n else 0
        rest, upto, last = max(0.0, target.get(s, 0) - whole * n), 0, -1
        words = {}
        for d, _, x in rows:
            if x == s:
                words[slot[d]] = words.get(slot[d], 0) + size[d]
        for k in sorted(words):
            upto += words[k]
            last = k if upto - words[k] / 2 <= rest - 1e-6 else last
        out |= {(d, c): t for d, t, x in rows if x == s for c in range(1, whole + (slot[d] <= last) + 1)}
    return out


def test_pipeline_equals_its_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = corpus_pipeline.train(corpus_pipeline.training_sample(docs, labels))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain_pipeline([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], items, model)
    assert {(r.doc_id, r.copy): r.text for r in corpus_pipeline.run(spark, SF).collect()} == want
