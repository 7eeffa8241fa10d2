"""Decontamination, Jaccard join, suffix dedup and line dedup against brute force, and their edge cases."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomtext.llm import common, decontam, jaccard, linededup, mixing, suffixdedup, textvec

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string"
WORDS = ["ab", "Cd", "ef", "gh", "ij", "kl", "mn", "ôp", "qr", "st"]


def made(seed, n=60, words=40):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(6)) for _ in range(rng.randrange(1, words))) for _ in range(n // 2)]
    for _ in range(n // 4):  # near copies
        w = rng.choice(texts).split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [rng.choice(texts) for _ in range(n // 8)] + [None, "", " \n\t ", "one", "one", "zwei wörter", "X" * 700, "ab " * 400, "Ü" * 5000]
    return [(i, t, f"s{i % 5}" if i % 7 else None, "en") for i, t in enumerate(texts)]


# ---- decontamination


def words_of(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_hits(text, items, size):
    w = words_of(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words_of(t)
        for i in range(max(1, len(iw) - size + 1) if iw else 0):
            win = iw[i : i + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item))
    ids = sorted(found)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("size", [3, 10])
def test_decontamination_matches_brute_force(spark, size):
    rows = made(1)
    rng = random.Random(2)
    items = [(k, " ".join((rows[k][1] or "x").split()[: rng.randrange(1, 14)])) for k in range(0, 30, 3)] + [(100, None), (101, ""), (102, "?!"), (11, "one"), (2, "ONE.")]
    docs = spark.createDataFrame(rows, DOCS)
    out = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), size=size).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out}
    assert got == {d: brute_hits(t, items, size) for d, t, *_ in rows}


def test_decontamination_spans_map_to_the_original(spark):
    text = "Äh, Foo--BAR  (baz) end. foo bar baz"
    out = decontam.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, "foo bar baz")], "item_id long, text string"), size=3).first()
    assert [text[s.start : s.stop] for s in out.hit_spans] == ["Foo--BAR  (baz", "foo bar baz"]


def test_items_beyond_the_bound_are_held_in_groups_with_the_same_result(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(9)] + ["É", "a"]
    rows = [(i % 50, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), f"k{i}") for i in range(120)] + [(None, None, "n"), (7, "", "e"), (8, "w1 " * 5000, "long")]
    items = [(i % 30, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))) for i in range(40)] + [(99, None), (None, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    read = lambda: sorted(map(str, decontam.decontaminate(docs, bench, size=3, keep=["doc_id", "row"]).collect()))
    whole = read()
    monkeypatch.setattr(decontam, "MOST_BYTES", 200)
    assert read() == whole and sum("contaminated=True" in r for r in whole) > 20
    assert decontam.decontaminate(docs.limit(0), bench).collect() == []


def test_decontamination_splits_large_automata():
    w = decontam.item_windows([(1, "a b c d e")], 2)
    machines = decontam.automata(w, most=1)
    assert len(machines) == 4 and decontam.scan(b"x A,b c", machines)[:3][0] == 4
    assert decontam.scan(b"x A,b c", machines)[1].tolist() == [False, True, True, True]


# ---- Jaccard


def brute_components(rows, k, num, den):
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("k,num,share", [(3, 90, None), (5, 80, None), (2, 50, 0.05), (1, 60, 1.0)])
def test_jaccard_matches_brute_force(spark, k, num, share):
    rows = made(3, n=160, words=60) if k > 1 else made(4, n=80, words=8)
    out = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS), k=k, num=num, den=100, share=share).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, k, num, 100)


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard_links_short_texts_with_words_appended_or_cut(spark, k, num):
    rng = random.Random(21)
    rows = []
    for g in range(400):
        w = [f"g{g}w{rng.randrange(1000)}" for _ in range(rng.randrange(8, 24))]
        rows += [(3 * g, " ".join(w)), (3 * g + 1, " ".join([*w, f"more{g}"])), (3 * g + 2, " ".join(w[1:]))]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, num=num, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, k, num, 100)


def test_jaccard_chains_and_borderline_pairs(spark):
    # A chain in which only neighbours are similar, and pairs just at and just under the threshold.
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(30)]
    rows += [(100, " ".join(f"v{j}" for j in range(20))), (101, " ".join(f"v{j}" for j in range(18))), (102, " ".join(f"v{j}" for j in range(17)))]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1, num=90, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 1, 90, 100)


def test_jaccard_repeated_rows_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (3, text + " x"), (None, text), (7, None), (8, "")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.component_id or -1) for r in jaccard.near_duplicates(docs, k=3, num=80, den=100).collect()))
    assert got == [(-1, 3), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8)]
    assert jaccard.near_duplicates(docs.limit(0), k=3).collect() == []


def _components(edges):
    least = {}
    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        least[y] = x
    return {x: root(x) for x in list(least) if root(x) != x}


@pytest.mark.parametrize("most", [8, 1 << 20])
def test_components_of_chains_hubs_and_loops(spark, most):
    rng = random.Random(9)
    chain = list(range(1000, 1400))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *((7, x) for x in range(5000, 5300)), *((x, 5299) for x in range(6000, 6050)), (3, 3), (9, 8), (8, 9), (9, 8), (-4, 2**62)]
    edges += [(rng.randrange(10_000, 10_400), rng.randrange(10_000, 10_400)) for _ in range(220)]
    rng.shuffle(edges)
    found = common.connected(spark.createDataFrame(edges, "a long, b long").repartition(5), most=most).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == _components(edges)
    assert common.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_forest_spans_the_passing_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    e = np.zeros(12, jaccard.ENTRY)
    for i in range(12):
        s = np.unique(np.concatenate([base, rng.integers(0, 1 << 63, i % 3, dtype=np.uint64)])) if i < 9 else np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        e[i]["gid"], e[i]["group"], e[i]["n"], e[i]["rest"], e[i]["rank"] = i + 1, i + 1, len(s), len(s), 3
        e[i]["bits"] = np.frombuffer(jaccard.parity(s), "<u8")
    edges = jaccard.forest(e, 90, 100)
    assert len(edges) == 8 and {x for p in edges for x in p} == set(range(1, 10))


# ---- suffix dedup


def brute_repeats(rows, window=200):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(x[i : i + window] for _, x in texts for i in range(len(x) - window + 1))
    out = []
    for d, x in texts:
        cover = np.zeros(len(x) + 1, int)
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                cover[i] += 1
                cover[i + window] -= 1
        hit = np.cumsum(cover)[: len(x)] > 0
        runs = int(np.count_nonzero(np.diff(np.concatenate([[False], hit]).astype(int)) == 1))
        out.append((d, len(x), int(hit.sum()), runs, hashlib.sha256(bytes(b for b, h in zip(x, hit, strict=True) if not h)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    body = lambda n: "".join(rng.choice("abcdefgh éü") for _ in range(n))
    shared, hot = body(900), body(230)
    rows = [(i, body(rng.randrange(0, 500))) for i in range(20)]
    for i in range(20, 60):
        a = rng.randrange(0, 700)
        rows.append((i, body(rng.randrange(0, 60)) + shared[a : a + rng.randrange(100, 400)] + body(rng.randrange(0, 60)) + (hot if i % 2 else "")))
    rows += [(60, "a" * 450), (61, "xy" * 300), (62, "a" * 199), (63, "a" * 200), (64, None), (65, ""), (66, rows[30][1]), (66, rows[30][1]), (67, shared[:199]), (68, "rested " * 90 + "the " * 120)]
    for hot in (suffixdedup.HOT, 4):  # with 4, contexts of most repeated anchors are cut into ranges of offsets
        out = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=hot).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == brute_repeats(rows)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_suffix_dedup_query_matches_brute_force_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = suffixdedup.op2_suffix_array_dedup(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r.n_removed for r in out)


def test_pieces_of_a_long_text_hold_every_window_once(monkeypatch):
    rng = random.Random(12)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (5000, 100, 200, 1099, 1100, 1101)]
    monkeypatch.setattr(suffixdedup, "PIECE", 900)
    recs, doc, at = suffixdedup._numbered(texts)
    for k, t in enumerate(texts):
        r = recs[doc == k]
        covered = [w for p, lo, hi in zip(r["p"].tolist(), r["lo"].tolist(), r["hi"].tolist(), strict=True) for w in range(p - lo, p - hi + 1)]
        assert covered == list(range(max(0, len(t) - 199))) and at[doc == k].tolist() == list(range(len(r)))
    with pytest.raises(ValueError):
        suffixdedup.contexts(np.zeros((1 << 26) + 1, np.uint8), np.array([0, (1 << 26) + 1]))


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def transform(strings, width):
    sym = suffixdedup.symbols(strings, width)
    return suffixdedup.shard_bwts(sym, suffixdedup.suffix_ranks(sym), np.zeros(len(strings), int), 1)[0]


def test_merged_transforms_equal_a_sort():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(120)] + [b"", b"ab" * 15, b"ab" * 15]
    cut = [strings[:40], strings[40:41], strings[41:100], strings[100:]]
    order, common = suffixdedup.sorted_strings([transform(c, 30) for c in cut], 2)
    assert [strings[x] for x in order] == sorted(strings)
    s = sorted(strings)
    assert common[1:].tolist() == [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in zip(s, s[1:], strict=False)]


def test_contexts_own_every_window_once():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (0, 199, 200, 900, 1500)] + [b"a" * 600]
    own = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf, starts = textvec.joined(own, np.frombuffer(b"".join(texts), np.uint8), 0, len(texts))
    recs, doc = suffixdedup.contexts(buf, starts)
    for k, t in enumerate(texts):
        r = recs[doc == k]
        covered = [w for p, lo, hi in zip(r["p"].tolist(), r["lo"].tolist(), r["hi"].tolist(), strict=True) for w in range(p - lo, p - hi + 1)]
        assert covered == list(range(max(0, len(t) - 199)))


# ---- line dedup


def brute_lines(rows, min_sites, min_texts, spare_copies=False, classes=None):
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    body = lambda t: tuple(map(key, t.split("\n")))
    sites, bodies = {}, {}
    for _, t, s, *_ in rows:
        for x in t.split("\n") if t is not None else []:
            if key(x):
                sites.setdefault(key(x), set()).add(s or "")
                bodies.setdefault(key(x), set()).add((classes or {}).get(t) or body(t))
    boiler = {x for x, s in sites.items() if len(s) >= min_sites and len(bodies[x]) >= min_texts}
    times = Counter(body(t) for _, t, *_ in rows if t is not None)
    out = []
    for d, t, *_ in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines = t.split("\n")
        gone = [x for x in lines if key(x) in boiler and not (spare_copies and times[body(t)] > 1)]
        out.append((d, "\n".join(x for x in lines if x not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    lines = [f"Line number {i} {'x' * (i % 9)}" for i in range(40)]
    rows = []
    for i in range(150):
        own = [f"own line {i} {j} " + "y" * 40 for j in range(rng.randrange(0, 4))]
        rows.append((i, "\n".join(rng.sample(own + rng.sample(lines, rng.randrange(0, 3)) + ["", "  line NUMBER 3 xxx\t"], k=2 + len(own)) if own else rng.sample(lines, 1)), f"s{rng.randrange(12)}"))
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "\n\n", None), (203, "z" * 100_000 + "\nLine number 1 x", "s3"), (204, rows[0][1], None), (204, rows[0][1], None)]
    rows += [(300 + i, "a mirrored text\nof two lines" + " " * i, f"s{i}") for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for sites, texts, spare in ((3, 1, False), (4, 4, False), (8, 3, True)):
        out = linededup.remove_boilerplate(docs, min_sites=sites, min_texts=texts, spare_copies=spare).collect()
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out), key=str) == brute_lines(rows, sites, texts, spare)


def test_texts_of_one_class_count_once(spark):
    rows = [(i, f"Shared line\nown {i}\nand more of {i}", f"s{i}") for i in range(6)] + [(10 + i, f"A copied text\nof lines {i}\n{'b' * i}", f"s{i}") for i in range(6)] + [(20, None, "s1"), (None, "Shared line", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    named = {t: "copies" for _, t, _ in rows if t and t.startswith("A copied")}
    classes = docs.where("text LIKE 'A copied%'").selectExpr("doc_id", "xxhash64(text) AS text_hash", "7L AS class")
    out = linededup.remove_boilerplate(docs, classes=classes).collect()
    want = brute_lines(rows, 4, 4, classes=named)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out), key=str) == want
    assert {r.doc_id: r.n_removed for r in out} == {i: int(i is None or i < 10) for i, _, _ in rows}
    assert all(r[3] == 1 for r in brute_lines(rows, 4, 4) if r[1] is not None)  # without classes both kinds would be cut


def test_line_dedup_takes_texts_of_very_many_lines(spark):
    shared = [f"shared {i}" for i in range(50_000)]
    rows = [(i, "\n".join(x for j, s in enumerate(shared) for x in (s, f"own {i} {j}")), f"s{i}") for i in range(4)]
    out = {r.doc_id: r for r in linededup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all((r.n_lines, r.n_removed) == (100_000, 50_000) and r.text == "\n".join(f"own {i} {j}" for j in range(50_000)) for i, r in out.items())


def test_line_dedup_keeps_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a\nb", "s", "en", 3)], "doc_id long, text string, source string, site string, n_lines int")
    assert set(docs.columns) <= set(linededup.remove_boilerplate(docs).columns)
    assert linededup.remove_boilerplate(docs.limit(0)).collect() == []


def test_results_are_the_same_beyond_the_broadcast_bounds(spark, monkeypatch):
    rows = made(11, n=80) + [(500, "w " * 300, "s1", "en"), (501, "x " + "w " * 300, "s2", "en")]
    docs = spark.createDataFrame(rows, DOCS)
    key = lambda df: sorted(map(str, df.collect()))
    run = lambda: [key(suffixdedup.remove_repeats(docs)), key(jaccard.near_duplicates(docs, k=3)), key(linededup.remove_boilerplate(docs, min_sites=2)), key(mixing.mix(docs))]
    want = run()
    monkeypatch.setattr(common, "MOST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
