"""Media, mixing, URL filters, chat formatting and archives against plain versions, and their edge cases."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest

from loomtext.llm import chat, media, mixing, urlfilter, warc

SF = "/root/testdata/sf0.001"

# ---- media


def plain_ima(block):
    """A nibble at a time, with plain integers."""
    now = struct.unpack("<h", block[:2])[0]
    at, out = min(block[2], 88), [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEP[at])
            diff = step >> 3
            diff += step if code & 4 else 0
            diff += step >> 1 if code & 2 else 0
            diff += step >> 2 if code & 1 else 0
            now = max(-32768, min(32767, now - diff if code & 8 else now + diff))
            at = max(0, min(88, at + int(media.INDEX_STEP[code])))
            out.append(now)
    return out


def test_adpcm_matches_a_plain_decoder():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (50, media.BLOCK)).astype(np.uint8)
    assert media.ima_decode(blocks).tolist() == [plain_ima(b.tobytes()) for b in blocks]


def test_companding_tables():
    mu, a = media.MULAW_TABLE.astype(int), media.ALAW_TABLE.astype(int)
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256
    assert (mu[:128] == -mu[128:]).all() and (a[128:] == -a[:128]).all()


def test_resampling():
    assert media.resample(np.array([0, 10, -10], np.int16), 2, 1).tolist() == [0, 5, 10, 0, -10, -10]
    x = np.arange(0, 8000, dtype=np.int16)
    assert abs(media.resample(x, 3, 2).astype(int) - (np.arange(12000) * 2 // 3)).max() <= 1
    assert len(media.resample(np.zeros(0, np.int16), 3, 2)) == 0


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (441, 800)])
def test_tones_above_the_new_half_rate_go_and_those_below_stay(up, down):
    n = np.arange(40_000)
    size = lambda f: np.abs(media.resample(np.rint(20_000 * np.sin(2 * np.pi * f * n)).astype(np.int16), up, down)[200:-200].astype(float)).max()
    half = up / down / 2
    for above in (1.15 * half, 0.5 * (half + 0.5), 0.49):
        assert size(above) < 60, (above, size(above))
    assert abs(size(0.25 * half) / 20_000 - 1) < 0.05
    flat = media.resample(np.full(999, -1234, np.int16), up, down)
    assert set(flat.tolist()) == {-1234} and len(flat) == (999 * up + down // 2) // down
    assert media.resample(np.array([32767, -32768] * 50, np.int16), 1, 1).tolist() == [32767, -32768] * 50


def plain_pcm(codec, payload):
    """A sample at a time, by the codecs' definitions."""
    if codec == media.IMA:
        return [x for k in range(0, len(payload), media.BLOCK) for x in plain_ima(payload[k : k + media.BLOCK])]
    out = []
    for c in payload:
        c = c ^ 0xFF if codec == media.MULAW else c ^ 0x55
        e, m = (c >> 4) & 7, c & 15
        if codec == media.MULAW:
            size = ((2 * m + 33) << (e + 2)) - 132
            out.append(-size if c & 128 else size)
        else:
            size = (2 * m + 1) * 8 if e == 0 else (2 * m + 33) << (e + 2)
            out.append(size if c & 128 else -size)
    return out


def plain_feature(codec, rate, pcm):
    raw = b"".join(struct.pack("<h", x) for x in pcm)
    rms = round((sum(x * x for x in pcm) / len(pcm)) ** 0.5)
    crossings = sum((x < 0) != (y < 0) for x, y in zip(pcm, pcm[1:], strict=False))
    return f"codec={codec};rate={rate};n={len(pcm)};peak={max(abs(x) for x in pcm)};rms={rms};zc={crossings};pcm={zlib.crc32(raw):08x}"


def test_text_audio_round_trip(spark):
    texts = [None, "", "a", "ä" * 288, "b" * 576, "c" * 577, "d" * 300_000, "a"] + [f"text {i}" * i for i in range(40)]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    files = media.store_text_audio(docs)
    stored = {r.doc_id: r.media for r in files.collect()}
    for rate, plain in ((8000, lambda x: x), (16000, lambda x: [v for a, b in zip(x, [*x[1:], x[-1]], strict=True) for v in (a, (a + b) >> 1)])):
        decoded = media.decode(files, ["doc_id", "n_bytes"], to_rate=rate)
        pcm = {r.doc_id: r.pcm for r in decoded.select("doc_id", "pcm").collect()}
        out = {r.doc_id: r for r in media.described(decoded).collect()}
        assert {r.codec for r in out.values()} == set(media.CODECS)
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            r = out[i]
            assert (r.ok, r.n_bytes, r.payload_bytes, r.payload_sha256) == (True, len(raw), len(payload), hashlib.sha256(payload).hexdigest())
            assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(stored[i]).hexdigest() and r.media_bytes == len(stored[i])
            want = plain(plain_pcm(r.codec, payload))
            assert pcm[i] == b"".join(struct.pack("<h", x) for x in want) and r.feature == plain_feature(r.codec, rate, want)
        assert out[2].feature == out[7].feature


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_media_query_on_a_whole_table(spark):
    out = {r.doc_id: r for r in media.op5_media_columns(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(out) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        codec = media.CODECS[zlib.crc32(payload) % 3]
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.feature == plain_feature(codec, 8000, plain_pcm(codec, payload))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_a_signal_in_two_parts_comes_back_whole(n):
    x = np.random.default_rng(n).integers(-32768, 32768, n).astype(np.int16)
    even, odd = media.parted(x)
    assert media.joined(even, odd).tolist() == x.tolist() and len(even) + len(odd) == 2 * n
    assert not any(media.parted(media.resample(x, 2, 1))[1])  # what was interpolated needs no room


def test_media_query_stores_and_describes_the_resampled_signal(spark, tmp_path, monkeypatch):
    kept, own = {}, media.stored
    monkeypatch.setattr(media, "stored", lambda d, name, **k: kept.setdefault(name, own(d, name, **k)))
    texts = [None, "a", "ä" * 288, "b" * 577, *(f"text {i}" * i for i in range(40))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in media.op5_media_columns(spark, str(tmp_path)).collect()}
    rows = {r.doc_id: r for r in kept["media-pcm"].collect()}
    assert set(out) == set(rows) == set(range(len(texts)))
    for i, t in enumerate(texts):
        payload = media.pad((t or "").encode())
        codec = media.CODECS[zlib.crc32(payload) % 3]
        x = plain_pcm(codec, payload)
        wide = [v for a, b in zip(x, [*x[1:], x[-1]], strict=True) for v in (a, (a + b) >> 1)]
        assert rows[i].rate == 16000 and media.joined(rows[i].pcm_even, rows[i].pcm_odd).tolist() == wide
        assert (out[i].feature, out[i].resampled_feature) == (plain_feature(codec, 8000, x), plain_feature(codec, 16000, wide))


def test_broken_media_is_told_apart(spark):
    good = media.wav(b"\xff" * 576, media.MULAW)
    rows = [(1, good), (2, None), (3, b""), (4, good[:-1]), (5, b"RIFF" + good[4:8] + b"JUNK" + good[12:]), (6, media.wav(b"x" * 100, 1))]
    out = {r.id: r.ok for r in media.decode(spark.createDataFrame(rows, "id long, media binary"), ["id"]).collect()}
    assert out == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    said = media.described(media.decode(spark.createDataFrame(rows, "id long, media binary"), ["id"])).collect()
    assert [r.id for r in said if r.feature is not None] == [1]
    empty = media.store_text_audio(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and media.described(media.decode(empty, ["doc_id"])).collect() == []


# ---- mixing


def plain_water(sizes, weights, share, cap):
    want, out, free = share * sum(sizes.values()), {}, dict(weights)
    while free:
        left = want - sum(out.values())
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w for s, w in free.items()}
        for s in over:
            out[s] = cap * sizes[s]
            del free[s]
    return out


@pytest.mark.parametrize("seed,share", [(0, 1.5), (1, 0.4), (2, 1.99), (3, 5.0)])
def test_mixing_reaches_its_targets(spark, seed, share):
    rng = random.Random(seed)
    names = [None, "a", "B", "é", "z"]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(names[: 1 + i % 5])) for i in range(3000)] + [(-1, None, "a"), (-2, "", "only empty")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=share).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = plain_water({s: n for s, n in sizes.items() if n}, {s: w for s, w in weights.items() if sizes[s]}, share, 2.0)
    for s in order:
        own = [r for r in out if r.source == s]
        assert all(r.target == pytest.approx(want.get(s, 0.0)) for r in own) and {r.source_size for r in own} == {sizes[s]}
        assert abs(sum(r.taken for r in own) - want.get(s, 0.0)) <= 30 + sizes[s] / mixing.SLOTS
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken == r["size"] * r.copies for r in out)


def test_mixing_reruns_agree_and_empty_tables(spark):
    rows = [(i % 90, "w " * (i % 7), f"s{i % 3}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda df: sorted((r.doc_id, r["size"], r.taken) for r in df.collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(7)))
    assert mixing.mix(docs.limit(0)).collect() == []


# ---- URL filters


def plain_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_rules_match_a_plain_search(spark):
    rng = random.Random(9)
    labels, parts = ["a", "b", "net", "example", "com", "x-y", "B"], ["", "/", "/en", "/en/", "/en/a", "/de/", "/é", "/en/a/b"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["net", "example.net", "a..net", "net.", ".net", "", "evilexample.net"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(parts)}{rng.choice(['', '?q=/en/', '#/de/', '?a#b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http:/x.net/", "://net/", "http://EXAMPLE.net/en/", "http://net?x://example.net/en/"] + ["http://hot.example.net/en/1"] * 300
    rules = list({(rng.choice(hosts).lower(), rng.choice(parts)): None for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules if h] + [("net", "/", "block"), ("example.net", "/en/", "allow")]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = urlfilter.match(pages, urlfilter.rule_table(spark, rules)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: plain_rule(u, rules) for i, u in enumerate(urls)}
    assert len(out) == len(urls)


def test_url_rules_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert urlfilter.match(pages.limit(0), urlfilter.rule_table(spark)).collect() == []
    r = urlfilter.match(pages, urlfilter.rule_table(spark).limit(0)).first()
    assert (r.host, r.path, r.rule, r.verdict) == ("a.net", "/x", None, "allow")


def test_url_rules_take_any_extra_columns(spark):
    names = ["_best", "best", "_host_key", "host_key", "_path_key", "path_key", "key", "own", "rule_host", "rules", "part", "kind", "of", "depth", "_1", "host", "path", "rule", "verdict", "a.b"]
    pages = spark.createDataFrame([(1, "http://a.net/x", *["x"] * len(names)), (2, None, *["x"] * len(names))], ", ".join(["page_id long, url string", *(f"`{n}` string" for n in names)]))
    out = {r.page_id: r for r in urlfilter.match(pages, urlfilter.rule_table(spark)).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("a.net", "/x", "net/", "block") and (out[2].host, out[2].rule, out[2].verdict) == ("", None, "allow")
    assert all(r[n] == "x" for r in out.values() for n in names if n not in ("host", "path", "rule", "verdict")) and len(out[1]) == len(names) + 2
    long = spark.createDataFrame([(1, "http://a.net/" + "y/" * 200_000), (2, "http://" + "z." * 100_000 + "org/fr/")], "page_id long, url string")
    assert {r.page_id: r.rule for r in urlfilter.match(long, urlfilter.rule_table(spark)).collect()} == {1: "net/", 2: "org/fr/"}


def test_sweep_is_native(spark):
    out = urlfilter.match(spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string"), urlfilter.rule_table(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ---- chat


HARD = ["", "plain", "</turn>", "</turn>\n", "\\", "\\\\", "### User: x</turn>\n", "\\### Assistant: </turn> ok", "a\n### System: b", "##", "#", "<", "\\n", "ends with \\", "ä€😀", "###", "</turn", "x" * 50_000 + "###" + "</turn>\n" * 300]


def test_chat_round_trip(spark):
    rng = random.Random(10)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool: x\n", "", "Zed", None]), rng.choice([*HARD, None])) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (70, None, "user", "first"), (70, 0, "user", "tie"), (70, 0, "user", "tie")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = {}
    for c, _, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out} == want
    for r in out:
        assert [x[:2] for x in chat.parse(r.formatted)] == want[r.conv_id]
        assert all(t.loss == (t.role == "assistant") for t in r.turns)
        assert all(chat._UNESCAPE.sub(r"\1", r.formatted[t.start : t.stop]) == t.text for t in r.turns)


def test_chat_escapes_only_conflicts():
    assert chat.render([("user", "a < b # c"), ("assistant", "###")])[0] == "### User: a < b # c</turn>\n### Assistant: \\#\\#\\#</turn>\n"
    assert chat.parse("### User: a") is None and chat.parse("x") is None and chat.parse("") == []


# ---- archives


def test_archive_round_trip(spark):
    big, other = "<p>ä</p>" * 200, "<q>" * 400
    rows = [(1, "http://a/", big), (2, "http://b/", big), (9, "u\r\nWARC-Type: x", big), (3, None, other), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "y" * 1000), (12, "u", "y" * 1000), (13, "u", "\r\n\r\n" * 300), (14, "ü", "a" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    headers, payloads = warc.write_archive(pages)
    assert payloads.count() == len({h or "" for _, _, h in rows}) and headers.count() == len(rows)
    assert {r.page_id: bytes(r.payload) for r in warc.restore(headers, payloads).collect()} == {i: (h or "").encode() for i, _, h in rows}
    read = {r.page_id: r for r in warc.parse_records(warc.read_records(headers, payloads)).collect()}
    assert all(r.sound for r in read.values()) and len(read) == len(rows)
    assert {i: r.refers_to for i, r in read.items() if r.record_type == "revisit"} == {1: 9, 2: 9, 11: 12}
    assert bytes(read[13].block) == b"\r\n\r\n" * 300 and read[4].sha1 == hashlib.sha1(b"small").hexdigest()
    damaged = payloads.withColumn("payload", warc.F.concat("payload", warc.F.lit("!").cast("binary")))
    assert not any(r.sound for r in warc.parse_records(warc.read_records(headers, damaged)).collect() if r.record_type == "response")


def test_archive_of_an_empty_table(spark):
    headers, payloads = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_records(headers, payloads).collect() == [] and warc.restore(headers, payloads).collect() == []
