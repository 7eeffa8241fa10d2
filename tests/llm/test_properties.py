"""Properties over generated inputs, without Spark."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import chat, decontam, media, suffixdedup, textvec

control = st.text(alphabet=st.sampled_from(list("\\#</turn>\n: Aé😀")), max_size=40)
texts = st.one_of(control, st.text(max_size=60), st.lists(st.sampled_from(["</turn>\n", "### ", "User: ", "\\", "x"]), max_size=8).map("".join))
roles = st.one_of(st.sampled_from(["user", "assistant", "system", ""]), st.text(max_size=8), control)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(roles, texts), max_size=5))
def test_chats_survive_their_round_trip(turns):
    rendered, back = chat.render(turns)
    assert [b[:2] for b in back] == turns and chat.parse(rendered) == back


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000), st.sampled_from(media.CODECS))
def test_wav_files_give_their_payload_back(data, codec):
    payload = media.pad(data)
    got = media.parse_wav(media.wav(payload, codec))
    assert got[0] == codec and got[3] == payload and len(payload) % media.UNIT == 0 and payload.startswith(data)
    assert media.expand(codec, np.frombuffer(payload, np.uint8)) is not None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=45).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), min_size=1, max_size=4))
def test_transforms_merge_to_sorted_order(shards):
    symbols = [suffixdedup.symbols(c, 45) for c in shards]
    bwts = [suffixdedup.shard_bwts(s, suffixdedup.suffix_ranks(s), np.zeros(len(s), int), 1)[0] for s in symbols]
    strings = [s for c in shards for s in c]
    order, common = suffixdedup.sorted_strings(bwts, 3)
    want = sorted(strings)
    assert [strings[x] for x in order] == want
    assert common[1:].tolist() == [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in zip(want, want[1:], strict=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=12))
def test_spans_merge_to_their_union(spans):
    a, z = suffixdedup.merge_spans(np.array([x for x, _ in spans], np.int64), np.array([x + n for x, n in spans], np.int64))
    covered = {i for x, n in spans for i in range(x, x + n)}
    assert covered == {i for x, y in zip(a, z, strict=True) for i in range(x, y)} and (a[1:] > z[:-1]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB \t\né")), max_size=40), min_size=1, max_size=5), st.integers(1, 4))
def test_shingle_sets_have_the_size_of_the_sets_they_stand_for(rows, k):
    raw = [t.encode() for t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = textvec.shingle_sets(offsets, np.frombuffer(b"".join(raw), np.uint8), 0, len(rows), k)
    for t, s in zip(raw, got, strict=True):
        w = t.replace(b"B", b"b").split()
        assert len(s) == (len({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}) if w else 0)


@pytest.mark.parametrize("text", ["", "A b", "a-b c", "ä b"])
def test_one_word_windows_hit_every_equal_word(text):
    machines = decontam.automata(decontam.item_windows([(1, "b")], 1))
    n, hit, ids, _ = decontam.scan(text.encode(), machines)
    words = text.lower().replace("-", " ").split()
    assert n == len(words) and (0 if hit is None else int(hit.sum())) == words.count("b") and ids == (["1"] if "b" in words else [])
