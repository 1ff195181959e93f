"""Speculative BPE against exact merging, a public encoder and the round trip."""

import base64
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec()


@pytest.fixture(scope="module")
def reference(codec):
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "Hello world, it's 2024!", "don't we've I'll", "Größenwahn und Äpfel", "日本語のテキスト", "🙂🙃 emoji‍", "a" * 5000, "\n\n\t  x  \n", "<|endoftext|> as text", "ababababab" * 300,
    "http://example.com/a_b-c?d=e&f=1234567890", "  leading and trailing  ", " nbsp em", "ÀÉÎ" * 100,
]


def test_equals_a_public_encoder(codec, reference):
    for t, ids in zip(TEXTS, codec.encode(TEXTS)):
        assert ids.tolist() == reference.encode_ordinary(t), t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    c = bpe.codec()
    ids = c.encode([text])[0].tolist()
    assert c.decode(ids) == text.encode("utf-8", "surrogatepass")
    assert ids == [i for p in c.pattern.findall(text) for i in bpe.merge(p.encode("utf-8", "surrogatepass"), c.ranks)]


def test_verification_finds_each_wrong_proposal(codec):
    r = random.Random(4)
    letters = "etaoinshrdlucmfwypvbgkqjxz"
    pieces = sorted({"".join(r.choices(letters, k=r.randint(1, 14))) for _ in range(4000)})
    fresh = bpe.Codec(codec.ranks)
    fresh.learn(pieces)
    wrong = sum(tuple(fresh.greedy(p.encode())) != tuple(bpe.merge(p.encode(), fresh.ranks)) for p in pieces)
    assert all(np.frombuffer(fresh.known[p], np.int32).tolist() == bpe.merge(p.encode(), fresh.ranks) for p in pieces)
    assert 0 < wrong == fresh.counts[1]  # just the failing ones were merged


def test_whole_table(spark, sf, reference):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(df.select("doc_id", "text").collect())
    rows = bpe.round_trip(df).collect()
    assert len(rows) == df.count() and all(r["intact"] for r in rows)
    assert all(r["tokens"] == reference.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["tokens"]) for r in rows)


def test_defined_cases(docs, clashing):
    df = clashing(docs([None, "", "same text", "same text", "x" * 300_000]))
    rows = {r["doc_id"]: r for r in bpe.tokenize(df).collect()}
    assert (rows[0]["tokens"], rows[0]["n_tokens"]) == (None, None)
    assert (rows[1]["tokens"], rows[1]["n_tokens"]) == ([], 0)
    assert rows[2]["tokens"] == rows[3]["tokens"]
    back = {r["doc_id"]: r["text"] for r in bpe.detokenize(bpe.tokenize(df)).collect()}
    assert back == {0: None, 1: "", 2: "same text", 3: "same text", 4: "x" * 300_000}
    assert [r["intact"] for r in bpe.round_trip(docs([None])).collect()] == [None]
    assert bpe.tokenize(docs([])).count() == 0


def test_a_small_vocabulary():
    c = bpe.Codec({bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259})
    for t in ("abcd", "bcd", "ababc", "xbcabcd", "cdcdab"):
        assert c.encode([t])[0].tolist() == bpe.merge(t.encode(), c.ranks)


def test_unknown_ids_raise(codec):
    with pytest.raises(KeyError):
        codec.decode([10**7])


def test_long_texts_in_parts(codec, reference, monkeypatch):
    r = random.Random(9)
    words = ["the", "don't", "Größe", "12345", "...", "\n\n", " ", "\t \t", "日本", "x" * 90, "a_b", "'s", "  z"]
    monkeypatch.setattr(bpe, "PART", 50)
    for _ in range(40):
        text = "".join(r.choice(words) + r.choice(["", " ", "  ", "\n"]) for _ in range(r.randint(1, 120)))
        assert codec.encode([text, text[:7]])[0].tolist() == reference.encode_ordinary(text)
    assert "".join(codec._parts("word " * 1000)) == "word " * 1000 and len(list(codec._parts("word " * 1000))) > 20


def test_memory_is_bounded_and_long_pieces_are_not_kept(codec, monkeypatch):
    c = bpe.Codec(codec.ranks)
    monkeypatch.setattr(bpe, "MEMORY", 50_000)
    for i in range(40):
        c.encode([" ".join(f"w{i}x{j}" for j in range(100)) + " " + "q" * 500])
        assert c.held <= 25_000 + 100 * 2 * 250 and not any(len(p) > bpe.KEPT for p in [*c.known, *c.older])
    assert len(c.older) < 600


def test_merging_in_step_is_merging_one_by_one(codec, monkeypatch):
    r = random.Random(6)
    raw = ["".join(r.choices("abcdeorst äß日🙂", k=r.randint(1, 40))).encode() for _ in range(1500)] + [b"a" * n for n in (1, 2, 3, 63, 64, 65, 300)]
    want = [bpe.merge(b, codec.ranks) for b in raw]
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.merged(raw)] == want
    small = bpe.Codec({bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"aa": 260, b"aaaa": 261})
    odd = ["".join(r.choices("abcd", k=r.randint(1, 12))).encode() for _ in range(500)]
    assert [np.frombuffer(x, np.int32).tolist() for x in small.merged(odd)] == [bpe.merge(b, small.ranks) for b in odd]
    assert small.merged([]) == []
    alone = []
    monkeypatch.setattr(bpe, "merge", lambda b, ranks: alone.append(b) or [])
    bpe.Codec(codec.ranks).learn([b.decode() for b in raw])
    assert all(len(b) > bpe.KEPT for b in alone)  # short ones are never merged one by one


def test_ascii_texts_are_cut_alike_and_a_wrong_id_is_seen(codec):
    r = random.Random(7)
    for _ in range(3000):
        t = "".join(r.choices([*map(chr, range(128)), " ", "  ", "'s", "'ll", "ab", "12"], k=r.randint(0, 30)))
        assert bpe._ASCII.findall(t) == codec.pattern.findall(t), repr(t)
    texts = ["some text", None, "", "Größe", "more"]
    ids = codec.encode([t or "" for t in texts])
    assert codec.intact(texts, ids) == [True, None, True, True, True] and codec.intact([], []) == []
    ids[3] = ids[3][::-1]
    assert codec.intact(texts, ids) == [True, None, True, False, True]
    assert codec.intact(["ab", "c"], codec.encode(["a", "bc"])) == [False, False]
