"""The token automaton against the vocabulary's library, against merges applied one by one, and on odd tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import automaton, catalog

DATA = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def made():
    return automaton.load(FILE)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def ids(made, text):
    machine, rule = made
    out = []
    for words, special in rule.parts(text):
        for w in words:
            out += np.frombuffer(machine.words[w], "<u4").tolist()
        out += [] if special is None else [special]
    return out


def test_query(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: r for r in catalog.queries()["op13_bpe"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_every_character(made, library):
    for low in range(0, 0x110000, 512):
        chars = [chr(c) for c in range(low, low + 512) if not 0xD800 <= c < 0xE000]
        for text in ("".join(chars), "".join(f"a{c}1{c} {c}!{c}" for c in chars)):
            assert ids(made, text) == library.encode(text, add_special_tokens=False).ids


def test_hard_texts(made, library):
    rng = random.Random(5)
    texts = ["", " ", "  x", "\n" * 99, "a" * 999, "ab" * 500, " " * 400 + "x", "<|endoftext|>", "a<|endoftext|>  b<|endoftext|><|endoftext|>", "<|endoftext", "it's 'S we'll'd"]
    texts += ["".join(rng.choice("aabt  '\n\téßжк漢字12😀") for _ in range(80)) for _ in range(500)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(30_000))]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(made, text) == want
        assert made[0].emit(want).decode() == text


def applied(data, merges):
    """Each merge at all places from the left, in the order of the merges."""
    path = [bytes([b]) for b in data]
    for u, v in merges:
        at = 0
        while at + 1 < len(path):
            if path[at] == u and path[at + 1] == v:
                path[at : at + 2] = [u + v]
            at += 1
    return path


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_any_merges(data):
    """Vocabularies of few letters, where merges of a token with itself and unreachable tokens are frequent."""
    tokens, merges = [bytes([b]) for b in range(256)], []
    for _ in range(data.draw(st.integers(0, 14))):
        usual = st.sampled_from([*tokens[97:100], *tokens[256:]])
        u, v = data.draw(usual), data.draw(usual)
        if u + v not in tokens:
            tokens.append(u + v)
            merges.append((u, v))
    number = {t: i for i, t in enumerate(tokens)}
    machine = automaton.Automaton(dict(enumerate(tokens)), [(number[u], number[v], number[u + v]) for u, v in merges])
    for _ in range(8):
        word = bytes(data.draw(st.lists(st.sampled_from(b"abc"), max_size=24)))
        assert machine.word(word) == [number[t] for t in applied(word, merges)]


def test_refused():
    tokens = dict(enumerate([*(bytes([b]) for b in range(256)), b"abc", b"ab"]))
    for merges in ([(257, 99, 256), (97, 98, 257)], [(97, 98, 257), (97, 98, 257)]):
        with pytest.raises(ValueError):
            automaton.Automaton(tokens, merges)


def test_odd_rows(spark, made):
    schema = "doc_id long, text string, ids string, decoded string, n_tokens int"
    rows = [(1, None, "x", "y", 1), (2, "", "x", "y", 1), (2, "ab ab", "x", "y", 1), (2, "ab ab", "x", "y", 1), (None, "z", None, None, None), (3, "w " * 100_000, "", "", 0)]
    got = automaton.encode(spark.createDataFrame(rows, schema), *made, "doc_id").collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, t or "") for i, t, *_ in rows)
    assert automaton.encode(spark.createDataFrame([], schema), *made, "doc_id", digests=True).collect() == []


def test_memo_is_bounded(made, monkeypatch):
    monkeypatch.setattr(automaton, "MEMO", 50)
    made[0].words.clear()
    text = " ".join(map(str, range(1000)))
    first = ids(made, text)
    assert len(made[0].words) <= 50 and ids(made, text) == first
