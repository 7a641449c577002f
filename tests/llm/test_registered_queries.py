"""Registered queries that SQL can't express, over the small tables, against plain loops."""

import hashlib
import zlib
from collections import Counter

import pytest
import tiktoken
import xxhash

from trackloom.llm import catalog, lengths

DATA = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def fingerprint(text):
    words = text.encode().translate(LOWER).decode().translate({ord(c): " " for c in SPACE}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_all_pairs(spark, documents):
    prints = {i: fingerprint(t) for i, t in documents.items()}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(prints)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.queries()["op6_simhash"](spark, DATA).collect()}
    assert got == {i: (f"{p:016x}", top(i)) for i, p in prints.items()}
    assert len({c for _, c in got.values()}) < len(got)


def test_lengths_of_all_documents(spark, documents):
    coder = tiktoken.Encoding("t", pat_str=lengths.pattern(), mergeable_ranks=lengths.ranks(), special_tokens={})
    n = Counter(len(coder.encode_ordinary(t)) for t in documents.values())
    every, total = list(n.elements()), sum(n.elements())
    got = {r.length: r for r in catalog.queries()["op8_token_counts"](spark, DATA).collect()}
    assert got.keys() == n.keys() | {*lengths.LIMITS}
    for limit, r in got.items():
        longer = [x for x in every if x > limit]
        assert (r.n_docs, r.n_ids, r.total_docs, r.total_ids) == (n[limit], n[limit] * limit, len(every), total)
        assert (r.docs_longer, r.ids_longer, r.truncated_ids) == (len(longer), sum(longer), sum(min(x, limit) for x in every))
        assert (r.lost_ids, r.docs_within) == (total - r.truncated_ids, len(every) - len(longer)) and r.quantile == pytest.approx(r.docs_within / len(every))


def test_scores_of_all_documents(spark, documents):
    """Every document once; who is held out; equal texts score alike; what was held out is told apart."""
    query = catalog.queries()["op9_toxicity"]
    got = {r.doc_id: r for r in query(spark, DATA).collect()}
    assert got.keys() == documents.keys()
    by_text = {}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert by_text.setdefault(hashlib.sha256(documents[i].encode()).digest(), r.score) == pytest.approx(r.score, abs=1e-6)
    folder = "/root/testdata/sf0.01"  # the smallest tables hold too few labels to tell
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect()}
    seen = [(r.predicted, toxic[r.doc_id]) for r in query(spark, folder).where("held_out").collect() if toxic.get(r.doc_id) is not None]
    right = sum(p == t for p, t in seen) / len(seen)
    usual = max(Counter(t for _, t in seen).values()) / len(seen)
    assert len(seen) > 50 and right >= 0.9 and right > usual
