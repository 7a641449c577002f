"""The text operators against brute force on small tables, with nulls, ties, repeats, long texts and odd columns."""

import hashlib
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark import cloudpickle
from pyspark.sql import functions as F

from trackloom.llm import catalog, chat, contam, exact, lengths, lines, pieces, simhash, substrings, toxic, urls

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test module
DATA = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, h string, shard int, kept int, bucket string, key string, n string"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus():
    """Documents with everything that may go wrong; a third are copies of one text."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    hot, near, line, passage = prose(60), prose(90), prose(8) + " Shared Line", prose(55)
    texts = [None, "", " ", "\n", "\n\n", "\t \r", "A", "a", "\x00\x00", "ÀÉ ß İ", "x" * 450, "x" * 700, "ab " * 300, prose(20000)]
    for i in range(200):
        k = i % 8
        if k < 3:
            texts.append(hot if i % 5 else hot.upper().replace("É", "é"))
        elif k == 3:
            w = near.split()
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif k == 4:
            texts.append(f"{prose(10)}\n  {line if i % 3 else line.upper()}\t\n{prose(5)}\n{line}")
        elif k == 5:
            texts.append(f"{prose(30)} {passage} {prose(rng.randint(0, 20))}")
        else:
            texts.append(prose(rng.randint(1, 80)))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", "s", len(t or ""), "h", 1, 2, "b", "k", "n") for i, t in corpus]
    return spark.createDataFrame(rows, ODD).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- 1 exact copies


def test_exact(docs, corpus):
    got = rows(exact.exact_duplicates(docs, capacity=4))
    groups = {}
    for i, t in corpus:
        groups.setdefault(low(t), []).append(i)
    for i, t in corpus:
        g, r = groups[low(t)], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), i == max(g), sha(low(t)))
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_ties_nulls_empty(spark, none):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, None), (None, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact.exact_duplicates(df).collect())
    assert got == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 2, True), ("None", "None", 2, True)]
    assert exact.exact_duplicates(none).count() == 0
    assert exact.drop_exact_duplicates(none).count() == 0


@pytest.mark.parametrize("few", [2, 1000])
def test_exact_collisions(spark, corpus, few, tmp_path):
    """Three hashes for all texts: long chains, told apart by bytes, whether their rows combine first or not."""
    weak = lambda text: F.pmod(F.length(text), F.lit(3)).cast("long") - 1
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    groups = {}
    for i, t in corpus:
        groups.setdefault(low(t), []).append(i)
    got = rows(exact.exact_duplicates(df, capacity=1, few=few, hashed=weak))
    for i, t in corpus:
        g = groups[low(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].text_sha256) == (max(g), len(g), sha(low(t)))
    found = exact.entries(df, exact.build_index(df, str(tmp_path / "x"), 1, few, weak), str(tmp_path / "y")).collect()
    assert len({(r.h, r.chain) for r in found}) == len(groups) and max(r.chain for r in found) > 50
    assert {(r.h, r.chain): r.text_sha256 for r in found} == {(r.h, r.chain): r.text_sha256 for r in reversed(found)}


@given(st.dictionaries(st.one_of(st.integers(0, 2**64 - 1), st.integers(2**63, 2**63 + 40), st.integers(2**64 - 9, 2**64 - 1)), st.just(1), max_size=80), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_directory(keys, capacity):
    def counts(bits, prefixes):
        return Counter(k >> (64 - bits) for k in keys if prefixes is None or k >> (64 - bits + exact.STEP) in prefixes)

    buckets, depth = exact.grow(counts, capacity)
    ends = [*(b for b, _ in buckets[1:]), 1 << 64]
    assert buckets[0][0] == 0 and all(b + (1 << (64 - d)) == e for (b, d), e in zip(buckets, ends, strict=True))
    assert all(sum(b <= k < e for k in keys) <= capacity for (b, _), e in zip(buckets, ends, strict=True))
    top = min(depth, exact.LEAD)
    directory = exact.slots(buckets, depth)
    for k in [*keys, 0, 2**64 - 1]:
        own = [b for s, low, high, b in directory if s == (k >> (64 - top)) and low <= k & (1 << 48) - 1 < high]
        assert len(own) == 1 and buckets[own[0]][0] <= k < ends[own[0]]


# ---- 2 chat


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "&amp;lt;", "&lt;", "a&b", "[TEXT]", "[/ROLE]x", "", None, "<<SYS>>\n\\", "é\x00"]
    turns = [(i, j, ["user", "assistant"][j % 2], odd[(i + j) % len(odd)]) for i in range(10) for j in range(4)]
    turns += [(50, 0, "to<ol[", "x"), (51, None, None, None), (None, 1, "user", "q"), (52, 1, "user", "b"), (52, 1, "user", "a"), (53, 0, "system", "s"), (53, 1, "user", "u"), (53, 2, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"rows": df_lit("x"), "piece": df_lit(1)})
    got = rows(chat.read_back(chat.format_conversations(df)), "conv_id")
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] if t[1] is not None else -1), t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in own]
        assert got[conv].loss_text == "".join(x for _, r, x in own if r == "assistant")
    assert [got[c].valid for c in (0, 50, 51, 52, 53, None)] == [True, False, False, False, True, True]
    assert chat.format_conversations(df.limit(0)).count() == 0


def df_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


def test_chat_templates():
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Turn("U:", "[/]")})


# ---- 3 decontamination


def contamination(corpus, items, window=13):
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for i, t in items:
        w = rule.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(k) for k in wins}
    for i, t in corpus:
        w, hit, found = rule.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    found |= own
                    hit.update(range(k, k + n))
        yield i, len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination(spark, docs, corpus, block):
    text = dict(corpus)
    long = [t for _, t in corpus if t and 30 < len(t.split()) < 100]
    items = [(i, " ".join(t.split()[2:25])) for i, t in enumerate(long[::9])] + [(100, text[10]), (101, "A"), (102, None), (103, "..."), (104, long[0]), (105, long[0]), (106, " ".join(long[3].split()[:4]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(contam.find(docs, bench, ["doc_id"], shard_bytes=20_000, block_bytes=block))
    for i, n, hit, found in contamination(corpus, items):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, hit, found)
        assert sum(b - a for a, b in zip(got[i].spans[::2], got[i].spans[1::2], strict=True)) == hit
    for i, want in longest_matches(corpus[:60], items):
        assert (got[i].longest_match, got[i].longest_at) == want


def longest_matches(corpus, items):
    """Length and first place of each text's longest run of words that an item has too, three or a whole item at least."""
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    held = [rule.findall(low(t)) for _, t in items]
    for i, t in corpus:
        w, best = rule.findall(low(t)), (0, None)
        for x in held:
            before = [0] * (len(x) + 1)
            for k, word in enumerate(w):
                now = [0] * (len(x) + 1)
                for j, other in enumerate(x):
                    if word == other:
                        n = now[j + 1] = before[j] + 1
                        if n >= min(3, len(x)) and (n, -(k - n + 1)) > (best[0], -(best[1] if best[1] is not None else 1 << 40)):
                            best = n, k - n + 1
                before = now
        yield i, best


@given(st.lists(st.integers(0, 5), max_size=60), st.sampled_from([1, 2, 3]))
@settings(max_examples=40, deadline=None)
def test_suffix_array_with_fewer_words_in_a_pack(words, pack):
    stream = np.array([*words, *[0] * 80], np.int64)
    order = contam.suffix_array(stream, np.flatnonzero(stream), 70, pack)
    key = lambda p: stream[p : p + int(np.argmin(stream[p:]))].tolist()  # up to the end of its text
    assert [key(p) for p in order] == sorted(key(p) for p in np.flatnonzero(stream))


def test_contamination_edges(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contam.find(docs, bench, ["doc_id"]).where("n_hit > 0").count() == 0
    assert contam.drop_contaminated(none, bench).columns == none.columns
    one = spark.createDataFrame([(1, "the Quick brown fox jumps over it " * 3)], "item_id long, text string")
    two = spark.createDataFrame([(1, "a the quick brown fox jumps over it the quick brown fox jumps over it b", 1), (1, "quick brown", 2)], "doc_id long, text string, _words int")
    got = contam.find(two, one, ["doc_id"]).orderBy("n_words").collect()
    assert [(r.n_hit, r.longest_match, r.longest_at) for r in got] == [(0, 0, None), (14, 14, 1)]
    assert contam.drop_contaminated(two, one).count() == 1


def test_suffix_array():
    rng = np.random.default_rng(0)
    stream = np.r_[rng.integers(0, 4, 300), np.zeros(40, np.int64)]
    order = contam.suffix_array(stream, np.flatnonzero(stream[:300]), 30)

    def key(p):
        s = stream[p : p + 30].tolist()
        return s[: s.index(0)] if 0 in s else s

    assert [key(p) for p in order] == sorted(key(p) for p in order)


# ---- 4 lines


def test_lines(docs, corpus):
    strip = " \t\n\x0b\x0c\r"
    found = {}
    for i, t in corpus:
        for x in (t or "").split("\n"):
            found.setdefault(low(x.strip(strip)), set()).add(i)
    gone = {k: max(v) for k, v in found.items() if len(k) >= 20 and len(v) >= 3}
    finish = lambda kept, n, dropped: (n, dropped, sha(kept))
    got = rows(lines.apply_bitmaps(docs, lines.keep_bitmaps(docs), "n_lines long, n_dropped long, kept string", finish))
    assert gone
    for i, t in corpus:
        every = (t or "").split("\n")
        left = [x for x in every if gone.get(low(x.strip(strip)), i) <= i]
        assert tuple(got[i])[:3] == (len(every), len(every) - len(left), sha("\n".join(left)))


def test_lines_edges(spark, none):
    assert lines.keep_bitmaps(none).count() == 0
    same = "a line of more than twenty characters"
    df = spark.createDataFrame([(None, same), (2, same), (2, same), (3, same + "\nb")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.dropped) for r in lines.apply_bitmaps(df, lines.keep_bitmaps(df), "dropped long", lambda kept, n, dropped: (dropped,)).collect())
    assert got == [("2", 1), ("2", 1), ("3", 0), ("None", 1)]


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 6)), min_size=1, max_size=60), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_line_runs(found, size):
    """What is told of a partition, with its open ends counted, is what counting all of it gives."""
    import pyarrow as pa

    found = sorted(found, key=lambda x: (x[0], -x[1]))
    make = lambda part, off: pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array([d for _, d in part], pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array([9] * len(part), pa.int32()), pa.array(range(off, off + len(part)), pa.int32())], names=["k1", "k2", "doc", "text_key", "n_lines", "pos"])
    out = [r for b in lines.stream_runs(3)(make(found[i : i + size], i) for i in range(0, len(found), size)) for r in b.to_pylist()]
    edge = [r for r in out if r["open"]]
    told = {r["pos"] for r in out if not r["open"]}
    for k in {r["k1"] for r in edge}:
        own = [r for r in edge if r["k1"] == k]
        if len({r["doc"] for r in own}) >= 3:
            told |= {r["pos"] for r in own if r["doc"] < max(x["doc"] for x in own)}
    docs_of = {k: {d for x, d in found if x == k} for k, _ in found}
    assert told == {i for i, (k, d) in enumerate(found) if len(docs_of[k]) >= 3 and d < max(docs_of[k])}


# ---- 5 substrings


def removed(corpus, size, keep_first=False):
    raw = [(i, (t or "").encode()) for i, t in corpus]
    count = Counter(b[p : p + size] for _, b in raw for p in range(len(b) - size + 1))
    seen = set()
    for i, b in raw:
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            if count[s] > 1 and not (keep_first and s not in seen):
                mask[p : p + size] = True
            seen.add(s)
        yield i, mask, b


def _spans(kept, size, runs):
    return size, size - len(kept), len(runs), sha(kept)


@pytest.mark.parametrize(("many", "shard_many", "shard_bytes"), [(64, 16, 2 << 20), (2, 1, 3000), (3, 50, 5000)])
def test_substrings(docs, corpus, many, shard_many, shard_bytes):
    got = rows(substrings.repeated(docs, "n_bytes long, n_removed long, n_spans long, kept string", _spans, keep_first=False, many=many, shard_many=shard_many, shard_bytes=shard_bytes))
    for i, mask, b in removed(corpus, 200):
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept) == (len(b), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), sha(kept))


def test_substrings_keep_first(spark, corpus):
    ordered = spark.createDataFrame(corpus, "doc_id long, text string").coalesce(1)
    got = rows(substrings.repeated(ordered, "kept string", lambda kept, size, runs: (sha(kept),), keep_first=True, shard_bytes=4000, many=3, shard_many=2))
    for i, mask, b in removed(corpus, 200, keep_first=True):
        assert got[i].kept == sha(np.frombuffer(b, np.uint8)[~mask].tobytes())


def test_substrings_edges(spark, none):
    assert substrings.repeated(none, "n long", lambda kept, size, runs: (size,)).count() == 0
    df = spark.createDataFrame([(None, "q" * 199), (1, "r" * 200), (1, "r" * 200)], "doc_id long, text string")
    got = sorted(r.n for r in substrings.repeated(df, "n long", lambda kept, size, runs: (len(kept),), keep_first=False).collect())
    assert got == [0, 0, 199]


@given(st.lists(st.integers(0, 2), min_size=6, max_size=60))
@settings(max_examples=60, deadline=None)
def test_longest_previous_factor(text):
    size = 5
    windows = np.lib.stride_tricks.sliding_window_view(np.array(text, np.uint8), size)
    order, lcp = substrings.suffix_order(windows)
    shared = lambda i, j: next((k for k in range(size) if windows[i][k] != windows[j][k]), size)
    n = len(windows)
    assert substrings.longest_previous_factor(order, lcp).tolist() == [max([shared(i, j) for j in range(i)], default=0) for i in range(n)]
    assert substrings.longest_previous_factor(order, lcp, later=True).tolist() == [max([shared(i, j) for j in range(i + 1, n)], default=0) for i in range(n)]


# ---- 6 simhash


def prints(corpus):
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        yield i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, corpus):
    want = dict(prints(corpus))
    root = {f: f for f in want.values()}

    def find(f):
        return f if root[f] == f else find(root[f])

    for a in root:
        for b in root:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in want.items():
        least[find(f)] = min(i, least.get(find(f), i))
    got = rows(simhash.near_duplicates(docs))
    for i, f in want.items():
        assert (got[i].fp % (1 << 64), got[i].component_id) == (f, least[find(f)])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


@given(st.sets(st.integers(0, 2**64 - 1), max_size=30), st.integers(0, 3), st.randoms(), st.sampled_from([1, 32]), st.sampled_from([1, 5, 1 << 16]))
@settings(max_examples=80, deadline=None)
def test_trie_pairs(keys, budget, rng, few, at_once):
    keys = sorted([*keys, *(k ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for k in keys)])
    group = np.sort(np.array([rng.randrange(3) for _ in keys], np.int64))
    got = [(a, b) for i, j in simhash.trie_pairs(np.array(keys, np.uint64), group, budget, few, at_once) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    want = [(a, b) for b in range(len(keys)) for a in range(b) if group[a] == group[b] and bin(keys[a] ^ keys[b]).count("1") <= budget]
    assert sorted(got) == sorted(want)


@given(st.lists(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=2), max_size=700))
@settings(max_examples=20, deadline=None)
def test_majority(rows):
    got = simhash.majority(np.array(rows, np.uint64).reshape(-1, 2))
    assert got.tolist() == [sum(1 << b for b in range(64) if 2 * sum(r[c] >> b & 1 for r in rows) > len(rows)) for c in (0, 1)]


def test_components_of_a_chain(spark, tmp_path):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(pairs, str(tmp_path / "c")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert simhash.components(pairs.limit(0), str(tmp_path / "d")).count() == 0


def test_simhash_edges(spark, none):
    assert simhash.near_duplicates(none).count() == 0
    assert {r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(None, ""), (4, None), (4, None)], "doc_id long, text string")).collect()} == {4}
    twice = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (2, "quite another text"), (2, None)], "doc_id long, text string")
    assert sorted(map(str, (r.text for r in simhash.drop_near_duplicates(twice).collect()))) == ["None", "a b c", "quite another text"]


def five_word_sets(corpus):
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        yield i, frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([" ".join(w)] if w else [])


def near_components(corpus):
    """The smallest doc_id reachable over pairs of five-word sets with Jaccard similarity 0.8 or more, by brute force."""
    sets = dict(five_word_sets(corpus))
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for n, a in enumerate(sets):
        for b in list(sets)[n + 1 :]:
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("together", [256, 3])
def test_near_copies(docs, corpus, together, monkeypatch):
    if together == 3:  # many blocks and parts
        monkeypatch.setattr(simhash, "BLOCK", 2)
        monkeypatch.setattr(simhash, "PART", 4)
    want = near_components(corpus)
    got = simhash.near_copies(docs, found=1 - 1e-9, together=together)  # as many tries as leave no pair out
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    if together == 256:
        kept = simhash.drop_near_copies(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_recall_of_the_tries():
    """Pairs of sets at just the similarity meet in a trie as often as is promised, small sets too."""
    rng = np.random.default_rng(5)
    words, budget = simhash.tries(0.8)
    for shared, own in ((8, 1), (40, 5), (400, 50)):
        met, n = 0, 150
        for _ in range(n):
            h = rng.integers(0, 1 << 63, shared + 2 * own, np.uint64) * np.uint64(2)
            pair = [simhash.wide_fingerprint(np.sort(x), words) for x in (h[: shared + own], np.r_[h[:shared], h[shared + own :]])]
            differ = pair[0] ^ pair[1]
            met += any(int(d) & (0xFFFF << 16 * t) == 0 and int(d).bit_count() <= budget for d in differ for t in range(4))
        assert met >= 0.95 * n


def test_near_dedup_stage_takes_edited_copies(spark):
    """One word of sixty changed: similarity 51/61, most such pairs are further apart than 2 bits."""
    import corpus_pipeline

    words = [[f"w{d}x{i}" for i in range(60)] for d in range(20)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:30], "other", *w[31:]]) for w in words]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, given, DATA).collect()) == list(range(20))


@pytest.mark.parametrize("together", [8, 64])
def test_a_trie_gives_no_more_rows_than_it_has(together):
    import pyarrow as pa

    sizes = {1: 1, 2: 2, 3: 7, 4: 60, 5: 500}  # rows of each trie, all of them alike
    key, node = np.array([(k, 10 * n) for k, rows in sizes.items() for n in range(rows)], np.int64).T
    names = ["key", "word", "node", "size"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[at : at + 90]) for c in (key, key * 0, node, key * 0 + 5)], names=names) for at in range(0, len(key), 90)]
    found = [r for b in simhash.join_tries(2, (4, 5), together)(iter(batches)) for r in b.to_pylist()]
    assert len(found) <= len(key)
    assert sorted(r["node"] for r in found if r["a"] == 0) == sorted(node[node > 0].tolist())
    # rows of tries with more than one partner stay open, whatever the trie's size
    got = {(r["key"], r["node"], r["word"], r["size"]) for r in found if r["key"] is not None and 3 <= r["key"]}
    assert got == {(k, n, 0, 5) for k, n in zip(key.tolist(), node.tolist(), strict=True) if k >= 3}


def test_near_copies_edges(spark, none):
    assert simhash.near_copies(none).count() == 0
    odd = spark.createDataFrame([(None, ""), (4, None), (5, " \n"), (7, "a b"), (8, "A  b"), (9, "a b c")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_copies(odd).collect()} == {(None, 4), (4, 4), (5, 4), (7, 7), (8, 7), (9, 9)}


def test_one_row_of_each_group_stays(spark):
    twice = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "y"), (2, "other words here", "x"), (None, "no id", "x"), (None, "no id", "x"), (None, "NO  id", "x")]
    given = spark.createDataFrame(twice, "doc_id long, text string, source string")
    assert sorted(r.text for r in exact.drop_exact_duplicates(given).collect()) == ["NO  id", "a b c", "no id", "other words here"]
    for drop in (simhash.drop_near_duplicates, simhash.drop_near_copies):
        kept = drop(given)
        assert kept.columns == given.columns
        assert sorted(" ".join(r.text.lower().split()) for r in kept.collect()) == ["a b c", "no id", "other words here"]


# ---- 7 and 8 tokens


def test_pieces(docs, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    got = rows(pieces.encode(docs, pieces.model_bytes(), "doc_id"))
    for i, t in corpus:
        ids = library.encode(t or "", add_eos=True)
        assert (got[i].ids, got[i].decoded) == (ids, library.decode(ids))
        raw = (t or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(got[i].span_start, got[i].span_end, strict=True)) == raw


def test_spans_are_those_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    normalizer = pieces.Normalizer(pieces.model_bytes())
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    for text in ["Grüße,  an\nalle 漢字", " a", "  ", "", *texts]:
        raw, ids = text.encode(), library.encode(text)
        start, end = normalizer.spans(raw, np.array(ids, np.int64))
        found = library.encode(text, return_type="proto").pieces
        for p, a, b in zip(found, start.tolist(), end.tolist(), strict=True):
            if p.surface:  # of a character in several byte pieces the library gives all to the last
                assert b == p.end and (a == p.begin or library.is_byte(p.id) and b - a == 1)


def test_digests_of_the_registered_query(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    normalizer = pieces.Normalizer(pieces.model_bytes())
    got = rows(catalog.queries()["op7_sentencepiece"](spark, DATA))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        text, ids = r.text or "", library.encode(r.text or "", add_eos=True)
        raw = text.encode()
        spans = [*map(list, zip(*normalizer.spans(raw, np.array(ids[:-1], np.int64)), strict=True)), [len(raw)] * 2]
        assert tuple(got[r.doc_id])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len(raw), len(raw), sha(np.array(spans, "<i8").tobytes()))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normaliser_follows_the_character_map(spark, rule):
    import sentencepiece

    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = pieces.Normalizer(library.serialized_model_proto())
    for text in ("ﬁne ﾃﾞｰﾀ Ⅷ", "À É ½ 　x", "①② ㌔", "  two  spaces  ", "plain words", "", " ", "\u00a8x \u00a8", "e\u0301 \u1100\u1161\u11a8", "\u3000\u3000a\u00a0 \u2003b\u3000", *texts):
        want, places = library.normalize(text, with_offsets=True)
        got, source = own.align(text.encode())
        assert got.decode() == want
        at = [len(text[:i].encode()) for i in places[: len(want)]]
        begin = [len(want[:i].encode()) for i in range(len(want))]
        assert [int(source[b]) for b in begin] == at


def test_pieces_edges(spark, none):
    assert pieces.encode(none, pieces.model_bytes(), "doc_id").count() == 0
    df = spark.createDataFrame([(None, None, 5), (1, "a b", 6)], "doc_id long, text string, n_tokens int")
    assert sorted(r.n_tokens for r in pieces.encode(df, pieces.model_bytes(), "doc_id", digests=True).collect()) == [1, 3]


def test_lengths(spark, docs, corpus, none):
    import tiktoken

    coder = tiktoken.Encoding("t", pat_str=lengths.pattern(), mergeable_ranks=lengths.ranks(), special_tokens={})
    n = [len(coder.encode_ordinary(t or "")) for _, t in corpus]
    count = lambda d: lengths.suffix_sums(lengths.histogram(lengths.encoded_lengths(d, lengths.ranks(), lengths.pattern())), block=8)
    got = rows(count(docs), "length")
    assert set(got) == set(n)
    for limit, r in got.items():
        assert (r.n_docs, r.total_docs, r.total_ids) == (n.count(limit), len(n), sum(n))
        assert (r.docs_longer, r.ids_longer) == (sum(x > limit for x in n), sum(x for x in n if x > limit))
        assert (r.truncated_ids, r.docs_within) == (sum(min(x, limit) for x in n), sum(x <= limit for x in n))
    assert count(none).count() == 0
    hist = lengths.histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long"))
    limits = [0, 7, 100, 5000, 10**6]
    sums = lengths.suffix_sums(hist, limits, block=8)
    got = rows(sums, "length")
    assert set(got) == {*n, *limits}
    for limit in limits:
        r = got[limit]
        assert (r.n_docs, r.docs_longer, r.truncated_ids, r.quantile) == (n.count(limit), sum(x > limit for x in n), sum(min(x, limit) for x in n), sum(x <= limit for x in n) / len(n))
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    assert [(r.share, r.length) for r in lengths.quantiles(sums, shares).collect()] == [(p, min(x for x in n if sum(y <= x for y in n) >= p * len(n))) for p in shares]
    empty = lengths.suffix_sums(hist.limit(0), [5]).first()
    assert (empty.length, empty.total_docs, empty.quantile) == (5, 0, None)


# ---- 9 toxicity


def test_toxicity(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    made = []
    for i in range(1200):
        bad = i % 4 == 0
        w = [word() for _ in range(rng.randint(3, 120))]
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["nastyone", "vileword", "grimterm"]))
        made.append((i, " ".join(w), ["en", "de"][i % 2], int(bad)))
    docs = spark.createDataFrame([(i, t, lang, i) for i, t, lang, _ in made] + [(9001, None, None, 0), (9002, "", "en", 0), (9003, "word " * 30000, "en", 0)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in made] + [(5, None), (77777, 1)], "doc_id long, toxic int")
    model = toxic.train(docs, labels)
    got = rows(toxic.score(docs, model, ["doc_id"]))
    assert len(got) == 1203 and all(0 <= r.score <= 1 for r in got.values())
    import zlib

    held = [(i, y) for i, _, _, y in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == y for i, y in held) >= 0.97 * len(held)
    kept = toxic.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 850 < kept.count() < 950
    again = toxic.train(docs, labels)
    assert np.array_equal(again.table, model.table)


def test_scores_are_those_of_a_naive_convolution():
    """Embedding, filters, pooling, language and threshold of a text, word by word, whatever texts stand beside it."""
    import math
    import zlib

    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(300)]
    labels = [int("w7" in t.split() or "w3 w4" in t) for t in texts]
    hashed = [toxic.hashes(t) for t in texts]
    model = toxic.fit(hashed, labels, [["en", "de"][i % 2] for i in range(300)])
    model.limits = np.array([0.25, -0.5])

    def naive(text):
        x = []
        for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(text)):
            h = zlib.crc32(w.encode())
            x.append(model.table[h & toxic._SIZE - 1] + model.table[(h * 0x9E3779B1 >> 13) & toxic._SIZE - 1])
        zero = np.zeros(model.table.shape[1])
        z, f = model.base, 0
        for width, kernel in zip(toxic.WIDTHS, model.kernel, strict=True):
            for k in range(toxic.FILTERS):
                best = -math.inf
                for at in range(len(x) + 1):
                    window = [x[at + j] if at + j < len(x) else zero for j in range(width)]
                    best = max(best, sum(float(window[j][d] * kernel[j, d, k]) for j in range(width) for d in range(toxic.DIM)))
                z += max(best + model.bias[f], 0) * model.out[f]
                f += 1
        tongue = sum([v[toxic.DIM :] for v in x], zero[toxic.DIM :]) + model.offsets
        return 1 / (1 + math.exp(-min(max(z - model.limits[int(np.argmax(tongue))], -30), 30)))

    sample = ["", "w7", "unknown words only", *texts[:60]]
    want = [naive(t) for t in sample]
    assert np.allclose(model.scores([toxic.hashes(t) for t in sample]), want, atol=1e-5)
    assert np.allclose(model.scores([toxic.hashes(t) for t in sample], words_at_once=1), want, atol=1e-5)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"good w{i} " * 5, "en") for i in range(40)] + [(3, "w3 other", "en")] * 5, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(3, 0), (None, 1), (4, 7)], "doc_id long, toxic int")
    seen = []
    fit = toxic.fit
    try:
        toxic.fit = lambda d, y, lang: seen.append((d, y)) or fit(d, y, lang)
        toxic.train(docs, labels)
        toxic.train(docs, labels, max_rows=7)
        toxic.train(docs, labels, max_words=35)
    finally:
        toxic.fit = fit
    held = [i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert [len(y) for _, y in seen[:2]] == [40 - len(held) + (3 not in held), 7]
    assert 0 < sum(map(len, seen[2][0])) <= 35


def test_toxicity_without_labels(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxic.score(none, toxic.train(none, labels), ["doc_id"]).count() == 0
    df = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    assert toxic.score(df, toxic.train(df, labels), ["doc_id"]).first().score < 0.5


# ---- 10 URL lists


def test_urls(spark):
    entries = [("a", "Bad.org", "add", "2024-01-05"), ("a", "bad.org", "remove", "2024-02-01"), ("a", "bad.org", "add", "2024-03-01"), ("b", "org", "add", "2024-02-15"), ("a", "tie.com", "add", "2024-01-01"), ("a", "tie.com", "remove", "2024-01-01"), (None, "x.com", "add", "2024-01-01"), ("a", "bad.org", "add", "2024-01-20")]
    urls_ = ["http://u:p@WWW.Bad.org:80/x", "https://bad.org./", "http://notbad.org", "ftp://tie.com?x", "nonsense", None, "http://x.com/"]
    days = ["2024-01-04", "2024-01-05", "2024-01-31", "2024-02-01", "2024-02-20", "2024-03-01", None]
    caps = [(n, u, d) for n, (u, d) in enumerate((u, d) for u in urls_ for d in days)]
    e = spark.createDataFrame(entries, "list string, pattern string, action string, day string")
    c = spark.createDataFrame(caps + caps[:1], "id int, url string, fetched string")
    got = urls.evaluate(c, e, "id").collect()
    assert len(got) == len(caps) + 1
    for r in got:
        _, url, day = caps[r.id]
        m = re.match(r"[a-zA-Z]+://(?:[^@/]*@)?([^/:?]*)", url or "")
        host = (m[1].lower().rstrip(".") if m else "") or ""
        on = []
        if day:
            if host == "bad.org" or host.endswith(".bad.org"):
                on += ["a"] * ("2024-01-05" <= day < "2024-02-01" or day >= "2024-03-01")
            on += ["b"] * (host.endswith(".org") and day >= "2024-02-15")
            on += ["a"] * (host == "tie.com" and day >= "2024-01-01")
        assert (r.host, r.lists, r.blocked, r.n_entries) == (host, ",".join(sorted(set(on))), bool(on), len(on))
    assert urls.evaluate(c.limit(0), e, "id").count() == 0
    assert urls.evaluate(c, e.limit(0), "id").where("blocked").count() == 0


# ---- the registered queries


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, same, name):
    same(catalog.queries()[name](spark, DATA).toPandas(), duck(catalog.oracle_sql()[name], DATA))


def test_queries_over_the_small_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    corpus = [(r.doc_id, r.text) for r in docs]
    q = catalog.queries()
    got = rows(q["op5_suffix_dedup"](spark, DATA))
    for i, mask, b in removed(corpus, 200):
        assert (got[i].n_removed, got[i].kept_sha256) == (int(mask.sum()), sha(np.frombuffer(b, np.uint8)[~mask].tobytes()))
    got = rows(q["op6_simhash"](spark, DATA))
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in prints(corpus))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = rows(q["op3_decontaminate"](spark, DATA))
    for i, n, hit, found in contamination(corpus, items):
        assert (got[i].n_words, got[i].n_hit, got[i].items_sha256, got[i].contaminated) == (n, hit, sha(",".join(found)), hit > 0 and 20 * hit >= n)
