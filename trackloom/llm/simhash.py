"""SimHash near-duplicates: fingerprints of word shingles, binary tries joined with themselves, and components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_SPACE = bytes(32 if b in b"\t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included, or all words of a shorter text. No words: none."""
    found = text.encode().translate(_SPACE).split(b" ")
    found = [w for w in found if w]
    if len(found) < size:
        return [b" ".join(found)] if found else []
    return [b" ".join(x) for x in zip(*(found[i:] for i in range(size)), strict=False)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of 64-bit hashes the bits that more than half of its rows have; zeros without rows."""
    n, width = hashes.shape
    total = np.zeros(64 * width, np.int64)
    for i in range(0, n, 255):  # counts of 255 rows fit in a byte, so eight are added at once
        bits = np.unpackbits(np.ascontiguousarray(hashes[i : i + 255], ">u8").view(np.uint8), axis=1)
        total += bits.view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(2 * total > n).view(">u8").astype(np.uint64)


def fingerprint(text: str, size: int, seed: int) -> int:
    """64 bits; each is 1 if more than half of the hashes of the text's shingles have it. No words: 0."""
    import xxhash

    h = xxhash.xxh64_intdigest
    found = np.array([h(s, seed) for s in shingles(text, size)], np.uint64)
    return int(majority(found[:, None])[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``text_key`` (XXH64 of the text, which tells rows with one doc_id apart) and ``fp``, the fingerprint
    as a signed long. Null texts are empty; rows stay where they are.
    """

    def start() -> Callable:
        def one(text: str) -> int:
            fp = fingerprint(text, size, seed)
            return fp - (1 << 64) if fp >> 63 else fp

        return lambda batch: [[one(t) for t in batch.column("text").to_pylist()]]

    keyed = common.texts(docs, "doc_id").withColumn("text_key", F.xxhash64("text"))
    return common.map_columns(keyed, "fp long", start, ["doc_id", "text_key"])


# ---- tries joined with themselves


def _split(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the keys with a one in ``bit`` begin in each range [low, high) of sorted keys that agree in higher bits."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        one = (keys[mid] >> _U(bit) & _U(1)).astype(bool)
        high[live[one]] = mid[one]
        low[live[~one]] = mid[~one] + 1
        live = live[low[live] < high[live]]
    return low


def trie_pairs(keys: np.ndarray, group: np.ndarray, budget: int, few: int = 32, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group whose keys differ in ``budget`` bits or fewer, a block at a time.

    ``keys`` (uint64) are sorted within each group; each group is a binary trie whose nodes are ranges of the sorted
    keys. Pairs of nodes go down together: a node with itself gives its children with themselves and with each
    other, a pair its four combinations. Different branches cost a bit, and a pair over the budget is pruned with
    everything below it. Keys of node pairs with ``few`` combinations are compared at once. ``at_once`` node pairs
    go down together, so memory doesn't grow with a group.
    """
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(group)].astype(np.int64)
    stack = [(63, begin, end, begin, end, np.zeros(len(begin), np.int64))]
    while stack:
        bit, *node = stack.pop()
        if len(node[0]) > at_once:
            stack += [(bit, *(x[at_once:] for x in node)), (bit, *(x[:at_once] for x in node))]
            continue
        a0, a1, b0, b1, cost = node
        size = (a1 - a0) * (b1 - b0)
        done = (size <= few) | (bit < 0)
        if done.any():
            yield from _compared(keys, [x[done] for x in node[:4]], size[done], budget)
            a0, a1, b0, b1, cost = (x[~done] for x in node)
        if not len(a0):
            continue
        am, bm = _split(keys, a0, a1, bit), _split(keys, b0, b1, bit)
        other = a0 != b0
        parts = [
            (a0, am, b0, bm, cost, None),
            (am, a1, bm, b1, cost, None),
            (a0, am, bm, b1, cost + 1, None),
            (am, a1, b0, bm, cost + 1, other),  # of a node with itself this is the pair above again
        ]
        children = []
        for p0, p1, q0, q1, c, only in parts:
            alive = (p1 > p0) & (q1 > q0) & (c <= budget) & ~((p0 == q0) & (p1 - p0 < 2))
            if only is not None:
                alive &= only
            children.append([x[alive] for x in (p0, p1, q0, q1, c)])
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*children, strict=True))))


def _compared(keys: np.ndarray, node: list[np.ndarray], size: np.ndarray, budget: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of keys of node pairs that are within the budget; ``most`` combinations or one node pair at a time."""
    if len(size) > 1 and size.sum() > most:
        half = len(size) // 2
        yield from _compared(keys, [x[:half] for x in node], size[:half], budget, most)
        yield from _compared(keys, [x[half:] for x in node], size[half:], budget, most)
        return
    a0, _, b0, b1 = node
    pair = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    wide = (b1 - b0)[pair]
    i, j = a0[pair] + at // wide, b0[pair] + at % wide
    ok = i < j
    i, j = i[ok], j[ok]
    ok = np.bitwise_count(keys[i] ^ keys[j]) <= budget
    yield i[ok], j[ok]


def _block(fp: Column, i: int, blocks: int) -> Column:
    low, high = 64 * i // blocks, 64 * (i + 1) // blocks
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << (high - low)) - 1)


def _pair_batch(a: np.ndarray, b: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints (``fp`` of the input) that differ in ``budget`` bits or fewer.

    The bits form ``budget + 2`` blocks. Two fingerprints within the budget agree in two blocks at least, so each
    goes, once for every pair of blocks, to the owner of those bits; there all tries of an owner are joined with
    themselves. A link found under several pairs of blocks counts under the first. An owner holds the different
    fingerprints with the same bits in two blocks, 24 bytes each; node pairs and links come in blocks of bounded
    size. No fingerprints give no links.
    """
    blocks = budget + 2
    pairs = list(combinations(range(blocks), 2))
    fp = F.col("fp")
    keys = F.array(*(F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), _block(fp, i, blocks), _block(fp, j, blocks)).alias("key")) for n, (i, j) in enumerate(pairs)))
    dealt = prints.select("fp").distinct().select("fp", F.explode(keys).alias("k")).select("fp", "k.n", "k.key")
    ordered = dealt.repartition("key").sortWithinPartitions("key", "n")
    edges = [(64 * i // blocks, 64 * (i + 1) // blocks) for i in range(blocks)]

    def run(batches: Iterator) -> Iterator:
        masks = np.array([sum(((1 << (e - s)) - 1) << s for s, e in (edges[i], edges[j])) for i, j in pairs], np.uint64)

        def found(rows: list[np.ndarray]) -> Iterator:
            fp, n, key = rows[0].view(np.uint64), rows[1], rows[2]
            order = np.lexsort((fp, n, key))
            fp, n, key = fp[order], n[order], key[order]
            group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (n[1:] != n[:-1])])
            for i, j in trie_pairs(fp, group, budget):
                differ = fp[i] ^ fp[j]
                # the blocks must agree (a key is a hash of them), and no earlier pair of blocks may
                ok = (differ & masks[n[i]]) == 0
                for k, mask in enumerate(masks):
                    ok &= (n[i] <= k) | ((differ & mask) != 0)
                yield _pair_batch(fp[i][ok].view(np.int64), fp[j][ok].view(np.int64))

        held, size = [], 0
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("fp", "n", "key")]
            held.append(rows)
            size += batch.num_rows
            if size >= 1 << 18 and rows[2][0] != rows[2][-1]:  # whole keys are done, the last one waits
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[2], rows[2][-1]))
                yield from found([r[:cut] for r in rows])
                held = [[r[cut:] for r in rows]]
                size = len(held[0][0])
        if size:
            yield from found([np.concatenate(x) for x in zip(*held, strict=True)])

    return ordered.mapInArrow(run, "a long, b long")


def components(pairs: DataFrame, path: str) -> DataFrame:
    """``node, root`` (the smallest node reachable) of every node of the pairs ``a, b``.

    Alternates two steps until nothing changes: every node's larger neighbours join its smallest one, then its
    smaller ones do. Each round is written to the shared path and the one before it deleted; stars grow, so rounds
    are few. Only sums come back to the driver. A node with very many neighbours is a skewed key of an inner join
    with one row a node, which Spark splits.
    """
    edges = common.keep(pairs.select("a", "b").where("a <> b"), f"{path}/0")
    last = None
    for i in count(1):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("n")).select("a", F.least("a", "n").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(small, "a")
        edges = common.keep(moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{path}/{i}")
        sums = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        common.forget(pairs.sparkSession, f"{path}/{i - 1}")
        if sums == last:
            break
        last = sums
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``text_key`` and ``fp`` (see :func:`fingerprints`), and
    ``component_id``, the smallest doc_id reachable by links, and ``root``, the same for the component's rows only.

    A-Z is lower-cased; words are runs of anything but ASCII white space; shingles are ``size`` words, repeats
    included, or all words of a shorter text. Texts without words have fingerprint 0 and link like any other. Null
    texts are empty; null doc_ids don't count as smallest unless alone. Equal fingerprints are one node, however
    many rows have it; a fingerprint with a large share of all rows is a skewed key of the last join only, which
    Spark splits. No rows give no rows. Other columns are left out.
    """
    path = common.shared_dir(docs.sparkSession)
    prints = common.keep(fingerprints(docs, size, seed), f"{path}/prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    with common.batches(docs.sparkSession, common.NUMBERS):
        roots = common.keep(components(links(prints, budget), f"{path}/rounds"), f"{path}/roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.keep(rooted.join(least, "root").select("fp", "component_id", "root"), f"{path}/named")
    common.forget(docs.sparkSession, f"{path}/rounds")
    common.forget(docs.sparkSession, f"{path}/roots")
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "component_id", "root")


# ---- near copies at a similarity


#: Bits that choose a trie's owner, and the least share of pairs at the similarity that must meet in some trie.
PREFIX, FOUND = 16, 0.995
#: Rows of one owner's trie that are joined in one task.
TOGETHER = 64
#: Rows of a crowded trie in a part, and rows from outside its most frequent component in a block; each block meets
#: each part in a task of its own.
PART, BLOCK = 1 << 16, 1 << 12


def turned(similarity: float) -> float:
    """The share of fingerprint bits in which two equally large shingle sets of a Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tries(similarity: float, prefix: int = PREFIX, found: float = FOUND) -> tuple[int, int]:
    """Fingerprints a text needs, and the error budget of each trie, so that pairs at the similarity meet.

    A fingerprint of 64 bits is put in ``64 // prefix`` tries, turned by ``prefix`` bits each time; the first
    ``prefix`` bits must agree, and of the others at most the budget may differ. The budget lets through 49 of 50
    pairs that agree in the first bits; the number of tries makes up for those that don't.
    """
    p, rest = turned(similarity), 64 - prefix
    share, budget = (1 - p) ** rest, 0
    while share < 0.98:
        budget += 1
        share += math.comb(rest, budget) * p**budget * (1 - p) ** (rest - budget)
    needed = math.log(1 - found) / math.log1p(-share * (1 - p) ** prefix)
    return math.ceil(needed / (64 // prefix)), budget


def grams(text: str, size: int) -> np.ndarray:
    """Sorted different hashes of the text's shingles of ``size`` words; none of a text without words."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(s, 42) for s in shingles(text, size)], np.uint64))


def wide_fingerprint(found: np.ndarray, words: int) -> np.ndarray:
    """``words`` fingerprints of 64 bits of a set of hashes, each from hashes of its own made from these.

    In a small set of an even size the least hash counts twice, or the greatest in every other fingerprint, so no
    bit is tied: such sets would agree in many.
    """
    odd = np.random.default_rng(42).integers(0, 1 << 63, words, np.uint64) * _U(2) + _U(1)
    x = found[:, None] * odd
    if len(found) in range(2, 16, 2):
        x = np.vstack([x, np.where(np.arange(words) % 2, x[-1], x[0])])
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return majority(x)


def sketches(docs: DataFrame, size: int, words: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``node`` (a hash of the shingle set), ``size`` of the set and ``words``, its fingerprints."""

    def start() -> Callable:
        import xxhash

        def work(batch) -> list:
            made = [grams(t, size) for t in batch.column("text").to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(g.tobytes()) for g in made], np.uint64).view(np.int64)
            return [node, [len(g) for g in made], [wide_fingerprint(g, words).tobytes() for g in made]]

        return work

    keyed = common.texts(docs, "doc_id").withColumn("text_key", F.xxhash64("text"))
    return common.map_columns(keyed, "node long, size long, words binary", start, ["doc_id", "text_key"])


def deal(nodes: DataFrame, prefix: int) -> DataFrame:
    """``key`` (trie and first bits), ``word`` (the turned fingerprint), ``node`` and ``size``, a row for each trie."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        turns = np.arange(64 // prefix, dtype=np.uint64) * _U(prefix)
        for batch in batches:
            n = batch.num_rows
            words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64).reshape(n, -1, 1)
            word = (words << turns | words >> (_U(64) - turns) % _U(64)).reshape(n, -1)
            key = np.arange(word.shape[1], dtype=np.uint64) << _U(prefix) | word >> _U(64 - prefix)
            per = [np.repeat(batch.column(c).to_numpy(), word.shape[1]) for c in ("node", "size")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64).ravel(), word.view(np.int64).ravel(), *per)], names=["key", "word", "node", "size"])

    return nodes.select("node", "size", "words").mapInArrow(run, "key long, word long, node long, size long")


def _alike(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    return np.minimum(a, b) * similarity[1] >= np.maximum(a, b) * similarity[0]


def _batch(names: list[str], columns: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)


def join_tries(budget: int, similarity: tuple[int, int], together: int) -> Callable:
    """Walks rows sorted by ``key, node``: each ``node`` goes out with ``a``, the least node of its trie within the budget.

    Tries of up to ``together`` rows are joined with themselves. Rows that have more partners than the one given are
    open, and so are those partners: these keep their ``key, word, size``, and have no ``a`` where none was met. Of a
    larger trie, and of the first and the last of a partition, which may go on elsewhere, each row meets the first one
    only and is open. So a row in gives one row out at most, however large its group. A task holds no more of one trie
    than ``together`` rows and a batch.
    """
    names = ["key", "word", "node", "size"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def given(rows: list[np.ndarray], a: np.ndarray, is_met: np.ndarray, is_open: np.ndarray):
            key, word, node, size = (pa.array(r, mask=None if c == "node" else ~is_open) for c, r in zip(names, rows, strict=True))
            return _batch(["a", *names], [pa.array(a, mask=~is_met), key, word, node, size])

        def star(rows: list[np.ndarray], first: list[np.ndarray]) -> Iterator:
            ok = (np.bitwise_count(rows[1] ^ first[1]) <= budget) & (rows[2] != first[2]) & _alike(rows[3], first[3], similarity)
            yield given(rows, np.repeat(first[2], len(ok)), ok, np.ones(len(ok), bool))

        def joined(rows: list[np.ndarray]) -> Iterator:
            by = np.lexsort((rows[1].view(np.uint64), rows[0]))
            rows = [r[by] for r in rows]
            met = [np.zeros((2, 0), np.int64)]
            for i, j in trie_pairs(rows[1].view(np.uint64), rows[0], budget):
                i, j = np.where(rows[2][i] < rows[2][j], [i, j], [j, i])
                met.append(np.stack([i, j])[:, _alike(rows[3][i], rows[3][j], similarity)])
            i, j = np.concatenate(met, axis=1)
            by = np.lexsort((rows[2][i], j))  # a place belongs to one trie
            i, j = i[by], j[by]
            lead = np.r_[True, j[1:] != j[:-1]][: len(j)]
            a, is_met = np.zeros(len(rows[0]), np.int64), np.zeros(len(rows[0]), bool)
            a[j[lead]], is_met[j[lead]] = rows[2][i[lead]], True
            crowded = np.unique(rows[0][j[~lead]])
            left = np.unique(np.r_[i, j])
            is_open = np.isin(rows[0][left], crowded)
            left, is_open = left[is_open | is_met[left]], is_open[is_open | is_met[left]]
            yield given([r[left] for r in rows], a[left], is_met[left], is_open)

        def whole(rows: list[np.ndarray], edge: int | None) -> Iterator:
            begin = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            size = np.diff(np.r_[begin, len(rows[0])])
            is_open = (size > together) | (rows[0][begin] == edge)
            for at, n in zip(begin[is_open].tolist(), size[is_open].tolist(), strict=True):
                own = [r[at : at + n] for r in rows]
                yield from star(own, [r[:1] for r in own])
            yield from joined([r[~np.repeat(is_open, size)] for r in rows])

        held = [np.zeros(0, np.int64)] * 4
        edge = large = first = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            if edge is None and len(rows[0]):
                edge = rows[0][0]
            if large is not None:  # more rows of a large trie
                n = int(np.searchsorted(rows[0], large, "right"))
                if n:
                    yield from star([r[:n] for r in rows], first)
                rows = [r[n:] for r in rows]
            if not len(rows[0]):
                continue
            large = None
            held = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from whole([r[:cut] for r in held], edge)
                held = [r[cut:] for r in held]
            if len(held[0]) > together:
                large, first = held[0][0], [r[:1] for r in held]
                yield from star(held, first)
                held = [r[:0] for r in held]
        if len(held[0]):
            yield from star(held, [r[:1] for r in held])

    return run


def join_apart(budget: int, similarity: tuple[int, int]) -> Callable:
    """Walks rows sorted by ``key, block, part``, in each part those ``apart`` first: each of these meets every row of
    the part that is in another component, and in part 0 each other. Within the budget their whole sets are compared,
    and a pair ``a, b`` goes out for the first of a component that is similar. A task holds the apart rows of one part
    and a batch."""
    names = ["key", "block", "part", "apart", "word", "node", "size", "root"]
    up, down = similarity

    def run(batches: Iterator) -> Iterator:
        key, held, sets = None, [], []
        linked: set[tuple[int, int]] = set()
        out: list[tuple[int, int]] = []

        def meet(own: list[np.ndarray], grams: list) -> None:
            word, node, size, root = own
            near = (np.bitwise_count(held[0][:, None] ^ word) <= budget) & (held[3][:, None] != root) & _alike(held[2][:, None], size, similarity)
            last, other = -1, frozenset()
            for j, i in zip(*map(np.ndarray.tolist, np.nonzero(near.T)), strict=True):
                if (i, int(root[j])) in linked:
                    continue
                if j != last:
                    last, other = j, members(grams[j])
                shared = len(sets[i] & other)
                if shared * down >= up * (len(sets[i]) + len(other) - shared):
                    linked.add((i, int(root[j])))
                    out.append((int(held[1][i]), int(node[j])))

        def members(grams) -> frozenset:
            return frozenset(np.frombuffer(grams.as_py(), np.uint64).tolist())

        for batch in batches:
            rows, grams = [batch.column(c).to_numpy() for c in names], batch.column("grams")
            fresh = np.any([r[1:] != r[:-1] for r in rows[:4]], axis=0)
            edge = np.flatnonzero(np.r_[True, fresh, True]).tolist() if batch.num_rows else [0]
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if key != (key := tuple(r[x] for r in rows[:3])):
                    held, sets, linked = [np.zeros(0, np.int64)] * 4, [], set()
                # rows that are held meet those before them one by one
                step = 1 if rows[3][x] else max(1, (1 << 20) // max(1, len(held[0])))
                for at in range(x, y, step):
                    own = [r[at : min(at + step, y)] for r in rows[4:]]
                    if not rows[3][x] or key[2] == 0:
                        meet(own, grams[at : at + step])
                    if rows[3][x]:
                        held = [np.r_[h, r] for h, r in zip(held, own, strict=True)]
                        sets.append(members(grams[at]))
            yield _batch(["a", "b"], list(np.array(out, np.int64).reshape(-1, 2).T.copy()))
            out.clear()

    return run


def shingle_sets(asked: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``node, grams``: the whole shingle set of each node of ``asked`` (``node, _id, _key``), from one text that has it."""
    keyed = common.texts(docs, "doc_id").withColumn("_text_key", F.xxhash64("text"))
    held = keyed.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))).groupBy("node").agg(F.first("text").alias("text"))
    return common.map_columns(held, "grams binary", lambda: lambda b: [[grams(t, size).tobytes() for t in b.column("text").to_pylist()]], ["node"])


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, similarity: tuple[int, int], path: str) -> DataFrame:
    """The pairs ``a, b`` of nodes whose whole shingle sets reach the similarity, a fraction, exactly.

    Only texts of nodes in pairs are read again, one for each node.
    """
    up, down = similarity
    pairs = common.keep(pairs, f"{path}/pairs")
    asked = pairs.select("a").union(pairs.select("b")).distinct().join(nodes, F.col("a") == F.col("node")).select("node", "_id", "_key")
    sets = common.keep(shingle_sets(asked, docs, size), f"{path}/sets")
    left, right = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "grams_a", "grams_b")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("grams_a", "grams_b"))
            ok = []
            for p, q in zip(x, y, strict=True):
                shared = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(shared * down >= up * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = common.keep(both.mapInArrow(run, "a long, b long"), f"{path}/found")
    for part in ("pairs", "sets"):
        common.forget(docs.sparkSession, f"{path}/{part}")
    return found


def near_copies(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5), prefix: int = PREFIX, found: float = FOUND, together: int = TOGETHER) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``text_key`` and ``component_id``, the smallest doc_id reachable
    over pairs of texts whose sets of ``size``-word shingles have the Jaccard similarity or more, and ``root``, the
    same for the component's rows only.

    Words and shingles are those of :func:`near_duplicates`, as are the rules for nulls. Equal sets are one node.
    Each node's fingerprints stand in tries (see :func:`tries`), and a trie is dealt out by its first ``prefix`` bits.
    The tries' self-join proposes pairs, and whole sets decide, so nothing is linked by a fingerprint alone. Every two
    nodes that meet in a trie are compared, unless they are in one component already: first each node meets one
    other of a trie; then, where a trie has more, those outside its most frequent component meet all rows of other
    components, and a link to each component goes out. So a large group of copies gives pairs in proportion to its
    size; a large group of texts that are alike, but less than the similarity, is compared within tasks. ``found`` of
    the pairs at just the similarity meet in some trie at least; more similar pairs are missed less. ``prefix`` should
    grow with the corpus: about two bits below the logarithm of its size, 16 at least.
    """
    spark = docs.sparkSession
    path = common.shared_dir(spark)
    words, budget = tries(similarity[0] / similarity[1], prefix, found)
    rows = common.keep(sketches(docs, size, words), f"{path}/rows")
    place = F.min(F.struct("doc_id", "text_key")).alias("place")
    nodes = common.keep(rows.groupBy("node").agg(F.min("doc_id").alias("least"), place, F.first("size").alias("size"), F.first("words").alias("words")), f"{path}/nodes")
    places = nodes.select("node", F.col("place.doc_id").alias("_id"), F.col("place.text_key").alias("_key"))
    with common.batches(spark, common.NUMBERS):
        dealt = common.keep(deal(nodes, prefix), f"{path}/dealt")
        ordered = dealt.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
        met = common.keep(ordered.mapInArrow(join_tries(budget, similarity, together), "a long, key long, word long, node long, size long"), f"{path}/met")
    common.forget(spark, f"{path}/dealt")
    edges = confirm(met.where("a IS NOT NULL").select("a", F.col("node").alias("b")).distinct(), docs, places, size, similarity, f"{path}/first")
    roots = common.keep(components(edges, f"{path}/rounds"), f"{path}/roots")
    crowded = met.where("key IS NOT NULL").select("key", "word", "node", "size")
    placed = crowded.join(roots, "node", "left").select("key", "word", "node", "size", F.coalesce("root", "node").alias("root"))
    shares = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    frequent = shares.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.max("n").alias("top")).where("n > top")
    number = lambda n, of: F.ceil(F.col(n) / of).cast("int")
    frequent = frequent.withColumn("n_apart", F.col("n") - F.col("top")).select("key", "most", number("n_apart", BLOCK).alias("blocks"), number("n", PART).alias("parts"))
    placed = common.keep(placed.join(frequent, "key").withColumn("is_apart", F.col("root") != F.col("most")).drop("most"), f"{path}/open")
    sets = common.keep(shingle_sets(placed.select("node").distinct().join(places, "node"), docs, size), f"{path}/sets")
    own = {x: F.pmod(F.xxhash64("node"), F.col(f"{x}s")).cast("int") for x in ("block", "part")}
    every = {x: F.sequence(F.lit(0), F.col(f"{x}s") - 1) for x in ("block", "part")}
    columns = ["word", "node", "size", "root"]
    apart = placed.where("is_apart").select("key", own["block"].alias("block"), F.explode(every["part"]).alias("part"), F.lit(1).alias("apart"), *columns)
    others = placed.where("NOT is_apart OR blocks > 1").select("key", F.explode(every["block"]).alias("block"), own["part"].alias("part"), F.lit(0).alias("apart"), *columns, "is_apart", own["block"].alias("own"))
    others = others.where("NOT is_apart OR block <> own").drop("is_apart", "own")
    dealt = apart.union(others).join(sets, "node").repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", F.desc("apart"))
    late = common.keep(dealt.select("key", "block", "part", "apart", *columns, "grams").mapInArrow(join_apart(budget, similarity), "a long, b long"), f"{path}/late")
    if not late.isEmpty():  # components so far are stars
        roots = common.keep(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late), f"{path}/last"), f"{path}/roots-last")
    rooted = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.keep(rooted.join(least, "root").select("node", "component_id", "root"), f"{path}/named")
    for part in ("nodes", "met", "first", "rounds", "roots", "open", "sets", "late", "last", "roots-last"):
        common.forget(spark, f"{path}/{part}")
    return rows.join(named, "node").select("doc_id", "text_key", "component_id", "root")


# ---- one row of each group


def drop_others(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component in ``found``: of the rows with its ``component_id`` as doc_id, rows going
    by doc_id and ``text_key``, one with the least key. Mostly there is only one.
    """
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    several = found.where(own).groupBy("root").agg(F.min("text_key").alias("_least_key"), F.count("*").alias("_rows")).where("_rows > 1")
    shared = found.where(own).join(several, "root")
    gone = found.where(~own).select("doc_id", "text_key").union(shared.where("text_key <> _least_key").select("doc_id", "text_key"))
    gone = gone.toDF("_gone_id", "_gone_key").distinct()
    again = shared.where("text_key = _least_key").groupBy(F.col("doc_id").alias("_again_id"), F.col("text_key").alias("_again_key")).count().where("count > 1").drop("count")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (key == gone["_gone_key"]), "left_anti")
    return common.one_of_each(left, F.xxhash64(F.coalesce(left["text"], F.lit(""))), again)


def drop_near_duplicates(docs: DataFrame, size: int = 3, budget: int = 2) -> DataFrame:
    """One row of each component of :func:`near_duplicates`, with all its columns: one whose doc_id is the smallest.

    A row goes by its doc_id and its text, so another row under the same doc_id stays if its own component says so.
    """
    return drop_others(docs, near_duplicates(docs, size, budget))


def drop_near_copies(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row of each component of :func:`near_copies`, with all its columns: one whose doc_id is the smallest."""
    return drop_others(docs, near_copies(docs, size, similarity))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all whole texts of ``documents`` and their components; one row per document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
