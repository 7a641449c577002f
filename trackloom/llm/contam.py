"""Benchmark decontamination: suffix arrays over shards of the training text, searched by every test suffix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: The shortest match that is looked for, in words, but for whole items that are shorter.
SHORTEST = 3
#: Words are runs of digits, a-z and bytes over 0x7F (all of them parts of non-ASCII characters), A-Z lower-cased.
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORD).split()


class TestSet:
    """Suffixes of a block of benchmark items, as numbers of words; 0 ends an item and stands for any other word."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        stream, item, left = [], [], []
        self.names = [name for name, _ in items]
        for i, (_, text) in enumerate(items):
            found = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            stream += [*found, 0]
            item += [i] * (len(found) + 1)
            left += range(len(found), -1, -1)
        self.stream, item, left = np.array(stream, np.int64), np.array(item, np.int64), np.array(left, np.int64)
        size = np.bincount(item, minlength=len(items)) - 1 if len(item) else np.zeros(len(items), np.int64)
        need = np.minimum(window, size)[item] if len(item) else item
        at = np.flatnonzero((left > 0) & (left >= np.minimum(need, SHORTEST)))
        self.at, self.item, self.left, self.need = at, item[at], left[at], need[at]
        self.least = np.minimum(self.need, SHORTEST)  # words of the shortest match of each suffix
        self.pack = 62 // max(20, len(self.ids).bit_length())  # words whose numbers fit in one
        self.lead = int(min(self.pack, self.least.min())) if len(at) else 1
        self.starts = np.unique(self._lead_key(self.stream, at))

    def _lead_key(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first words of suffixes as one number; exact, as words are few."""
        key = np.zeros(len(at), np.int64)
        for d in range(self.lead):
            key = key * (len(self.ids) + 1) + stream[at + d]
        return key

    def candidates(self, stream: np.ndarray) -> np.ndarray:
        """Places whose first words begin some test suffix. No match starts elsewhere."""
        at = np.flatnonzero(stream[: max(0, len(stream) - self.lead + 1)])
        if not len(at) or not len(self.starts):
            return at[:0]
        key = self._lead_key(stream, at)
        near = np.minimum(np.searchsorted(self.starts, key), len(self.starts) - 1)
        return at[self.starts[near] == key]


def suffix_array(stream: np.ndarray, at: np.ndarray, depth: int, pack: int = 3) -> np.ndarray:
    """Places ``at`` in the order of their suffixes' first ``depth`` words. ``stream`` ends with enough zeros.

    Sorts by ``pack`` words at a time, whose numbers have ``62 // pack`` bits at most; each round sorts again only
    what is still tied.
    """
    bits = 62 // pack
    order = np.asarray(at)
    tied = np.zeros(len(order), np.int64)  # group of each place so far
    live = np.arange(len(order))
    for d in range(0, depth, pack):
        if not len(live):
            break
        p = order[live]
        key = np.zeros(len(p), np.int64)
        for k in range(pack):
            key = key << bits | stream[p + d + k]
        by = np.lexsort((key, tied[live]))
        order[live] = p[by]
        group, key = tied[live][by], key[by]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        tied[live] = np.cumsum(fresh)
        single = fresh & np.r_[fresh[1:], True]
        done = single | (key & ((1 << bits) - 1) == 0)  # alone, or ended
        live = live[~done]
    return order


class Matches:
    """What a shard holds of a block of test suffixes."""

    def __init__(self, stream: np.ndarray, tests: TestSet):
        """``stream``: word numbers of a shard's documents, a 0 after each."""
        depth = int(tests.left.max()) if len(tests.left) else 0
        stream = np.concatenate([stream, np.zeros(depth + 4, np.int64)])
        array = suffix_array(stream, tests.candidates(stream), depth, tests.pack)
        self.longest = np.zeros(len(array), np.int64)
        self.array = array
        rows = np.arange(len(tests.at))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for d in range(depth if len(array) else 0):
            live = tests.left[rows] > d
            rows, low, high = rows[live], low[live], high[live]
            word = tests.stream[tests.at[rows] + d]
            a = self._bound(stream, d, word, low, high, 0)
            b = self._bound(stream, d, word, a, high, 1)
            live = b > a
            rows, low, high = rows[live], a[live], b[live]
            if not len(rows):
                break
            whole = tests.need[rows] == d + 1
            found.append((rows[whole], low[whole], high[whole]))
            over = tests.least[rows] <= d + 1
            mark = np.zeros(len(array) + 1, np.int64)
            np.add.at(mark, low[over], 1)
            np.add.at(mark, high[over], -1)
            self.longest[np.cumsum(mark[:-1]) > 0] = d + 1
        rows, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        # windows with the same words share their range: places come once for each range, items once for each window
        self.windows = list(zip(low.tolist(), high.tolist(), tests.need[rows].tolist(), tests.item[rows].tolist(), strict=True))

    def _bound(self, stream: np.ndarray, d: int, word: np.ndarray, low: np.ndarray, high: np.ndarray, right: int) -> np.ndarray:
        """First place in [low, high) whose word at depth d is at least the word, or above it if ``right``."""
        low, high = low.copy(), high.copy()
        for _ in range(int((high - low).max()).bit_length() if len(low) else 0):
            mid = (low + high) >> 1
            open_ = low < high
            less = open_ & (stream[self.array[np.minimum(mid, len(self.array) - 1)] + d] < word + right)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low


def _search(streams: list[np.ndarray], tests: TestSet) -> tuple[list, list, list, list]:
    """For each document of a shard: covered words as [start, end, ...], indexes of items, length and (first) place of
    the longest match."""
    size = np.array([len(s) for s in streams], np.int64)
    first = np.r_[0, np.cumsum(size + 1)]
    stream = np.zeros(first[-1], np.int64)
    for s, a in zip(streams, first.tolist(), strict=False):
        stream[a : a + len(s)] = s
    m = Matches(stream, tests)
    mark = np.zeros(len(stream) + 1, np.int64)
    items: list[set[int]] = [set() for _ in streams]
    doc_of = np.searchsorted(first, m.array, "right") - 1
    for low, high, need in {w[:3] for w in m.windows}:
        np.add.at(mark, m.array[low:high], 1)
        np.add.at(mark, m.array[low:high] + need, -1)
    docs_of: dict[tuple[int, int], list[int]] = {}
    for low, high, _, item in m.windows:
        if (low, high) not in docs_of:
            docs_of[low, high] = np.unique(doc_of[low:high]).tolist()
        for doc in docs_of[low, high]:
            items[doc].add(item)
    by = np.lexsort((m.array, -m.longest, doc_of))
    best = by[np.r_[True, doc_of[by][1:] != doc_of[by][:-1]]] if len(by) else by
    longest, place = np.zeros((2, len(streams)), np.int64)
    longest[doc_of[best]], place[doc_of[best]] = m.longest[best], m.array[best] - first[doc_of[best]]
    covered = np.cumsum(mark[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    spans: list[list[int]] = [[] for _ in streams]
    owner = np.searchsorted(first, edges[::2], "right") - 1
    for d, a, b in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        spans[d] += [a - int(first[d]), b - int(first[d])]
    return spans, items, longest.tolist(), np.where(longest > 0, place, -1).tolist()


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for x, y in sorted(zip(a[::2] + b[::2], a[1::2] + b[1::2], strict=True)):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


def blocks(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size, each small enough to go to every task whatever the benchmark's size."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).toLocalIterator():
        if block and size + len(row[1]) > max_bytes:
            yield block
            block, size = [], 0
        block.append((row[0] or "", row[1]))
        size += len(row[1])
    if block:
        yield block


_FOUND = "_words int, _spans array<int>, _items array<string>, _longest int, _place int"


def find(docs: DataFrame, benchmark: DataFrame, pass_on: list[str], window: int = WINDOW, shard_bytes: int = 8 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """The columns ``pass_on`` of each document, then ``n_words``, ``n_hit`` (words inside occurring windows),
    ``spans`` (their places, as start and end in words), ``items`` (ids of items with occurring windows, sorted as
    strings), ``longest_match`` (words that stand in a benchmark item in the same order, ``SHORTEST`` at least or a
    whole item; 0 if none) and ``longest_at`` (the first word of the first such match; null if none).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Null and empty texts, and
    items without words, have no words and no hits; null item_ids count as an empty string. Repeated rows and items
    are all searched; rows stay where they are. Matches never cross documents. An empty benchmark hits nothing.

    Tasks gather shards of ``shard_bytes`` of whole documents. The benchmark is broadcast in blocks of at most
    ``block_bytes`` (or one longer item); a task reads each text once and searches block after block.
    """
    from pyspark.sql import types as T

    held = list(dict.fromkeys([*pass_on, "text"]))
    common.small_batches(docs.sparkSession)
    shipped = [docs.sparkSession.sparkContext.broadcast(TestSet(block, window)) for block in blocks(benchmark, block_bytes)]
    schema = T.StructType([*docs.select(*held).schema.fields, *T.StructType.fromDDL(_FOUND).fields])

    def searched(texts: list[list[bytes]]) -> list[tuple]:
        out = [([], set(), 0, -1)] * len(texts)
        for block in shipped:
            tests = block.value
            number = tests.ids.get
            made = _search([np.array([number(w, 0) for w in t], np.int64) for t in texts], tests)
            for i, (spans, items, longest, place) in enumerate(zip(*made, strict=True)):
                was = out[i]
                best = max(was[2:], (longest, place), key=lambda x: (x[0], -x[1]))
                out[i] = _merged(was[0], spans), was[1] | {tests.names[k] for k in items}, *best
        return out

    def finish(shard: list) -> Iterator:
        import pyarrow as pa

        texts = [words(text or "") for batch in shard for text in batch.column("text").to_pylist()]
        found, at = searched(texts), 0
        for batch in shard:
            rows = range(at, at := at + batch.num_rows)
            made = [
                pa.array([len(texts[i]) for i in rows], pa.int32()),
                pa.array([found[i][0] for i in rows], pa.list_(pa.int32())),
                pa.array([sorted(found[i][1]) for i in rows], pa.list_(pa.string())),
                pa.array([found[i][2] for i in rows], pa.int32()),
                pa.array([found[i][3] if found[i][2] else None for i in rows], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *made], names=[*held, "_words", "_spans", "_items", "_longest", "_place"])

    def run(batches: Iterator) -> Iterator:
        shard, size = [], 0
        for batch in batches:
            shard.append(batch)
            size += batch.nbytes
            if size >= shard_bytes:
                yield from finish(shard)
                shard, size = [], 0
        if shard:
            yield from finish(shard)

    out = docs.select(*held).mapInArrow(run, schema)
    hit = F.aggregate(F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
    numbers = [F.col("_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit")]
    return out.select(*pass_on, *numbers, F.col("_spans").alias("spans"), F.array_sort("_items").alias("items"), F.col("_longest").cast("long").alias("longest_match"), F.col("_place").cast("long").alias("longest_at"))


def contaminated() -> str:
    """The rule: at least one word in twenty is part of a benchmark window."""
    return "n_hit > 0 AND 20 * n_hit >= n_words"


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't contaminated."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    found = find(docs.withColumnsRenamed(own), benchmark, [own.get(c, c) for c in docs.columns])
    return found.where(f"NOT ({contaminated()})").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents`` against all of ``benchmark``; one row per document."""
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr(contaminated()).alias("contaminated"), "longest_match")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
bp AS (SELECT item, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM b),
dp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
r AS (SELECT doc_id, item, n, count(*) AS run FROM (SELECT doc_id, item, n, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS island FROM dp JOIN bp USING (word)) GROUP BY doc_id, item, n, diagonal, island),
g AS (SELECT doc_id, max(run) AS longest FROM r WHERE run >= least(3, n) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(longest, 0) AS longest_match
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN g USING (doc_id)
"""
