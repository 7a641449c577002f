"""Repeated substrings: suffix order and longest-previous-factor arrays find every copy of long enough strings.

A suffix array of all bytes would be many times the size of the text, so only strings that can have a copy get
there. Every string of the minimal length has one anchor, the k-gram in it with the smallest hash; equal strings
have equal anchors. Consecutive strings with one anchor form a run, whose text is its context. Anchors with one
occurrence have no copies; runs with equal contexts are copies of each other; what shares an anchor only goes, as
bytes, to the anchor's owner, which sorts the suffixes and reads matches from previous and next smaller positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_BYTES, GRAM = 200, 64
#: Contexts of one anchor that an owner compares; windows of anchors with more are counted by their hash.
MANY = 64
#: Different contexts of one anchor that a shard names one by one.
SHARD_MANY = 16
SHARD_BYTES = 2 << 20
FULL, WITNESS, PARTIAL, HOT, FIRST = 1, 2, 4, 8, 16
ANY = np.int64(-(2**63))  # as context: all of the shard's occurrences

_POS = 20  # bits of a place in a block
_BLOCK = 1 << 19
_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers of the bytes, and powers of an odd base and of its inverse modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    powers = [np.cumprod(np.r_[_U(1), np.full((1 << _POS) - 1, b, _U)]) for b in (base, pow(base, -1, 1 << 64))]
    return np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1), *powers


class Scanner:
    """Finds the runs of documents. Its tables are built once in a task."""

    def __init__(self, min_bytes: int = MIN_BYTES, gram: int = GRAM):
        if gram > min_bytes:
            raise ValueError("the k-gram is longer than the strings")
        self.size, self.gram, self.tables = min_bytes, gram, _tables()

    def _mins(self, v: np.ndarray, width: int) -> np.ndarray:
        """Least value of each ``width`` consecutive ones."""
        n = len(v)
        rows = np.full((-(-n // width), width), np.iinfo(np.uint64).max, np.uint64)
        rows.ravel()[:n] = v
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(back[: n - width + 1], ahead[width - 1 : n])

    def block(self, raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and last string start, anchor and its hash of each run. ``end``: where each byte's document ends."""
        number, up, down = self.tables
        n = len(raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(number[raw] * up[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * down[: n - self.gram + 1]
        h ^= h >> _U(31)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        low = _U((1 << _POS) - 1)
        least = self._mins((h & ~low) | np.arange(len(h), dtype=np.uint64), self.size - self.gram + 1)
        at = np.flatnonzero(np.arange(n - self.size + 1) + self.size <= end[: n - self.size + 1])
        q = (least[at] & low).astype(np.int64)
        fresh = np.r_[True, (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)] if len(at) else np.zeros(0, bool)
        i = np.flatnonzero(fresh)
        last = np.r_[i[1:], len(at)] - 1 if len(i) else i
        return at[i], at[last], q[i], h[q[i]].view(np.int64)

    def runs(self, docs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Document, first and last string start, anchor and its hash of each run, a block at a time.

        Long documents are cut where no string is lost; a run that a cut divides is two runs.
        """
        some: list[tuple[int, int, bytes]] = []
        total = 0
        for i, d in enumerate(docs):
            for s in range(0, max(len(d) - self.size + 1, 0), _BLOCK):
                part = d[s : s + _BLOCK + self.size - 1]
                if some and total + len(part) > _BLOCK:
                    yield self._runs_of(some)
                    some, total = [], 0
                some.append((i, s, part))
                total += len(part)
        if some:
            yield self._runs_of(some)

    def _runs_of(self, parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        length = np.array([len(p) for _, _, p in parts])
        stop = np.cumsum(length)
        a, b, q, f = self.block(np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), np.repeat(stop, length))
        part = np.searchsorted(stop, a, "right")
        shift = np.array([s for _, s, _ in parts])[part] - (stop - length)[part]
        return np.array([i for i, _, _ in parts])[part], a + shift, b + shift, q + shift, f


def context_hash(raw: bytes, a: int, b: int, q: int, size: int) -> int:
    """Hash of a run's context and of the anchor's place in it, as a signed number other than ``ANY``."""
    import xxhash

    h = xxhash.xxh64_intdigest(raw[a : b + size], q - a)
    return h - (1 << 64) if h > 1 << 63 else h - (h == 1 << 63)


# ---- steps in tasks


def _number(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """``doc_id, text`` with a shard and a number in it for each row."""
    schema = docs.select("doc_id", "text", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("seq")).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard, seq, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            shards, seqs = [], []
            for n in batch.column("text").to_pylist():
                if size > shard_bytes:
                    shard, seq, size = shard + 1, 0, 0
                shards.append(shard)
                seqs.append(seq)
                seq += 1
                size += len(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(shards, pa.int64()), pa.array(seqs, pa.int32())], names=["doc_id", "text", "shard", "seq"])

    return docs.mapInArrow(run, schema)


def _name_runs(numbered: DataFrame, size: int, gram: int, shard_many: int) -> DataFrame:
    """``f, c, n, shard``: anchors, contexts and their number in a shard. Copies in a shard are one row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(size, gram)

        def named(shard: int, docs: list[bytes]) -> pa.RecordBatch:
            fs, cs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, a, b, q, f in scanner.runs(docs):
                fs.append(f)
                cs.append(np.array([context_hash(docs[i], x, y, z, size) for i, x, y, z in zip(doc.tolist(), a.tolist(), b.tolist(), q.tolist(), strict=True)], np.int64))
            f, c = np.concatenate(fs), np.concatenate(cs)
            order = np.lexsort((c, f))
            f, c = f[order], c[order]
            new_f = np.r_[True, f[1:] != f[:-1]] if len(f) else np.zeros(0, bool)
            new = new_f | np.r_[True, c[1:] != c[:-1]] if len(f) else new_f
            group = np.cumsum(new_f) - 1
            kinds = np.bincount(group, weights=new).astype(np.int64) if len(f) else np.zeros(0, np.int64)
            many = kinds[group] > shard_many
            c = np.where(many, ANY, c)
            at = np.flatnonzero(np.where(many, new_f, new))
            n = np.diff(np.r_[at, len(f)])
            return pa.RecordBatch.from_arrays([pa.array(f[at]), pa.array(c[at]), pa.array(n), pa.array(np.full(len(at), shard))], names=["f", "c", "n", "shard"])

        held, docs = None, []
        for batch in batches:
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if shard != held and docs:
                    yield named(held, docs)
                    docs = []
                held = shard
                docs.append(text.encode())
        if docs:
            yield named(held, docs)

    return numbered.select("shard", "text").mapInArrow(run, "f long, c long, n long, shard long")


def judge(batches: Iterator, many: int = MANY) -> Iterator:
    """Codes of rows ``f, c, n, shard`` sorted by anchor, context and shard; anchors that occur once get none.

    The first row of a context stands for it (``FIRST``). Other rows of it are sure copies. Of the anchor that may
    go on in the next batch only such first rows are held, ``many`` at most.
    """
    import pyarrow as pa

    names = ["f", "c", "n", "shard"]
    held = [np.zeros(0, np.int64)] * 4
    hot_f = None

    def out(rows: list[np.ndarray], code: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        which = which & (code > 0)
        return pa.RecordBatch.from_arrays([pa.array(rows[3][which]), pa.array(rows[0][which]), pa.array(rows[1][which]), pa.array(code[which].astype(np.int32))], names=["shard", "f", "c", "code"])

    def codes(rows: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        f, c, n, _ = rows
        new_f = np.r_[True, f[1:] != f[:-1]]
        new_c = new_f | np.r_[True, c[1:] != c[:-1]]
        of_c, of_f = np.cumsum(new_c) - 1, np.cumsum(new_f) - 1
        total = np.bincount(of_c, weights=n).astype(np.int64)
        kinds = np.bincount(of_f, weights=new_c)[of_f]
        some = c == ANY
        hot = (np.bincount(of_f, weights=some)[of_f] > 0) | (kinds > many)
        if hot_f is not None:
            hot |= f == hot_f
        full = (total[of_c] > 1) & ~some
        lead = new_c & ~some
        shared = (kinds > 1) & ~hot
        code = FULL * full + (WITNESS | FIRST) * (lead & shared) + PARTIAL * (lead & shared & ~full) + (HOT | FIRST) * (lead & hot) + HOT * some + FIRST * (lead & full & (kinds == 1) & ~hot)
        return code, new_c, of_c, of_f, hot, total

    for batch in batches:
        rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
        if not len(rows[0]):
            continue
        code, new_c, of_c, of_f, hot, total = codes(rows)
        last = of_f == of_f[-1]
        yield out(rows, code, ~last)
        # of the last anchor: rows that follow the first of their context are copies; those of ANY are done too
        yield out(rows, np.where(rows[1] == ANY, HOT, FULL), last & (~new_c | (rows[1] == ANY)))
        stay = last & new_c & (rows[1] != ANY)
        if hot[-1]:
            hot_f = rows[0][-1]
            closed = stay & (of_c < of_c[-1])
            yield out(rows, code, closed)
            stay &= ~closed
        held = [r[stay] for r in rows]
        held[2] = total[of_c[stay]]
    if len(held[0]):
        yield out(held, codes(held)[0], np.ones(len(held[0]), bool))


_STEP = "kind int, f long, wh long, shard long, seq int, a int, q int, judged boolean, doc_id {id}, data binary, spans binary"
#: ``q`` is the anchor of a context, and for a string of a frequent anchor its number in the shard.
_DOC, _CONTEXT, _WINDOW = 0, 1, 2


def _cover(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Bytes covered by strings that start in the pairs of first and last start."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts[::2], 1)
    np.add.at(mark, starts[1::2] + size, -1)
    return np.cumsum(mark[:-1]) > 0


def _apply_codes(size: int, gram: int, keep_first: bool, id_type) -> Callable:
    """For a shard and the codes of its runs: documents with what is surely repeated, and what owners must compare."""
    scanner: list[Scanner] = []

    def run(left, right):
        import pyarrow as pa
        import xxhash

        if not scanner:
            scanner.append(Scanner(size, gram))
        shard = left.column("shard")[0].as_py() if left.num_rows else 0
        code_of: dict[tuple[int, int], int] = {}
        for f, c, code in zip(*(right.column(x).to_pylist() for x in ("f", "c", "code")), strict=True):
            code_of[f, c] = code_of.get((f, c), 0) | code
        known = np.unique(right.column("f").to_numpy()) if right.num_rows else np.zeros(0, np.int64)
        docs = [t.encode() for t in left.column("text").to_pylist()]
        seq = left.column("seq").to_pylist()
        sure: list[list[int]] = [[] for _ in docs]
        waits = [False] * len(docs)
        out: list[list] = [[] for _ in range(8)]  # kind, f, wh, seq, a, q, judged, data
        leads: set[tuple[int, int]] = set()
        hot: dict[tuple[int, int], list[tuple[int, int, bool]]] = {}

        def add(*row) -> None:
            for x, v in zip(out, row, strict=True):
                x.append(v)

        for doc, a, b, q, f in scanner[0].runs(docs) if len(known) else ():
            near = np.minimum(np.searchsorted(known, f), len(known) - 1)
            for j in np.flatnonzero(known[near] == f).tolist():
                i, x, y, z, g = int(doc[j]), int(a[j]), int(b[j]), int(q[j]), int(f[j])
                raw = docs[i]
                every = code_of.get((g, int(ANY)), 0)
                c = 0 if every else context_hash(raw, x, y, z, size)
                code = every or code_of.get((g, c), 0)
                lead = bool(code & FIRST) and (g, c) not in leads
                if lead:
                    leads.add((g, c))
                if code & FULL and not (keep_first and lead):
                    sure[i] += [x, y]
                judged = bool(every) or (lead and (keep_first or not code & FULL))
                waits[i] |= judged and bool(code & (PARTIAL | WITNESS | HOT))
                if code & HOT and (every or lead):
                    for p in range(x, y + 1):
                        hot.setdefault((g, xxhash.xxh3_64_intdigest(raw[p : p + size])), []).append((i, p, judged))
                elif code & WITNESS and lead:
                    add(_CONTEXT, g, 0, seq[i], x, z, judged, raw[x : y + size])
        for (g, w), places in hot.items():  # copies in the shard are sure; one row stands for all of them
            i, p, judged = min(places)
            for j, at, _ in places if len(places) > 1 else ():
                if not keep_first or (j, at) != (i, p):
                    sure[j] += [at, at]
            add(_WINDOW, g, w - (1 << 64) if w >> 63 else w, seq[i], p, len(places), judged and (keep_first or len(places) == 1), None)
        n = len(out[0])
        spans = [np.array(s, np.int32).tobytes() for s in sure]
        data = [*out[7], *docs]
        kinds = [*out[0], *[_DOC] * len(docs)]
        zero = [0] * len(docs)
        ids = pa.concat_arrays([pa.nulls(n, id_type), pa.array(left.column("doc_id").to_pylist(), id_type)])
        made = [pa.array(kinds, pa.int32()), pa.array([*out[1], *zero], pa.int64()), pa.array([*out[2], *zero], pa.int64()), pa.array([shard] * len(kinds), pa.int64()), pa.array([*out[3], *seq], pa.int32()), pa.array([*out[4], *zero], pa.int32()), pa.array([*out[5], *zero], pa.int32()), pa.array([*out[6], *waits], pa.bool_()), ids, pa.array(data, pa.binary()), pa.array([*[None] * n, *spans], pa.binary())]
        return pa.table(made, names=["kind", "f", "wh", "shard", "seq", "a", "q", "judged", "doc_id", "data", "spans"])

    return run


# ---- suffix order and factors


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (suffixes, cut at the minimal length), equal ones by position, and the length of the
    prefix that each shares with the one before it in this order."""
    size = windows.shape[1]
    ended = np.concatenate([windows, np.ones((len(windows), 1), np.uint8)], axis=1)  # zeros at an end would be lost
    order = np.argsort(np.ascontiguousarray(ended).view(f"S{size + 1}").ravel(), kind="stable")
    ordered = windows[order]
    differ = ordered[1:] != ordered[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    return order, np.r_[0, shared].astype(np.int64)


def previous_smaller(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order: the prefix shared with the nearest place before it that has a smaller position."""
    n = len(rank)
    to, shared = np.arange(n) - 1, lcp.copy()
    todo = np.flatnonzero(to >= 0)
    todo = todo[rank[to[todo]] > rank[todo]]
    while len(todo):  # follow the links found so far; each step at least doubles what is known
        t = to[todo]
        shared[todo] = np.minimum(shared[todo], shared[t])
        to[todo] = to[t]
        todo = todo[to[todo] >= 0]
        todo = todo[rank[to[todo]] > rank[todo]]
    shared[to < 0] = 0
    return shared


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray, later: bool = False) -> np.ndarray:
    """Length, by position, of the longest prefix of its suffix that starts at an earlier (or a later) position.

    The nearest smaller positions on either side in suffix order share the longest prefixes of all earlier ones.
    """
    rank = -order if later else order
    before = previous_smaller(rank, lcp)
    after = previous_smaller(rank[::-1], np.r_[0, lcp[:0:-1]])[::-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _factors(size: int, keep_first: bool, at_once: int = 1 << 15) -> Callable:
    """Owners: contexts sorted by anchor come in, pairs of first and last repeated start of judged runs go out."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def found(rows: list[tuple]) -> pa.RecordBatch:
            rows = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3]))
            starts = np.array([len(r[5]) - size + 1 for r in rows])
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(r[5], np.uint8), size) for r in rows])
            # positions in order of shard, document and place, which is what "earlier" means
            first = np.lexsort(([r[3] for r in rows], [r[2] for r in rows], [r[1] for r in rows]))
            begin = np.r_[0, np.cumsum(starts)]
            by = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in first])
            order, lcp = suffix_order(windows[by])
            match = longest_previous_factor(order, lcp) >= size
            if not keep_first:
                match |= longest_previous_factor(order, lcp, later=True) >= size
            hit = np.zeros(len(match), bool)
            hit[by] = match
            out = []
            for i, r in enumerate(rows):
                if r[4]:
                    edge = np.flatnonzero(np.diff(np.r_[False, hit[begin[i] : begin[i + 1]], False].astype(np.int8)))
                    out += [(r[1], r[2], r[3] + x, r[3] + y - 1) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["shard", "seq", "a", "b"])

        held, count = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("f", "shard", "seq", "a", "judged", "data")), strict=True):
                if count >= at_once and row[0] != held[-1][0]:
                    yield found(held)
                    held, count = [], 0
                held.append(row)
                count += len(row[5]) - size + 1
        if held:
            yield found(held)

    return run


def repeated(docs: DataFrame, added: str, finish: Callable, min_bytes: int = MIN_BYTES, gram: int = GRAM, keep_first: bool = True, many: int = MANY, shard_many: int = SHARD_MANY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id`` of each row and what ``finish(kept bytes, size, removed runs)`` makes of its text.

    Removed is each byte covered by a string of ``min_bytes`` UTF-8 bytes that starts earlier too (in order of
    shard and row as the table was read), or with ``keep_first=False`` anywhere else. Strings don't cross rows;
    they are judged on the input. Null and empty texts are empty; texts below the length lose nothing; repeated
    rows are copies of each other whatever their doc_ids; null doc_ids stay null. No rows give no rows. Other
    columns are left out.

    Copies are one row a shard before they reach an owner. A passage in a third of all documents costs its owner a
    row or ``shard_many`` a shard; anchors with more than ``many`` contexts are counted by the hash of each string.
    """
    spark, path = docs.sparkSession, common.shared_dir(docs.sparkSession)
    common.small_batches(spark)
    numbered = common.keep(_number(common.texts(docs, "doc_id"), shard_bytes), f"{path}/numbered")
    named = _name_runs(numbered, min_bytes, gram, shard_many).repartition("f").sortWithinPartitions("f", "c", "shard")
    codes = common.keep(named.mapInArrow(lambda batches: judge(batches, many), "shard long, f long, c long, code int"), f"{path}/codes")
    kind = numbered.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    step = numbered.groupBy("shard").cogroup(codes.groupBy("shard")).applyInArrow(_apply_codes(min_bytes, gram, keep_first, to_arrow_type(kind)), _STEP.format(id=kind.simpleString()))
    step = common.keep(step, f"{path}/step")
    common.forget(spark, f"{path}/numbered")

    contexts = step.where(F.col("kind") == _CONTEXT).select("f", "shard", "seq", "a", "judged", "data").repartition("f").sortWithinPartitions("f")
    matched = contexts.mapInArrow(_factors(min_bytes, keep_first), "shard long, seq int, a int, b int")
    windows = step.where(F.col("kind") == _WINDOW)
    place = F.struct("shard", "seq", "a")
    counted = windows.groupBy("f", "wh").agg(F.sum("q").alias("n"), F.min(place).alias("first")).where("n > 1")
    copies = windows.where("judged").join(counted, ["f", "wh"])
    if keep_first:
        copies = copies.where(place != F.col("first"))
    starts = matched.union(copies.select("shard", "seq", "a", F.col("a").alias("b")))
    late = starts.groupBy("shard", "seq").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("starts"))

    texts = step.where(F.col("kind") == _DOC).select("shard", "seq", "doc_id", "data", "spans", "judged")
    done = texts.where("NOT judged").withColumn("starts", F.lit(None).cast("array<struct<a:int,b:int>>"))
    waiting = texts.where("judged").join(late, ["shard", "seq"], "left")

    def start() -> Callable:
        def one(raw: bytes, spans: bytes, starts: list | None) -> tuple:
            sure = np.frombuffer(spans, np.int32)
            more = np.array([x for s in starts or () for x in (s["a"], s["b"])], np.int32)
            gone = _cover(len(raw), np.concatenate([sure, more]), min_bytes)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(sure) or len(more) else raw
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
            return finish(kept, len(raw), list(zip(edge[::2], edge[1::2], strict=True)))

        return lambda b: zip(*(one(*row) for row in zip(*(b.column(c).to_pylist() for c in ("data", "spans", "starts")), strict=True)), strict=True)

    columns = ["doc_id", "data", "spans", "starts"]
    return common.map_columns(done.select(*columns).union(waiting.select(*columns)), added, start, columns).drop(*columns[1:])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all whole texts of ``documents`` that stand in strings of 200 bytes with another start anywhere."""
    finish = lambda kept, size, runs: (size, size - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    return repeated(common.table(spark, sf_dir, "documents"), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", finish, keep_first=False)


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, k, len(x) // 2 AS n, substr(x, 512 * k + 1, 912) AS y FROM (SELECT doc_id, x, unnest(range(0, (len(x) // 2 + 255) // 256)) AS k FROM d)),
q AS (SELECT doc_id, 256 * k + j AS p, j, n, y FROM (SELECT *, unnest(range(0, 256)) AS j FROM k) WHERE 256 * k + j < n),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY md5(substr(y, 2 * j + 1, 400))) AS n FROM q WHERE p <= n - 200) WHERE n > 1),
b AS (SELECT doc_id, p, substr(y, 2 * j + 1, 2) AS byte FROM q),
c AS (SELECT b.doc_id, b.p, byte, max(r.p) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM b LEFT JOIN r ON b.doc_id = r.doc_id AND b.p = r.p),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM c),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
