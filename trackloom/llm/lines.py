"""Line deduplication: hashes in key ranges, sorted by document and position, become keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id: before all others.
NO_ID = -(2**63)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """``k1, k2`` (128-bit hash of the key), ``doc, text_key, n_lines, pos`` of each line whose key is long enough."""
    schema = "k1 long, k2 long, doc long, text_key long, n_lines int, pos int"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            hashes, at, pos, size = bytearray(), [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = text.encode().translate(common.LOWER_BYTES).split(b"\n")
                size.append(len(found))
                for j, line in enumerate(found):
                    key = line.strip(SPACE)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        hashes += digest(key)
                        at.append(i)
                        pos.append(j)
            k = np.frombuffer(bytes(hashes), "<i8").reshape(-1, 2)
            at = np.array(at, np.int64)
            rows = [batch.column(c).to_numpy()[at] for c in ("doc", "text_key")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.ascontiguousarray(k[:, 0]), np.ascontiguousarray(k[:, 1]), *rows, np.array(size, np.int32)[at], np.array(pos, np.int32))], names=["k1", "k2", "doc", "text_key", "n_lines", "pos"])

    return docs.mapInArrow(run, schema)


def stream_runs(min_docs: int) -> Callable:
    """Walks lines sorted by key, then document (largest first), then position, a batch at a time.

    Gives the lines that go, as ``open = false``: those of a key's second and later documents, if it has
    ``min_docs``. The first and the last key of the partition may have lines elsewhere: the first one's lines are
    given whole, as ``open = true``, and so are those of the last one's first ``min_docs`` documents. No more
    lines than these are held at a time.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["open", "k1", "k2", "doc", "text_key", "n_lines", "pos"]

        def out(rows: list, is_open: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), is_open)), *map(pa.array, rows)], names=names)

        first = held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names[1:]]
            if first is None and len(rows[0]):
                first = rows[0][0], rows[1][0]
            if held is None:
                n = int(((rows[0] == first[0]) & (rows[1] == first[1])).sum()) if first else 0
                yield out([r[:n] for r in rows], True)
                rows = [r[n:] for r in rows]
            else:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            new_key = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
            new_doc = new_key | np.r_[True, rows[2][1:] != rows[2][:-1]]
            begin = np.flatnonzero(new_key)
            size = np.diff(np.r_[begin, len(new_key)])
            nth = np.cumsum(new_doc)
            nth = nth - np.repeat(nth[begin], size) + 1  # documents of the key so far
            enough = np.repeat(np.maximum.reduceat(nth, begin) >= min_docs, size)
            last = np.arange(len(nth)) >= begin[-1]
            yield out([r[np.where(last, nth > min_docs, enough & (nth > 1))] for r in rows], False)
            held = [r[last & (nth <= min_docs)] for r in rows]
        if held is not None:
            yield out(held, True)

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Compressed bitmaps of the lines that stay, for documents that lose any: ``doc, text_key, n_lines, n_dropped, keep``.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``min_chars`` code points
    found in ``min_docs`` documents stay only in the largest doc_id. ``keep`` is a zlib-compressed bitmap, first
    line first; documents that aren't named keep every line. ``doc`` is the doc_id (nulls: one document before all
    others), ``text_key`` the XXH64 of the text, which tells rows with one doc_id apart; equal rows share a bitmap.
    Null and empty texts have one empty line. Other columns are left out.

    Lines are dealt out by ranges of key and document, so a line that a third of all documents hold spreads over
    many tasks; what is open at the ends of the ranges is counted by key and document.
    """
    path = common.shared_dir(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    lines = common.keep(line_keys(identified(docs), min_chars), f"{path}/lines")
    ranged = lines.repartitionByRange("k1", "k2", "doc").sortWithinPartitions("k1", "k2", F.desc("doc"), "text_key", "pos")
    with common.batches(docs.sparkSession, common.NUMBERS):
        told = common.keep(ranged.mapInArrow(stream_runs(min_docs), "open boolean, k1 long, k2 long, doc long, text_key long, n_lines int, pos int"), f"{path}/told")
    common.forget(docs.sparkSession, f"{path}/lines")
    edge = told.where("open")
    # two keys for each range at most, so they can be broadcast
    counted = edge.select("k1", "k2", "doc").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc").alias("top")).where(F.col("n") >= min_docs)
    late = edge.join(F.broadcast(counted), ["k1", "k2"]).where("doc < top")
    columns = ["doc", "text_key", "n_lines", "pos"]
    gone = told.where("NOT open").select(*columns).union(late.select(*columns))
    by_doc = gone.groupBy("doc", "text_key", "n_lines").agg(F.collect_set("pos").alias("gone"))

    def start() -> Callable:
        import numpy as np

        def one(n: int, gone: list[int]) -> tuple[int, bytes]:
            bits = np.ones(n, np.uint8)
            bits[gone] = 0
            return len(gone), zlib.compress(np.packbits(bits).tobytes(), 1)

        return lambda b: zip(*map(one, b.column("n_lines").to_pylist(), b.column("gone").to_pylist()), strict=True)

    return common.map_columns(by_doc, "n_dropped long, keep binary", start, ["doc", "text_key", "n_lines", "gone"]).drop("gone")


def identified(docs: DataFrame) -> DataFrame:
    """``doc, text_key, text``: what names a row in the bitmaps, and its text."""
    return common.texts(docs, "doc_id").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, added: str, finish: Callable) -> DataFrame:
    """Texts with the lines left that their bitmap keeps, through ``finish(kept bytes, lines, dropped)``."""
    source = identified(docs).join(bitmaps.select("doc", "text_key", "keep"), ["doc", "text_key"], "left")

    def start() -> Callable:
        import numpy as np

        def one(text: str, keep: bytes | None) -> tuple:
            raw = text.encode()
            if keep is None:
                return finish(raw, raw.count(b"\n") + 1, 0)
            found = raw.split(b"\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(found)]
            left = [x for x, b in zip(found, bits.tolist(), strict=True) if b]
            return finish(b"\n".join(left), len(found), len(found) - len(left))

        return lambda b: zip(*map(one, b.column("text").to_pylist(), b.column("keep").to_pylist()), strict=True)

    made = common.map_columns(source, added, start, ["doc"])
    return made.withColumn("doc_id", F.when(F.col("doc") != NO_ID, F.col("doc"))).drop("doc")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of all whole texts of ``documents``; one row per document."""
    docs = common.table(spark, sf_dir, "documents")
    finish = lambda kept, lines, dropped: (lines, dropped, hashlib.sha256(kept).hexdigest())
    return apply_bitmaps(docs, keep_bitmaps(docs), "n_lines long, n_dropped long, kept_sha256 string", finish).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.top > doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (g.top IS NULL OR g.top <= doc_id), '')) AS kept_sha256
FROM k LEFT JOIN g USING (key) GROUP BY doc_id
"""
