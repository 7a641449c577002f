"""Exact deduplication on an extendible-hash index kept in shared files."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Keys of a bucket, and buckets up to which that holds; a larger index has larger buckets.
CAPACITY, BUCKETS = 1 << 13, 1 << 15
#: A key of more than ``FEW`` rows and a ``SHARE``-th of all rows, or of more than ``MANY`` rows, combines before it moves.
FEW, SHARE, MANY = 1 << 10, 1 << 10, 1 << 16
#: Leading bits of a hash by which keys are counted first, and bits that each further look adds.
LEAD, STEP = 16, 8


def prefix(h: Column, bits: int) -> Column:
    """The leading bits of a hash as an unsigned number, a long (negative for all 64 bits of a large one)."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def grow(counts: Callable[[int, list[int] | None], dict[int, int]], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """Buckets ``(first hash, local depth)`` in order of hash, and the depth of the directory.

    Starts from one bucket of depth 0. A bucket with more than ``capacity`` keys splits by its next bit; where its
    depth is that of the directory, the directory doubles. ``counts(bits, prefixes)`` gives the number of keys by
    their leading bits, of all (None) or of keys with one of the prefixes of ``bits - STEP`` bits: only buckets that
    are still too full at one resolution are counted at the next. A single hash can't be split any more.
    """
    bits, seen = LEAD, counts(LEAD, None)
    done: list[tuple[int, int]] = []
    todo = [(0, 0)]
    while True:
        points = sorted(seen)
        total = [0, *accumulate(seen[p] for p in points)]
        fuller = []
        while todo:
            start, depth = todo.pop()  # start: leading ``bits`` bits
            end = start + (1 << (bits - depth))
            if total[bisect_left(points, end)] - total[bisect_left(points, start)] <= capacity or depth == 64:
                done.append((start << (64 - bits), depth))
            elif depth == bits:
                fuller.append(start)
            else:
                todo += [(start, depth + 1), (start + (1 << (bits - depth - 1)), depth + 1)]
        if not fuller:
            return sorted(done), max(d for _, d in done)
        bits += STEP
        seen = counts(bits, fuller)
        todo = [(p << STEP, bits - STEP) for p in fuller]


def slots(buckets: list[tuple[int, int]], depth: int) -> list[tuple[int, int, int, int]]:
    """The directory: ``slot`` (leading bits of a hash, ``LEAD`` at most), the range of the 48 bits after ``LEAD`` that
    the entry covers, and the bucket. Slots of an unsplit bucket share it; buckets deeper than ``LEAD`` share a slot."""
    top, rest = min(depth, LEAD), 64 - LEAD
    out = []
    for i, (start, d) in enumerate(buckets):
        if d <= top:
            first = start >> (64 - top)
            out += [(s, 0, 1 << rest, i) for s in range(first, first + (1 << (top - d)))]
        else:
            low = start & ((1 << rest) - 1)
            out.append((start >> rest, low, low + (1 << (64 - d)), i))
    return out


@dataclass
class Index:
    """``keys``: ``doc_id, h, text_sha256`` of each row; ``hot``: hashes whose rows combine before they move; the
    directory and its depth; the number of buckets; the hash function of texts."""

    keys: DataFrame
    hot: DataFrame
    directory: DataFrame
    depth: int
    buckets: int
    hashed: Callable[[Column], Column]

    def bucket_of(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``bucket`` of their hash ``h``. The directory's size has a bound: ``BUCKETS`` and slots."""
        top = prefix(F.col("h"), min(self.depth, LEAD))
        low = F.col("h").bitwiseAND((1 << (64 - LEAD)) - 1)
        found = rows.withColumns({"_slot": top, "_low": low}).join(F.broadcast(self.directory), (F.col("_slot") == F.col("slot")) & (F.col("_low") >= F.col("low")) & (F.col("_low") < F.col("high")))
        return found.drop("_slot", "_low", "slot", "low", "high")

    def owned(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``h`` and others, but no hot ones), each in the partition that owns its bucket."""
        return self.bucket_of(rows.join(self.hot, "h", "left_anti")).repartitionById(self.buckets, F.col("bucket"))


def build_index(docs: DataFrame, path: str, capacity: int = CAPACITY, few: int = FEW, hashed: Callable[[Column], Column] = F.xxhash64) -> Index:
    """The directory over the hashes of all texts; tables go to ``path``. Only counts by prefix come to the driver."""
    spark = docs.sparkSession
    text = common.texts(docs, "doc_id").select("doc_id", common.ascii_lower(F.col("text")).alias("text"))
    keys = common.keep(text.select("doc_id", hashed(F.col("text")).alias("h"), F.sha2("text", 256).alias("text_sha256")), f"{path}/keys")
    hashes = common.keep(keys.groupBy("h").agg(F.count("*").alias("n")), f"{path}/hashes")
    n_rows, n_keys = hashes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = common.keep(hashes.where(F.col("n") > min(max(few, n_rows // SHARE), MANY)).select("h"), f"{path}/hot")

    def counts(bits: int, prefixes: list[int] | None) -> dict[int, int]:
        some = hashes
        if prefixes is not None:  # of more keys than a bucket holds each, so there are BUCKETS of them at most
            asked = spark.createDataFrame([(p,) for p in prefixes], "p long")
            some = hashes.join(F.broadcast(asked), prefix(F.col("h"), bits - STEP) == F.col("p"), "left_semi")
        return {r[0] % (1 << 64): r[1] for r in some.groupBy(prefix(F.col("h"), bits)).count().collect()}

    buckets, depth = grow(counts, max(capacity, -(-n_keys // BUCKETS)))
    directory = spark.createDataFrame(slots(buckets, depth), "slot long, low long, high long, bucket int").coalesce(1)
    return Index(keys, hot, common.keep(directory, f"{path}/directory"), depth, len(buckets), hashed)


def _chained(rows: DataFrame, size: Column) -> DataFrame:
    """``rows`` with ``chain, keep_id, group_size``: texts with one hash are a chain, told apart by their bytes."""
    same = Window.partitionBy("h", "bucket", "text")
    order = Window.partitionBy("h", "bucket").orderBy("text")
    return rows.select("*", F.dense_rank().over(order).alias("chain"), F.max("doc_id").over(same).alias("keep_id"), F.sum(size).over(same).alias("group_size"))


def entries(docs: DataFrame, index: Index, path: str) -> DataFrame:
    """``bucket, h, chain, text_sha256, doc_id, keep_id, group_size`` of each row, from the owner of its bucket.

    An owner has all rows of a range of hashes. It sorts them by hash and text, so texts with one hash stand in one
    chain and equal texts next to each other. Rows of a hot key combine where they are read, to one row for each
    different text and task, and get their entry by hash and digest afterwards.
    """
    text = common.texts(docs, "doc_id").select("doc_id", common.ascii_lower(F.col("text")).alias("text")).withColumn("h", index.hashed(F.col("text")))
    columns = ["bucket", "h", "chain", "text_sha256", "doc_id", "keep_id", "group_size"]
    cold = _chained(index.owned(text), F.lit(1)).withColumn("text_sha256", F.sha2("text", 256)).select(*columns)
    hot = text.join(index.hot, "h", "left_semi").groupBy("h", "text").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
    hot = _chained(index.bucket_of(hot), F.col("n")).withColumn("text_sha256", F.sha2("text", 256)).drop("text", "n", "doc_id")
    hot = common.keep(hot, f"{path}/hot-entries")
    rows = index.keys.join(index.hot, "h", "left_semi").join(hot, ["h", "text_sha256"])
    return common.keep(cold.union(rows.select(*columns)), f"{path}/entries")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, few: int = FEW, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are, A-Z lower-cased; null counts as empty. The largest doc_id of a group
    stays. Null doc_ids come before all others; rows that share both text and the largest doc_id all stay, since
    nothing tells them apart. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    path = common.shared_dir(docs.sparkSession)
    found = entries(docs, build_index(docs, path, capacity, few, hashed), path)
    for part in ("keys", "hashes", "hot", "hot-entries"):
        common.forget(docs.sparkSession, f"{path}/{part}")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, few: int = FEW) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`exact_duplicates` keeps; one of those that share both
    doc_id and text.

    Rows go to the owners with all their columns, and an owner gives one row of each group. Of a hot key only rows
    with the largest doc_id of their text move.
    """
    path = common.shared_dir(docs.sparkSession)
    index = build_index(docs, path, capacity, few)
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    at = {c: own[i] for i, c in enumerate(docs.columns)}
    lowered = common.ascii_lower(F.coalesce(at["text"], F.lit("")))
    rows = docs.toDF(*own).withColumn("h", index.hashed(lowered))
    order = [F.desc_nulls_last(at["doc_id"]), F.xxhash64(*(c for c, kind in zip(own, (t for _, t in docs.dtypes), strict=True) if "map<" not in kind))]
    place = F.row_number().over(Window.partitionBy("h", "bucket", "text").orderBy(*order))
    cold = index.owned(rows).withColumn("text", lowered).withColumn("_place", place).where("_place = 1").select(*own)

    hot_keys = index.keys.join(index.hot, "h", "left_semi").groupBy("h", "text_sha256").agg(F.max("doc_id").alias("keep_id"))
    hot_keys = common.keep(hot_keys, f"{path}/hot-entries")
    hot = rows.join(index.hot, "h", "left_semi").withColumn("text_sha256", F.sha2(lowered, 256)).join(hot_keys, ["h", "text_sha256"]).where(F.col(at["doc_id"]).eqNullSafe(F.col("keep_id")))
    # the filter on the place leaves one row of a text in each task before rows move
    hot = hot.withColumn("_place", F.row_number().over(Window.partitionBy("h", "text_sha256").orderBy(*order))).where("_place = 1").select(*own)
    return cold.union(hot).toDF(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all whole texts of ``documents``; one row per document."""
    return exact_duplicates(common.table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
