"""The nearest vectors of the same label: blocks of queries against blocks of vectors, each a product of matrices in a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import vectors as V

#: Queries and vectors of a block, on average; queries that a task compares with a block at once.
QUERIES, VECTORS, ROWS = 4096, 8192, 256
DIGITS = 6


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, added from left to right as ``vectors.cosine`` does."""
    dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
    return dot(a, b) / ((np.sqrt(dot(a, a)) + V.EPS) * (np.sqrt(dot(b, b)) + V.EPS))


def _best(a: np.ndarray, b: np.ndarray, a_id: np.ndarray, b_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that may be among a query's first ``k``: by rounded cosine, equal ones by id. ``b_id`` ascends.

    Products of matrices differ from sums in order by less than 1e-12. So pairs that lie that near to a border of
    rounding stay beside the ``k`` best; those are few.
    """
    length = [np.sqrt((v * v).sum(axis=1)) + V.EPS for v in (a, b)]
    scaled = (a @ b.T) / (length[0][:, None] * length[1][None]) * 10**DIGITS
    whole = np.floor(scaled + 0.5)
    whole[a_id[:, None] == b_id[None]] = -np.inf
    if len(b_id) > k:
        least = np.partition(whole, len(b_id) - k, axis=1)[:, len(b_id) - k]
    else:
        least = np.full(len(a), -(10.0 ** (DIGITS + 1)))
    r, c = np.nonzero((whole >= least[:, None] - 1) & (whole > -np.inf))
    value, bound = whole[r, c], least[r]
    border = np.abs(scaled[r, c] + 0.5 - np.round(scaled[r, c] + 0.5)) < 1e-5
    # sure ones count by their place among those of one query and value; ids ascend
    order = np.lexsort((c, -value, r))
    r, c, value, bound, border = (v[order] for v in (r, c, value, bound, border))
    sure = np.cumsum(~border)
    begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    before = np.repeat(sure[begin] - ~border[begin], np.diff(np.r_[begin, len(r)])) if len(r) else sure
    taken = border | (sure - before <= k)
    return r[taken], c[taken]


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``vec_id, other_id, similarity, rank`` of the ``k`` vectors of the same label that are most like each query: rounded cosines,
    equal ones by id, never the query itself.

    Every query is compared with every vector of its label. Both fall into blocks by their ids, so a task holds one block
    of each whatever the table holds, and of every two blocks only a query's best rows go on. Vectors that aren't as
    long as most, or hold what is no number, meet all others by expressions, as few as they are.
    """
    sizes = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = sizes["n"] if sizes else 1
    plain = F.coalesce((F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < 1e15)) & F.exists("embedding", lambda x: F.abs(x) > 1e-15) & F.col("vec_id").isNotNull(), F.lit(False))
    (qa, qo), (va, vo) = ((df.select("vec_id", "label", "embedding").where(plain), df.select("vec_id", "label", "embedding").where(~plain)) for df in (queries, vectors))
    most = lambda df: int(df.groupBy("label").count().agg(F.max("count")).first()[0] or 1)
    rows, cols = -(-most(qa) // QUERIES), -(-most(va) // VECTORS)
    block = lambda n, mine: F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(mine)
    every = lambda n, other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(other)
    left = qa.select("label", "vec_id", "embedding", block(rows, "_q"), every(cols, "_v")).where("label IS NOT NULL")
    # new names, since a table that meets itself must not share columns
    right = va.where("label IS NOT NULL").select(F.col("label").alias("_l"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"), block(cols, "_w"), every(rows, "_p"))

    def met(one, two):
        import pyarrow as pa

        def of(t, key, vector):
            parts = [np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in t.column(vector).chunks)]
            ids = t.column(key).to_numpy()
            order = np.argsort(ids, kind="stable")
            return ids[order], np.concatenate(parts).astype(float).reshape(-1, width)[order]

        out = []
        if one.num_rows and two.num_rows:
            (q, a), (v, b) = of(one, "vec_id", "embedding"), of(two, "other_id", "other")
        for at in range(0, one.num_rows if two.num_rows else 0, ROWS):
            r, c = _best(a[at : at + ROWS], b, q[at : at + ROWS], v, k)
            out.append((q[at + r], v[c], _cosines(a[at + r], b[c])))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("vec_id", "other_id", "similarity"), columns, strict=True)))

    found = left.groupBy("label", "_q", "_v").cogroup(right.groupBy("_l", "_p", "_w")).applyInArrow(met, "vec_id long, other_id long, similarity double")

    def slow(one: DataFrame, two: DataFrame) -> DataFrame:
        a, b = one.alias("a"), two.alias("b")
        pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") != F.col("b.vec_id")))
        return pairs.select(F.col("a.vec_id").alias("vec_id"), F.col("b.vec_id").alias("other_id"), V.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("similarity"))

    if not (qo.isEmpty() and vo.isEmpty()):
        found = found.unionByName(slow(qo, vectors)).unionByName(slow(qa, vo))
    rounded = found.withColumn("similarity", F.round("similarity", DIGITS))
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other_id"))).where(F.col("rank") <= k)
