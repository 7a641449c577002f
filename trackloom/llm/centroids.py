"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors with multiplicities, in whole numbers."""

from __future__ import annotations

import hashlib
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Largest component of a quantised vector: squared distances and their sums over 64 components fit 64 bits.
LARGEST = 1 << 27
Centroids = list[tuple[int, ...]]


def quantised(rows: DataFrame, key: str, vector: str, components: int = 64, scale: int = 1024) -> DataFrame:
    """``key, vector``: vectors with so many components, each as ``floor(scale * component)``.

    Null vectors, other lengths, and null or non-finite components leave their rows out. A component beyond ``LARGEST``
    fails: its distances would not fit 64 bits.
    """
    number = rows[vector]
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda x: F.floor(x.cast("double") * float(scale))
    fits = lambda x: F.when(F.abs(x.cast("double") * float(scale)) < LARGEST, whole(x)).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}")).cast("long"))
    return rows.where((F.size(number) == components) & finite).select(rows[key].alias("key"), F.transform(number, lambda x: fits(x).cast("int")).alias("vector"))


def distinct(vectors: DataFrame) -> DataFrame:
    """``vector, n``: each vector once, with its multiplicity, counted before rows move."""
    return vectors.groupBy("vector").agg(F.count("*").alias("n"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> Centroids:
    """The ``k`` vectors whose keys have the least hashes, in that order; of rows with one key, the lesser vector first."""
    label = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return [tuple(r.vector) for r in vectors.withColumn("_label", label).orderBy("_label", "vector").limit(k).collect()]


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as 64-bit numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the first of equally near ones, and its squared distance."""
    best, least = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.iinfo(np.int64).max)
    for i, c in enumerate(centroids):
        far = np.square(vectors - c).sum(axis=1)
        closer = far < least
        best[closer], least[closer] = i, far[closer]
    return best, least


def step(weighted: DataFrame, centroids: Centroids) -> Centroids:
    """One round: each distinct vector goes to its nearest centroid, which moves to the floor of their weighted mean.

    A task sends one row per cluster and component, so what reaches the driver is bounded by the centroids.
    """
    held = np.array(centroids, np.int64)

    def sums(batches):
        import pyarrow as pa

        totals, counts = np.zeros(held.shape, np.int64), np.zeros(len(held), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, n = _matrix(batch.column("vector")), batch.column("n").to_numpy()
                cluster, _ = nearest(vectors, held)
                for i in np.unique(cluster):
                    own = cluster == i
                    totals[i] += n[own] @ vectors[own]
                    counts[i] += n[own].sum()
        used = np.flatnonzero(counts)
        place, part = np.repeat(used, held.shape[1]), np.tile(np.arange(held.shape[1]), len(used))
        columns = place, part, totals[used].ravel(), counts[place]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "part", "total", "n"])

    found = weighted.mapInArrow(sums, "cluster long, part long, total long, n long").groupBy("cluster", "part").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = [list(c) for c in centroids]
    for r in found.collect():
        moved[r.cluster][r.part] = r.total // r.n
    return [tuple(c) for c in moved]


def assigned(weighted: DataFrame, centroids: Centroids) -> DataFrame:
    """``vector, n, cluster, distance`` of the distinct vectors."""
    held = np.array(centroids, np.int64)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, nearest(_matrix(batch.column("vector")), held))], names=[*batch.schema.names, "cluster", "distance"])

    return weighted.mapInArrow(run, "vector array<int>, n long, cluster int, distance long")


def joined(vectors: DataFrame, found: DataFrame, total: int, parts: int = 1000) -> DataFrame:
    """Every row of ``vectors`` with what ``found`` has for its vector.

    Vectors with over a ``parts``-th of all rows, fewer than ``parts`` in number, are broadcast; the others meet by vector.
    """
    heavy = F.broadcast(found.where(F.col("n") * parts > total))
    light = found.where(F.col("n") * parts <= total)
    return vectors.join(heavy, "vector").unionByName(vectors.join(heavy, "vector", "left_anti").join(light, "vector"))


def cluster(rows: DataFrame, key: str, vector: str, k: int = 8, rounds: int = 10, seed: int = 3, components: int = 64, scale: int = 1024) -> DataFrame:
    """Each kept vector's ``key, cluster, distance``, its cluster's and the whole inertia, and its centroid's digest.

    Vectors are kept and quantised as in ``quantised``; repeated vectors count each. Fewer vectors than ``k`` give as many
    centroids. Of equal centroids the first takes all; a centroid without vectors stays where it is. Rounds stop early
    when nothing moves, which changes nothing. Repeated and null keys have a row each, no rows give none. Columns but the two
    named are left out, so their names can't clash.
    """
    spark = rows.sparkSession
    path = common.shared_dir(spark)
    vectors = quantised(rows, key, vector, components, scale)
    weighted = common.keep(distinct(vectors), f"{path}/distinct")
    centroids = first_centroids(vectors, k, seed) or [(0,) * components]
    with common.batches(spark, common.NUMBERS):
        for _ in range(rounds):
            before, centroids = centroids, step(weighted, centroids)
            if centroids == before:
                break
        found = common.keep(assigned(weighted, centroids), f"{path}/assigned")
    # a row for each cluster
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("inertia")).collect()}
    about = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    total = found.agg(F.sum("n")).first()[0] or 0
    return joined(vectors, found, total).join(F.broadcast(about), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` in eight clusters."""
    return cluster(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _sql(rounds: int = 10) -> str:
    far = "list_sum(list_transform(list_zip(w.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        """q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "w AS MATERIALIZED (SELECT v, count(*) AS n FROM q GROUP BY v)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM q ORDER BY h, v LIMIT 8))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v, n, b.c AS c, b.d AS d FROM (SELECT w.v, w.n, min({{'d': {far}, 'c': c.c}}) AS b FROM w, c{i} c GROUP BY w.v, w.n))")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v
  FROM (SELECT c, i, sum(n * v[i])::HUGEINT AS s, sum(n)::HUGEINT AS n FROM a{i}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return f"""WITH {', '.join(steps)}
SELECT q.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM q JOIN a{rounds} a ON q.v = a.v JOIN c{rounds} c ON c.c = a.c"""


OP12_SQL = _sql()
