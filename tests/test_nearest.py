"""The nearest vectors by blocks against all pairs by expressions."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import vectors as V
from trackloom.operators import nearest


def test_nearest_in_blocks(spark, monkeypatch):
    """Copies, ties, lone vectors, zeros, nulls and other lengths; many small blocks."""
    for name, n in (("QUERIES", 3), ("VECTORS", 7), ("ROWS", 2)):
        monkeypatch.setattr(nearest, name, n)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 3) for i in range(90)] + [(100, [0.0] * 4, 0), (120, None, 1), (140, [1.0, None, 2.0, 1.0], 2), (160, [1.0, 2.0], 0), (180, [1.0] * 4, 7), (200, [2.0] * 4, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    a, b = e.where("vec_id % 20 = 0").alias("a"), e.alias("b")
    like = F.round(V.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("similarity")
    met = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") != F.col("b.vec_id"))).select(F.col("a.vec_id").alias("vec_id"), F.col("b.vec_id").alias("other_id"), like)
    want = met.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other_id"))).where("rank <= 3")
    got = nearest.nearest(e.where("vec_id % 20 = 0"), e, 3).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 9


def test_no_pair_leaves_its_block(spark):
    """Vectors of one label meet in a task, not in a join that gives every pair out as a row."""
    from trackloom.plans import queries as plans

    plan = plans.QUERIES["emb_cosine_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroups" in plan
