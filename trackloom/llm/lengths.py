"""Exact histogram of encoded lengths, and what its suffix sums tell about every context limit."""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def ranks(name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoded_lengths(docs: DataFrame, merges: dict[bytes, int], splits: str) -> DataFrame:
    """``n_tokens`` of each row: the byte-level BPE ids of its whole ``text``; null and empty texts have none.

    One row for each row, repeated rows too; rows stay where they are. All other columns are left out, whatever their
    names. A text is encoded at once, so a very long one takes memory in proportion to its size.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((merges, splits))  # a vocabulary: its size doesn't depend on the data

    def start() -> Callable:
        import tiktoken

        vocabulary, rule = shipped.value
        coder = tiktoken.Encoding("lengths", pat_str=rule, mergeable_ranks=vocabulary, special_tokens={})
        return lambda batch: [[len(coder.encode_ordinary(x)) for x in batch.column("text").to_pylist()]]

    return common.map_columns(common.texts(docs), "n_tokens long", start, [])


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """``length, n_docs, n_ids``: documents and ids by encoded length. Counts combine before the shuffle, so common
    lengths don't gather. Repeated rows count each; null lengths are left out; no rows give no rows.
    """
    lengths = lengths.where(F.col(length).isNotNull())
    return lengths.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n_docs")).withColumn("n_ids", F.col("length") * F.col("n_docs"))


def suffix_sums(hist: DataFrame, limits: Sequence[int] = (), block: int = 256) -> DataFrame:
    """For each length, and each of ``limits``, as a context limit: what is longer, what fits, what truncation leaves.

    Columns: ``length, n_docs, n_ids`` of that length; ``docs_longer, ids_longer`` above it; ``total_docs,
    total_ids`` of all; ``truncated_ids`` the ids left when texts are cut at the length; ``lost_ids``;
    ``docs_within`` and ``quantile``, the share of documents that fit. Between two lengths of the histogram only
    ``lost_ids`` changes, so these rows answer for every limit. A limit that no document has joins the histogram with
    no documents. Sums run in blocks of lengths, then over the blocks: no task sees more than a block, or one row per
    block. The histogram is read twice, so it should be a written table. An empty one gives the limits with zeros.
    """
    asked = hist.sparkSession.createDataFrame([(x,) for x in sorted({*limits})], "length long")
    hist = hist.select("length", "n_docs", "n_ids").union(asked.select("length", F.lit(0).cast("long"), F.lit(0).cast("long")))
    hist = hist.groupBy("length").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
    hist = hist.withColumn("block", F.floor(F.col("length") / block))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_ids").alias("t"))
    # one row for each block of lengths: as many as the longest text has ids, divided by the block
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    own = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    out = hist.join(blocks, "block").select("length", "n_docs", "n_ids", (own("n_docs") + F.col("d_after")).alias("docs_longer"), (own("n_ids") + F.col("t_after")).alias("ids_longer"), F.col("d_all").alias("total_docs"), F.col("t_all").alias("total_ids"))
    lost = F.col("ids_longer") - F.col("length") * F.col("docs_longer")
    within = F.col("total_docs") - F.col("docs_longer")
    return out.withColumns({"lost_ids": lost, "truncated_ids": F.col("total_ids") - lost, "docs_within": within, "quantile": within / F.nullif("total_docs", F.lit(0))})


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, length``: the least length that at least this share of all documents doesn't exceed; null without any."""
    found = sums.agg(F.array(*(F.struct(F.lit(float(p)).alias("share"), F.min(F.when((F.col("quantile") >= p) & (F.col("n_docs") > 0), F.col("length"))).alias("length")) for p in shares)).alias("rows"))
    return found.select(F.explode("rows").alias("r")).select("r.*")


#: Context limits that the query answers for, beside the lengths themselves.
LIMITS = tuple(1 << i for i in range(9, 18))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram of all whole texts of ``documents``; one row per encoded length and per usual limit."""
    docs = common.table(spark, sf_dir, "documents")
    hist = common.keep(histogram(encoded_lengths(docs, ranks(), pattern())), f"{common.shared_dir(spark)}/histogram")
    return suffix_sums(hist, LIMITS)
