"""Merkle manifest of a table: a tree over each source's rows, a tree over the sources, and a proof for every row.

Trees are cut into aligned blocks of 16 ** ``DEPTH`` nodes. Going up, a block becomes one node of the next table, until
each tree has one node. Going down, each block is traversed once: a task streams its nodes and keeps, for every level, the
existing run of 16 nodes around the current one and the desired next run, which grows while the existing one is passed.
The block's own path, made the same way one table further up, comes with its nodes and ends each proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Children of a node; levels of a block, so that a block has 4096 nodes.
FAN, DEPTH = 16, 3
#: Rows at which a task hands on what it made, at the end of a block.
ROWS = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(docs: DataFrame, **changed: Column) -> Column:
    """Digest of a row's ``FIELDS``: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    values = [changed.get(c, docs[c]).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def ranked(nodes: DataFrame, key: str, *order: str) -> DataFrame:
    """Nodes with ``pos``, their place within their key in the given order (nulls first), and ``n``, the key's nodes.

    Range partitions are written in order; each adds the counts of those before it, so a key with most of the rows is
    spread over as many tasks as it has shares. Equal rows get places of their own.
    """
    spark, path = nodes.sparkSession, common.shared_dir(nodes.sparkSession)
    by = [key, *order, "_tie"]
    dealt = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = common.keep(dealt.withColumn("_id", F.monotonically_increasing_id()), f"{path}/placed")
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a key has at most one row for each range partition here
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(key, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(key)).alias("n"))
    return placed.join(counts, [key, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_id", "_part", "_at", "_shift")


def block_roots(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``key, pos, n, digest`` of the blocks of ``key, pos, n, digest``; a key's only node stays as it is.

    One exchange by block serves all levels. A block has a bounded number of nodes.
    """
    out = nodes.select("key", "pos", "n", "digest", F.expr(f"pos div {FAN**depth}").alias("block")).repartition("key", "block")
    for _ in range(depth):
        runs = out.groupBy("key", "block", "n", F.expr(f"pos div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run"))
        joined = F.array_join(F.transform("run", lambda x: x["digest"]), "")
        own = F.when(F.col("n") > 1, F.sha2(joined, 256)).otherwise(joined)
        out = runs.select("key", "block", F.col("up").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), own.alias("digest"))
    return out.select("key", "pos", "n", "digest")


def grown(nodes: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """The nodes, then tables of block roots up to one with a single node a key; as many as the logarithm of the rows."""
    path = common.shared_dir(nodes.sparkSession)
    tables = [nodes, common.keep(block_roots(nodes, depth), f"{path}/1")]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tables.append(common.keep(block_roots(tables[-1], depth), f"{path}/{len(tables)}"))
    return tables


class Run:
    """Up to 16 neighbouring nodes of a level, made from leaves 16 at a time. A stack holds unfinished nodes below it."""

    def __init__(self, leaves: Sequence[str], level: int, number: int):
        self.leaves, self.level = leaves, level
        self.at = number * FAN ** (level + 1)
        self.stop = min(len(leaves), self.at + FAN ** (level + 1))
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def grow(self) -> None:
        if self.at < self.stop:
            self.stack[0] = list(self.leaves[self.at : min(self.at + FAN, self.stop)])
            self.at += FAN
            for k in range(self.level):
                if len(self.stack[k]) < FAN and self.at < self.stop:
                    break
                self.stack[k + 1].append(digest("".join(self.stack[k])))
                self.stack[k] = []

    def nodes(self) -> list[str]:
        while self.at < self.stop:
            self.grow()
        return self.stack[self.level]


def traverse(leaves: Sequence[str], height: int) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf of a block, in order: its siblings' digests to the left and to the right, one text a level.

    Beside the leaves, two runs of 16 nodes and a stack are held for each level, however many leaves there are.
    """
    existing = [Run(leaves, level, 0).nodes() for level in range(height)]
    desired = [Run(leaves, level, 1) for level in range(height)]
    left, right = [""] * height, [""] * height
    for j in range(len(leaves)):
        for level in range(height):
            if j % FAN**level:
                break
            if j and not j % FAN ** (level + 1):
                existing[level] = desired[level].nodes()
                desired[level] = Run(leaves, level, j // FAN ** (level + 1) + 1)
            own = j // FAN**level % FAN
            left[level], right[level] = "".join(existing[level][:own]), "".join(existing[level][own + 1 :])
        yield left, right
        if not (j + 1) % FAN:
            for run in desired:
                run.grow()


def fold(node: str, left: Sequence[str], right: Sequence[str]) -> str:
    """What a node and its siblings, level by level, come to."""
    for a, b in zip(left, right, strict=True):
        node = digest(a + node + b)
    return node


def _height(n: int, depth: int) -> int:
    """Levels that a block of a tree with so many nodes has."""
    height = 0
    while height < depth and FAN**height < n:
        height += 1
    return height


def _walk(nodes: DataFrame, above: DataFrame, extra: Sequence[str], added: str, make, depth: int) -> DataFrame:
    """Blocks of ``nodes`` streamed in order behind the row of ``above`` with the block's own path.

    ``make(row, left, right, path, top)`` gives the ``added`` columns of a node, behind the ``extra`` ones.
    """
    block = F.expr(f"pos div {FAN**depth}").alias("block")
    path = [F.lit(None).cast(kind).alias(c) for c, kind in (("left", "array<string>"), ("right", "array<string>"), ("top", "string"))]
    blank = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in extra]
    first = above.select("key", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit("").alias("digest"), *blank, "left", "right", "top")
    stream = nodes.select("key", block, "pos", "n", "digest", *extra, *path).union(first)
    stream = stream.repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    fields = [nodes.schema[c] for c in extra]
    schema = T.StructType([*fields, *T.StructType.fromDDL(added).fields])

    def run(batches):
        import pyarrow as pa

        kind = to_arrow_schema(schema)
        path, held, found = None, [], []

        def close() -> None:
            height = _height(held[0]["n"], depth) if held else 0
            for row, (left, right) in zip(held, traverse([r["digest"] for r in held], height), strict=True):
                found.append((*(row[c] for c in extra), *make(row, left, right, path)))
            held.clear()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found, strict=True), kind, strict=True)], schema=kind)
            found.clear()
            return made

        for batch in batches:
            for row in batch.to_pylist():
                if row["pos"] < 0:
                    close()
                    path = row
                    if len(found) >= ROWS:
                        yield out()
                else:
                    held.append(row)
        close()
        if found:
            yield out()

    return stream.mapInArrow(run, schema)


def paths(tables: Sequence[DataFrame], above: DataFrame, extra: Sequence[str] = (), depth: int = DEPTH) -> DataFrame:
    """``key, pos, digest, left, right, top`` of the first table's nodes: their siblings up to where ``above`` ends.

    ``above`` has ``key, pos, left, right, top`` of each tree's only node. Columns named in ``extra`` pass through.
    """

    def make(row, left, right, path):
        return row["key"], row["pos"], row["digest"], [*left, *path["left"]], [*right, *path["right"]], path["top"]

    added = "key string, pos long, digest string, left array<string>, right array<string>, top string"
    for i in range(len(tables) - 2, -1, -1):
        above = _walk(tables[i], above, extra if not i else (), added, make, depth)
    return above


def roots(docs: DataFrame, changed: Column | None = None, depth: int = DEPTH) -> tuple[list[DataFrame], DataFrame, str | None]:
    """Tables of the sources' trees, the paths of their subroots to the root, and the root (None without rows).

    Leaves ascend by doc_id, null first; of repeated doc_ids by digest. Sources ascend bytewise, null first. Text is read
    once; afterwards only digests move. ``changed`` is a digest to keep with each leaf.
    """
    spark = docs.sparkSession
    # ahead of any source's name, and no name itself
    key = F.when(docs["source"].isNull(), "").otherwise(F.concat(F.lit("="), docs["source"]))
    own = docs.select(docs["doc_id"], key.alias("key"), leaf(docs).alias("digest"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    trees = grown(ranked(own, "key", "doc_id", "digest"), depth)
    subroots = ranked(trees[-1].select(F.lit("").alias("all"), F.col("key").alias("name"), "digest"), "all", "name").withColumnRenamed("all", "key")
    over = grown(subroots, depth)
    last = over[-1].first()
    top = over[-1].select("key", "pos", F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"), F.col("digest").alias("top"))
    named = paths(over, top, ["name"], depth).select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "left", "right", F.col("digest").alias("top"))
    return trees, common.keep(named, f"{common.shared_dir(spark)}/subroots"), last and last["digest"]


def proofs(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id, leaf, left, right, subroot, root`` of every row: folding a leaf with its siblings gives the root.

    Null fields count as ``-``, empty ones as ``0:``; repeated rows have a leaf each; no rows give no rows. Other columns
    are left out, whatever their names. The only leaf of a source is its subroot, the only subroot the root.
    """
    trees, above, root = roots(docs, depth=depth)
    found = paths(trees, above, ["doc_id"], depth)
    return found.select("doc_id", F.col("digest").alias("leaf"), "left", "right", F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"))


def manifest(docs: DataFrame, changed: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """Every row's ``doc_id, leaf, subroot, root``, the digest of its proof, and the root that the row comes to when read again.

    ``changed`` is the leaf as read again, null where it is the same. Nulls, repeats and empty tables are as in ``proofs``.
    """
    trees, above, root = roots(docs, changed, depth)
    same: dict[tuple[str, int, str], str] = {}

    def make(row, left, right, path):
        siblings = "".join(a + b for a, b in zip((*left, *path["left"]), (*right, *path["right"]), strict=True))
        block = fold(row["changed"] or row["digest"], left, right)
        at = path["key"], path["block"], block
        if at not in same:  # rows that weren't changed share what their block comes to
            if row["changed"]:
                return row["digest"], path["top"], root, digest(siblings), (end := fold(block, path["left"], path["right"])), end == root
            same.clear()
            same[at] = fold(block, path["left"], path["right"])
        return row["digest"], path["top"], root, digest(siblings), same[at], same[at] == root

    above = paths(trees[1:], above, depth=depth)
    return _walk(trees[0], above, ["doc_id", "changed"], "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", make, depth).drop("changed")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``; those where 5 divides the CRC of the doc_id are read again with A-Z in lower case."""
    docs = common.table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
    return manifest(docs, F.when(tampered, leaf(docs, text=common.ascii_lower(docs["text"]))))


def _sql(leaf_levels: int = 5, source_levels: int = 3) -> str:
    """The levels are written out, so the SQL serves up to 16 ** 5 rows a source and 16 ** 3 sources."""
    field = lambda c, v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR END"
    own = lambda text: "sha256(" + " || ".join(field(c, text if c == "text" else c) for c in FIELDS) + ")"
    up = lambda t, i: f"""{t}{i + 1} AS MATERIALIZED (SELECT key, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE min(digest) END AS digest
  FROM {t}{i} GROUP BY key, pos // 16, n)"""  # noqa: E731
    frame = "OVER (PARTITION BY key, pos // 16 ORDER BY pos ROWS BETWEEN"
    beside = lambda t, i: f"""{t}{i}s AS MATERIALIZED (SELECT key, pos, n, coalesce(string_agg(digest, '') {frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') {frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{i})"""  # noqa: E731
    bit = "(CASE WHEN i % 8 = 0 THEN xor(a, ascii(t[i // 8 + 1])) ELSE a END)"
    steps = [
        f"""d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key, {own('text')} AS digest,
  {own("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lower, doc_id::VARCHAR AS t FROM documents)""",
        f"""c AS (SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || range(0, 8 * len(t)), lambda a, i: xor({bit} // 2, {bit} % 2 * 3988292384))) % 5 = 0 AS tampered FROM d)""",
        """t0 AS MATERIALIZED (SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n, digest, doc_id,
  CASE WHEN tampered THEN lower ELSE digest END AS again FROM c)""",
        *(up("t", i) for i in range(leaf_levels)),
        *(beside("t", i) for i in range(leaf_levels)),
        f"""u0 AS MATERIALIZED (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n, digest, key AS name FROM t{leaf_levels})""",
        *(up("u", i) for i in range(source_levels)),
        *(beside("u", i) for i in range(source_levels)),
    ]
    places = [f"t{i}s" for i in range(leaf_levels)] + [f"u{i}s" for i in range(source_levels)]
    joins = [f"JOIN t{i}s ON t{i}s.key = t0.key AND t{i}s.pos = t0.pos // {FAN**i}" for i in range(leaf_levels)] + ["JOIN u0 ON u0.name = t0.key"] + [f"JOIN u{i}s ON u{i}s.pos = u0.pos // {FAN**i}" for i in range(source_levels)]
    proof = " || ".join(f"{p}.l || {p}.r" for p in places)
    found = "again"
    folds = []
    for k, p in enumerate(places):
        folds.append(f"f{k} AS MATERIALIZED (SELECT * EXCLUDE (again, n{k}, l{k}, r{k}), CASE WHEN n{k} > 1 THEN sha256(l{k} || {found} || r{k}) ELSE {found} END AS again FROM {f'f{k - 1}' if k else 'p'})")
    sides = ", ".join(f"{p}.n AS n{k}, {p}.l AS l{k}, {p}.r AS r{k}" for k, p in enumerate(places))
    steps.append(f"p AS MATERIALIZED (SELECT t0.doc_id, t0.digest AS leaf, u0.digest AS subroot, t0.again, sha256({proof}) AS proof_sha256, {sides} FROM t0 {' '.join(joins)})")
    return f"""WITH {', '.join([*steps, *folds])}
SELECT doc_id, leaf, subroot, u{source_levels}.digest AS root, proof_sha256, again AS folded_root, again = u{source_levels}.digest AS verified FROM f{len(places) - 1}, u{source_levels}"""


OP11_SQL = _sql()
