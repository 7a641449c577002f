"""Merkle proofs and centroid clusters against plain recursion and plain Lloyd rounds, their SQL, and odd tables."""

import hashlib
import random
import zlib

import pytest

from trackloom.llm import catalog, centroids, merkle

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_merkle", "op12_centroids"])
def test_sql(spark, duck, same, name):
    same(catalog.queries()[name](spark, DATA).toPandas(), duck(catalog.oracle_sql()[name], DATA))


# ---- Merkle trees


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_paths(leaves):
    """Root and, for each leaf, its siblings to the left and right on every level."""
    nodes, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, p in zip(paths, at, strict=True):
            run = runs[p // 16]
            path.append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes, at = [sha("".join(r)) for r in runs], [p // 16 for p in at]
    return nodes[0], paths


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows in the documents' column order."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for s in sources]
    trees = [plain_paths([plain_leaf(r) for r in g]) for g in groups]
    root, over = plain_paths([t[0] for t in trees])
    out = []
    for group, (subroot, paths), above in zip(groups, trees, over, strict=True):
        for r, path in zip(group, paths, strict=True):
            again = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                again = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = plain_leaf(again)
            for left, right in (*path, *above):
                node = sha(left + node + right)
            out.append((r[0], plain_leaf(r), subroot, root, sha("".join(a + b for a, b in (*path, *above))), node))
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 255, 256, 257, 600])
def test_traversal(n, depth):
    leaves = [sha(str(i)) for i in range(n)]
    if 0 < n <= 16**depth:
        root, want = plain_paths(leaves)
        height = merkle._height(n, depth)
        got = [list(zip(left, right, strict=True)) for left, right in merkle.traverse(leaves, height)]
        assert got == want
        assert all(merkle.fold(leaf, *zip(*p, strict=True)) == root for leaf, p in zip(leaves, want, strict=True) if p)
    else:
        assert not n or merkle._height(n, depth) == depth


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest(spark, depth):
    """One source has most rows, and several levels of blocks; others have one row, or no name, or a strange one."""
    rng = random.Random(depth)
    sources = ["hot"] * 6 + ["b", "é", "", "-", "Z", None]
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), rng.choice(["Ab", "ab", "", None, "É" * 9])) for i in range(700)]
    rows += [(1000, "lone", "en", 1, "X"), (5, "b", "en", 1, "Rep"), (5, "b", "en", 1, "Rep"), (5, "b", "en", 2, "Rep"), (None, "b", None, None, None), (7, "long", "en", 1, "Wx " * 200_000)]
    rows += [(2000 + i, f"s{i}", "en", i, "T") for i in range(40)]
    schema = "doc_id long, source string, lang string, n_chars long, text string, key string, pos int, n string, digest string, changed string, root string"
    docs = spark.createDataFrame([(*r, "k", 1, "n", "d", "c", "r") for r in rows], schema).repartition(7)
    changed = merkle.F.when(merkle.F.crc32(docs["doc_id"].cast("string")) % 5 == 0, merkle.leaf(docs, text=merkle.common.ascii_lower(docs["text"])))
    got = merkle.manifest(docs, changed, depth=depth).collect()
    want = plain_manifest(rows)
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:6] for r in got), key=order) == sorted(want, key=order)
    assert all(r.verified == (r.folded_root == r.root) for r in got) and not all(r.verified for r in got)
    for r in merkle.proofs(docs, depth=depth).collect():
        assert merkle.fold(r.leaf, r.left, r.right) == r.root
    assert merkle.manifest(docs.limit(0)).collect() == [] and merkle.proofs(docs.limit(0)).collect() == []
    one = merkle.manifest(docs.where("doc_id = 1000")).collect()
    assert [(r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in one] == [(plain_leaf(rows[700]),) * 3 + (sha(""), True)]


# ---- centroid clusters


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, tuple(int((1024 * x) // 1) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and abs(x) < float("inf") for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    pick = lambda v: min((far(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(pick(v)[1], []).append(v)
        centres = [tuple(sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)) if i in groups else c for i, c in enumerate(centres)]
    found = [(i, *pick(v)) for i, v in kept]
    own = lambda c: sum(d for _, d, x in found if x == c)
    return [(i, c, d, own(c), sum(d for _, d, _ in found), sha(",".join(map(str, centres[c])))) for i, d, c in found]


def test_clusters(spark):
    """A third of the vectors are one; some repeat, tie, or don't count."""
    rng = random.Random(2)
    hot = [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(i, hot if i % 3 == 0 else [rng.choice([-1.0, 0.0, 0.25]) for _ in range(64)] if i % 3 == 1 else [rng.gauss(i % 5, 1) for _ in range(64)]) for i in range(120)]
    rows += [(5, hot), (5, hot), (None, hot), (None, [0.0] * 64), (200, None), (201, []), (202, [1.0] * 63), (203, [None] + [1.0] * 63), (204, [float("nan")] + [1.0] * 63), (205, [float("-inf")] + [1.0] * 63)]
    schema = "id long, v array<double>, vector string, n int, cluster string, distance string, key string"
    got = centroids.cluster(spark.createDataFrame([(*r, "a", 1, "b", "c", "d") for r in rows], schema).repartition(5), "id", "v").collect()
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(plain_clusters(rows), key=order)


def test_few_and_equal_vectors(spark):
    schema = "id long, v array<float>"
    for rows in ([], [(1, [0.5] * 64)], [(i, [0.5] * 64) for i in range(20)], [(i, [float(i)] * 64) for i in range(5)]):
        got = centroids.cluster(spark.createDataFrame(rows, schema), "id", "v").collect()
        assert sorted(map(tuple, got)) == sorted(plain_clusters(rows))
    with pytest.raises(Exception, match="a component is beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema), "id", "v").collect()
