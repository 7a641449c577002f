"""Toxicity: a convolutional text classifier over hashed words, trained in numpy, with a threshold by language."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .contam import words

#: Labelled rows that the model is fitted on, at most, and words of all of them; rows with the smallest hash of doc_id
#: are taken.
MAX_ROWS, MAX_WORDS = 6000, 4_000_000
BITS, DIM, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
_SIZE = 1 << BITS
_PAD = _SIZE  # the row of zeros


def hashes(text: str) -> np.ndarray:
    """CRC-32 of each word of a whole text."""
    crc = zlib.crc32
    return np.array([crc(w) for w in words(text)], np.uint32)


def _rows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each word in the table: words that share one seldom share both."""
    h = h.astype(np.uint64)
    return (h & np.uint64(_SIZE - 1)).astype(np.int64), ((h * np.uint64(0x9E3779B1) >> np.uint64(13)) & np.uint64(_SIZE - 1)).astype(np.int64)


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words of all documents, each followed by empty ones, where each document's filters start, and
    where they stop: after the first empty place, so none reaches the next document."""
    gap = max(WIDTHS)
    first = np.cumsum([0, *(len(d) + gap for d in docs)])
    places = np.full((2, first[-1] + gap), _PAD, np.int64)
    at = np.concatenate([np.arange(a, a + len(d)) for a, d in zip(first.tolist(), docs, strict=False)]) if docs else np.zeros(0, np.int64)
    places[:, at] = _rows(np.concatenate(docs)) if docs else 0
    return places[0], places[1], first[:-1], first[:-1] + np.array([len(d) + 1 for d in docs], np.int64)


@dataclass
class Classifier:
    """``table``: embeddings of hashed words, then a column per language; ``kernel``: the filters of each width."""

    table: np.ndarray
    kernel: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    limits: np.ndarray
    offsets: np.ndarray

    def convolve(self, x: np.ndarray) -> np.ndarray:
        n = len(x) - max(WIDTHS) + 1
        return np.concatenate([sum(x[j : j + n] @ k[j] for j in range(w)) for w, k in zip(WIDTHS, self.kernel, strict=True)], axis=1)

    def logits(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Score before calibration, and the language that the words look like."""
        a, b, first, stop = _padded(docs)
        x = self.table[a] + self.table[b]
        top = np.maximum.reduceat(self.convolve(x[:, :DIM]), np.stack([first, stop], axis=1).ravel(), axis=0)[::2]
        pooled = np.maximum(top + self.bias, 0)
        tongue = np.argmax(np.add.reduceat(x[:, DIM:], first, axis=0) + self.offsets, axis=1)
        return pooled @ self.out + self.base, tongue

    def scores(self, docs: list[np.ndarray], words_at_once: int = 1 << 17) -> np.ndarray:
        """Calibrated scores of documents given as word hashes; 0.5 is the threshold of the guessed language."""
        out, some, size = [], [], 0
        for i, d in enumerate(docs):
            some.append(d)
            size += len(d)
            if size >= words_at_once or i + 1 == len(docs):
                z, tongue = self.logits(some)
                out.append(1 / (1 + np.exp(-np.clip(z - self.limits[tongue], -30, 30))))
                some, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)


def _languages(docs: list[np.ndarray], lang: list[str]) -> np.ndarray:
    """Columns of the table that tell languages: log shares of hashed words; their sum over a text points to one."""
    names = sorted(set(lang))
    count = np.full((_SIZE, len(names)), 0.1, np.float64)
    for d, name in zip(docs, lang, strict=True):
        np.add.at(count[:, names.index(name)], np.concatenate(_rows(np.unique(d))), 1)
    share = np.log(count / count.sum(axis=0))
    share -= share.mean(axis=1, keepdims=True)
    return np.vstack([share, np.zeros(len(names))]).astype(np.float32)


def fit(docs: list[np.ndarray], labels: list[int], lang: list[str], epochs: int = 4, seed: int = 7) -> Classifier:
    """Train on word hashes of documents, their labels (0 or 1) and their languages.

    A fifth of the rows sets the thresholds, the rest the weights. The first embedding dimension starts from how
    much more often a word stands in documents of label 1, in standard errors; the others start at random. Without
    rows of both labels every score is the share of label 1 (0 without rows).
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    lang = lang or [""]
    tongues = _languages(docs, lang) if docs else np.zeros((_SIZE + 1, 1), np.float32)
    table = np.zeros((_SIZE + 1, DIM + tongues.shape[1]), np.float32)
    kernel = [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS]
    n_out = FILTERS * len(WIDTHS)
    model = Classifier(table, kernel, np.zeros(n_out, np.float32), np.zeros(n_out, np.float32), 0.0, np.zeros(tongues.shape[1]), np.zeros(tongues.shape[1], np.float32))
    table[:, DIM:] = tongues / 2
    rate = float(y.mean()) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        model.base = 30.0 if rate == 1 else -30.0
        return model

    order = rng.permutation(len(docs))
    tune, train = order[: len(docs) // 5], order[len(docs) // 5 :]
    df = np.zeros((2, _SIZE + 1))
    for i in train:
        np.add.at(df[int(y[i])], np.unique(_rows(docs[i])[0]), 1)
    n = np.maximum(np.array([(y[train] == 0).sum(), (y[train] == 1).sum()]), 1)
    both = (df.sum(axis=0) + 1) / (n.sum() + 2)
    z = (df[1] / n[1] - df[0] / n[0]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    told = {int(p): float(v) for p, v in enumerate(z) if v > 2.5 and df[1][p] >= 3}
    for i in train:
        a, b = _rows(docs[i])
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            if p in told:
                table[p, 0] = table[q, 0] = min(told[p], 8) / 8
    table[:-1, 1:DIM] = rng.normal(0, 0.05, (_SIZE, DIM - 1))
    for w, k in zip(WIDTHS, kernel, strict=True):
        k += rng.normal(0, 0.05, k.shape)
        k[:, 0] += 1 / w
    model.bias[:] = -0.5
    model.out[:] = 0.3
    model.base = float(np.log(rate / (1 - rate))) - 1
    grads = [np.full_like(p, 1e-4) for p in (*kernel, model.bias, model.out)]
    seen_base, rows_seen, rate_of = 1e-4, np.full(_SIZE + 1, 1e-3), 0.03
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
            batch = [docs[i] for i in part]
            a, b, first, stop = _padded(batch)
            x = table[a, :DIM] + table[b, :DIM]
            c = model.convolve(x)
            top = np.array([s + np.argmax(c[s:e], axis=0) for s, e in zip(first, stop, strict=True)])
            pool = np.take_along_axis(c, top, axis=0) + model.bias
            live = np.maximum(pool, 0)
            p = 1 / (1 + np.exp(-np.clip(live @ model.out + model.base, -30, 30)))
            err = (p - y[part]) / len(part)
            g_pool = err[:, None] * model.out[None, :] * (pool > 0)
            g_kernel, g_x = [np.zeros_like(k) for k in kernel], {}
            for f in range(n_out):
                w = WIDTHS[f // FILTERS]
                k = kernel[f // FILTERS][:, :, f % FILTERS]
                for j in range(w):
                    at = top[:, f] + j
                    g_kernel[f // FILTERS][j, :, f % FILTERS] += g_pool[:, f] @ x[at]
                    for i in np.flatnonzero(g_pool[:, f]):
                        g_x[at[i]] = g_x.get(at[i], 0) + g_pool[i, f] * k[j]
            steps = [*g_kernel, g_pool.sum(axis=0), live.T @ err]
            for q, s, g in zip((*kernel, model.bias, model.out), grads, steps, strict=True):
                s += g * g
                q -= (rate_of * g / np.sqrt(s)).astype(np.float32)
            seen_base += err.sum() ** 2
            model.base -= float(rate_of * err.sum() / np.sqrt(seen_base))
            for at, g in g_x.items():
                for row in (a[at], b[at]):
                    if row != _PAD:
                        rows_seen[row] += float(g @ g)
                        table[row, :DIM] -= (rate_of * g / np.sqrt(rows_seen[row])).astype(np.float32)
    _calibrate(model, [docs[i] for i in tune], y[tune])
    return model


def _calibrate(model: Classifier, docs: list[np.ndarray], y: np.ndarray) -> None:
    """Thresholds that make the fewest mistakes on rows not trained on: one of all, then by guessed language."""
    if not len(y):
        return
    z, tongue = (np.concatenate(x) for x in zip(*(model.logits(docs[i : i + 64]) for i in range(0, len(docs), 64)), strict=True))

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z)
        z, y = z[order], y[order]
        wrong = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]
        edges = np.r_[z[0] - 1, (z[1:] + z[:-1]) / 2, z[-1] + 1]
        least = np.flatnonzero(wrong == wrong.min())
        return float(edges[least[np.argmax(np.r_[1, np.diff(z), 1][least])]])  # where the scores leave the widest gap

    model.limits[:] = best(z, y)
    for t in range(len(model.limits)):
        own = tongue == t
        if y[own].sum() >= 10 and (1 - y[own]).sum() >= 10:
            model.limits[t] = best(z[own], y[own])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Classifier:
    """Fit on labelled rows that aren't held out: ``max_rows`` of them and ``max_words`` words at most come to the
    driver, as hashes. The model's size is fixed.

    Of rows that share doc_id and label one counts; a doc_id with both labels counts with each. Labels other than 0
    and 1 and null doc_ids are left out. ``lang`` only tells the languages apart whose thresholds are set; a table
    without labelled rows gives a model that scores every text alike. Other columns don't matter.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_y IN (0, 1)").where(~held_out(F.col("_id"))).distinct()
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    source = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("_lang"))
    rows = source.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "_y", "_lang", F.xxhash64("text", "_lang").alias("_h"), F.coalesce("text", F.lit("")).alias("text"))

    def start() -> Callable:
        return lambda batch: [[hashes(t).tobytes() for t in batch.column("text").to_pylist()]]

    read = common.map_columns(rows, "_words binary", start, ["_id", "_y", "_lang", "_h"])
    one = read.groupBy("_id", "_y").agg(F.min(F.struct("_h", "_lang", "_words")).alias("r")).select("_id", "_y", "r.*")
    # max_rows rows at most, so one task may add up their words
    so_far = F.sum(F.octet_length("_words") / 4).over(Window.orderBy(F.xxhash64("_id"), "_id", "_y"))
    got = one.withColumn("_n", so_far).where(F.col("_n") <= max_words).toPandas().sort_values(["_id", "_y"], kind="stable")
    return fit([np.frombuffer(x, np.uint32) for x in got["_words"]], got["_y"].tolist(), got["_lang"].tolist())


def score(docs: DataFrame, model: Classifier, pass_on: list[str], name: str = "score") -> DataFrame:
    """The columns ``pass_on``, then the score of each whole text. Null and empty texts have a score too.

    Rows stay where they are; repeated rows score alike, whatever stands beside them. Very long texts are scored
    whole. An empty table gives no rows. A column that has the score's name must not be passed on; others are left
    out. The model, whose size is fixed, is broadcast.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable:
        return lambda batch: [shipped.value.scores([hashes(t or "") for t in batch.column("text").to_pylist()])]

    # the text goes to Python even where it isn't passed on
    held = list(dict.fromkeys([*pass_on, "text"]))
    return common.map_columns(docs.select(*held), f"{name} double", start, held).select(*pass_on, name)


def drop_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below 0.5."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    scored = score(docs.withColumnsRenamed(own), model, [own.get(c, c) for c in docs.columns], "_toxic_score")
    return scored.where("_toxic_score < 0.5").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored by a model that learnt from the rows not held out."""
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
