"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, cut, mixed, small_batches

ORDERS = (3, 4, 5)
BITS = 20
#: Most labelled rows of each class whose texts the logistic fit sees; the log-count ratios come from all labelled rows.
FIT_ROWS = 2000
#: Features kept of the 2**BITS: those whose log-count ratio is surest.
KEPT = 1 << 13
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def grams(text: bytes | None, orders: tuple = ORDERS, bits: int = BITS) -> np.ndarray:
    """Buckets of the character n-grams of a text (UTF-8, A-Z lower-cased, a space added at either end), repeats included."""
    code = np.frombuffer((" " + (text or b"").translate(_LOWER).decode(errors="replace") + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    for n in orders:
        if len(code) >= n:
            h = code[: len(code) - n + 1].copy()
            for i in range(1, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[i : len(code) - n + 1 + i]
            out.append(mixed(h + np.uint64(n)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Model:
    """weights: one float32 for each bucket, 0 where a feature isn't kept; bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: bytes | None) -> float:
        b = grams(text)
        b = np.unique(b[self.weights[b] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.weights[b].sum(dtype=np.float64) + self.bias, -500, 500))))


def ratios(counts: pd.DataFrame, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept buckets and their log-count ratios, from the documents of either class (p, q) that have each bucket b."""
    counts = counts.sort_values("b")
    b, p, q = counts.b.to_numpy(), counts.p.to_numpy(np.float64), counts.q.to_numpy(np.float64)
    r = np.log((p + 0.5) / (n_pos + 1)) - np.log((q + 0.5) / (n_neg + 1))
    sure = np.abs(r) / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    top = np.argsort(-sure, kind="stable")[:KEPT]
    return b[top], r[top]


def fit_logistic(docs: list[np.ndarray], y: np.ndarray, r: np.ndarray, steps: int = 200, l2: float = 1e-3, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on presence times log-count ratio, by AdaGrad over the whole sample."""
    row = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    col = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    val = r[col]
    w, bias, gw, gb = np.ones(len(r)) * 0.1, 0.0, np.full(len(r), 1e-8), 1e-8
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[col], len(docs)) + bias, -30, 30)))
        d = (p - y) * share
        g = np.bincount(col, val * d[row], len(r)) + l2 * w / len(r)
        gw, gb = gw + g * g, gb + d.sum() ** 2
        w, bias = w - rate * g / np.sqrt(gw), bias - rate * d.sum() / np.sqrt(gb)
    return w * r, bias


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labels.toxic from the labelled rows given (doc_id, text; doc_id, toxic).

    Counts of documents per bucket and class are summed by Spark over every labelled row; the driver gets at most
    2**BITS counts, and kept feature numbers of at most FIT_ROWS rows a class, those whose id hashes lowest.
    Null labels and ids are left out; a null text counts as empty. Without labels of both classes every text scores the share
    of positive labels (0.5 without any).
    """
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    ids = cut(ids)
    rows = by_ids(docs.select("doc_id", F.col("text").cast("binary").alias("text")), ids, "doc_id", "inner")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        n = [0, 0]
        for pdf in batches:
            for t, y in zip(pdf.text, pdf.y):
                sums[y, np.unique(grams(t))] += 1
                n[y] += 1
        yield pd.DataFrame({"b": [-1], "p": [n[1]], "q": [n[0]]})
        for start in range(0, 1 << BITS, 1 << 16):
            part = sums[:, start : start + (1 << 16)]
            b = np.flatnonzero(part.any(axis=0))
            yield pd.DataFrame({"b": b + start, "p": part[1, b], "q": part[0, b]})

    sums = rows.mapInPandas(count, "b long, p long, q long").groupBy("b").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    counts = sums.where("b < 0 or p + q >= 3").toPandas()
    n_pos, n_neg = (int(counts.loc[counts.b < 0, c].sum()) for c in "pq")
    weights = np.zeros(1 << BITS, np.float32)
    if not n_pos or not n_neg:
        share = (n_pos + 0.5) / (n_pos + n_neg + 1)
        return Model(weights, float(np.log(share / (1 - share))))
    kept, r = ratios(counts[counts.b >= 0], n_pos, n_neg)
    order = np.argsort(kept)
    sorted_kept = kept[order]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"y": pdf.y, "f": [order[np.searchsorted(sorted_kept, np.intersect1d(grams(t), sorted_kept))].astype("<i4").tobytes() for t in pdf.text]})

    chosen = ids.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).union(ids.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").mapInPandas(features, "y int, f binary").toPandas()
    w, bias = fit_logistic([np.frombuffer(f, "<i4") for f in sample.f], sample.y.to_numpy(np.float64), r)
    weights[kept] = w
    # the fit weighs both classes alike; the bias puts their true shares back
    return Model(weights, bias + float(np.log(n_pos / n_neg)))


def scorer(spark, model: Model):
    """A function from a text column to its score."""
    sent = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*sent.value)
        for s in text:
            yield pd.Series([m.score(t) for t in s], dtype="float64")

    return lambda text: score(text.cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels the fit never sees: crc32 of the id as text, mod 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted added, learnt from the labelled rows that aren't held out.

    All columns and rows of docs stay, repeated ones too; of columns that have those names already the new values
    replace the old. Null and empty texts get the score of a text without n-grams but those of the added spaces. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    model = train(own, labels.select("doc_id", "toxic"))
    scored = docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": scorer(docs.sparkSession, model)(F.col("text"))})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
