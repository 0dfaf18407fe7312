"""Hard-negative mining: exact searches by inner product, cut short by a rotation that puts most of the length of all vectors in front."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch
from .vectors import common_length, matrix, packed, total, unpacked

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Bytes of whole and of rotated vectors of the anchors that one pass over all rows serves.
PASS_BYTES = 16 << 20
#: Rows and anchors whose products are taken at once, and pairs whose vectors are gathered at once.
ROWS, ANCHORS, PAIRS = 1024, 2048, 1 << 14
#: New hits from which the best ones are sorted out again.
HELD = 1 << 18
_EPS = float(np.finfo(np.float64).eps)


@dataclass
class Rotation:
    """Rows of `r` are the directions of all vectors, the longest share first. A product of two vectors is that of the first entries of the rotated ones, up to the
    product of the lengths of what is left, and up to `slack` times the product of the whole lengths for rounding."""

    r: np.ndarray
    levels: list[int]
    slack: float

    @classmethod
    def of(cls, scatter: np.ndarray) -> Rotation:
        dim = len(scatter)
        r = np.linalg.eigh((scatter + scatter.T) / 2)[1].T[::-1].copy()
        uneven = float(np.abs(r @ r.T - np.eye(dim)).sum(axis=1).max(initial=0.0))
        return cls(r, sorted({max(1, dim // 4), max(1, dim // 2), dim}), 64 * dim * _EPS + 4 * uneven)

    def turned(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rotated rows, and their lengths past each level; the whole ones."""
        y = q @ self.r.T
        left = np.stack([np.sqrt((y[:, k:] ** 2).sum(axis=1)) for k in self.levels])
        return y, left, np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))


class Anchors:
    """A block of anchors: whole and rotated vectors."""

    def __init__(self, rotation: Rotation, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.rotation, self.ids, self.labels, self.q = rotation, ids, labels, q
        self.y, self.left, self.length = rotation.turned(q)

    def scores(self, q, turned, sl: slice, ok: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, anchor, score) of the pairs in `ok` whose score can lie between the anchor's `least` and `most`; the score is the integer product. A pair goes
        as soon as the product of its first entries and the lengths of the others leave it no such score."""
        y, left, length = turned
        r, z, zleft, zlength = self.rotation, self.y[sl], self.left[:, sl], self.length[sl]
        k = r.levels[0]
        part = y[:, :k] @ z[:, :k].T
        room = np.outer(left[0], zleft[0]) + r.slack * np.outer(length, zlength)
        i, j = np.nonzero(ok & (part + room >= least[sl]) & (part - room <= most[sl]))
        for a in range(0, len(i), PAIRS):
            x, w = i[a : a + PAIRS], j[a : a + PAIRS]
            p = part[x, w]
            for n, (k0, k1) in enumerate(zip(r.levels[:-1], r.levels[1:]), 1):
                p = p + np.einsum("ij,ij->i", y[x, k0:k1], z[w, k0:k1])
                gap = left[n][x] * zleft[n][w] + r.slack * length[x] * zlength[w]
                on = (p + gap >= least[sl][w]) & (p - gap <= most[sl][w])
                x, w, p = x[on], w[on], p[on]
            w = w + sl.start
            yield x, w, np.einsum("ij,ij->i", q[x], self.q[w])


class Best:
    """The first `most` hits of each group: the highest scores, of equal ones the smallest ids. Groups are whole numbers below `groups`."""

    def __init__(self, groups: int, most: int):
        self.groups, self.most, self.new, self.count = groups, most, [], 0
        self.held = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.worst = np.full(groups, -math.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(group):
            self.new.append((group, score, ids))
            self.count += len(group)
            if self.count > HELD:
                self.settle()

    def settle(self) -> None:
        """Sorts the new hits in; `worst` is then the last score of each group that is full, minus infinity elsewhere."""
        if not self.new:
            return
        g, s, i = (np.concatenate(x) for x in zip(self.held, *self.new))
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        nth = np.arange(len(g)) - np.searchsorted(g, g)
        g, s, i = (x[nth < self.most] for x in (g, s, i))
        last = nth[nth < self.most] == self.most - 1
        self.worst[g[last]] = s[last]
        self.held, self.new, self.count = (g, s, i), [], 0


def _alike(labels: np.ndarray, q: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of rows without those that have `most` rows of smaller ids, of their own label and vector, beside them: they would come after all of those everywhere."""
    order = np.lexsort((ids, *q.T, labels))
    same = (labels[order][1:] == labels[order][:-1]) & (q[order][1:] == q[order][:-1]).all(axis=1)
    first = np.r_[True, ~same] if len(order) else np.zeros(0, bool)
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return np.sort(order[nth < most])


def _blocks(n: int, size: int) -> Iterator[slice]:
    for i in range(0, n, size):
        yield slice(i, min(n, i + size))


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, scale: float = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor of df (vec_id, embedding, label), each row whose vec_id `every` divides, and each of its
    positives the first `negatives` rows of other labels with least * positive_score <= 100 * negative_score <= 100 * positive_score.

    Positives are the first `positives` rows of the anchor's label besides itself. Entries x count as floor(scale * x), scores are the integer products of such
    vectors; higher ones come first, of equal ones the smaller vec_id. A positive without such a negative (one of negative score has none) has no row.

    Rows with a null id, label or vector, with an entry that is null, not finite or so large that a product might leave a long, or whose vector has not the
    length that most have, take no part. Rows that repeat, also their ids, are each rows of their own: a second row of the anchor's id can be its positive, and two
    rows of an anchor's id are two anchors. Ties are broken by vec_id alone; rows that tie in that too give equal results. An empty table gives an empty one. Other columns are not looked at.

    All rows stay where they are: the anchors come to them, in blocks of PASS_BYTES, with the positives found for them in a pass before, and each
    task gives at most `positives` + 1 (then positives * negatives) hits an anchor. The driver holds one block at a time, and a matrix of dim x dim.
    """
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null")
    dim = common_length(rows, "v")
    if not dim:
        return spark.createDataFrame([], SCHEMA)
    below = math.isqrt((1 << 62) // dim) / scale

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, m = matrix(batch.column("v"), dim, below)
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False)[at].astype(np.int64) for c in ("vec_id", "label"))
        return ids, labels, np.floor(scale * m).astype(np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dim, dim))
        for batch in batches:
            q = read(batch)[2].astype(np.float64)
            out += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, q = read(batch)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), packed(q)], ["vec_id", "label", "q"])

    rotation = Rotation.of(total(rows.mapInArrow(scatter, "sums array<double>"), "sums", dim * dim, np.float64).reshape(dim, dim))
    found = []
    with scratch(spark) as s:
        anchors = s.keep(rows.where(F.col("vec_id") % every == 0).mapInArrow(pack, "vec_id long, label long, q binary"), "anchors")
        blocks = max(1, -(-anchors.count() // max(1, PASS_BYTES // (16 * dim))))
        anchors = s.keep(anchors.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")), "blocks")
        for b in range(blocks):
            own = anchors.where(F.col("block") == b).select("vec_id", "label", "q").toArrow()
            if not len(own):
                continue
            own = own.sort_by([("vec_id", "ascending"), ("label", "ascending"), ("q", "ascending")]).combine_chunks()
            block = Anchors(rotation, own["vec_id"].to_numpy(), own["label"].to_numpy(), unpacked(own["q"].combine_chunks(), dim))
            found.append(_served(spark, rows, read, block, positives, negatives, least))
    out = found[0] if found else spark.createDataFrame([], SCHEMA)
    for more in found[1:]:
        out = out.union(more)
    return out


def _served(spark, rows: DataFrame, read, block: Anchors, positives: int, negatives: int, least: int) -> DataFrame:
    """What hard_negatives returns, for one block of anchors, from a table of its own."""
    n = len(block.ids)
    sent = spark.sparkContext.broadcast(block)
    with_self = positives + 1

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        best, no_most = Best(n, with_self), np.full(n, math.inf)
        for batch in batches:
            ids, labels, q = read(batch)
            at = _alike(labels, q, ids, with_self)
            for x in _blocks(len(at), ROWS):
                i, own, qs = ids[at[x]], labels[at[x]], q[at[x]]
                turned = a.rotation.turned(qs)
                for sl in _blocks(n, ANCHORS):
                    for row, anchor, score in a.scores(qs, turned, sl, own[:, None] == a.labels[sl], best.worst, no_most):
                        best.add(anchor, score, i[row])
                best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.held], ["anchor", "score", "vec_id"])

    first = lambda keys, most: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")) <= most
    hits = rows.mapInArrow(near, "anchor long, score long, vec_id long")
    # positives + 1 rows an anchor of the block
    top = hits.withColumn("first", first(["anchor"], with_self)).where("first").select("anchor", "score", "vec_id").toArrow()
    top = top.sort_by([("anchor", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
    g, score, ids = (top[c].to_numpy() for c in ("anchor", "score", "vec_id"))
    itself = (ids == block.ids[g]) & (score == (block.q[g] ** 2).sum(axis=1))
    itself &= np.r_[True, ~((g[1:] == g[:-1]) & itself[1:] & itself[:-1])] if len(g) else itself  # one row is the anchor, others like it are not
    g, score, ids = g[~itself], score[~itself], ids[~itself]
    nth = np.arange(len(g)) - np.searchsorted(g, g)
    g, score, ids, nth = (x[nth < positives] for x in (g, score, ids, nth))
    p_score, p_id = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
    p_score[g, nth], p_id[g, nth] = score, ids
    there = np.zeros((n, positives), bool)
    there[g, nth] = True
    pos = spark.sparkContext.broadcast((p_score, p_id, there))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, (p, p_ids, there) = sent.value, pos.value
        floor = -(-least * p // 100)  # the least whole score that will do; rounded up
        best = Best(n * positives, negatives)
        high = np.where(there, p, np.iinfo(np.int64).min).max(axis=1).astype(np.float64)
        for batch in batches:
            ids, labels, q = read(batch)
            at = _alike(labels, q, ids, negatives)
            for x in _blocks(len(at), ROWS):
                i, own, qs = ids[at[x]], labels[at[x]], q[at[x]]
                turned = a.rotation.turned(qs)
                low = np.where(there, np.maximum(floor, best.worst.reshape(n, positives)), math.inf).min(axis=1)
                for sl in _blocks(n, ANCHORS):
                    for row, anchor, score in a.scores(qs, turned, sl, own[:, None] != a.labels[sl], low, high):
                        for k in range(positives):
                            on = there[anchor, k] & (score >= floor[anchor, k]) & (score <= p[anchor, k])
                            best.add(anchor[on] * positives + k, score[on], i[row[on]])
                best.settle()
        group, score, ids = best.held
        anchor, k = group // positives, group % positives
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor, k, a.ids[anchor], p_ids[anchor, k], p[anchor, k], score, ids)], ["anchor", "nth", "anchor_id", "positive_id", "positive_score", "score", "vec_id"])

    hits = rows.mapInArrow(hard, "anchor long, nth long, anchor_id long, positive_id long, positive_score long, score long, vec_id long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= negatives)
    out = cut(ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    sent.destroy()
    pos.destroy()
    return out
