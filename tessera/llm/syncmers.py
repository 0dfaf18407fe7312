"""Document fingerprints of closed syncmers: k-mers whose least inner substring lies at an edge."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_hot_key, by_ids, cut, mixed, running_totals, small_batches

K, S = 40, 8
#: Texts of fewer than SHORT characters have finer anchors: of any 12 characters in a row at least one.
SHORT, FINE_K, FINE_S = 200, 8, 3
#: Bytes of text in a part, which one task reads row by row, and how many parts the driver knows at most (or four times the shuffle partitions, if more).
PART_BYTES, PARTS = 16 << 20, 2048
_B = np.uint64(0x9FB21C651E98DF25)


def _rolling(code: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all substrings of this length, by doubling; the binary digits of length say which doublings to join."""
    out, done, h, have = None, 0, code, 1
    while True:
        if length & have:
            out = h if out is None else _join(h, have, out, done)
            done += have
        if 2 * have > length:
            return out
        h = _join(h, have, h, have)
        have *= 2


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def _join(a: np.ndarray, la: int, b: np.ndarray, lb: int) -> np.ndarray:
    """Hashes of substrings of length la + lb from those of their first la and last lb."""
    n = max(0, min(len(a), len(b) - la))
    return a[:n] * _pow(lb) + b[la : la + n]


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Anchors(tuple):
    """Positions and hashes; `coarse` has those of K and S where these are finer."""

    coarse: tuple | None = None


def anchors(text: str, k: int | None = None, s: int | None = None) -> Anchors:
    """Positions and 32-bit hashes of the closed syncmers of a text, the finer ones of a short text unless k and s are given.
    One that has none, or is shorter than k, has one anchor: itself, at 0."""
    if k is None and len(text) < SHORT:
        fine = Anchors(_anchors(text, FINE_K, FINE_S))
        fine.coarse = _anchors(text, K, S)
        return fine
    return Anchors(_anchors(text, k or K, s or S))


def _anchors(text: str, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    code = mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    if len(code) >= k:
        inner = mixed(_rolling(code, s))
        least = _window_min(inner, k - s + 1)
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s : k - s + len(least)] == least))
        if len(at):
            return at, (mixed(_rolling(code, k)[at]) >> np.uint64(32)).astype(np.int64)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = hashlib.blake2b(text.encode(), digest_size=4).digest()
    return np.zeros(1, np.int64), np.array([int.from_bytes(h, "big")], np.int64)


def written(a: tuple[np.ndarray, np.ndarray]) -> str:
    """position step.hash, in hexadecimal, of each anchor in turn."""
    return " ".join("%x.%08x" % x for x in zip(np.diff(a[0], prepend=0).tolist(), a[1].tolist()))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Anchors of the longest chain that rises in both texts, over all anchors of either; 1 for two without any.
    Of a finer and a coarser text both coarse anchors count.

    Each occurrence of a hash is paired with the same-numbered occurrence in the other text, so repeats cost no more than their number.
    """
    fine, other = getattr(a, "coarse", None), getattr(b, "coarse", None)
    if (fine is None) != (other is None):
        a, b = fine or a, other or b
    n, m = len(a[1]), len(b[1])
    if not n or not m:
        return float(n == m)
    if n == m and (a[1] == b[1]).all() and (a[0] == b[0]).all():
        return 1.0
    _, i, j = np.intersect1d(_numbered(a[1]), _numbered(b[1]), assume_unique=True, return_indices=True)
    j = j[np.argsort(i)]
    tails: list[int] = []
    for x in j.tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails) / (n + m - len(tails))


def _numbered(h: np.ndarray) -> np.ndarray:
    """Hashes with the number of their occurrence, as one integer each."""
    order = np.argsort(h, kind="stable")
    start = np.r_[True, h[order][1:] != h[order][:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - first
    return (h << 31) | out


def edited(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def syncmers(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors.

    The edited text is the text with its last n_chars // 4 code points replaced by the first as many of the next row's, by ascending
    doc_id (null first, ties by the text's md5), the first row's after the last. Null counts as empty, whose fingerprint is empty; two such are alike (1).
    Rows go into contiguous parts of about part_bytes of text, larger ones where there would be more than PARTS parts or four times the
    session's shuffle partitions: the driver knows the first row of each, so their number must not follow the data. A part's rows are
    streamed. The first row of each part also goes, marked, to the part before, so the texts are shuffled once. Equal rows of one id follow one another and travel as one with their number, so no id
    or missing id is a hot key. An empty table gives an empty one; other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    base = base.withColumn("m", F.md5("text"))
    keys = base.groupBy("doc_id", "m").agg(F.max(F.octet_length("text") + 1).cast("long").alias("size"), F.count(F.lit(1)).alias("n"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("m")]
    placed = running_totals(keys, order, "size")
    at = cut(placed)
    most = max(PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = at.agg(F.coalesce(F.max(F.col("before") + F.col("size")), F.lit(0))).first()[0]
    at = at.withColumn("part", F.expr(f"before div {max(part_bytes, -(-whole // most))}"))
    # where each part starts: one row a part
    starts = [(r.doc_id is not None, r.doc_id or 0, r.m) for r in at.groupBy("part").agg(F.min_by(F.struct("doc_id", "m"), "before").alias("r")).select("part", "r.*").orderBy("part").collect()]
    repeated = cut(at.where("n > 1").select("doc_id", "m", "n"))
    if repeated.limit(1).count():
        # equal rows are counted before their texts move; one of them goes on
        key = F.concat_ws(":", "doc_id", "m")
        base, few = base.withColumn("key", key), repeated.select(key.alias("key"), "n")
        once = by_ids(base, few, "key", "left_anti").withColumn("n", F.lit(1).cast("long"))
        base = once.unionByName(by_hot_key(base, few, "key", "inner").groupBy("key", "doc_id", "m", "n").agg(F.any_value("text").alias("text"))).drop("key")
    else:
        base = base.withColumn("n", F.lit(1).cast("long"))
    sent = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("part int, also int")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        starts = sent.value
        for doc_id, m in batches:
            row = list(zip(doc_id.notna(), doc_id.fillna(0).astype("int64"), m))
            part = [bisect_right(starts, r) - 1 for r in row]
            also = [(p - 1) % len(starts) if starts[p] == r else -1 for p, r in zip(part, row)]
            yield pd.DataFrame({"part": pd.Series(part, dtype="int32"), "also": pd.Series(also, dtype="int32")})

    own, marked = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("mark")), F.struct(F.col("at.also").alias("part"), F.lit(True).alias("mark"))
    rows = base.withColumn("at", place("doc_id", "m")).withColumn("at", F.explode(F.when(F.col("at.also") >= 0, F.array(own, marked)).otherwise(F.array(own))))
    # the first of all is last in the last part
    rows = rows.select("doc_id", "m", "n", "text", F.col("at.part").alias("part"), F.col("at.mark").alias("mark"))
    rows = rows.repartitionById(max(1, len(starts)), "part").sortWithinPartitions("part", "mark", *order)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_anchors long"
    return rows.select("doc_id", "n", "text", "part", "mark").mapInPandas(_in_turn, schema)


def _in_turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row with the one after it; a marked row is only ever the one after. Of equal rows all but the last are followed by their like."""
    held = None
    for pdf in batches:
        out = []
        for doc_id, n, text, part, mark in zip(pdf.doc_id, pdf.n, pdf.text, pdf.part, pdf["mark"]):
            text = text.decode(errors="replace")
            now = (doc_id, text, part, mark, anchors(text))
            if held is not None and not held[3] and held[2] == part:
                out.append(_result(held, now))
            if n > 1 and not mark:
                out += [_result(now, now)] * (n - 1)
            held = now
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_anchors"]).astype({"doc_id": "Int64"})


def _result(row: tuple, following: tuple) -> tuple:
    doc_id, text, _, _, a = row
    new = edited(text, following[1])
    b = anchors(new)
    return (doc_id if not pd.isna(doc_id) else None, len(text), hashlib.sha256(new.encode()).hexdigest(), written(a), written(b), likeness(a, b), likeness(a, following[4]), len(a[1]))
