"""N-gram Jaccard join: exact links between documents whose sets of word shingles are alike, their number, and their classes.

A document's set is held as sorted 64-bit hashes. Tiles are keyed by a shingle and a band of set sizes: each set
enters those of its rarest shingles, so many that two sets which link must share one of them, in the band of its size
and, if a partner may be that large, in the next. In a tile a hashed bitmap as wide as the band needs bounds the overlap from
above. Sets that pairs which pass connect meet once more, whole, and every pair of them is decided on the sorted arrays themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, by_hot_key, by_ids, chunks, cut, mixed, scratch, small_batches
from .components import components

BUCKETS = 1 << 16
#: In tiles of at most so many sets every pair is a candidate; larger tiles compare bitmaps first.
SMALL = 16
#: A tile is compared in blocks of so many sets, and so many bytes of bitmaps, on average.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Bytes that the bitmaps of the pairs compared at once may take.
STEP_BYTES = 32 << 20
#: Sets whose pairs are decided meet in blocks of so many at most, with so many shingles on average.
GROUP, ELEMENTS = 512, 1 << 20
#: Of every HOT_OF sets one is looked at to find tiles of very many sets, which then skip the shuffle by tile: those seen HOT_SEEN times. It decides where
#: a tile is compared, not what: one that is missed is found to be large where its rows meet.
HOT_OF, HOT_SEEN = 64, 64


def shingle_sets(texts: list[bytes | None], k: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of its whole sequence, if it has fewer words; none without words."""
    for part in chunks(texts):
        w, begin = hashes(texts[part])
        rolled = [w]
        for i in range(1, k):
            rolled.append(rolled[-1][: len(w) - i] * np.uint64(0x9FB21C651E98DF25) + w[i:])
        rolled = [mixed(r + np.uint64(m + 1)) if m == k - 1 else r for m, r in enumerate(rolled)]
        for a, b in zip(begin[:-1], begin[1:]):
            if b - a >= k:
                s = np.sort(rolled[-1][a : b - k + 1])
                yield s[np.r_[True, s[1:] != s[:-1]]]
            else:
                yield mixed(rolled[b - a - 1][a : a + 1] + np.uint64(b - a)) if b > a else w[:0]


def links(o, n, m):
    """Whether an overlap o of sets of n and m has 100 * o >= 80 * union."""
    return 9 * o >= 4 * (n + m)


def width_bytes(n: int) -> int:
    return max(32, 1 << max(0, n.bit_length() - 1))


def bitmap(s: np.ndarray) -> bytes:
    """Bits of the hashes' low digits; as many as suit the set's band: 8 to 16 a shingle, 256 at least."""
    width = 8 * width_bytes(len(s))
    bits = np.zeros(width, bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def prefix(n: int) -> int:
    """So many first elements, in any order all sets keep, that a linked set of any size has one of them among its own first."""
    return n - (4 * n + 4) // 5 + 1


def tile_keys(s: np.ndarray) -> np.ndarray:
    """Keys of a set's tiles; the lowest bit tells a visitor from the band below."""
    n = len(s)
    first, band, most = s[: prefix(n)], n.bit_length() - 1, (5 * n // 4).bit_length() - 1
    key = lambda x: mixed(first + np.uint64(x * 0xD6E8FEB86659FD93 % (1 << 64))) & ~np.uint64(1)
    return np.concatenate([key(band), key(most) | np.uint64(1)]) if most > band else key(band)


def overlap_bound(x: np.ndarray, y: np.ndarray, n, m):
    """The most that sets of n and m with these bitmaps (uint64 in the last axis) can share."""
    common = np.bitwise_count(x & y).sum(axis=-1, dtype=np.int64)
    px, py = np.bitwise_count(x).sum(axis=-1, dtype=np.int64), np.bitwise_count(y).sum(axis=-1, dtype=np.int64)
    return np.minimum(n - px + common, m - py + common)


def _bits(col: pd.Series, width: int | None = None) -> np.ndarray:
    """Bitmaps as rows of uint64, all folded to `width` bytes, or to the narrowest: the bit of a low digit is then that of fewer digits."""
    size = col.map(len).to_numpy()
    width = width or int(size.min())
    out = np.empty((len(col), width // 8), np.uint64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = np.frombuffer(b"".join(col.iloc[at]), np.uint64).reshape(len(at), n // width, width // 8)
        out[at] = np.bitwise_or.reduce(x, axis=1)
    return out


def _rank_of_buckets(texts: DataFrame, k: int) -> np.ndarray:
    """Order of the BUCKETS (by the hash's high bits) by how many distinct shingles of documents fall into each, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, hashes = np.zeros(BUCKETS, np.int64), WordHashes()
        for pdf in batches:
            held: list[np.ndarray] = []
            for s in shingle_sets(pdf.text.tolist(), k, hashes):
                held.append(s)
                if len(held) == 500:
                    sums += np.bincount((np.concatenate(held) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
                    held = []
            if held:
                sums += np.bincount((np.concatenate(held) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        yield pd.DataFrame({"b": np.flatnonzero(sums), "c": sums[sums > 0]})

    counts = np.zeros(BUCKETS, np.int64)
    for b, c in texts.mapInPandas(count, "b int, c long").groupBy("b").agg(F.sum("c")).collect():
        counts[b] = c
    rank = np.empty(BUCKETS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return rank


def _sets(texts: DataFrame, k: int, rank: np.ndarray) -> DataFrame:
    """doc_id, n, digest of the set, bitmap, tiles. Hashes are renamed so that rare buckets come first; that is a bijection."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, low = WordHashes(), np.uint64((1 << 48) - 1)
        for pdf in batches:
            rows = []
            for s in shingle_sets(pdf.text.tolist(), k, hashes):
                s = np.sort((rank[(s >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (s & low))
                d = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), bitmap(s), tile_keys(s).view(np.int64) if len(s) else []))
            n, d1, d2, bits, tiles = zip(*rows) if rows else ([],) * 5
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n": n, "d1": d1, "d2": d2, "bits": bits, "tiles": tiles})

    return texts.mapInPandas(build, "doc_id long, n long, d1 long, d2 long, bits binary, tiles array<long>")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Rows of whole tiles (False), or a part of one tile of more than SMALL sets (True). A batch and SMALL rows are held at most, whatever a tile's size."""
    held, over = None, None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        held = None
        tile = pdf.k.to_numpy() >> 1
        if over is not None and len(tile):
            at = int(np.searchsorted(tile, over, "right"))
            if at:
                yield pdf[:at], True
            pdf, tile, over = pdf[at:], tile[at:], over if at == len(tile) else None
        if not len(tile):
            continue
        at = int(np.searchsorted(tile, tile[-1]))
        if at:
            yield pdf[:at], False
        held = pdf[at:]
        if len(held) > SMALL:
            over = tile[-1]
            yield held, True
            held = None
    if held is not None:
        yield held, False


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of the small tiles, each once a task; the rows (k, a, and in b the set's size) of large ones. Comes sorted by tile."""
    parts, waiting = [], 0
    for pdf, part in _runs(batches):
        if part:
            yield pd.DataFrame({"large": True, "k": pdf.k.to_numpy(), "a": pdf.doc_id.to_numpy(), "b": pdf.n.to_numpy()})
            continue
        k, ids, n = (pdf[c].to_numpy() for c in ("k", "doc_id", "n"))
        tile = k >> 1
        start = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        count = np.repeat(c := np.diff(np.r_[start, len(tile)]), c)
        small = count <= SMALL
        for d in range(1, min(SMALL, int(count.max()))):
            i = np.flatnonzero(small[:-d] & (tile[d:] == tile[:-d])) if len(tile) > d else np.zeros(0, np.int64)
            i = i[((k[i] & k[i + d] & 1) == 0) & (ids[i] != ids[i + d]) & (5 * np.minimum(n[i], n[i + d]) >= 4 * np.maximum(n[i], n[i + d]))]
            if len(i):
                parts.append(pd.DataFrame({"a": np.minimum(ids[i], ids[i + d]), "b": np.maximum(ids[i], ids[i + d])}))
                waiting += len(i)
        if not small.all():
            yield pd.DataFrame({"large": True, "k": k[~small], "a": ids[~small], "b": n[~small]})
        if waiting > 500_000:
            parts = [pd.concat(parts, ignore_index=True).drop_duplicates()]
            waiting = 0 if len(parts[0]) < 250_000 else 500_001
            if waiting:
                yield parts.pop().assign(large=False, k=0)[["large", "k", "a", "b"]]
                waiting = 0
    if parts:
        yield pd.concat(parts, ignore_index=True).drop_duplicates().assign(large=False, k=0)[["large", "k", "a", "b"]]


def _of_leaders(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each set of a block of a tile the two of its eight most typical sets that may overlap it most."""
    bits, n, ids = _bits(pdf.bits), pdf.n.to_numpy(), pdf.doc_id.to_numpy()
    often = sum(np.unpackbits(bits[i : i + 64].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(ids), 64))
    centre = np.packbits(2 * often >= len(ids)).view(np.uint64)
    typical = np.bitwise_count(bits & centre).sum(axis=1, dtype=np.int64) / np.maximum(1, np.bitwise_count(bits | centre).sum(axis=1, dtype=np.int64))
    top = np.lexsort((ids, -typical))[:8]
    bound = np.stack([overlap_bound(bits[t], bits, n[t], n) for t in top], axis=1)
    ok = links(bound, n[top][None, :], n[:, None]) & (ids[top][None, :] != ids[:, None])
    best = np.argsort(-np.where(ok, bound / (n[top][None, :] + n[:, None]), -1), axis=1, kind="stable")[:, :2]
    i = np.repeat(np.arange(len(ids)), best.shape[1])
    j = best.ravel()
    i, j = i[ok[i, j]], top[j[ok[i, j]]]
    return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}).drop_duplicates()


def _across(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pairs of a pair of blocks of a tile that lie in different classes so far and may link."""
    bits, n, ids, part, comp = _bits(pdf.bits), pdf.n.to_numpy(), pdf.doc_id.to_numpy(), pdf.part.to_numpy(), pdf.comp.to_numpy()
    visitor, two = pdf.k.to_numpy() & 1, part.min() != part.max()
    order = np.argsort(n, kind="stable")
    bits, n, ids, part, comp, visitor = (x[order] for x in (bits, n, ids, part, comp, visitor))
    if comp.min() == comp.max():
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    pop, out = np.bitwise_count(bits).sum(axis=1, dtype=np.int64), []
    step = max(1, min(16, STEP_BYTES // bits.nbytes)) if len(ids) else 1
    for i in range(0, len(ids), step):
        x = slice(i, i + step)
        y = slice(i, int(np.searchsorted(n, 5 * n[x][-1] // 4, "right")))
        ok = (comp[x][:, None] != comp[y]) & (visitor[x][:, None] + visitor[y] < 2) & (np.arange(i, i + len(ids[x]))[:, None] < np.arange(y.start, y.stop))
        if two:
            ok &= part[x][:, None] != part[y]
        at = np.flatnonzero(ok.any(axis=0))
        if not len(at):
            continue
        common = np.bitwise_count(bits[x][:, None, :] & bits[y][at]).sum(axis=2, dtype=np.int64)
        bound = np.minimum((n[x] - pop[x])[:, None], (n[y] - pop[y])[at]) + common
        p, q = np.nonzero(ok[:, at] & links(bound, n[x][:, None], n[y][at]))
        out.append((ids[x][p], ids[y][at][q]))
    a, b = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(2))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _may_link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose bitmaps let them link."""
    for pdf in batches:
        width = np.minimum(pdf.abits.map(len), pdf.bbits.map(len)) if len(pdf) else []
        for w in np.unique(width):
            own = pdf[width == w]
            n, m = own.an.to_numpy(), own.bn.to_numpy()
            yield own.loc[links(overlap_bound(_bits(own.abits, int(w)), _bits(own.bbits, int(w)), n, m), n, m), ["a", "b"]]


def _linked(sets: list[np.ndarray], part: np.ndarray, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each set its number of links, and a set that it reaches by links, the same for all that reach one another. In a group of
    two parts, of which one may be empty, only pairs of a set of each count."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, part = n[order], part[order]
    start = np.r_[0, np.cumsum(n)]
    names, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    bits = _bits(pd.Series([bitmap(sets[i]) for i in order])) if len(n) > SMALL else None
    member, number, root = np.zeros(len(names), np.int32), np.zeros(len(n), np.int64), np.arange(len(n))
    for i in range(len(n) - 1):
        y = np.arange(i + 1, np.searchsorted(n, 5 * n[i] // 4, "right"))
        if two:
            y = y[part[y] != part[i]]
        if bits is not None and len(y):
            y = y[links(overlap_bound(bits[i], bits[y], n[i], n[y]), n[i], n[y])]
        if not len(y):
            continue
        own = flat[start[i] : start[i + 1]]
        member[own] = 1
        common = np.add.reduceat(member[np.concatenate([flat[start[j] : start[j + 1]] for j in y])], np.r_[0, np.cumsum(n[y])[:-1]])
        member[own] = 0
        y = y[links(common, n[i], n[y])]
        number[i] += len(y)
        number[y] += 1
        met = np.unique(root[np.r_[i, y]])
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    back = np.argsort(order)
    return number[back], order[root][back]


def _decide(k: int):
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Comes sorted by group; one group is held at a time."""
        hashes = WordHashes()

        def of(held: list[tuple]) -> pd.DataFrame:
            ids = np.array([h[0] for h in held])
            number, root = _linked([h[1] for h in held], np.array([h[2] for h in held]), group[1] != group[2])
            return pd.DataFrame({"doc_id": ids, "near": ids[root], "n_links": number})[number > 0]

        group, held, done = None, [], []
        for pdf in batches:
            for now, doc_id, part, s in zip(zip(pdf.class_id, pdf.i, pdf.j), pdf.doc_id, pdf.part, shingle_sets(pdf.text.tolist(), k, hashes)):
                if now != group:
                    if len(held) > 1:
                        done.append(of(held))
                    group, held = now, []
                held.append((doc_id, s, part))
            if done:
                yield pd.concat(done)
                done = []
        if len(held) > 1:
            yield of(held)

    return decide


def dealt(df: DataFrame, keys: list[str], nth: Column) -> DataFrame:
    """Rows by the groups of keys, sorted by them. The blocks of one tile (or class), numbered by nth, go to partitions one after another, so
    that few meet in one task by chance."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(n, F.pmod(F.xxhash64(keys[0]) % n + nth, F.lit(n)).cast("int")).sortWithinPartitions(*keys)


def _by_group(keys: list[str], f):
    """f of each group of rows with equal keys, which come one after another; one group is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], None
        for pdf in batches:
            k = pdf[keys].to_numpy()
            edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            for a, b in zip(edges[:-1], edges[1:]):
                if b > a:
                    key = tuple(k[a])
                    if held and key != now:
                        yield f(pd.concat(held, ignore_index=True))
                        held = []
                    held.append(pdf[a:b])
                    now = key
        if held:
            yield f(pd.concat(held, ignore_index=True))

    return run


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{x}{c}") for c in df.columns if c != "doc_id"])


def ngram_join(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs (doc_id, text).

    Two rows link when their sets have 100 * intersection >= 80 * union; component_id is the smallest doc_id that links reach,
    n_links the number of different sets that the row's set links with: all candidates are decided, also those whose classes are known to be one.
    Words and shingles are compared by 64-bit hashes, and equal sets are known by a 128-bit one.
    Sets that are equal are one class represented by its smallest doc_id, so copies are never paired. Null and empty texts have an empty set and
    link with nothing. Rows with one doc_id are one node; a row whose doc_id is null links to the others but is never named: its
    component_id is that of its set, null if no row with an id has that set. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with scratch(spark) as s:
        sets = s.keep(_sets(texts, k, _rank_of_buckets(texts, k)), "sets")
        owners = s.cut(sets.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("owner")))
        ids = owners.where("owner is not null").select(F.col("owner").alias("doc_id"))
        repeated = sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
        own = sets.join(ids.distinct(), "doc_id", "left_semi")
        own = s.keep(own.dropDuplicates(["doc_id", "d1", "d2"]) if repeated else own, "own")
        sets = s.keep(sets.select("doc_id", "n", "d1", "d2"), "rows")
        s.drop("sets")
        once = lambda df: df.dropDuplicates(["doc_id"]) if repeated else df
        sig = once(own.select("doc_id", "n", "bits"))
        tiles = own.select("doc_id", "n", F.explode("tiles").alias("k")).withColumn("tile", F.shiftright("k", 1))
        hot = tiles.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_OF)) == 0).groupBy("tile").count().where(F.col("count") >= HOT_SEEN).select("tile")
        hot = s.cut(hot)
        at_hot = by_ids(tiles, hot, "tile", "left_semi").select(F.lit(True).alias("large"), "k", F.col("doc_id").alias("a"), F.col("n").alias("b"))
        others = by_ids(tiles, hot, "tile", "left_anti").repartition("tile").sortWithinPartitions("k").drop("tile")
        found = s.keep(others.mapInPandas(_candidates, "large boolean, k long, a long, b long").union(at_hot), "found")

        def near(pairs: DataFrame) -> DataFrame:
            return pairs.join(_side(sig, "a").hint("shuffle_merge"), "a").join(_side(sig, "b").hint("shuffle_merge"), "b").mapInPandas(_may_link, "a long, b long")

        large = found.where("large").select("k", F.shiftright("k", 1).alias("tile"), F.col("a").alias("doc_id"), F.col("b").alias("n"))
        width = F.greatest(F.lit(32), F.col("n"))  # a bitmap has 8 to 16 bits a shingle
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(width) / BLOCK_BYTES)).cast("int")
        # only tiles of several blocks need their number, and a large tile's rows must not meet in one task to get it
        several = s.cut(large.groupBy("tile").agg(blocks.alias("blocks")).where("blocks > 1"))
        large = by_hot_key(large.drop("n"), several, "tile").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        large = s.cut(large.withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)")))
        leaders = dealt(large.join(sig.hint("shuffle_merge"), "doc_id"), ["tile", "part"], F.col("part")).mapInPandas(_by_group(["tile", "part"], _of_leaders), "a long, b long")
        candidates = s.cut(near(found.where("not large").select("a", "b").union(leaders).distinct()))
        # what candidates connect so far; of large tiles' pairs only those that would still join two classes say more
        classes = components(candidates)
        parts = large.join(classes.withColumnRenamed("node", "doc_id").hint("shuffle_merge"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
        open_ = parts.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tile")
        parts = by_hot_key(parts, s.cut(open_), "tile", "inner").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        parts = parts.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).join(sig.hint("shuffle_merge"), "doc_id")
        parts = dealt(parts, ["tile", "i", "j"], F.col("i") * F.col("blocks") + F.col("j"))
        rest = s.cut(parts.mapInPandas(_by_group(["tile", "i", "j"], _across), "a long, b long").distinct())
        if rest.limit(1).count():
            star = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
            classes = components(star.union(rest))
        # every two sets that may link are of one class now: each class meets whole, in blocks, and each pair in one of them
        placed = classes.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")).join(sig.select("doc_id", "n").hint("shuffle_merge"), "doc_id")
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / ELEMENTS)).cast("int")
        placed = placed.join(placed.groupBy("class_id").agg(blocks.alias("blocks")), "class_id").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
        placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("doc_id", "class_id", "blocks", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        placed = s.cut(placed)
        some = once(by_ids(texts, s.cut(placed.select("doc_id").distinct()), "doc_id", "left_semi")) if repeated else texts
        some = dealt(by_ids(some, placed, "doc_id", "inner"), ["class_id", "i", "j"], F.col("i") * F.col("blocks") + F.col("j"))
        linked = s.cut(some.mapInPandas(_decide(k), "doc_id long, near long, n_links long"))
        classes = components(linked, "doc_id", "near")
        number = linked.groupBy(F.col("doc_id").alias("owner")).agg(F.sum("n_links").alias("n_links"))
        named = owners.join(classes, owners["owner"] == classes["node"], "left").join(number, "owner", "left").select("d1", "d2", F.coalesce("component", "owner").alias("component_id"), "n_links")
        out = sets.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
        component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        return cut(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
