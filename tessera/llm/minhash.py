"""MinHash near-dedup: minima of many universal hash functions, in bands; signatures decide which pairs are looked at, whole sets decide which link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, by_hot_key, by_ids, cut, mixed, scratch, small_batches
from .components import components
from .ngram_join import _bits, _side, bitmap, links, overlap_bound, shingle_sets

#: Bands of so many minima each: two sets at the threshold share no band once in 40 million times.
BANDS, WIDTH = 48, 5
#: Minima that the signatures of two sets have in common at least, six deviations below what sets at the threshold have on average.
AGREE = int(0.8 * BANDS * WIDTH - 6 * (0.8 * 0.2 * BANDS * WIDTH) ** 0.5)
#: Sets of a block of a bucket on average, and the bytes of their signatures and bitmaps.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Pairs of one set whose texts meet in one task.
PAIRS = 512
#: Shingles and functions whose hashes are taken at once.
STEP, TURN = 4096, 16
#: So many sets of each bucket are looked at with all others of it, before whole buckets are compared.
ORDERS = 2


def universal(n: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """n functions x -> a * x + b modulo 2**32, a odd."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each function over a set of hashes."""
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), STEP):
        for j in range(0, len(a), TURN):
            f = slice(j, j + TURN)
            np.minimum(out[f], (a[f, None] * x[i : i + STEP] + b[f, None]).min(axis=1), out=out[f])
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """For each signature (uint16 in the last axis) one key a band, of its minima and its number."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (*sig.shape[:-1], BANDS))
    for i in range(WIDTH):
        key = mixed(key * np.uint64(0x9FB21C651E98DF25) + sig[..., i::WIDTH].astype(np.uint64))
    return key.view(np.int64)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, n, digest of the set, signature (16 bits a minimum), bitmap, band keys."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, (a, b) = WordHashes(), universal(BANDS * WIDTH)
        for pdf in batches:
            rows = []
            for s in shingle_sets(pdf.text.tolist(), k, hashes):
                d, sig = xxhash.xxh3_128_digest(s.tobytes()), minima(s, a, b).astype(np.uint16)
                signed = [int.from_bytes(x, "little", signed=True) for x in (d[:8], d[8:])]
                rows.append((len(s), *signed, sig.tobytes(), bitmap(s), bands(sig) if len(s) else []))
            n, d1, d2, sig, bits, keys = zip(*rows) if rows else ([],) * 6
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n": n, "d1": d1, "d2": d2, "sig": sig, "bits": bits, "keys": keys})

    return texts.mapInPandas(build, "doc_id long, n long, d1 long, d2 long, sig binary, bits binary, keys array<long>")


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many minima signatures (uint16 in the last axis) have in common."""
    return (x == y).sum(axis=-1)


def _signatures(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint16).reshape(len(col), BANDS * WIDTH)


def _may_link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose sizes, signatures and bitmaps let them link."""
    for pdf in batches:
        n, m = pdf.an.to_numpy(), pdf.bn.to_numpy()
        pdf = pdf[(5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (_agreement(_signatures(pdf.asig), _signatures(pdf.bsig)) >= AGREE)]
        width = np.minimum(pdf.abits.map(len), pdf.bbits.map(len)) if len(pdf) else []
        for w in np.unique(width):
            own = pdf[width == w]
            n, m = own.an.to_numpy(), own.bn.to_numpy()
            yield own.loc[links(overlap_bound(_bits(own.abits, int(w)), _bits(own.bbits, int(w)), n, m), n, m), ["a", "b"]]


def _confirm(k: int):
    """Pairs that link, of runs of rows: the text of b first (a null), then those of its partners a. One set and a batch are held."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, of, own = WordHashes(), None, None
        for pdf in batches:
            a, b = [], []
            for first, x, y, s in zip(pdf["first"], pdf.a, pdf.b, shingle_sets(pdf.text.tolist(), k, hashes)):
                if first:
                    of, own = y, s
                elif y == of and links(len(np.intersect1d(own, s, assume_unique=True)), len(own), len(s)):
                    a.append(x)
                    b.append(y)
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return confirm


def _near(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a group of a bucket's sets, and with each the rows of those it is to be compared with: on the other side, or, where there is one side, after it; of another class,
    near enough to link, and sharing no band before the bucket's with it. So two sets meet in one group only, however many buckets they share."""
    n, ids, comp, second = pdf.n.to_numpy(), pdf.doc_id.to_numpy(), pdf.comp.to_numpy(), pdf.second.to_numpy()
    sig, bits = _signatures(pdf.sig), _bits(pdf.bits)
    key, one = pdf.key.iloc[0], pdf.among.iloc[0] and pdf.i.iloc[0] == pdf.j.iloc[0]
    x = np.flatnonzero(~second)
    y = x if one else np.flatnonzero(second)
    for i in x:
        z = y[(comp[y] != comp[i]) & (5 * np.minimum(n[y], n[i]) >= 4 * np.maximum(n[y], n[i]))]
        z = z[ids[z] > ids[i]] if one else z
        z = z[_agreement(sig[z], sig[i]) >= AGREE]
        z = z[links(overlap_bound(bits[i], bits[z], n[i], n[z]), n[i], n[z])]
        if len(z):
            first = (sig[z] == sig[i]).reshape(-1, BANDS, WIDTH).all(axis=2).argmax(axis=1)
            yield i, z[bands(sig[i])[first] == key]


def _partnered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of a group that are to be compared with any."""
    some = np.zeros(len(pdf), bool)
    for i, z in _near(pdf):
        some[i] |= len(z) > 0
        some[z] = True
    return pdf[some]


def _joining(k: int):
    """Links of a group's whole sets that make one class of two: fewer than it has rows. Every other pair that meets here is of one class by then, or does not link."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sets, root, out = pdf.doc_id.to_numpy(), list(shingle_sets(pdf.text.tolist(), k, WordHashes())), pdf.comp.to_numpy().copy(), []
        for i, z in _near(pdf):
            for j in z:
                if root[i] != root[j] and links(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
                    out.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return join


def _by_key(keys: list[str], f):
    """f of each run of rows with equal keys; one run is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for _, part in pdf.groupby(keys, sort=False):
                if held and tuple(held[-1][keys].iloc[0]) != tuple(part[keys].iloc[0]):
                    if len(out := f(pd.concat(held, ignore_index=True))):
                        yield out
                    held = []
                held.append(part)
        if held and len(out := f(pd.concat(held, ignore_index=True))):
            yield out

    return run


class _Texts:
    """What decides pairs: signatures and bitmaps first, texts then."""

    def __init__(self, texts: DataFrame, sig: DataFrame, k: int, s: Scratch):
        self.texts, self.sig, self.k, self.s = texts, sig, k, s

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those that link. Texts of a's go to b's; a b of very many is dealt in parts, each with its text once."""
        near = pairs.join(_side(self.sig, "a").hint("shuffle_merge"), "a").join(_side(self.sig, "b").hint("shuffle_merge"), "b")
        near = self.s.cut(near.mapInPandas(_may_link, "a long, b long"))
        many = self.s.cut(near.groupBy("b").count().where(F.col("count") > PAIRS).select("b", F.ceil(F.col("count") / PAIRS).cast("int").alias("parts")))
        near = by_hot_key(near, many, "b").withColumn("part", F.expr("coalesce(cast(pmod(xxhash64(a), parts) as int), 0)"))
        near = near.select("a", "b", "part")
        wanted = near.select(F.col("a").alias("doc_id"), F.lit(False).alias("first"), "a", "b", "part")
        wanted = self.s.cut(wanted.union(near.select("b", "part").distinct().select(F.col("b").alias("doc_id"), F.lit(True), F.lit(None).cast("long"), "b", "part")))
        rows = by_ids(self.texts, wanted, "doc_id", "inner").repartition("b", "part").sortWithinPartitions("b", "part", F.desc("first"))
        return self.s.cut(rows.select("first", "a", "b", "text").mapInPandas(_confirm(self.k), "a long, b long"))

    def joining(self, groups: DataFrame, keys: list[str]) -> DataFrame:
        """Of the rows (keys, doc_id, comp, second) of groups links that join all classes which links of a group join. No pair leaves a group before it is known to link and to be needed."""
        dealt = groups.join(self.sig.hint("shuffle_merge"), "doc_id").repartition(*keys).sortWithinPartitions(*keys)
        near = self.s.cut(dealt.mapInPandas(_by_key(keys, _partnered), dealt.schema))
        rows = by_ids(self.texts, near, "doc_id", "inner").repartition(*keys).sortWithinPartitions(*keys)
        return self.s.cut(rows.mapInPandas(_by_key(keys, _joining(self.k)), "a long, b long"))


def _leaders(keyed: DataFrame, s: Scratch) -> DataFrame:
    """(a, b) of the buckets of keyed (key, doc_id): each set, and those of its bucket that are first in ORDERS orders, of which all but one are the same for a few buckets only.
    A bucket's rows are not gathered: the first is found by aggregation and comes back to them."""
    order = lambda n: F.xxhash64("doc_id", F.pmod(F.col("key"), F.lit(3)), F.lit(n)) if n else F.col("doc_id")
    firsts = F.array_distinct(F.array(*[F.min_by("doc_id", order(n)) for n in range(ORDERS)]))
    both = by_hot_key(keyed.select("key", "doc_id"), s.cut(keyed.groupBy("key").agg(firsts.alias("firsts"))), "key", "inner")
    return both.select(F.col("doc_id").alias("a"), F.explode("firsts").alias("b")).where("a != b").distinct()


def _open(keyed: DataFrame, classes: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (key, doc_id, w, comp) of the buckets of three sets and more that are not all of one class yet, w being how heavy a set is; and the number c and weight w of each such
    bucket's rows of each class. Of a bucket of two sets the one pair has been looked at."""
    now = keyed.join(classes.select(F.col("node").alias("doc_id"), "component").hint("shuffle_merge"), "doc_id", "left")
    now = s.cut(now.select("key", "doc_id", "w", F.coalesce("component", "doc_id").alias("comp")))
    several = s.cut(now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi and n > 2").select("key"))
    now = s.cut(by_hot_key(now, several, "key", "inner"))
    return now, now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("w"))


def minhash_dedup(docs: DataFrame, k: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Two rows link when their sets of k-word shingles have 100 * intersection >= 80 * union; component_id is the smallest doc_id that links reach, kept says whether it is
    the row's own. Links are found where signatures share a band, and decided on whole sets: none is wrong, and one is missed only where all BANDS
    bands of two such sets differ (4e-9 at the threshold, less above it). A pair is looked at unless links known by then join its sets already.
    Words and shingles are compared by 64-bit hashes, and equal sets are known by a 128-bit one; they are one node, so copies are never paired.

    Null and empty texts have an empty set and link with nothing. Rows that share a doc_id are one node, for which the least of their texts stands; a row of another
    text is in the class of an equal set, if there is one, or of its id. A row whose doc_id is null is never named: its component_id
    is that of its set, null if no row with an id has that set, and then it is kept. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with scratch(spark) as s:
        several = s.cut(texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
        repeated = several.limit(1).count() > 0
        one = by_ids(texts, several, "doc_id", "left_anti").union(by_ids(texts, several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))) if repeated else texts
        sets = s.keep(_sets(one, k), "sets")
        owners = s.cut(sets.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("owner")))
        own = s.keep(sets.join(owners.select(F.col("owner").alias("doc_id")), "doc_id", "left_semi"), "own")
        nodes = s.keep(sets.select("doc_id", "n", "d1", "d2"), "nodes")
        s.drop("sets")
        rows = s.keep(_sets(texts, k).select("doc_id", "n", "d1", "d2"), "rows") if repeated else nodes
        sig = own.select("doc_id", "n", "sig", "bits")
        weight = F.greatest(F.lit(1.0), (F.length("sig") + F.length("bits")) * (BLOCK / BLOCK_BYTES))
        keyed = own.select(F.explode("keys").alias("key"), "doc_id", weight.alias("w"))
        shared = s.cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
        keyed = s.cut(by_hot_key(keyed, shared, "key", "inner"))
        pairs = _Texts(one, sig, k, s)
        classes = components(pairs.linked(_leaders(keyed, s)))
        keyed, held = _open(keyed, classes, s)
        if keyed.limit(1).count():
            more = _rest(keyed, held, pairs)
            if more.limit(1).count():
                classes = components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        of_set = owners.join(classes, owners["owner"] == classes["node"], "left").select("d1", "d2", F.coalesce("component", "owner").alias("of_set"))
        out = rows.join(of_set, ["d1", "d2"], "left")
        if repeated:
            least = s.cut(nodes.where("n > 0").join(of_set, ["d1", "d2"]).where("doc_id is not null").select("doc_id", F.col("of_set").alias("of_id")))
            out = out.join(by_ids(least, several, "doc_id", "left_semi"), "doc_id", "left")
        component = F.when(F.col("n") > 0, F.coalesce("of_set", "of_id", "doc_id") if repeated else F.col("of_set")).otherwise(F.col("doc_id"))
        return cut(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))


def _rest(keyed: DataFrame, held: DataFrame, pairs: _Texts) -> DataFrame:
    """Links that join the classes of each bucket's sets, where any link does. A bucket's largest class is one side, all others, which are few where near copies
    have found each other, the other; blocks of those meet blocks of that, and each other."""
    blocks = lambda weight: f"cast(greatest(1, ceil(({weight}) / {BLOCK})) as int)"
    main = held.groupBy("key").agg(F.max(F.struct("c", "comp", "w")).alias("most"), F.sum("w").alias("w"))
    main = pairs.s.cut(main.select("key", F.col("most.comp").alias("main"), F.expr(blocks("most.w")).alias("lot"), F.expr(blocks("w - most.w")).alias("few")))
    sides = by_hot_key(keyed.select("key", "doc_id", "comp"), main, "key", "inner").withColumn("odd", F.col("comp") != F.col("main"))
    sides = sides.withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), if(odd, few, lot)) as int)")).withColumn("other", F.explode(F.expr("sequence(0, if(odd, lot, few) - 1)")))
    with_main = sides.select("key", "doc_id", "comp", F.lit(False).alias("among"), F.expr("if(odd, part, other)").alias("i"), F.expr("if(odd, other, part)").alias("j"), (~F.col("odd")).alias("second"))
    among = sides.where("odd and other = 0").withColumn("other", F.explode(F.expr("sequence(0, few - 1)")))
    among = among.select("key", "doc_id", "comp", F.lit(True).alias("among"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.expr("part > other").alias("second"))
    keys = ["key", "among", "i", "j"]
    return pairs.joining(with_main.union(among), keys)
