"""Hard negatives, whitening and MinHash classes against plain versions, over null, not finite, repeated, tied and clashing rows."""

import math
import random

import numpy as np
import pytest

from tessera.llm import minhash as mh
from tessera.llm import negatives as hn
from tessera.llm.ngram_join import shingle_sets, links
from tessera.llm.common import WordHashes
from tessera.llm.negatives import hard_negatives
from tessera.llm.whitening import jacobi, squared, whiten

VECTORS = "vec_id long, embedding array<float>, label int, score double, x string, n long, q binary"


def vectors(rng, n, dim=12):
    centres = rng.normal(size=(4, dim))
    out = [(i, [float(np.float32(v)) for v in centres[i % 4] * (1 + i % 3) / 3 + rng.normal(size=dim) * 0.4], int(rng.integers(0, 3)), 0.5, "x", 1, b"q") for i in range(n)]
    out += [(n + j, out[7 * j][1], j % 3, None, None, None, None) for j in range(12)]  # ties between ids and labels
    out += [(300 + j, out[0][1], 1, None, None, None, None) for j in range(15)]  # one vector that many rows have
    odd = [None, [math.nan] * dim, [math.inf] + [0.0] * (dim - 1), [None] + [0.0] * (dim - 1), [0.0] * (dim - 1), [], [3e38] * dim]
    out += [(400 + j, v, 1, None, None, None, None) for j, v in enumerate(odd)] + [(500, [0.0] * dim, 2, None, None, None, None), (600, out[3][1], None, None, None, None, None)]
    return out + [(None, out[1][1], 1, None, None, None, None), out[10], (10, out[11][1], 0, None, None, None, None), (10, out[12][1], 1, None, None, None, None)]


def fit(v, dim=12, below=1e9):
    return v is not None and len(v) == dim and all(c is not None and math.isfinite(c) and abs(c) < below for c in v)


def plain_negatives(rows, every):
    """By sorting everything; rows of one id are rows of their own."""
    rows = [(r[0], r[2], np.floor(256 * np.array(r[1], np.float64)).astype(object)) for r in rows if r[0] is not None and r[2] is not None and fit(r[1], below=2**31 / 256 / 4)]
    out = []
    for at, (a, label, q) in enumerate(rows):
        if a % every:
            continue
        scored = sorted(((-int(q @ p), i, lab) for k, (i, lab, p) in enumerate(rows) if k != at))
        for ps, pid, _ in [r for r in scored if r[2] == label][:5]:
            hard = [(s, i) for s, i, lab in scored if lab != label and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(a, pid, n + 1, i, -ps, -s) for n, (s, i) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # several blocks of anchors, of rows, of pairs, and lists settled all the time
        for name, value in {"PASS_BYTES": 5 * 16 * 12, "ROWS": 7, "ANCHORS": 2, "PAIRS": 3, "HELD": 4}.items():
            monkeypatch.setattr(hn, name, value)
    rows = vectors(np.random.default_rng(3), 150)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = hard_negatives(df, every=10)
    assert [f.simpleString() for f in got.schema] == ["anchor_id:bigint", "positive_id:bigint", "rank:int", "negative_id:bigint", "positive_score:bigint", "negative_score:bigint"]
    want = plain_negatives(rows, 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives(none).count() == 0 and whiten(none).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, None, 1), (100, [], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(one).count() == 0


def test_rotation_bounds_every_product():
    """Partial products, the lengths left and the slack enclose the integer product, also of vectors of very different lengths."""
    rng = np.random.default_rng(1)
    q = np.floor(rng.normal(size=(300, 16)) * 10.0 ** rng.integers(0, 7, (300, 1))).astype(np.int64)
    r = hn.Rotation.of(q.T.astype(float) @ q.astype(float))
    y, left, length = r.turned(q)
    exact = (q.astype(object) @ q.T.astype(object)).astype(float)
    for n, k in enumerate(r.levels):
        gap = np.outer(left[n], left[n]) + r.slack * np.outer(length, length)
        assert (np.abs(y[:, :k] @ y[:, :k].T - exact) <= gap).all()
    assert r.slack < 1e-10


@pytest.mark.parametrize("kind", ["full", "graded", "few", "one"])
def test_whiten(spark, kind):
    rng = np.random.default_rng(4)
    rows = vectors(rng, 150) if kind != "one" else vectors(rng, 150)[-4:-3]
    if kind == "graded":  # variances over ten orders of magnitude
        rows = [(r[0], None if r[1] is None or len(r[1]) != 12 else [float(np.float32(c * 10.0 ** (j / 2))) if c is not None and abs(c) < 1e9 else None for j, c in enumerate(r[1])], *r[2:]) for r in rows]
    if kind == "few":  # an entry that never changes, two that always agree
        rows = [(r[0], None if r[1] is None or len(r[1]) != 12 else [0.5, r[1][1], r[1][1], *r[1][3:]], *r[2:]) for r in rows]
    df = whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).cache()
    got = df.toPandas()
    kept = [(r[0], np.floor(64 * np.array(r[1], np.float64)).astype(object) + 10**6) for r in rows if fit(r[1], below=1e13)]
    assert len(got) == 12 * len(kept)
    points = sorted({tuple(int(c) for c in x) for _, x in kept})
    n = len(points)
    sums = [sum(p[j] for p in points) for j in range(12)]
    assert (got.n == n).all()
    exact = [(i, sum((n * int(c) - s) ** 2 for c, s in zip(x, sums))) for i, x in kept]
    known = lambda pairs: sorted((-1 if i is None else i, -1 if d is None or d >= 1 << 63 else d) for i, d in pairs)
    assert known((r.vec_id, r.deviation) for r in df.where("component = 1").collect()) == known(exact)
    d = np.array([[(n * c - s) / n for c, s in zip(p, sums)] for p in points])
    v = d.T @ d / n
    e = np.linalg.eigvalsh(v)[::-1]
    live = got.groupby("component").whitened.count() > 0
    assert live.sum() == {"full": 12, "graded": 12, "few": 10, "one": 0}[kind]
    for c in live.index[live]:
        own = got[got.component == c]
        assert np.isclose(own.explained.iloc[0], e[c - 1] / np.trace(v), rtol=1e-4 if kind == "graded" else 1e-9)
    assert (got.identity_error < 1e-6).all()


def test_jacobi_keeps_small_eigenvalues():
    """A scaled matrix of condition 1e20, where a dense solver is lost, against the eigenvalues of its exact square root."""
    rng = np.random.default_rng(2)
    scale = 10.0 ** -np.arange(11)
    b = np.eye(11) + 0.1 * rng.normal(size=(11, 11))
    a = (b @ b.T) * np.outer(scale, scale)
    e, u = jacobi(a)
    exact = np.linalg.svd(scale[:, None] * b, compute_uv=False) ** 2
    assert (np.diff(e) <= 0).all() and np.allclose(u.T @ u, np.eye(11), atol=1e-13)
    assert np.allclose(e[:4], exact[:4], rtol=1e-10) and np.allclose(np.prod(e), np.linalg.det(b) ** 2 * np.prod(scale) ** 2, rtol=1e-10, atol=0)
    assert jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_deviation_beyond_a_long():
    x = np.array([[10**15, 0], [3, 4]], np.int64)
    whole, rest = np.array([0, 0]), np.array([1, 1])
    assert squared(x, 2, whole, rest) == [None, 25 + 49] and squared(x[1:], 2, whole, rest) == [74]


def plain_classes(rows):
    """By comparing all pairs of rows with an id, each id's least text only."""
    text = {}
    for i, t in rows:
        if i is not None:
            t = t if t is None else t.encode()
            text[i] = min([x for x in (text[i], t) if x is not None], default=None) if i in text else t
    sets = {i: set(next(shingle_sets([t], 2, WordHashes())).tolist()) for i, t in text.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            if links(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def minhash_rows():
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    base = [words(n) for n in (1, 2, 3, 6, 11, 40, 150, 400, 3000)]
    out = [None, "", " \t\n"] + [" ".join(b) for b in base for _ in range(2)]
    for b in base[3:]:
        for edits in (1, 1, 2, 4, 8, 12):
            v = list(b)
            for _ in range(edits):
                v[rng.randrange(len(v))] = f"E{rng.randrange(10**6)}"
            out.append(" ".join(v).upper())
    hub = words(120)
    for _ in range(120):  # a group of which most pairs lie about the threshold
        v = list(hub)
        for _ in range(rng.choice((2, 5, 7, 9))):
            v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(v))
    out += [" ".join(hub)] * 30
    return [(1000 - i, t) for i, t in enumerate(out)] + [(990, out[-1]), (990, None), (None, out[-1]), (None, "only here twice"), (None, "only here twice"), (None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_minhash(spark, monkeypatch, small):
    if small:
        for name, value in {"BLOCK": 8, "PAIRS": 3, "STEP": 10, "TURN": 7}.items():
            monkeypatch.setattr(mh, name, value)
    rows = minhash_rows()
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n long, key string, component_id int").repartition(5)
    got = mh.minhash_dedup(df).collect()
    assert len(got) == len(rows)
    classes, sizes = plain_classes(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id != 990:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], classes[r.doc_id], classes[r.doc_id] == r.doc_id)
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id == 990)[0] == (0, 990)
    hub_class = classes[1000 - len(rows) + 7]
    assert sorted(((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None), key=lambda x: (x[0], x[1] or 0)) == [(0, None, True), (2, None, True), (2, None, True), (len({*zip(t.split(), t.split()[1:])}) if (t := rows[-6][1]) else 0, hub_class, False)]


def test_minhash_whole_buckets(spark, monkeypatch):
    """What the first of each bucket leaves is found by comparing whole buckets, in blocks."""
    monkeypatch.setattr(mh, "ORDERS", 1)
    monkeypatch.setattr(mh, "BLOCK", 10)
    rows = [r for r in minhash_rows() if r[0] is not None and r[0] != 990]
    got = {r.doc_id: r.component_id for r in mh.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)[0]


def test_minhash_no_pair_leaves_its_group(spark, monkeypatch):
    """Of a group of sets of which most pairs lie just under the threshold no more comes out than the rows it has, and no link is lost."""
    rng, texts = random.Random(5), []
    for _ in range(100):
        v = [f"h{i}" for i in range(400)]
        for at in rng.sample(range(1, 399, 2), 13):
            v[at] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(v))
    rows, seen = list(enumerate(texts)), []
    rest = mh._rest

    def counted(keyed, *more):
        out = rest(keyed, *more)
        seen.append((keyed.select("doc_id").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(mh, "_rest", counted)
    got = {r.doc_id: r.component_id for r in mh.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)[0]
    assert len(set(got.values())) > 20 and seen[0][1] < seen[0][0]


def test_minhash_of_nothing(spark):
    assert mh.minhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in mh.minhash_dedup(spark.createDataFrame([(5, None)], "doc_id long, text string")).collect()] == [(5, 0, 5, True)]


def test_signatures_agree_as_sets_do():
    """Shares of equal minima come near the similarity of the sets, small sets too."""
    rng, (a, b) = np.random.default_rng(0), mh.universal(mh.BANDS * mh.WIDTH)
    for n in (5, 50, 5000):
        got = []
        for _ in range(20):
            u = rng.integers(0, 1 << 63, n + n // 5 + n // 5, dtype=np.uint64)
            got.append((mh.minima(u[: n + n // 5], a, b) == mh.minima(u[n // 5 :], a, b)).mean())
        want = n / (n + 2 * (n // 5))
        assert abs(np.mean(got) - want) < 0.04
