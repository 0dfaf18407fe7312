"""Toxicity's counts, ratios and scores against plain loops over strings; url verdicts where columns of pages clash with those of the result."""

import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity as tox
from tessera.llm.url_filter import url_filter


def strings(text):
    """The distinct character n-grams of a text, by their strings."""
    t = " " + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "") + " "
    return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}


def bucket_of(gram):
    """The bucket of one n-gram: texts gain a space at either end, so it is the one in the middle."""
    inner = tox.grams(gram.encode(), (len(gram),))
    return int(inner[1])


def test_ratios_and_scores_are_what_they_say(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "Ünder", "nasty", "VILE", "x"]
    rows = []
    for i in range(160):
        bad = rng.random() < 0.4
        text = " ".join(rng.choice(vocabulary if bad else vocabulary[:5]) for _ in range(rng.randrange(1, 12)))
        rows.append((i, None if i % 40 == 7 else "" if i % 40 == 9 else text, int(bad)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = {}
    real = tox.ratios

    def watched(counts, p, q):
        seen["counts"], seen["n"], seen["out"] = counts, (p, q), real(counts, p, q)
        return seen["out"]

    models = []
    trained = tox.train
    monkeypatch.setattr(tox, "ratios", watched)
    monkeypatch.setattr(tox, "train", lambda d, l: models.append(trained(d, l)) or models[-1])  # noqa: E741
    got = {r.doc_id: r for r in tox.toxicity(df, labels).collect()}
    learnt = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    assert seen["n"] == (sum(y for _, y in learnt), sum(1 - y for _, y in learnt))
    plain = {}
    for t, y in learnt:
        for g in strings(t):
            plain.setdefault(g, [0, 0])[y] += 1
    # two n-grams may share a bucket; here none do
    at = {g: bucket_of(g) for g in plain}
    assert len(set(at.values())) == len(at)
    want = {at[g]: (p, q) for g, (q, p) in plain.items() if p + q >= 3}
    assert {int(b): (int(p), int(q)) for b, p, q in seen["counts"][["b", "p", "q"]].itertuples(index=False)} == want
    kept, r = seen["out"]
    pos, neg = seen["n"]
    assert len(kept) == len(want)
    for b, ratio in zip(kept.tolist(), r.tolist()):
        p, q = want[b]
        assert ratio == pytest.approx(math.log((p + 0.5) / (pos + 1)) - math.log((q + 0.5) / (neg + 1)))
    # a score is the sum of the weights of a text's distinct n-grams, through the logistic function
    (model,) = models
    assert set(np.flatnonzero(model.weights).tolist()) <= set(kept.tolist())
    for i, t, _ in rows:
        total = model.bias + sum(float(model.weights[bucket_of(g)]) for g in strings(t))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6) and got[i].predicted == (got[i].score >= 0.5)


def test_the_surest_ratios_are_kept(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(tox, "KEPT", 2)
    counts = pd.DataFrame({"b": [9, 4, 6, 1], "p": [50, 1, 30, 0], "q": [1, 0, 2, 50]})
    kept, r = tox.ratios(counts, 60, 60)
    sure = lambda p, q: abs(math.log((p + 0.5) / (q + 0.5))) / math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    order = sorted(counts.itertuples(index=False), key=lambda c: -sure(c.p, c.q))
    assert kept.tolist() == [c.b for c in order[:2]] and r == pytest.approx([math.log((c.p + 0.5) / (c.q + 0.5)) for c in order[:2]])


def test_urls_of_pages_with_clashing_columns(spark):
    """Columns named as the result's, or as those it goes through, are not looked at."""
    link = '<link rel="canonical" href="https://a.net/x">'
    rows = [(1, "https://q.test/a", link), (2, "https://b.org/fr/1", link), (3, None, link), (4, "https://r.test/", None), (4, "https://r.test/", None)]
    more = ("host", "path", "rule", "verdict", "alias_verdict", "own", "name", "component", "ruled", "a", "b", "to", "to_url", "node")
    df = spark.createDataFrame([(*r, *("other.net" for _ in more)) for r in rows], "page_id long, url string, html string, " + ", ".join(f"{m} string" for m in more))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(df).collect()))
    assert got == [(1, "q.test", "/a", None, "allow"), (2, "b.org", "/fr/1", "org/fr/", "allow"), (3, "", "", None, "allow"), (4, "r.test", "/", None, "allow"), (4, "r.test", "/", None, "allow")]
    alone = url_filter(df.where("page_id in (1, 3)")).collect()
    assert {r.page_id: r.verdict for r in alone} == {1: "block", 3: "allow"}
    assert {r.page_id: r.verdict for r in url_filter(df.where("page_id = 4")).collect()} == {4: "allow"}
