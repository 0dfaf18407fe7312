"""Memory and driver lists that must not follow the data."""

import hashlib
import random
import tracemalloc

import numpy as np

from tessera.llm import lattice as lt
from tessera.llm import syncmers as sm


def _lattice():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "bab": 5, "aabba": 6}
    return lt.Lattice(pieces, [7] * 256, np.array([-3.0, -1.0, -2.0, -2.5, -3.0, -1.5, -4.0, -9.0]), -1.0)


def test_blocks_of_a_word_give_the_same_sums(monkeypatch):
    rng = random.Random(3)
    words = ["a", "é", "abab", *("".join(rng.choices("abéx", [5, 5, 1, 1], k=rng.randint(1, 40))) for _ in range(60))]

    def all_of():
        lm, sums = _lattice(), np.zeros(8)
        for w in words:
            lm.expect(w, 3.0, sums)
        return [lm.word(w) for w in words], sums.tolist()

    whole = all_of()
    for block in (1, 3, 7):
        monkeypatch.setattr(lt, "BLOCK", block)
        assert all_of() == whole


def test_a_long_word_takes_little_memory():
    lm, sums = _lattice(), np.zeros(8)
    word = "".join(random.Random(4).choices("ab", k=200_000))
    lm.word("ab")
    tracemalloc.start()
    lm.expect(word, 1.0, sums)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20, peak  # its places, 8 bytes each, and the arcs of a block


def test_parts_of_fingerprints_are_bounded(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["one", "two", "three", "four"], k=rng.randint(0, 60)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(sm.syncmers(docs).collect())
    monkeypatch.setattr(sm, "PARTS", 1)
    few = sm.syncmers(docs, 1)
    assert 4 < few.rdd.getNumPartitions() <= 16 and sorted(few.collect()) == want
    edited = {i: hashlib.sha256((t[: len(t) - len(t) // 4] + rows[(i + 1) % 150][1][: len(t) // 4]).encode()).hexdigest() for i, t in rows}
    assert {r.doc_id: r.edited_sha256 for r in want} == edited
