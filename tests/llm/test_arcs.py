"""A word's arcs are found once, for both recursions."""

import numpy as np

from tessera.llm import lattice


def _sums(model, words):
    sums = [0.0] * len(model.logp)
    for i, w in enumerate(words):
        model.expect(w, 1.0 + i, sums)
    return sums


def test_arcs_of_a_short_word_are_found_once(monkeypatch):
    pieces, byte_ids, own = lattice.vocabulary(lattice.TOKENIZER)
    model = lattice.Lattice(pieces, byte_ids, np.log(np.maximum(own, 1e-300)), 0.0)
    words = ["a", "marginal", "überall", "\U0001f600x", "aaaaaaaa" * 40]
    asked = []
    monkeypatch.setattr(lattice.Lattice, "arcs", lambda self, *a, of=lattice.Lattice.arcs: asked.append(a) or of(self, *a))
    whole = _sums(model, words)
    assert len(asked) == len(words)
    monkeypatch.setattr(lattice, "BLOCK", 5)
    assert np.allclose(whole, _sums(model, words), rtol=1e-12, atol=0)
