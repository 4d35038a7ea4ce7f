"""Words of the toxicity operator that differ only by the marks around them are compared with the landmarks once."""

import numpy as np
import pyarrow as pa

from molquarry.llm import toxicity


def test_marked_words_are_one(monkeypatch):
    scorer = toxicity.Scorer(toxicity.Similarity(["{stupid", "{idiots"]))
    scorer.weights = np.array([1.0, 0.5])
    asked = []
    whole = toxicity.Similarity.__call__
    monkeypatch.setattr(toxicity.Similarity, "__call__", lambda self, words: asked.extend(words) or whole(self, words))
    kept = {}
    texts = ["(stupid) words.", "stupid! 'words' \"stupid\"", "Stupid, words", "s t u p i d"]
    scores = [scorer.document(pa.array([t]), kept) for t in texts]
    assert sorted(w for w in asked if len(w) > toxicity.ORDER) == ["{stupid", "{words"]
    assert scores[0].tolist() == scores[2].tolist() and scores[3][0, 0] > 0.9
    assert np.allclose(scorer.document(pa.array(texts)), np.concatenate(scores))


def test_kernel_in_strips(monkeypatch):
    """The kernel of many rows does not depend on how many it holds at a time."""
    rng = np.random.default_rng(3)
    s, t = rng.integers(95, 104, (200, 14)), rng.integers(97, 104, 9)
    s[s < 97] = -1
    one, own = toxicity.kernel(s, t), toxicity.kernel(s, s)
    monkeypatch.setattr(toxicity, "AT_ONCE", 14 * 14 * 3)
    assert np.allclose(toxicity.kernel(s, t), one) and np.allclose(toxicity.kernel(s, s), own)
