import numpy as np

from emberlake.llm import langid


def test_subwords_of_few_texts_are_held_at_once(monkeypatch):
    texts = ["", None, "one two three", "x", "wörter " * 9, "12 34", "y z"] * 20
    table = np.random.default_rng(0).normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    whole = langid._averages(table, texts)
    seen, plain = [], langid.subwords

    def watched(part):
        seen.append(sum(len(t or "") for t in part))
        return plain(part)

    monkeypatch.setattr(langid, "subwords", watched)
    monkeypatch.setattr(langid, "SLICE_CHARS", 100, raising=False)
    assert np.array_equal(langid._averages(table, texts), whole)
    assert max(seen) <= 100 and len(seen) > 10
