"""Scores by runs of texts."""

import numpy as np
import pyarrow as pa

from wordtide.llm import classifier


def test_scores_of_runs(spark, monkeypatch):
    monkeypatch.setattr(classifier, "_RUN_WORDS", 7)
    draw = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "ñandú", "x" * 50]
    texts = [None, "", " \n"] + [" ".join(draw.choice(vocabulary, draw.integers(0, 12))) for _ in range(60)] + [" ".join(draw.choice(vocabulary, 300)), ""]
    runs = list(classifier._runs(pa.array(texts)))
    assert [w for run in runs for w in run] == [(t or "").split() for t in texts] and len(runs) > 20
    for buckets in (1 << 8, 1000):  # a mask, a remainder
        model = classifier.Classifier(draw.normal(size=(buckets, 3)).astype(np.float32), np.array([0.5, -1, 0], np.float32), np.ones(3, bool))
        rows = model.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)).collect()
        assert len(rows) == len(texts)
        for row in rows:
            ids, shares = classifier.features(row["text"], buckets)
            z = model.bias + shares.astype(float) @ model.per_bucket[ids]
            p = np.exp(z - z.max())
            assert np.allclose(row["__probabilities"], p / p.sum(), rtol=1e-5) and row["__n_words"] == len((row["text"] or "").split())
