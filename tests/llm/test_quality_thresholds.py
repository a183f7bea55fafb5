"""Thresholds of the quality judge against all labelled rows at once."""

import numpy as np

from wayfold.llm import quality


def best(scores, good, max_loss):
    """The threshold by trying every score."""
    found, at = (0.0, float("inf")), np.unique(scores)
    for low, high in zip(at, [*at[1:], np.inf]):
        lost, caught = 1 - (scores[good] <= low).mean(), 1 - (scores[~good] <= low).mean()
        if lost <= max_loss and caught - quality.COST * lost > found[0] + 1e-12:
            found = (caught - quality.COST * lost, (low + high) / 2)
    return found[1]


def test_all_labelled_rows_set_the_thresholds(spark):
    rng, n = np.random.default_rng(6), 26_000
    words = rng.integers(60, 2000, n)
    bad = rng.random(n) < 0.1
    counts = np.stack([words, words * rng.uniform(3.5, 6.5, n) + bad * words * 2 * rng.random(n), rng.integers(0, 4, n) + bad * words // 4, rng.integers(0, 3, n), words * rng.uniform(0, 0.05, n)], axis=1).astype(int)
    counted = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(counts)], "doc_id long, " + ", ".join(f"{k} long" for k in quality.COUNTS)).cache()
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)], "doc_id long, quality int")
    judge = quality.fit(counted, labels)
    scores = judge.scores(counts.astype(float))
    assert np.isfinite(judge.most).any()
    assert np.allclose(judge.most, [best(s, ~bad, 0.001) for s in scores])
    # each tree of each forest has rows of its own, as many as there are
    assert len(judge.forests[0].trees) * judge.forests[0].sample == quality.TREES * quality.PART <= n
