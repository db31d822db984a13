"""Levels of counts, and what the driver gets of them."""

import numpy as np

from wordtide.llm import linejoin


def test_levels():
    counts = np.sort(np.concatenate([np.arange(5000), np.random.default_rng(1).integers(0, 2**50, 5000), [2**52]]))
    levels = linejoin.levels(counts).astype(np.int64)
    assert (np.diff(levels) >= 0).all() and (levels[counts < 2048] == counts[counts < 2048]).all()
    apart = counts[1:] > counts[:-1] * (1 + 2.0**-9)
    assert (np.diff(levels)[apart] > 0).all()


def test_rarity_is_small(spark):
    """The driver gets two bytes an entry of the table, the entries of very many occurrences and their blocks."""
    texts = [(k, f"often a{k} b{k % 50}\nonce{k} often\n" + "many " * (k % 3)) for k in range(300)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4).selectExpr("doc_id", "doc_id AS mark", "text")
    described = frame.mapInArrow(linejoin._describe(1), linejoin.DESCRIBED)
    order = linejoin.rarity(described, 200)
    counts = np.zeros(linejoin.TABLE, np.int64)
    for _, text in texts:
        np.add.at(counts, (linejoin.lines_of([text.encode()]).word & np.uint64(linejoin.TABLE - 1)).astype(np.int64), 1)
    assert order.level.nbytes == 2 * linejoin.TABLE and (order.level == linejoin.levels(counts)).all()
    assert order.hot.tolist() == np.flatnonzero(counts > 200).tolist() and sorted(order.blocks.tolist()) == [2, 3] and order.words == counts.sum()
