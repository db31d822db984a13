"""Flags of required literals, a text at a time."""

import tracemalloc

import pyarrow as pa

from wordtide.operators import audit


def test_flags_hold_one_text_at_a_time():
    texts = pa.array([("x" * 100_000 + "é", None, "", "Cookie " + "y" * 100_000)[k % 4] for k in range(400)])  # 20 MB
    run = audit.flagged(["cookie", r"\d+", "é|z"])
    tracemalloc.start()
    found = list(run(iter([texts.slice(0, 0), texts.slice(0, 200), texts.slice(200)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in found] == [0, 200, 200] and peak < 2_000_000
    want = [[False, True, True], [False, True, False], [False, True, False], [True, True, False]]
    assert [row for x in found for row in x.to_pylist()] == want * 100
    assert next(audit.flagged([])(iter([texts.slice(0, 2)]))).to_pylist() == [[], []]
