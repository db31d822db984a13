"""Lines of few words in one large group: results by brute force, and memory that follows the tile, not the square of the rows."""

import resource

import numpy as np

from wordtide.llm import linejoin


def matched(sets, apart):
    """{row: (matches, first)} by Python sets."""
    out = {}
    for x, a in enumerate(sets):
        hit = [y for y, b in enumerate(sets) if apart(x, y) and 100 * len(a & b) >= 75 * len(a | b)]
        if hit:
            out[x] = (len(hit), hit[0])
    return out


def arrays(sets):
    size = np.array([len(s) for s in sets])
    return np.repeat(np.arange(len(sets)), size), np.concatenate([sorted(s) for s in sets]).astype(np.int64), size


def test_matches_of_many_by_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [set(rng.choice(14, size=int(rng.integers(1, 9)), replace=False).tolist()) for _ in range(300)]
    for tile in (1, 700, 10**6):
        monkeypatch.setattr(linejoin, "_TILE", tile)
        own = rng.integers(0, 2, 300)
        x, n, y = linejoin.matches_of_many(*arrays(sets), lambda part: own[part, None] != own)  # noqa: B023
        assert {a: (b, c) for a, b, c in zip(x.tolist(), n.tolist(), y.tolist())} == matched(sets, lambda i, j: own[i] != own[j])  # noqa: B023


def test_many_short_lines_take_little_memory():
    """20,000 lines "posted by user X" and "posted by user": a product of memberships would hold 20,000 squared counts, 1.6 GB at four bytes."""
    n = linejoin.MOST_ROWS
    sets = [{0, 1, 2}, *({0, 1, 2, 3 + k} for k in range(n - 1))]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids = np.arange(n)
    x, count, first = linejoin.matches_of_many(*arrays(sets), lambda part: ids[part, None] != ids)
    assert len(x) == n and count[0] == n - 1 and (count[1:] == 1).all() and (first[1:] == 0).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_many_licence_matches_in_one_text(spark):
    """64,000 places in one text: positions take about n^(4/3) steps, so seconds."""
    from wordtide.llm import licenses

    docs = spark.createDataFrame([(1, "mit license " * 64_000)], "doc_id bigint, text string")
    r = licenses.licenses(docs).select("n_words", "n_base", "first_word", "last_word", "labels").first()
    assert tuple(r) == (128_000, 64_000, 0, 127_998, "mit")


def test_slots_by_an_independent_fill():
    """Each shard's order over the slots as a list; in turn, each takes the first of its own that is free."""
    import hashlib

    from wordtide.llm import sharding

    def order(name, size):
        number = lambda salt: int(hashlib.sha256(f"{salt}:{name}".encode()).hexdigest()[:16], 16)
        offset, stride = number("offset") % size, number("stride") % (size - 1) + 1
        return [(offset + k * stride) % size for k in range(size)]

    for shards, size in ((["a", "b", "c"], 7), ([f"s{k}" for k in range(11)], 101)):
        owner, orders = {}, [order(s, size) for s in shards]
        while len(owner) < size:
            for s, slots in enumerate(orders):
                if len(owner) < size:
                    owner[next(x for x in slots if x not in owner)] = s
        assert sharding.fill_table(shards, size) == [owner[x] for x in range(size)]
