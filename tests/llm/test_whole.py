"""The whole job: every unit, rule, item and row counts, by brute force."""

import hashlib
import random
from collections import Counter
from re import _parser

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F
from wordtide.llm import classifier, decontamination, licenses, linejoin, minhash, mixing, mjpeg, substring, warc
from wordtide.llm.license_rules import RULES
from wordtide.llm import queries as q

SF = "/root/testdata/sf0.001"


def texts():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def repeated(rows, least=substring.PASSAGE_WORDS):
    """{row: (removed lines, removed runs of sentences, passages)} of rows (doc_id, text), each a document, in their order."""
    norm = lambda x: b" ".join(x.encode().lower().split())
    seen, holders, out = set(), {}, {}
    pieces = {k: [(m.start(), m.end(), norm(m.group())) for m in substring._SENTENCE.finditer(text) if norm(m.group())] for k, (_, text) in enumerate(rows)}
    for k in pieces:
        for piece in pieces[k]:
            holders.setdefault(piece[2], []).append(k)
    for k, (_, text) in enumerate(rows):
        at, lines = 0, []
        for line in text.split("\n"):
            if (body := norm(line)) in seen and body:
                lines.append((at, at + len(line)))
            seen.add(body)
            at += len(line) + 1

        def runs(wanted, own=pieces[k]):
            found, run = [], []
            for piece in [*own, None]:
                if piece and wanted(piece[2]):
                    run.append(piece)
                elif run:
                    n = sum(len(p[2].split()) for p in run)
                    found += [(run[0][0], run[-1][1], n)] if n >= least else []
                    run = []
            return found

        out[k] = (lines, runs(lambda b, k=k: holders[b][0] < k), runs(lambda b: len(set(holders[b])) > 1))
    return out


def test_substring_removes_every_repeat(spark):
    want = repeated(texts())
    assert any(lines for lines, *_ in want.values()) and any(runs for _, runs, _ in want.values())
    rows = {r["doc_id"]: r for r in q.op5_substring(spark, SF).collect()}
    for k, (doc_id, text) in enumerate(texts()):
        lines, later, passages = want[k]
        r = rows[doc_id]
        assert [tuple(p) for p in r["passages"]] == passages and r["n_passages"] == len(passages)
        gone = {i for a, b in lines + [x[:2] for x in later] for i in range(a, b) if text[i] != "\n"}
        assert {i for a, b in r["removed"] for i in range(a, b)} == gone and r["n_removed"] == len(r["removed"])
        left = "".join(c for i, c in enumerate(text) if i not in gone)
        assert r["text"].split() == left.split() and (r["removed"] or r["text"] == text)


def test_passage_within_lines(spark):
    """A passage put into the middle of lines is found in all documents that hold it and stays in the first only."""
    draw = random.Random(8)
    prose = lambda n: " ".join(draw.choice("abcdefghij") + str(draw.randrange(10**6)) + ("." if k % 9 == 8 else "") for k in range(n))
    passage = prose(63)
    rows = [(k, f"{prose(20)}\n{prose(7)} {passage} {prose(15)}\nshort line" if k % 3 == 0 else prose(60) + "\nshort line") for k in range(12)]
    for hot in (2, 10**9):
        found = {r["doc_id"]: r for r in substring.drop_repeats(spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id bigint, text string, passages int, h1 string"), hot=hot).collect()}
        assert {k for k, r in found.items() if r["passages"]} == {0, 3, 6, 9} and found[1]["h1"] == "x"
        last = passage.split(". ")[-1]
        assert [last in found[k]["text"] for k in (0, 3, 6, 9)] == [True, False, False, False]
        assert all(r["text"].endswith("short line") == (k == 0) for k, r in found.items())


def test_substring_edges(spark):
    docs = spark.createDataFrame([(None, "one line"), (None, "one line"), (2, "one line"), (2, "Other\none  LINE"), (3, None), (4, ""), (5, "\n\n")], "doc_id bigint, text string")
    rows = sorted(map(str, (tuple(r) for r in substring.drop_repeats(docs).select("doc_id", "text", "n_removed").collect())))
    assert rows == sorted(map(str, [(None, "", 1), (None, "", 1), (2, "one line", 0), (2, "Other", 1), (3, None, 0), (4, "", 0), (5, "\n\n", 0)])) or rows == sorted(map(str, [(None, "", 1), (None, "", 1), (2, "", 1), (2, "Other\none  LINE", 0), (3, None, 0), (4, "", 0), (5, "\n\n", 0)]))
    paragraphs = spark.createDataFrame([(1, "a b\nc\n\nd"), (2, "x\n \nA  b\nc")], "doc_id bigint, text string")
    assert [tuple(r) for r in substring.drop_repeats(paragraphs, kind="paragraph").select("doc_id", "text").orderBy("doc_id").collect()] == [(1, "a b\nc\n\nd"), (2, "x")]
    assert substring.drop_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2, 10**9])
def test_substring_hot_units(spark, hot):
    docs = spark.createDataFrame([(k, f"Amen.\nline {k}\n amen. \n\nline {k % 3}") for k in range(20)], "doc_id bigint, text string")
    gone = {(r["doc_id"], r["unit"]) for r in substring.repeats(docs, hot=hot).collect()}
    assert gone == {(k, u) for k in range(20) for u in (0, 2, 4)} - {(0, 0)}


@pytest.mark.parametrize(("hot", "blocks"), [(3, {"block_rows": 3, "block_words": 10}), (10**9, {})])
def test_lines_of_any_size(spark, hot, blocks):
    draw = random.Random(5)
    rows = [(k, "\n".join(" ".join(draw.choices("abcdefgh", k=draw.randint(0, 6))) for _ in range(5))) for k in range(60)]
    lines = [(k, n, frozenset(line.split())) for k, text in rows for n, line in enumerate(text.split("\n")) if line.split()]
    want = {(k, n): any(4 * len(x & y) >= 3 * len(x | y) for *_, y in lines[:at]) for at, (k, n, x) in enumerate(lines)}
    assert {len(x) for *_, x in lines} == {1, 2, 3, 4, 5, 6} and 0 < sum(want.values()) < len(want)
    links = Counter((k, n) for k, n, x in lines for y in {y for *_, y in lines} if x != y and 4 * len(x & y) >= 3 * len(x | y))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = linejoin.decisions(frame, hot=hot, **blocks)[1].collect()
    assert {(r["doc_id"], r["line"]) for r in found if r["removed"]} == {k for k, v in want.items() if v}
    assert {(r["doc_id"], r["line"]): r["n_links"] for r in found if r["n_links"]} == dict(links)
    counted = {r["doc_id"]: r for r in linejoin.line_dedup(frame).collect()}
    for k, text in rows:
        assert counted[k]["n_lines"] == sum(own == k for own, *_ in lines) and counted[k]["n_links"] == sum(v for (own, _), v in links.items() if own == k)
        assert [text[r["start"] : r["stop"]] for r in counted[k]["removed"]] == [text.split("\n")[n] for (own, n), v in want.items() if own == k and v]


def test_lines_of_long_and_odd_texts(spark):
    """Near lines of many sizes, words of any length, letters of several bytes, form feeds, and lines longer than the filters tell apart."""
    draw = random.Random(6)
    words = ["\u00e9t\u00e9", "x" * 600, "A", "\u4e2d\u6587", *(f"w{k}" for k in range(400))]
    rows = []
    for k in range(40):
        lines = []
        for size in (3, 8, 30, 120):
            base = draw.sample(words, size)
            lines += [" ".join(base), "\t".join(base[1:]) + "\x0c", " ".join([*base[: size - size // 9], "new"]).upper()]
        rows.append((k, "\n".join(draw.sample(lines, 8)) + "\n\n  "))
    rows += [(100, " ".join(f"v{k}" for k in range(40_000))), (101, " ".join(f"v{k}" for k in range(2_000, 40_000))), (102, None), (103, ""), (None, rows[0][1]), (5, rows[5][1])]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    units = sorted([(k, n, frozenset(lower(line).encode().split())) for k, text in {(k if k is not None else 10**9, t) for k, t in rows} for n, line in enumerate((text or "").split("\n")) if line.split()], key=lambda x: x[:2])
    want = {(k, n) for at, (k, n, x) in enumerate(units) if any(4 * len(x & y) >= 3 * len(x | y) for *_, y in units[:at] if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)))}
    found = linejoin.decisions(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))[1].where("removed").collect()
    assert {(r["doc_id"] if r["doc_id"] is not None else 10**9, r["line"]) for r in found} == want and (101, 0) in want and 20 < len(want) < len(units)


def test_large_group_of_near_lines(spark, monkeypatch):
    """A group of some hundreds of lines that all but match: blocks of any size count the same links."""
    draw = random.Random(12)
    base = [f"w{k}" for k in range(24)]
    rows = [(k, " ".join([*draw.sample(base, 21), *(f"n{draw.randrange(40)}" for _ in range(draw.randrange(4)))])) for k in range(300)]
    sets = {t: frozenset(t.split()) for _, t in rows}
    distinct = set(sets.values())
    want = {k: sum(x != sets[t] and 4 * len(x & sets[t]) >= 3 * len(x | sets[t]) for x in distinct) for k, t in rows}
    gone = {k for at, (k, t) in enumerate(rows) if any(4 * len(sets[t] & sets[u]) >= 3 * len(sets[t] | sets[u]) for _, u in rows[:at])}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    for few, blocks in ((24, {}), (10**9, {}), (2, {"block_rows": 40, "block_words": 900})):
        monkeypatch.setattr(linejoin, "_FEW", few)
        monkeypatch.setattr(linejoin, "PACKED_ROWS", 70 if blocks else 10**6)
        found = linejoin.decisions(frame, **blocks)[1].collect()
        assert {r["doc_id"]: r["n_links"] for r in found if r["n_links"]} == {k: v for k, v in want.items() if v} and {r["doc_id"] for r in found if r["removed"]} == gone
    assert max(want.values()) > 100 and min(want.values()) < 20


def test_word_hashes_split_like_python():
    draw = random.Random(1)
    texts = ["".join(draw.choices("ab\u00e9 \t\r\x0b\x1c\n\x00Z", k=draw.randint(0, 60))).encode() for _ in range(200)]
    lines = linejoin.lines_of(texts)
    got = {}
    for word, line in zip(lines.word.tolist(), lines.line.tolist(), strict=True):
        got.setdefault((int(lines.text[line]), int(lines.number[line])), []).append(word)
    want = {(k, n): x.lower().split() for k, t in enumerate(texts) for n, x in enumerate(t.split(b"\n")) if x.split()}
    assert got.keys() == want.keys()
    name = {}
    assert all(len(got[k]) == len(want[k]) and all(name.setdefault(w, h) == h for w, h in zip(want[k], got[k], strict=True)) for k in want)
    assert len(set(name.values())) == len(name)
    assert all(texts[t][a:b] == texts[t].split(b"\n")[n] for t, n, a, b in zip(lines.text, lines.number, lines.start, lines.stop, strict=True))


def strings(pattern):
    """All strings that a rule's pattern matches."""

    def seq(items):
        out = {""}
        for op, arg in items:
            match str(op):
                case "LITERAL":
                    new = {chr(arg)}
                case "IN":
                    new = {chr(c) for kind, v in arg for c in (range(v[0], v[1] + 1) if str(kind) == "RANGE" else [v])}
                case "SUBPATTERN":
                    new = seq(arg[3])
                case "BRANCH":
                    new = set().union(*map(seq, arg[1]))
                case "MAX_REPEAT":
                    assert arg[:2] == (0, 1)
                    new = {""} | seq(arg[2])
                case "ASSERT_NOT":
                    new = {""}
            out = {a + b for a in out for b in new}
        return out

    return seq(_parser.parse(pattern))


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.pattern)
def test_licence_gate_drops_no_match(rule):
    assert [x for x in strings(rule.pattern) if not set(x.split()) & set(rule.keywords.split())] == []


def test_licence_gated_against_ungated(spark):
    texts = ["LGPLv3", "LGPLv2.1", "GPL3", "GPL2 only", "AGPL3", "common public licence 1.0", "Permission is hereby granted, free of charge, to any person obtaining a copy", "Mit License, no gate", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["labels"] for r in licenses.licenses(docs).collect()}
    # Every word of the texts opens every rule.
    every = " ".join(sorted({w for t in texts for w in t.lower().replace(",", " ").replace(".", " ").split()}))
    ungated = {r["doc_id"]: r["labels"] for r in licenses.licenses(docs, [r._replace(keywords=every) for r in RULES]).collect()}
    assert found == ungated
    assert [found[k] for k in range(9)] == ["lgpl-3.0", "lgpl-2.1", "gpl-3.0", "gpl-2.0", "agpl-3.0", "cpl-1.0", "mit", "mit", ""]


def test_near_items(spark):
    draw = random.Random(3)
    docs = [(k, " ".join(draw.choices("abcdef", k=draw.randint(0, 9)))) for k in range(40)]
    bench = [(k, " ".join(draw.choices("abcdefg", k=draw.randint(1, 6)))) for k in range(30)]
    docs += [(40, "one two"), (41, "three four"), (42, "four x three two one")]
    bench += [(30, "one two three four")]

    def near(text, item, size=4, slop=1):
        words, own = text.split(), item.split()
        windows = [own[at : at + size] for at in range(max(1, len(own) - size + 1))]
        return any(Counter(w) <= Counter(words[at : at + len(w) + slop]) for w in windows for at in range(len(words)))

    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    found = {r["doc_id"]: r for r in decontamination.contamination(frame, spark.createDataFrame(bench, "item_id bigint, text string"), window=4, slop=1).collect()}
    assert {d: set(r["near_items"]) for d, r in found.items()} == {d: {str(i) for i, item in bench if near(text, item)} for d, text in docs}
    assert all(set(r["items"]) <= set(r["near_items"]) for r in found.values()) and found[42]["near_items"] == ["30"]


def test_near_query(spark):
    rows = q.op1_near(spark, SF).collect()
    assert all(r["n_near_items"] >= r["n_items"] for r in rows) and any(r["n_near_items"] for r in rows)


def test_mixing_converges_on_soft_posteriors():
    draw = np.random.default_rng(1)
    logits = draw.normal(0, 1, (20_000, 3))
    domain = draw.choice(3, 20_000, p=[0.985, 0.01, 0.005])
    logits[np.arange(20_000), domain] += 1
    posterior = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    tokens, shares = draw.integers(1, 2000, 20_000).astype(float), np.array([0.94, 0.03, 0.03])
    sums = lambda steps: mixing.sums_of(tokens, posterior, steps)
    steps, now, targets, _ = mixing.solve(sums, shares)
    assert np.abs(now - targets).max() <= mixing.TOLERANCE * tokens.sum()
    assert np.allclose((tokens * mixing.replayed(posterior, steps)[0]) @ posterior, now)
    with pytest.raises(RuntimeError, match="not converged"):
        mixing.solve(sums, shares, max_rounds=2)


def test_mixing_out_of_reach_is_least_squares():
    sums = lambda steps: mixing.sums_of(np.ones(50), np.full((50, 3), 1 / 3), steps)
    assert np.allclose(mixing.solve(sums, np.array([0.94, 0.03, 0.03]))[1], 50 / 3)


def test_mixing_by_brute_force():
    """Against nonnegative least squares by plain descent over every rate, with targets in reach and out of it."""
    draw = np.random.default_rng(4)
    tokens = draw.integers(1, 9, 40).astype(float)
    posterior = draw.dirichlet([2, 1, 1], 40)
    for shares in ([0.5, 0.25, 0.25], [0.8, 0.1, 0.1], [1.0, 0.0, 0.0]):
        steps, now, targets, _ = mixing.solve(lambda steps: mixing.sums_of(tokens, posterior, steps), np.array(shares))
        gram = np.linalg.inv((posterior * tokens[:, None]).T @ posterior / tokens.sum())
        rates = np.ones(40)
        for _ in range(60_000):
            rates = np.maximum(rates - posterior @ gram @ ((tokens * rates) @ posterior - targets) / tokens.sum(), 0)
        error = lambda totals: (totals - targets) @ gram @ (totals - targets) / tokens.sum() ** 2  # noqa: B023, E731
        assert error(now) <= error((tokens * rates) @ posterior) + 1e-8
        assert (mixing.replayed(posterior, steps)[0] >= 0).all()


def test_clean_row_of_null_id_stays(spark):
    rows = [(None, "a b c leak leak d"), (None, "clean words"), (None, None), (1, "clean words"), (2, "x leak leak"), (2, "same id, clean")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = decontamination.drop_contaminated(docs, spark.createDataFrame([(1, "leak leak")], "item_id bigint, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [rows[1], rows[2], rows[3], rows[5]]))


def test_sample_is_of_documents_that_are_there(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(3)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, label int")
    monkeypatch.setattr(classifier, "train", lambda docs, of, n, buckets, **_: ([d[0].tolist() for d in docs], of))
    model = classifier.Classifier.fit(docs, labels, 2, max_docs=3)
    assert model.per_bucket == [classifier.features(f"text {k}", classifier.BUCKETS)[0].tolist() for k in range(3)]
    assert model.bias == [0, 1, 0] and model.seen.tolist() == [True, True]


def test_mixing_without_examples_of_a_domain(spark):
    docs = spark.createDataFrame([(k, ("alpha beta " if k % 3 else "gamma delta ") * 20) for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(40)], "doc_id bigint, label string")
    rows = mixing.mix(docs, labels, {"a": 0.4, "b": 0.4, "c": 0.2}).collect()
    posterior, tokens, rate = (np.array([r[c] for r in rows]) for c in ("__probabilities", "__n_words", "rate"))
    assert (posterior[:, 2] == 0).all()
    assert np.allclose((tokens * rate) @ posterior / tokens.sum(), [0.5, 0.5, 0], atol=2e-3)


def jaccard_components(rows):
    """{doc_id: component} by brute force, over every text of a doc_id."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").lower().split()
        own = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        sets.setdefault(doc_id, []).append(own)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in ids}


def test_near_copies_of_all_sizes(spark):
    """Chains of edits from sets of a few shingles to hundreds, around the threshold: no link is lost."""
    draw = random.Random(11)
    rows = []
    for size in (1, 4, 5, 7, 8, 12, 20, 30, 36, 40, 48, 60, 150, 400):
        for _ in range(12):
            words = draw.choices([f"w{k}" for k in range(3000)], k=size)
            for _ in range(6):
                rows.append((len(rows), " ".join(words)))
                at = draw.randrange(len(words))
                words = words[:at] + ([draw.choice("xyz") + str(draw.randrange(99))] if draw.random() < 0.7 else []) + words[at + 1 :] or ["one"]
    found = {r["doc_id"]: r["component_id"] for r in minhash.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = jaccard_components(rows)
    assert found == want and 50 < len(set(want.values())) < len(rows) - 200


def test_template_texts_are_not_merged(spark):
    """Many texts of one template just below the threshold, and a few links among them."""
    draw = random.Random(2)
    shared = [f"t{k}" for k in range(120)]
    rows = [(k, " ".join(shared + [f"u{draw.randrange(10**6)}" for _ in range(24)])) for k in range(150)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(0, 150, 10)]
    found = {r["doc_id"]: r["component_id"] for r in minhash.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == jaccard_components(rows)


def test_one_id_with_two_texts(spark):
    x, y = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(1, x), (1, y), (2, y + " more"), (3, x + " more"), (4, None), (5, "")]
    found = {(r["doc_id"], r["component_id"]) for r in minhash.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}


def test_parity_is_a_lower_bound():
    draw = np.random.default_rng(3)
    for n in (3, 50, 700):
        x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], draw.integers(0, 2**63, n).astype(np.uint64)]))
        for bits in (64, 1024):
            differing = sum(int(v).bit_count() for v in (minhash.parity(x, bits) ^ minhash.parity(y, bits)).view(np.uint64))
            assert differing <= len(np.setxor1d(x, y))
        wide = minhash.parity(x, 2048)
        assert (wide[:16] ^ wide[16:] == minhash.parity(x, 1024)).all()


def test_several_blocks_and_long_items(spark, monkeypatch):
    """Blocks of a few words, items cut into chunks and one text in several partitions: the rows are those of one block."""
    monkeypatch.setattr(decontamination, "CHUNK", 4)
    draw = random.Random(9)
    docs = [(k % 30, " ".join(draw.choices("abcd", k=draw.randint(0, 40)))) for k in range(40)] + [(100, "d c b a"), (100, "d c b a")]
    bench = spark.createDataFrame([(k, " ".join(draw.choices("abcd", k=draw.randint(0, 30)))) for k in range(12)] + [(12, "d c b a")], "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7, "text", F.rand(1))
    rows = lambda **o: sorted(map(str, decontamination.contamination(frame, bench, window=4, slop=1, **o).collect()))
    one, many = rows(), rows(block_words=20)
    assert one == many and len(one) == len(docs)

    def windows(text):
        w = text.split()
        return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()

    want = sorted((d, sum(bool(windows(t) & windows(b["text"])) if len(b["text"].split()) >= 4 else any(tuple(b["text"].split()) == tuple(t.split()[k : k + len(b["text"].split())]) for k in range(len(t.split()))) and bool(b["text"]) for b in bench.collect())) for d, t in docs)
    assert sorted((r["doc_id"], r["n_items"]) for r in decontamination.contamination(frame, bench, window=4, block_words=20).collect()) == want


def test_archive_is_whole(spark, tmp_path):
    html = ["<p>one</p>" * 30, None, "", "<p>one</p>" * 30, "short", "short", "<p>\u00e9</p>" * 20, "<p>one</p>" * 30]
    rows = [(3, "u3", html[0]), (4, None, html[1]), (5, "u\n5", html[2]), (2, "u2", html[3]), (6, "u6", html[4]), (7, "u7", html[5]), (None, "u8", html[6]), (2, "u2", html[7])]
    archive = warc.write_archive(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, payload string"))
    found = warc.read_records(spark, archive).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found) == sorted(
        [("3", "revisit", 2, 300), ("4", "response", None, 0), ("5", "response", None, 0), ("2", "response", None, 300), ("2", "response", None, 300), ("6", "response", None, 5), ("7", "response", None, 5), ("None", "response", None, 180)]
    )
    records = {r["page_id"]: bytes(r["record"]) for r in warc.reconstruct(spark, archive).collect()}
    for page_id, body in ((2, html[0]), (4, ""), (6, "short"), (None, html[6])):
        head, block = records[page_id].split(b"\r\n\r\n", 1)
        n = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert block[n:] == b"\r\n\r\n" and block[:n].split(b"\r\n\r\n", 1)[1] == body.encode()
        assert b"WARC-Payload-Digest: sha256:" + hashlib.sha256(body.encode()).hexdigest().encode() in head
    assert b"identical-payload-digest" in records[3] and html[0].encode() not in records[3] and b"u%0A5" in records[5]
    assert warc.read_records(spark, warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"))).count() == 0


def test_missing_payload_stops_the_query(spark):
    archive = warc.write_archive(spark.createDataFrame([(k, "u", f"page {k}") for k in range(4)], "page_id bigint, url string, html string"))
    kept = spark.read.parquet(archive.payloads).where("decode(payload, 'UTF-8') <> 'page 2'").collect()
    spark.createDataFrame(kept, "digest string, payload binary").write.mode("overwrite").parquet(archive.payloads + "-less")
    with pytest.raises(Exception, match="no payload"):
        warc.read_records(spark, warc.Archive(archive.payloads + "-less", archive.records)).collect()


def swept(found):
    """Which places stay, each held against all others."""
    inside = lambda x, y: y["start"] <= x["start"] and x["stop"] <= y["stop"] and y["priority"] >= x["priority"]
    same = lambda x, y: (x["start"], x["stop"], x["priority"]) == (y["start"], y["stop"], y["priority"])
    return [x for i, x in enumerate(found) if not any(i != j and inside(x, y) and (not same(x, y) or (y["rule"], j) < (x["rule"], i)) for j, y in enumerate(found))]


def test_licence_suppression(spark):
    draw = random.Random(4)
    pieces = ["mit license", "gpl v3", "apache license 2.0", "gnu general public license version 2 or later", "cc by sa 4.0", "the", "GNU LESSER GENERAL PUBLIC LICENSE v2.1", "bsd 3 clause license", "mpl 2.0", "\u212a licen\u0130e", "public domain", ""]
    docs = [(k, " ".join(draw.choices(pieces, k=draw.randint(0, 40)))) for k in range(60)]
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(rows) == 60 and sum(len(r["found"]) - len(r["kept"]) for r in rows) > 100
    for r in rows:
        assert sorted(map(str, r["kept"])) == sorted(map(str, swept(r["found"])))


def test_licence_many_matches(spark):
    text = "mit license " * 20_000
    row = licenses.licenses(spark.createDataFrame([(1, text), (2, "M\u0130T license"), (3, "\u212ait license")], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert (row[0]["n_base"], row[0]["first_word"], row[0]["last_word"]) == (20_000, 0, 39_998)
    assert [r["n_base"] for r in row[1:]] == [0, 0] and [r["n_words"] for r in row[1:]] == [2, 2]


def test_clip_rows(spark):
    parts = [b"\x00" * 576 * 20, b"\xc8" * 576 * 15, b"a" * 576 * 9]
    media = mjpeg.Encoder().encode([b"".join(parts), parts[0]])
    rows = mjpeg.clip_rows(mjpeg.features(spark.createDataFrame([(1, media[0]), (2, media[1])], "doc_id bigint, media binary"))).orderBy("doc_id", "clip").collect()
    assert [(r["doc_id"], r["clip"], r["first_frame"], r["n_frames"]) for r in rows] == [(1, 0, 0, 20), (1, 1, 20, 15), (1, 2, 35, 9), (2, 0, 0, 20)]
    assert [(r["start_s"], r["stop_s"]) for r in rows][:2] == [(0.0, 20 / 24), (20 / 24, 35 / 24)]


def test_sorted_words():
    draw = np.random.default_rng(4)
    for n, lines, words in ((0, 1, 1), (1, 1, 1), (5000, 300, 40), (5000, 1, 3), (3000, 3000, 9)):
        line = np.sort(draw.integers(0, lines, n))
        vocabulary = draw.integers(0, 2**63, words).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        if words == 40:
            vocabulary[1::2] = vocabulary[::2] ^ np.uint64(8)  # pairs that agree in the upper bits
        word = vocabulary[draw.integers(0, words, n)]
        rank = (word & np.uint64(linejoin.TABLE - 1)).astype(np.uint32)
        for order, key in ((linejoin._sorted_words(line, word), None), (linejoin._sorted_words(line, word, rank), rank)):
            want = sorted({(a, 0 if key is None else int(k), b) for a, k, b in zip(line.tolist(), rank.tolist(), word.tolist(), strict=True)})
            assert [(int(line[i]), 0 if key is None else int(key[i]), int(word[i])) for i in order] == want
