"""Cross-tokenizer alignment, spelling variants and fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wordtide.llm import alignment, variants, weighted
from wordtide.llm import queries as q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, stripe int, key string, bucket int, word string"
ODD = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, "word " * 40_000), (None, "x y"), (5, "   "), (6, " " * 100_000), (7, "<|endoftext|> ▁ ﬁ"), (8, "<|endoftext|><s></s>"), (9, "日本語 ünïcode\n\ttabs"), (None, "x y"), (10, "İ ퟿ \U0001f600")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "w") for r in rows], SCHEMA)


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def aligned(rows):
    """What ``align`` returns, by the file's own tokenizer and dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/piece_bpe_32k.model")
    letters = alignment.byte_alphabet()

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()

    docs, links = [], Counter()
    for doc_id, text in rows:
        groups, linked = [], []
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [of_b(i) for i in ids_b]
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (bytes_a, bytes_b)]
            both, parts = ends[0] & ends[1], []
            for ids, side in ((ids_a, bytes_a), (ids_b, bytes_b)):
                out, now, at = [], [], 0
                for i, x in zip(ids, side):
                    now.append(i)
                    at += len(x)
                    if at in both:
                        out.append(now)
                        now = []
                parts.append(out)
            groups = list(zip(*parts))
            assert len(groups) == len(both)
            linked = [(x[-1], y[-1]) for x, y in groups]
        else:
            ids_a, ids_b = [], []
        links.update(linked)
        docs.append((doc_id, len(ids_a), len(ids_b), groups, linked))
    best = {}
    for (_, y), n in links.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, linked in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(linked), sum(links[p] == best[p[1]] for p in linked), sum(links[p] for p in linked), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark):
    rows = q.op11_alignment(spark, SF).select(*COLUMNS).collect()
    assert sorted(map(tuple, rows), key=repr) == aligned(documents())


def test_alignment_of_odd_texts_in_small_chunks(spark, monkeypatch):
    for name, size in (("CHUNK_DOCS", 7), ("CHUNK_BYTES", 20_000), ("HELD_CELLS", 500), ("SHARE_BYTES", 2_000)):
        monkeypatch.setattr(alignment, name, size)
    rows = ODD + documents()[:20]
    found = alignment.align(frame(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == aligned(rows)
    assert alignment.align(frame(spark, [])).count() == 0


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spelled(rows, least_length=5, least_count=3):
    """What ``variants`` returns, by comparing words of near length that share a deletion."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    shared = {}
    for w in words:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            shared.setdefault(x, set()).add(w)
    close = {w: {v for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for v in shared[x] if near(w, v)} for w in words}
    form = {}
    for w, vs in close.items():
        top = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(close[w]), words.get(form[w])))
    return sorted(out, key=repr)


SPELLED = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants(spark):
    found = q.op12_variants(spark, SF).select(*SPELLED).collect()
    assert sorted(map(tuple, found), key=repr) == spelled(documents())


@pytest.mark.parametrize("block", [7, 100])
def test_variants_in_small_blocks(spark, block):
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choice("aabcé") for _ in range(rng.randint(4, 8))) for _ in range(60))) for k in range(60)]
    long = ["q" * 300, "q" * 299 + "r", "q" * 301, "q" * 65, "q" * 64, "q" * 63 + "z"]
    rows += [(None, " ".join(long * 4)), (None, " ".join(long[:2] * 9)), (200, None), (201, ""), (202, "×÷×÷× " * 5), *ODD]
    found = variants.variants(frame(spark, rows), block=block).select(*SPELLED).collect()
    assert sorted(map(tuple, found), key=repr) == spelled(rows)
    assert variants.variants(frame(spark, [])).count() == 0


def edited(rows):
    """{(doc_id, text): (n_chars, sha256 of the edited text, edited text, next text)} by the order that the docstring gives."""
    digest = lambda r: hashlib.sha256(f"{'null' if r[0] is None else r[0]}:{r[1] or ''}".encode()).digest()
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    out = {}
    for k, (d, t) in enumerate(order):
        follows = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        text = t[: len(t) - n] + follows[:n]
        out[d, t] = (len(t), hashlib.sha256(text.encode()).hexdigest(), text, follows)
    return out


def jaccard(a, b):
    a, b = (Counter(x for x in re.split("[ \t\n\x0b\x0c\r]+", t.lower()) if x) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints(spark):
    want = edited(documents())
    texts = {d: t or "" for d, t in documents()}
    rows = q.op13_fingerprints(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    prints, errors = {}, []
    for r in rows:
        n, sha, text, follows = want[r["doc_id"], texts[r["doc_id"]]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(text, r["edited_fingerprint"]) == r["edited_fingerprint"]
        errors += [r["near_edited"] - jaccard(texts[r["doc_id"]], text), r["near_next"] - jaccard(texts[r["doc_id"]], follows)]
    assert len(set(prints.values())) == len(set(prints))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.07


def test_collision_rate_is_generalised_jaccard(spark):
    """Pairs of made weights, 4,800 samples each: the rate lies within four standard deviations."""
    rng = random.Random(5)
    for _ in range(3):
        weights = {w: (rng.randint(1, 9), rng.randint(1, 9)) for w in range(12)} | {100: (3, 0), 101: (0, 5)}
        rows = spark.createDataFrame([(w, *x) for w, x in weights.items()], "word bigint, one bigint, two bigint").withColumn("sample", F.explode(F.expr("sequence(0, 4799)")))
        least = [F.min(F.when(F.col(c) > 0, weighted.value(F.col("word"), F.col(c), F.col("sample")))).bitwiseAND(F.lit((1 << 31) - 1)) for c in ("one", "two")]
        rate = rows.groupBy("sample").agg((least[0] == least[1]).alias("same")).agg(F.avg(F.col("same").cast("int"))).first()[0]
        truth = sum(min(x) for x in weights.values()) / sum(max(x) for x in weights.values())
        assert abs(rate - truth) < 4 * (truth * (1 - truth) / 4800) ** 0.5


def test_fingerprints_of_odd_texts(spark):
    rows = [r for r in ODD if r[0] != 6] + [(6, "Aé" * 50)]
    want = edited(rows)
    found = weighted.fingerprints(frame(spark, rows)).collect()
    text = lambda r: next(t or "" for d, t in rows if d == r["doc_id"])
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(d) for d, _ in rows)
    for r in found:
        n, sha, changed, follows = want[r["doc_id"], text(r)]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["fingerprint"] == "") == (not text(r).strip()) and (r["near_edited"] == 1.0 or jaccard(text(r), changed) < 1)
        if not text(r).strip():
            assert r["near_next"] == float(not follows.strip())
    assert weighted.fingerprints(frame(spark, [])).count() == 0
    alone = weighted.fingerprints(frame(spark, [(1, "abcdefgh")])).collect()
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone[0]["near_next"] == 1.0
