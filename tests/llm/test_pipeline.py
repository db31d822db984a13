"""Each stage of the pipeline on its own input, held against brute force; and the whole."""

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_whole import jaccard_components
from wordtide.llm import classifier, mixing, sharding
from wordtide.llm.queries import DOMAIN_WEIGHTS, SHARDS, TABLE_SIZE, table

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
#: Extra columns named like those that operators work with.
CLASHING = "__slot __owner __n_words __probabilities __copy __copies __rate __bad __mark __kept __id __row __found __scored extra slot shard id key component kept n_words rate".split()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def bad_ids(rows):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for (text,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        w = words(text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    return {d for d, t in rows if any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}


def test_quality(spark, docs):
    kept = STAGES["quality"](spark, docs, SF)
    scores = classifier.quality(docs, table(spark, SF, "labels")).collect()
    good = {r["doc_id"] for r in scores if r["score"] >= 0.3}
    assert kept.columns == docs.columns and rows_of(kept) == rows_of(docs.where(F.col("doc_id").isin(*good))) and 0 < len(good) < 200
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    assert sum((d in good) == (q == 1) for d, q in labels.items()) > 0.95 * len(labels)


def test_near_dedup(spark, docs):
    kept = STAGES["near_dedup"](spark, docs, SF)
    want = jaccard_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    roots = {d for d, c in want.items() if d == c}
    assert kept.columns == docs.columns and rows_of(kept) == rows_of(docs.where(F.col("doc_id").isin(*roots))) and len(roots) < 200


def test_decontamination(spark, docs):
    kept = STAGES["decontamination"](spark, docs, SF)
    bad = bad_ids([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert kept.columns == docs.columns and rows_of(kept) == rows_of(docs.where(~F.col("doc_id").isin(*bad))) and 0 < len(bad) < 50


def test_mixing(spark, docs):
    taken = Counter(r["doc_id"] for r in STAGES["mixing"](spark, docs, SF).collect())
    mixed = mixing.mix(docs.select("doc_id", "text"), mixing.label_domains(table(spark, SF, "labels")), DOMAIN_WEIGHTS)
    want = {r["doc_id"]: r["c"] for r in mixed.select("doc_id", mixing.copies(F.col("rate"), F.col("doc_id")).alias("c")).collect()}
    assert taken == Counter({d: c for d, c in want.items() if c})
    totals = {r["domain"]: r for r in mixing.domain_totals(mixed, DOMAIN_WEIGHTS).collect()}
    assert all(abs(totals[d]["mixed_share"] - w) < 2e-3 for d, w in DOMAIN_WEIGHTS.items())


def test_sharding(spark, docs):
    owners = sharding.fill_table(SHARDS, TABLE_SIZE)
    placed = STAGES["sharding"](spark, docs, SF)
    assert placed.columns == [*docs.columns, "slot", "shard"] and placed.count() == docs.count()
    for r in placed.collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, owners[slot])


def test_shards_on_disk(spark, docs, tmp_path):
    sharding.write_shards(STAGES["sharding"](spark, docs, SF), str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(back.select("doc_id", "text", "shard")) == rows_of(STAGES["sharding"](spark, docs, SF).select("doc_id", "text", "shard"))


def test_whole(spark, docs):
    """``run`` is the stages one after the other, each on what its predecessor kept."""
    frame, ids = docs, []
    for _, stage in corpus_pipeline.STAGES:
        frame = spark.createDataFrame(stage(spark, frame, SF).collect(), stage(spark, frame, SF).schema)
        ids.append(frame.select("doc_id").distinct().count())
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(frame) and ids[0] > ids[1] > ids[2] > 100


@pytest.mark.parametrize("name", list(STAGES))
def test_edges(spark, name):
    """Nulls, empty texts, repeated rows, ties, an empty table and extra columns of any name."""
    schema = "doc_id bigint, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING) + ", `a.b` int"
    fill = ["en", *CLASHING, 7]
    prose = " ".join(f"word{k}" for k in range(80))
    rows = [(None, None), (None, "some words here"), (1, prose), (1, prose), (2, ""), (3, "   "), (4, prose + " more"), (5, "x" * 200_000), (6, "word " * 50_000)]
    frame = spark.createDataFrame([(*r, *fill) for r in rows], schema)
    out = STAGES[name](spark, frame, SF)
    found = out.collect()
    added = ["slot", "shard"] if name == "sharding" else []
    assert out.columns == [c for c in frame.columns if c not in added] + added
    assert all(r["lang"] == "en" and r["a.b"] == 7 and all(r[c] == c for c in CLASHING if c not in added) for r in found)
    ids = Counter(r["doc_id"] for r in found)
    if name == "near_dedup":
        assert ids == Counter({None: 2, 1: 1, 2: 1, 3: 1, 5: 1, 6: 1})
    elif name in ("decontamination", "sharding"):
        assert ids == Counter(r[0] for r in rows)
    elif name == "quality":  # no labels of these ids but some: repeated rows share their fate
        assert ids[1] in (0, 2)
    assert STAGES[name](spark, frame.limit(0), SF).count() == 0
