"""Nulls, empty and long texts, repeated rows, ties, empty tables and extra columns with clashing names: the results that the docstrings define."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wordtide.llm import classifier, decontamination, licenses, linejoin, minhash, mixing, mjpeg, sharding, substring, warc
from wordtide.llm.queries import SHARDS

SCHEMA = "doc_id bigint, text string, id bigint, key string, n bigint, component string"
LONG = "word " * 60_000
ROWS = [(1, "one two three four five six seven eight nine ten"), (1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, LONG), (None, "x y"), (5, "   "), (6, "MIT License\nMIT License")]
WEIGHTS = {"a": 0.5, "b": 0.5}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "c") for r in rows], SCHEMA)


def operators(spark):
    bench = spark.createDataFrame([(1, ROWS[0][1]), (2, None), (None, "x y")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")
    named = labels.select("doc_id", F.when(F.col("quality") == 1, "a").otherwise("b").alias("label"))
    return {
        "decontamination": lambda d: decontamination.contamination(d, bench),
        "media": lambda d: mjpeg.features(mjpeg.media_column(d)),
        "licenses": licenses.licenses,
        "minhash": minhash.components,
        "substring": lambda d: substring.drop_repeats(d.select("doc_id", "text")),
        "quality": lambda d: classifier.quality(d, labels),
        "mixing": lambda d: mixing.mix(d, named, WEIGHTS),
        "sharding": lambda d: sharding.place(d, "doc_id", ["s1", "s2"], 101),
        "lines": linejoin.line_dedup,
    }


NAMES = ["decontamination", "media", "licenses", "minhash", "substring", "quality", "mixing", "sharding", "lines"]


@pytest.mark.parametrize("name", NAMES)
def test_row_per_document(spark, name):
    run = operators(spark)[name]
    assert run(frame(spark, ROWS)).count() == len(ROWS)
    assert run(frame(spark, [])).count() == 0


def values(spark, name, *columns):
    """{doc_id: the distinct values of the columns}, and how many rows each doc_id has."""
    rows = operators(spark)[name](frame(spark, ROWS)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).add(tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in columns))
    assert all(len(v) == 1 for v in out.values())  # repeated rows have equal results
    return {k: v.pop() for k, v in out.items()}


def test_decontamination_values(spark):
    found = values(spark, "decontamination", "n_words", "n_hit", "n_items", "contaminated", "items")
    none = (0, 0, 0, False, ())
    assert found == {1: (10, 10, 1, True, ("1",)), 2: none, 3: none, 5: none, None: (2, 2, 1, True, ("null",)), 4: (60_000, 0, 0, False, ()), 6: (4, 0, 0, False, ())}


def test_media_values(spark):
    found = values(spark, "media", "n_bytes", "payload_bytes", "payload_sha256")
    for doc_id, text in ROWS:
        body = (text or "").encode()
        payload = body + b"\xff" * (max(1, -(-len(body) // 576)) * 576 - len(body))
        assert found[doc_id] == (len(body), len(payload), hashlib.sha256(payload).hexdigest())


def test_licence_values(spark):
    found = values(spark, "licenses", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert found[6] == (4, 2, 0, 2, "mit", "mit") and found[2] == found[3] == found[5] == (0, 0, None, None, "", "") and found[4][:2] == (60_000, 0)


def test_minhash_values(spark):
    found = values(spark, "minhash", "n_shingles", "component_id", "kept")
    assert found == {1: (6, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (0, 5, True), 6: (1, 6, True), None: (1, None, None)}


def test_substring_values(spark):
    found = values(spark, "substring", "text", "n_removed", "n_passages")
    assert found == {r[0]: (r[1], 0, 0) for r in ROWS} | {6: ("MIT License", 1, 0)}


def test_line_values(spark):
    found = values(spark, "lines", "n_lines", "n_links", "n_removed")
    assert found == {1: (1, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 0, 0), 5: (0, 0, 0), 6: (2, 0, 1), None: (1, 0, 0)}


def test_quality_values(spark):
    found = values(spark, "quality", "held_out", "score", "predicted")
    assert found[2][1] == found[3][1] == found[5][1] and all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in found.values())
    one = classifier.quality(frame(spark, ROWS), spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert {r["score"] for r in one} == {0.5}


def test_mixing_values(spark):
    found = values(spark, "mixing", "__n_words", "rate", "__probabilities")
    assert {k: v[0] for k, v in found.items()} == {r[0]: len((r[1] or "").split()) for r in ROWS} and all(v[1] >= 0 for v in found.values())
    assert found[2][1:] == found[3][1:] == found[5][1:]


def test_sharding_values(spark):
    found = values(spark, "sharding", "slot", "shard")
    owners = sharding.fill_table(["s1", "s2"], 101)
    assert all(shard == owners[slot] for slot, shard in found.values()) and found[None][0] == int(hashlib.md5(b"\x00null").hexdigest()[:15], 16) % 101
    table = sharding.fill_table(SHARDS, 10_007)
    counts = [table.count(k) for k in range(len(SHARDS))]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.fill_table(SHARDS[:-1], 10_007)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != len(SHARDS) - 1)
    assert moved < 0.1 * len(table)


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(k, "the same line of words here", 1) for k in (9, 4, 7)], "doc_id bigint, text string, rank int")
    assert {r["doc_id"] for r in substring.repeats(docs, rank="rank").collect()} == {7, 9}
    assert {r["doc_id"] for r in linejoin.line_dedup(docs).where("n_removed > 0").collect()} == {7, 9}
    assert {r["component_id"] for r in minhash.components(docs).collect()} == {4}


def test_keep_one(spark):
    rows = minhash.keep_one(frame(spark, ROWS)).select("doc_id").collect()
    assert sorted(str(r[0]) for r in rows) == ["1", "2", "3", "4", "5", "6", "None"]


def test_short_item_is_found(spark):
    bench = spark.createDataFrame([(7, "x y")], "item_id bigint, text string")
    hit = decontamination.contamination(frame(spark, ROWS), bench).where("contaminated").collect()
    assert [r["doc_id"] for r in hit] == [None]


def test_near_items_of_odd_rows(spark):
    """Null, empty, long, repeated rows and an item that is one word: near items hold the exact ones."""
    bench = spark.createDataFrame([(1, ROWS[0][1]), (2, None), (3, ""), (4, "word"), (None, "x y")], "item_id bigint, text string")
    rows = decontamination.contamination(frame(spark, ROWS), bench, slop=decontamination.SLOP).collect()
    near = {}
    for r in rows:
        assert set(r["items"]) <= set(r["near_items"])
        near.setdefault(r["doc_id"], set()).add(tuple(r["near_items"]))
    assert near == {1: {("1",)}, 2: {()}, 3: {()}, 4: {("4",)}, None: {("null",)}, 5: {()}, 6: {()}}
    assert decontamination.contamination(frame(spark, []), bench, slop=decontamination.SLOP).count() == 0


def test_clips_of_odd_rows(spark):
    """Every row has clips that follow one another from the start; repeated rows have equal ones, a null id keeps its own."""
    clips = lambda rows: mjpeg.clip_rows(mjpeg.features(mjpeg.media_column(frame(spark, rows)))).collect()
    found = clips(ROWS)
    assert {str(r["doc_id"]) for r in found} == {str(r[0]) for r in ROWS} and clips([]) == []
    by = {}
    for r in found:
        by.setdefault(str(r["doc_id"]), []).append(tuple(r)[1:])
    assert all(by["1"].count(c) % 2 == 0 for c in by["1"]) and len(set(by["2"])) == len(set(by["3"])) == 1


def test_totals_of_odd_rows(spark):
    """A row per domain, with shares that add up to 1; without documents there is nothing to share."""
    labels = spark.createDataFrame([(1, "a"), (4, "b")], "doc_id bigint, label string")
    rows = mixing.domain_totals(mixing.mix(frame(spark, ROWS), labels, WEIGHTS), WEIGHTS).collect()
    assert {r["domain"]: r["target"] for r in rows} == WEIGHTS and abs(sum(r["share"] for r in rows) - 1) < 1e-9
    assert mixing.domain_totals(mixing.mix(frame(spark, []), labels, WEIGHTS), WEIGHTS).count() == 0


def test_archive_of_very_long_and_odd_pages(spark):
    long = "<p>é</p>" * 400_000
    rows = [(3, "u", long), (2, "u", long), (None, "u", long), (1, None, ""), (4, "a\r\nb", None), (5, "u", "x" * 99), (6, "u", "x" * 99), (2, "u", long)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    found = sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, archive).collect()), key=repr)
    size, digest = len(long.encode()), lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [("2", size, digest(long), "response", None)] * 2 + [("3", size, digest(long), "revisit", 2), ("None", size, digest(long), "revisit", 2)]
    want += [("1", 0, digest(""), "response", None), ("4", 0, digest(""), "response", None), *((k, 99, digest("x" * 99), "response", None) for k in "56")]
    assert found == sorted(want, key=repr)
    assert spark.read.parquet(archive.payloads).count() == 3
