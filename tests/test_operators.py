"""Functions on hand-made frames, against values worked out by hand or from published tables."""

import gzip
import io
import math
import tarfile

import pytest
from pyspark.sql import functions as F

from wordtide.functions import lexicons, stats
from wordtide.operators import audit, corpus, frequency
from wordtide.sources import feed, readers
from wordtide.streaming import live


def test_tokens_and_bigrams(spark):
    d = spark.createDataFrame([("A b-c 1d b",), ("x",), ("",), (None,)], "text string")
    rows = d.select(corpus.tokens(F.col("text")).alias("t")).select("t", frequency.bigrams(F.col("t")).alias("b")).collect()
    assert [r["t"] for r in rows] == [["a", "b", "c", "d", "b"], ["x"], [], []]
    assert [r["b"] for r in rows] == [["a b", "b c", "c d", "d b"], [], [], []]


def test_first_version_comes_before_date_filter(spark):
    d = spark.createDataFrame([("7", 0, "bad"), ("7", 1, "2024-02-01T00:00:00Z"), ("8", 2, "2024-05-01T00:00:00Z"), ("9", 3, None)], "base string, seq int, published string")
    rows = corpus.dated(corpus.first_versions(d, "base", "seq")).collect()
    assert [(r["base"], r["year"], r["quarter"]) for r in rows] == [("8", 2024, 2)]


def test_inference(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(3, 2085), (0, 0)], "k int, n int").select(low, high).collect()
    assert math.isclose(rows[0][0], 0.00049, abs_tol=1e-5) and math.isclose(rows[0][1], 0.00422, abs_tol=1e-5)
    assert tuple(rows[1]) == (0.0, 0.0)
    assert math.isclose(stats.t_two_sided(2.2281, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(stats.f_upper(4.9646, 1, 10), 0.05, abs_tol=1e-4)
    tail = spark.createDataFrame([(0, 2.0), (1, 2.0), (3, 2.0)], "x bigint, mu double").select(stats.poisson_tail(F.col("x"), F.col("mu"))).collect()
    assert [round(r[0], 6) for r in tail] == [1.0, 0.864665, 0.323324]


def test_step_is_recovered(spark):
    s = spark.createDataFrame([(float(x), 0.5 * x + (3.0 if x >= 6 else 0.0) + 0.01 * (x % 2)) for x in range(12)], "x double, y double")
    row = stats.step_test(s, "x", "y", 6.0).first()
    assert math.isclose(row["step"], 3.0, abs_tol=0.02) and row["f"] > 1000


def test_audit(spark):
    d = spark.createDataFrame([(1, "a % note\n5\\% of % this\nnone", "see doi 10.1234/AbC. and arXiv:2401.00001")], "id int, t string, u string")
    row = d.select(audit.comments(F.col("t")).alias("c"), audit.dois(F.col("u")).alias("d"), audit.preprint_ids(F.col("u")).alias("p"), audit.clean_doi(F.lit("10.1/x}y).")).alias("k")).first()
    assert row["c"] == " note\n this" and row["d"] == ["10.1234/abc"] and row["p"] == ["2401.00001"] and row["k"] == "10.1/x"
    hits = audit.pattern_hits(d, "id", "t", [(1, "NOTE"), (2, "absent")]).collect()
    assert [(h["tier"], h["snippet"]) for h in hits] == [(1, "a % note 5\\% of % this none")]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name, body in (("x.tex", b"one"), ("y.png", b"no"), ("z.bbl", b"two"), ("w.tex", b"\x00\x01" * 50)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"three"))
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"four" * 99)[:20] + b"no stream of that kind")
    (tmp_path / "d.tex").write_bytes(b"raw text " * 30)
    (tmp_path / "e.bin").write_bytes(b"x" * 20_000)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_archives(spark, str(tmp_path), most_bytes=15_000).collect()}
    assert {k: (r["text"], r["n_tex"]) for k, r in rows.items() if k in "a.tar b.gz".split()} == {"a.tar": ("one\ntwo", 1), "b.gz": ("three", 1)}
    assert rows["c.gz"]["n_tex"] == 0 and rows["d.tex"]["n_tex"] == 0 and rows["d.tex"]["text"].startswith("raw text")
    assert {k for k, r in rows.items() if r["has_source"]} == {"a.tar", "b.gz", "d.tex"}
    assert (rows["e.bin"]["text"], rows["e.bin"]["skipped_large"], rows["e.bin"]["bytes"]) == (None, True, 20_000)


def test_atom_and_progress(spark, tmp_path):
    page = tmp_path / "feed.xml"
    page.write_text('<feed><totalResults>7</totalResults><entry><id>http://h/abs/2401.1v1</id><published>2024-01-01T00:00:00Z</published><title>A\n  b</title><summary> s </summary><category term="x.GA"/><category term="x.CO"/></entry></feed>')
    row = readers.read_atom(spark, str(page)).first()
    assert (row["id"], row["primary_category"], row["title"], row["abstract"]) == ("2401.1v1", "x.GA", "A b", "s")
    assert readers.atom_total(spark, str(page)).first()["total"] == 7
    assert readers.done_months(spark, str(tmp_path / "none.json")) == []
    (tmp_path / "done.json").write_text('{"done_months": [[2015, 2], [2015, 1]]}')
    assert readers.done_months(spark, str(tmp_path / "done.json")) == ["2015-01", "2015-02"]


def test_records_as_a_stream(spark, tmp_path):
    frame = spark.createDataFrame([("1v1", "2024-01-01", "x", ["x"], "t", 'a "quoted"\nline')], readers.RECORD)
    readers.append_records(frame, str(tmp_path / "in"))
    for n in (1, 2, 2):  # the last run finds nothing new
        if n == 2 and not (tmp_path / "second").exists():
            readers.append_records(frame.withColumn("id", F.lit("2v1")), str(tmp_path / "in"))
            (tmp_path / "second").touch()
        readers.append_stream(spark.readStream.schema(readers.RECORD).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        rows = readers.read_records(spark, str(tmp_path / "out")).collect()
        assert len(rows) == n and rows[0]["abstract"] == 'a "quoted"\nline'


def test_stream_windows(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 23:00:00"), (3, "2024-01-02 01:00:00")]
    frame = spark.createDataFrame(rows, "k int, at string").withColumn("at", F.col("at").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "events"))
    found = live.counts_from_stream(spark, str(tmp_path / "events"), frame.schema, str(tmp_path / "run"), "at", "k", "1 day").collect()
    batch = live.counts(frame, "at", "k").collect()
    assert sorted((str(r["start"]), r["n"]) for r in found) == sorted((str(r["start"]), r["n"]) for r in batch) == [("2024-01-01 00:00:00", 2), ("2024-01-02 00:00:00", 1)]


class Flaky:
    """Fails once, then sends an empty page once."""

    def __init__(self, pages):
        self.pages, self.calls = pages, 0

    def fetch(self, start):
        self.calls += 1
        if self.calls == 1:
            raise OSError("busy")
        return feed.page_xml(3, []) if self.calls == 3 else feed.page_xml(3, self.pages.get(start, []))


def test_feed_retries_and_paces():
    record = lambda k: {"id": f"{k}v1", "published": "2024-01-01", "primary_category": "a", "categories": ["a", "b"], "title": "t <&>", "abstract": "s"}
    waits = []
    source = Flaky({0: [record(0), record(1)], 2: [record(2)]})
    rows = list(feed.read_month(source.fetch, 2, 3, 1.0, 4, waits.append))
    assert [r[0] for r in rows] == ["0v1", "1v1", "2v1"] and rows[0][2:5] == ("a", ["a", "b"], "t <&>") and waits == [2.0, 2.0]
    with pytest.raises(OSError):
        feed.fetched(lambda: (_ for _ in ()).throw(OSError("down")), 2, 0.5, waits.append)
    now, slept = [0.0], []
    pace = feed.Paced(3.0, lambda: now[0], slept.append)
    for t in (0.0, 1.0, 10.0):
        now[0] = t
        pace.wait()
    assert slept == [2.0]
    assert feed.months("2015-11", "2016-02") == ["2015-11", "2015-12", "2016-01", "2016-02"]


def test_feed_filters_cut_months():
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    reader = feed.FeedReader({"first": "2015-01", "last": "2026-07", "done": "2016-02", "root": "file:///none"})
    assert len(list(reader.pushFilters([GreaterThanOrEqual(("published",), "2016-01-15"), LessThan(("published",), "2016-03-01T00")]))) == 2
    assert [p.value for p in reader.partitions()] == ["2016-01", "2016-03"]


def test_ranked_over_partitions(spark):
    rows = [(g, (7 * k) % 101) for g in ("a", "b", None) for k in range(0 if g == "b" else 101)] + [("b", 5)]
    found = corpus.ranked(spark.createDataFrame(rows, "g string, k int").repartition(5), ["g"], ["k"]).collect()
    assert sorted((str(r["g"]), r["k"], r["rn"], r["cnt"]) for r in found) == sorted([*((g, k, k, 101) for g in ("a", "None") for k in range(101)), ("b", 5, 0, 1)])
    sample = corpus.step_sample(spark.range(103).select(F.col("id").alias("k")), "k", 25).collect()
    assert sorted(r["k"] for r in sample) == list(range(0, 100, 4))


def test_identifier_rules(spark):
    known = {
        "10.3847/1538-4357/ac082c": "wrong identifier",
        "10.1086/311384": "extraction artifact",
        "10.1000/x)/doi(y": "extraction artifact",
        "10.1000/10.48550/arxiv.1": "extraction artifact",
        "10.48550/arxiv.2401.1": "preprint",
        "10.5281/zenodo.77": "archive",
        "10.1000/other": "other",
    }
    rows = spark.createDataFrame([(k,) for k in known], "d string").select("d", audit.identifier_class(F.col("d")).alias("c")).collect()
    assert {r["d"]: r["c"] for r in rows} == known
    ids = spark.createDataFrame([("math/0601001 COND-MAT/0601002 physics/0601003 x arXiv:2401.00001 hep-th/0601004",)], "t string").select(audit.preprint_ids(F.col("t"))).first()[0]
    assert ids == ["2401.00001", "cond-mat/0601002", "hep-th/0601004", "math/0601001", "physics/0601003"]


def test_default_lexicons(spark):
    assert (len(lexicons.BASKET), len(set(lexicons.BASKET)), len(lexicons.WATCH), len(lexicons.TRAJECTORY), len(lexicons.HYPE), len(lexicons.HEDGE)) == (38, 38, 48, 41, 24, 21)
    d = spark.createDataFrame([("We delve into a pivotal state-of-the-art sample, as an AI language model. % ChatGPT",), ("A may.",)], "text string")
    toks = d.select("text", corpus.tokens(F.col("text")).alias("toks"), corpus.tokens(F.col("text"), corpus.HYPHENATED).alias("hyphenated"))
    assert [r[0] for r in toks.select(frequency.has_any()).collect()] == [True, False]
    tones = frequency.tone(toks.select(F.col("hyphenated").alias("toks"), F.lit(1).alias("year")), frequency.TONES, "year").first()
    assert (tones["hype_docpct"], tones["hedge_docpct"]) == (50.0, 50.0)
    found = d.select(audit.hits(F.col("text")).alias("h")).first()["h"]
    assert [(h["tier"], h["where"]) for h in found] == [(1, "body_or_comment"), (2, "comment")]
    assert [r[0] for r in spark.createDataFrame([("delve",), ("robust",), ("galaxy",), ("x",)], "w string").select(audit.word_group(F.col("w"))).collect()] == ["strong", "soft", "control", None]


def test_tails_of_distributions():
    exact = lambda x, mu: 1 - sum(math.exp(k * math.log(mu) - mu - math.lgamma(k + 1)) for k in range(x))
    for x, mu in ((1, 0.3), (5, 2.0), (40, 30.0), (300, 310.0)):
        assert math.isclose(stats.poisson_upper(x, mu), exact(x, mu), rel_tol=1e-9, abs_tol=1e-12)
    assert math.isclose(stats.poisson_upper(10**6, 1e6), 0.5, abs_tol=1e-3) and stats.poisson_upper(0, 5.0) == 1.0
    # published: r 0.870 over 12 years
    t = 0.8700 * math.sqrt(10 / (1 - 0.8700**2))
    assert math.isclose(stats.t_two_sided(t, 10), 2.34e-4, rel_tol=0.02)
