"""State-store windows, the feed as a stream and its slots, the sink with commit, permutations and baskets by counts, the pattern automaton, stored
tokens, percentiles in rounds, the cube."""

import json
import random
import re
import statistics
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordtide.functions import lexicons
from wordtide.operators import audit, corpus, frequency, selection
from wordtide.sources import feed, sink
from wordtide.streaming import live

WORDS = ["a", "b", "c", "d"]


def frame(spark, n=400, seed=1, fields=("x", "y", None)):
    rng = random.Random(seed)
    rows = [(k, rng.choice([2018, 2020, 2025]), 1, rng.choice(fields), [w for w in [*WORDS, "e", "f"] if rng.random() < 0.3]) for k in range(n)]
    return spark.createDataFrame(rows, "base_id bigint, year int, quarter bigint, subfield string, toks array<string>"), rows


# Streams


def test_windows_over_restarts(spark, tmp_path):
    """Three runs: a window closes once, a late row is dropped and counted, a repeated key counts once, open windows stay for later."""
    schema = "k bigint, g string, at timestamp"
    runs = [
        ([(1, "u", "2024-01-01 01:00:00"), (1, "u", "2024-01-01 01:00:00"), (2, "u", "2024-01-01 05:00:00")], 0),
        ([(3, "u", "2024-01-02 12:00:00"), (4, "v", "2024-01-01 23:30:00")], 0),  # 23:30 is within the watermark of 04:00
        ([(5, "u", "2024-01-01 02:00:00"), (6, "v", "2024-01-05 00:00:00"), (7, "v", "2024-01-01 02:00:00")], 2),
    ]
    seen = []
    for rows, late in runs:
        spark.createDataFrame(rows, "k bigint, g string, at string").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(f"{tmp_path}/in")
        assert live.take_in(spark, f"{tmp_path}/in", schema, str(tmp_path), "at", "k", "1 day", "1 hour", "g") == late
        out = spark.read.schema("start timestamp, g string, n bigint").parquet(f"{tmp_path}/windows")
        seen.append(sorted((str(r["start"])[:10], r["g"], r["n"]) for r in out.collect()))
    first = [("2024-01-01", "u", 2), ("2024-01-01", "v", 1)]
    assert seen == [[], first, [*first, ("2024-01-02", "u", 1)]]


def records(month, n):
    return [{"id": f"{month}-{k}", "published": f"{month}-02", "primary_category": "c", "categories": ["c"], "title": "t", "abstract": "a"} for k in range(n)]


def pages(root, months, page=2):
    for month, n in months.items():
        Path(root, month).mkdir(parents=True, exist_ok=True)
        rows = records(month, n)
        for start in range(0, n, page):
            Path(root, month, f"{start}.xml").write_bytes(feed.page_xml(n, rows[start : start + page]))


def test_feed_stream_goes_on_after_a_stop(spark, tmp_path):
    months = {"2024-01": 3, "2024-02": 0, "2024-03": 5, "2024-04": 1}
    pages(f"{tmp_path}/pages", months)
    feed.register(spark)
    counts = []
    for last in ("2024-01", "2024-01", "2024-03", "2024-04"):
        stream = spark.readStream.format("paged_feed").options(root=f"{tmp_path}/pages", first="2024-01", last=last, page="2", wait="0").load()
        live.run_now(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        ids = [r["id"] for r in spark.read.schema(feed.SCHEMA).parquet(f"{tmp_path}/out").collect()]
        assert len(ids) == len(set(ids))
        counts.append(len(ids))
    assert counts == [3, 3, 8, 9]


class Shorter:
    """Pages of fewer entries than asked, and an end before the total."""

    def __init__(self, there, total):
        self.there, self.total = there, total

    def fetch(self, start):
        return feed.page_xml(self.total, records("2024-01", self.there)[start : start + 2])


def test_months_that_end_early():
    read = lambda f, **more: [r[0] for r in feed.read_month(f.fetch, 5, 1, 0, 1, lambda s: None, **more)]
    assert len(read(Shorter(7, 7))) == 7  # short pages go on
    with pytest.raises(feed.Incomplete):
        read(Shorter(3, 7))
    assert len(read(Shorter(3, 7), keep=True)) == 3


class Stamped(feed.FilePages):
    """Writes down when it is asked."""

    def __init__(self, root):
        super().__init__(root)
        self.at = Path(root, "asked")

    def fetch(self, month, start, size):
        self.at.mkdir(exist_ok=True)
        (self.at / f"{month}-{start}").write_text(str(time.time()))
        return super().fetch(month, start, size)


def test_lanes_keep_the_pause(spark, tmp_path):
    """Four tasks at once, nine requests: none closer than the pause."""
    pages(tmp_path, {f"2024-0{k}": 3 for k in range(1, 5)})
    feed.register(spark)
    found = spark.read.format("paged_feed").options(root=str(tmp_path), first="2024-01", last="2024-04", page="2", wait="0", pause="0.2", lanes="4", transport=f"{__name__}:Stamped").load()
    assert found.rdd.getNumPartitions() == 4 and found.count() == 12
    times = sorted(float(p.read_text()) for p in (tmp_path / "asked").iterdir())
    assert len(times) == 8 and min(b - a for a, b in zip(times, times[1:])) >= 0.2


def test_slots_skip_what_they_miss():
    now, late = [0.0], [0.0]

    def sleep(s):
        now[0] += s + late[0]

    slots = feed.Slots(1.0, 1, 3, 0.0, lambda: now[0], sleep)
    slots.wait()
    assert now[0] == pytest.approx(1 * slots.width)
    slots.wait()
    assert now[0] == pytest.approx(4 * slots.width)
    late[0] = 0.5  # wakes up after the margin: that slot is lost, and the ones after it until a wake-up is in time

    def once(s):
        now[0] += s + late[0]
        late[0] = 0.0

    slots.sleep = once
    slots.wait()
    assert now[0] == pytest.approx(10 * slots.width)


# The sink


def test_sink_commits_all_or_nothing(spark, tmp_path):
    root = str(tmp_path)
    sink.append(spark.range(100).select("id", (F.col("id") % 7).cast("string").alias("s")), root, "one")
    bad = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("s"))
    with pytest.raises(Exception, match="lost"):
        sink.append(bad, root, "two")
    read = lambda: sink.read_committed(spark, root, "id bigint, s string")
    assert read().count() == 100 and not list(Path(root, "data", "two").glob("*"))
    sink.append(spark.range(1000).select("id", F.lit("x").alias("s")), root, "two")
    sink.append(spark.range(5).select("id", F.lit("y").alias("s")), root, "two")  # that run is there
    assert read().count() == 1100 and read().where("s = 'y'").count() == 0


def test_publish_twice_and_stray_files(tmp_path):
    root = str(tmp_path)
    Path(root, "data", "r").mkdir(parents=True)
    for name in ("0-kept.json", "0-lost.json"):
        Path(root, "data", "r", name).write_text('{"id": 1}\n')
    assert sink.publish(root, "r", [sink.Written("data/r/0-kept.json", 1), None])
    assert [p.name for p in Path(root, "data", "r").iterdir()] == ["0-kept.json"]
    Path(root, "data", "r", "0-again.json").write_text('{"id": 1}\n')
    assert not sink.publish(root, "r", [sink.Written("data/r/0-again.json", 1)])
    assert sink.lists(root) == {"r": ["data/r/0-kept.json"]} and [p.name for p in Path(root, "data", "r").iterdir()] == ["0-kept.json"]


def test_stream_into_sink(spark, tmp_path):
    """Micro-batches are runs; a batch that is given again counts once."""
    sink.register(spark)
    root = f"{tmp_path}/sink"
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
        q = stream.writeStream.format(sink.NAME).option("root", root).option("run", "s").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sink.read_committed(spark, root, "id bigint").count() == 10 * (k + 1)
    before = sink.lists(root)
    sink.StreamWriter(root, "s").commit([sink.Written("data/x.json", 1)], 0)
    assert sink.lists(root) == before and len(before) == 2


# Chance


def test_split_pairs_by_brute_force():
    """Counts of a permutation are those of real shuffles: mean and spread of pairs, and margins that hold exactly."""
    n, held = 60, [20, 30, 5]
    rng = np.random.default_rng(3)
    split = np.array([frequency.split_pairs(n, held, [7, k])[[0, 0, 1], [1, 2, 2]] for k in range(3000)])
    real = []
    for _ in range(3000):
        m = np.zeros((n, 3), bool)
        for k, c in enumerate(held):
            m[rng.permutation(n)[:c], k] = True
        real.append([(m[:, i] & m[:, j]).sum() for i, j in ((0, 1), (0, 2), (1, 2))])
    real = np.array(real)
    assert np.abs(split.mean(0) - real.mean(0)).max() < 0.2 and np.abs(split.std(0) - real.std(0)).max() < 0.15
    assert frequency.split_pairs(10, [10, 4, 0], [1])[0, 1] == 4 and frequency.split_pairs(0, [0, 0], [1]).sum() == 0


def test_draws_beyond_numpy():
    big = np.array([3 * 10**9, 2 * 10**9, 5], np.int64)
    got = frequency._given(np.random.default_rng(1), big, 10**9)
    assert got.sum() == 10**9 and (got <= big).all() and abs(got[0] / 10**9 - 0.6) < 1e-3


def test_permuted_null_against_rows(spark):
    """The row version deals documents, this one counts: means and 95th percentiles agree within the noise of 100 permutations."""
    d, _ = frame(spark)
    rows = frequency.permutation_null(d, WORDS, 100, below=0.3).first()
    split = frequency.permuted_null(d, WORDS, 100, below=0.3).first()
    assert [rows[c] for c in ("n", "n_subfields", "n_perm", "observed")] == [split[c] for c in ("n", "n_subfields", "n_perm", "observed")]
    assert abs(rows["null_mean"] - split["null_mean"]) < 0.6 and abs(rows["null_p95"] - split["null_p95"]) <= 1


def test_placebo_by_bits_equals_joins(spark):
    d, _ = frame(spark)
    rng = random.Random(2)
    drawn = [(k, w) for k in range(70) for w in rng.sample([*WORDS, "e", "f", "absent"], 2)]  # two numbers of bits
    baskets = spark.createDataFrame(drawn, "k int, word string")
    sorted_rows = lambda df: sorted((r["k"], round(r["alpha"], 9)) for r in df.collect())
    bits = frequency.placebo_by_bits(d, baskets)
    assert sorted_rows(bits) == sorted_rows(frequency.placebo(d, baskets))
    plan = bits._jdf.queryExecution().executedPlan().toString()
    assert "base_id" not in re.sub("Scan.*", "", "\n".join(x for x in plan.splitlines() if "Exchange" in x)) and "Join" not in plan


# Texts, tokens, percentiles, cube


def test_required_literals():
    of = audit.required_literals
    assert of("As an AI") == ["as an ai"] and of(r"<script\b.*>") == ["<script"] and of("(?:my|our) cutoff") == [" cutoff"]
    assert of("(alpha|be)") == ["alpha", "be"] and of("x*") is None and of("(?:a?|b)") is None and of(r"\d+") is None and of("(abc)+d") == ["abc"]
    for p in (*lexicons.LEAKS, *lexicons.MENTIONS):
        assert of(p)


def test_gated_hits_equal_ungated(spark):
    patterns = [*audit.LEAKS, *audit.MENTIONS, (1, r"\d{3,}"), (2, "straße"), (3, "K")]
    rng = random.Random(4)
    bits = [x for _, p in patterns for x in (audit.required_literals(p) or ["123"])] + ["x", " ", "\n", "STRASSE", "StraßE", "K", "İ", "As an AI language model", "ChatGPT was used", "123456"]
    rows = [(k, "".join(rng.choice([b, b.upper(), b + " "]) for b in rng.choices(bits, k=12))) for k in range(150)] + [(900, None), (901, "")]
    texts = spark.createDataFrame(rows, "k int, t string")
    plain = sorted(map(tuple, audit.pattern_hits(texts, "k", "t", patterns).collect()))
    assert sorted(map(tuple, audit.gated_hits(texts, "k", "t", patterns).collect())) == plain and plain
    flags = texts.select("t", audit.candidates(F.col("t"), [p for _, p in patterns]).alias("may")).collect()
    for r in flags:
        for (_, p), may in zip(patterns, r["may"]):
            needed = audit.required_literals(p)
            assert may == (not needed or any(x in (r["t"] or "").lower() for x in needed))


def test_stored_tokens_are_pruned(spark, tmp_path):
    d, rows = frame(spark)
    corpus.store(d, f"{tmp_path}/tokens")
    back = corpus.stored(spark, f"{tmp_path}/tokens")
    order = ["base_id", "year", "quarter", "subfield", "toks"]
    assert sorted(map(repr, map(tuple, back.select(*order).collect()))) == sorted(map(repr, map(tuple, d.select(*order).collect())))
    one = back.where("year = 2020")
    assert all("year=2020" in f for f in {r[0] for r in one.select(F.input_file_name()).collect()})
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    dim = spark.range(2015, 2027).select(F.col("id").cast("int").alias("year"), F.pmod("id", F.lit(5)).alias("x")).where("x = 0")
    joined = back.join(F.broadcast(dim), "year")
    assert joined.count() == sum(r[1] % 5 == 0 for r in rows) and "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bins", [2, 512])
def test_percentiles(spark, bins):
    rng = random.Random(6)
    rows = [("hot", rng.choice([1.0, 1.0, 2.5, 1e300, -1e300, rng.random()])) for _ in range(700)] + [("one", 3.25), (None, 1.0), (None, 2.0), ("ties", 7.0), ("ties", 7.0), ("null", None), ("nan", float("nan")), ("nan", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    found = {(r["g"], r["share"]): r["percentile"] for r in selection.percentiles(df, ["g"], "v", shares, bins).collect()}
    want = {}
    for r in df.groupBy("g").agg(*[F.percentile("v", s).alias(str(k)) for k, s in enumerate(shares)]).collect():
        want |= {(r["g"], s): r[k + 1] for k, s in enumerate(shares) if r[k + 1] is not None}
    assert found.keys() == want.keys()
    for key, v in want.items():
        assert found[key] == pytest.approx(v, rel=1e-12, nan_ok=True)
    whole = selection.percentiles(df.where("g = 'hot'"), [], "v", [0.5]).first()["percentile"]
    assert whole == statistics.median(v for g, v in rows if g == "hot")
    assert selection.percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_cube_adds_up(spark):
    d, rows = frame(spark)
    cells = frequency.subfield_cube(d, ["a"]).collect()
    at = {(r["level"], r["subfield"], r["year"]): (r["n"], r["hit"]) for r in cells}
    assert at[3, None, None] == (len(rows), sum("a" in r[4] for r in rows))
    for year in (2018, 2020, 2025):
        assert at[2, None, year] == tuple(sum(x) for x in zip(*[v for (level, _, y), v in at.items() if level == 0 and y == year]))
    assert at[1, None, None][0] == sum(r[3] is None for r in rows)


def test_lists_hold_counts(tmp_path):
    Path(tmp_path, "data", "r").mkdir(parents=True)
    sink.publish(str(tmp_path), "r", [sink.Written("data/r/a.json", 2), sink.Written("data/r/b.json", 0)])
    assert json.loads(Path(tmp_path, "commits", "r.json").read_text()) == {"files": ["data/r/a.json"], "n": 2}


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_citations_with_an_id_that_all_cite(spark, monkeypatch, hot):
    """Whether an id is looked up by broadcast or by a join, counts are the same; nulls and papers that cite nothing too."""
    monkeypatch.setattr(audit, "HOT_IDS", hot)
    rng = random.Random(8)
    rows = [(k, 2020 + k % 3, ["all", *({str(rng.randint(0, 9)) for _ in range(k % 4)})] if k % 5 else []) for k in range(60)] + [(99, 2020, None)]
    authority = [("all",), ("1",), ("2",), ("2",), (None,)]
    found = audit.citations_by_year(spark.createDataFrame(rows, "id int, year int, cited array<string>"), spark.createDataFrame(authority, "cited string")).collect()
    for r in found:
        of = [c or [] for _, y, c in rows if y == r["year"]]
        gone = [[x for x in c if x not in ("all", "1", "2")] for c in of]
        assert (r["papers"], r["cited"], r["missing"], r["papers_with_missing"]) == (len(of), sum(map(len, of)), sum(map(len, gone)), sum(map(bool, gone)))
