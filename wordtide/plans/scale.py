"""Queries of the forms made for size: state-store windows, the feed as a stream, a sink with commit, permutations and baskets without a row per
document and word, stored tokens, exact percentiles in rounds, the cube of subfields and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordtide.operators import audit, corpus, frequency, selection
from wordtide.sources import feed, sink
from wordtide.sources.shared import fresh_path
from wordtide.streaming import live

from .catalog import C, HIT, MARKERS, PATTERNS, RECENT, SQL, documents, query, quoted, r9, table
from .extended import FEED_SQL, RECENT_DOCS, feed_entries

# Streams

LATE = "event_id % 50 = 7 AND day(ts) <= 8"


@query(
    f"WITH e AS (SELECT *, {LATE} AS late, time_bucket(INTERVAL 1 DAY, ts) AS day FROM events), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e WHERE NOT late) "
    "SELECT CAST(day AS TIMESTAMP) AS start, event_type, count(DISTINCT event_id) AS n FROM e, m WHERE NOT late AND day + INTERVAL 1 DAY <= mark GROUP BY ALL UNION ALL SELECT NULL, 'late', count(*) FROM e WHERE late"
)
def stream_windows(spark, sf):
    """Events that come in four deliveries, some twice and some of the first week with the last; each delivery is a run that goes on from the checkpoint of the
    one before. Windows that the watermark has passed, and a row for what came too late."""
    events, root = table(spark, sf, "events"), fresh_path(spark, "windows")
    twice = events.unionByName(events.where("event_id % 20 = 3"))
    delivery = F.when(F.expr(LATE), 3).otherwise(F.least(F.floor((F.day("ts") - 1) / 8), F.lit(3)))
    schema = events.schema
    late = 0
    for k in range(4):
        twice.where(delivery == k).write.mode("append").parquet(f"{root}/source")
        late += live.take_in(spark, f"{root}/source", schema, root, "ts", "event_id", "1 day", "1 hour", "event_type")
    found = spark.read.schema("start timestamp, event_type string, n bigint").parquet(f"{root}/windows")
    found = found.withColumn("start", F.col("start").cast(schema["ts"].dataType))
    return found.unionByName(spark.range(1).select(F.lit(None).cast(schema["ts"].dataType).alias("start"), F.lit("late").alias("event_type"), F.lit(late).cast("bigint").alias("n")))


@query(FEED_SQL)
def feed_stream(spark, sf):
    """The feed as a stream, in two runs with a stop between: each record comes once."""
    root = fresh_path(spark, "feed_stream")
    feed.write_pages(feed_entries(spark, sf), f"{root}/pages", 3)
    feed.register(spark)
    for last in ("2024-03", "2024-06"):
        pages = spark.readStream.format("paged_feed").options(root=f"{root}/pages", first="2024-01", last=last, page="3", wait="0").load()
        live.run_now(pages, f"{root}/records", f"{root}/checkpoint")
    found = spark.read.schema(feed.SCHEMA).parquet(f"{root}/records")
    return found.select("id", "published", "primary_category", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "month")


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def committed_roundtrip(spark, sf):
    """Two runs into the sink with commit, one of them repeated."""
    root, rows = fresh_path(spark, "committed"), table(spark, sf, "conversations")
    for run, odd in (("even", 0), ("odd", 1), ("even", 0)):
        sink.append(rows.where(F.col("turn") % 2 == odd), root, run)
    found = sink.read_committed(spark, root, "conv_id bigint, turn bigint, role string, text string")
    return found.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# Chance

N_PERM = 300
PAIRS_SQL = f"""{RECENT_DOCS}, h AS (SELECT base_id, subfield, unnest(list_distinct(list_filter(toks, lambda t: t IN ({quoted(MARKERS)})))) AS w FROM d),
    n AS (SELECT subfield, count(*) AS n FROM d GROUP BY subfield), c1 AS (SELECT subfield, w, count(*) AS c FROM h GROUP BY ALL), k AS (SELECT unnest([{quoted(sorted(MARKERS))}]) AS w),
    o AS (SELECT a.w AS w1, b.w AS w2, count(*) AS pairs FROM h a JOIN h b ON a.base_id = b.base_id AND a.w < b.w GROUP BY ALL),
    e AS (SELECT a.w AS w1, b.w AS w2, sum(a.c * b.c / n.n) AS mu FROM c1 a JOIN c1 b ON a.subfield IS NOT DISTINCT FROM b.subfield AND a.w < b.w JOIN n ON n.subfield IS NOT DISTINCT FROM a.subfield GROUP BY ALL)"""


@query(f"{PAIRS_SQL} SELECT x.w AS w1, y.w AS w2, coalesce(pairs, 0) AS pairs, round(coalesce(mu, 0), 6) AS expected, true AS agrees FROM k x JOIN k y ON x.w < y.w LEFT JOIN o ON o.w1 = x.w AND o.w2 = y.w LEFT JOIN e ON e.w1 = x.w AND e.w2 = y.w")
def permutation_pairs(spark, sf):
    """Observed pairs, their exact mean under permutations within subfields, and whether 300 permutations come within five standard errors of it."""
    d = documents(spark, sf).where(F.col("year").between(*RECENT))
    drawn = frequency.permuted_pairs(d, MARKERS, N_PERM).groupBy("w1", "w2").agg(F.avg("pairs").alias("mean"), F.stddev("pairs").alias("sd"))
    own = d.groupBy("subfield").agg(F.count("*").alias("n"), *[F.sum(F.array_contains("toks", w).cast("bigint")).alias(f"w{k}") for k, w in enumerate(sorted(MARKERS))])
    names = list(enumerate(sorted(MARKERS)))
    cells = own.select("n", F.inline(F.array(*[F.struct(F.lit(a).alias("w1"), F.lit(b).alias("w2"), (F.col(f"w{i}") * F.col(f"w{j}")).alias("c")) for i, a in names for j, b in names if i < j])))
    expected = cells.groupBy("w1", "w2").agg(F.sum(F.col("c") / F.col("n")).alias("expected"))
    both = frequency.lift(d, MARKERS).select("w1", "w2", "pairs").join(F.broadcast(expected), ["w1", "w2"]).join(F.broadcast(drawn), ["w1", "w2"])  # a row per pair of markers
    agrees = F.abs(F.col("mean") - F.col("expected")) <= 5 * F.col("sd") / N_PERM**0.5 + 1e-9
    return both.select("w1", "w2", "pairs", F.round("expected", 6).alias("expected"), agrees.alias("agrees"))


@query()
def permutation_split(spark, sf):
    """``permutation_null`` at its full number of permutations. SQL cannot draw; ``permutation_pairs`` holds its means, a test its quantiles."""
    return frequency.permuted_null(documents(spark, sf).where(F.col("year").between(*RECENT)), MARKERS, N_PERM)


# Texts and tokens


@query(SQL["hit_detail"])  # the same rows
def hit_detail_gated(spark, sf):
    """``hit_detail`` behind an automaton of required literals, which reads each text once."""
    leaks, mentions = [x for x in PATTERNS if x[0] == 1], [*[x for x in PATTERNS if x[0] == 2], (2, "a")]
    texts = table(spark, sf, "pages").select("page_id", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    named = texts.withColumn("may", audit.candidates(F.col("html"), [p for _, p in (*leaks, *mentions)]))
    scans = named.select(F.col("page_id").alias("id"), (2015 + F.col("page_id") % 12).alias("year"), F.lit(True).alias("ok"), audit.hits(F.col("html"), leaks, mentions, may=F.col("may")).alias("hits"))
    return audit.hit_detail(scans)


PERIOD_SQL = "CASE WHEN year BETWEEN 2018 AND 2021 THEN 'base' WHEN year BETWEEN 2024 AND 2026 THEN 'recent' END"


@query(f"{C} SELECT {PERIOD_SQL} AS period, subfield, count(*) AS total, count(*) FILTER ({HIT}) AS hit, round(count(*) FILTER ({HIT}) / count(*), 9) AS rate FROM c WHERE {PERIOD_SQL} IS NOT NULL GROUP BY ALL")
def stored_tokens(spark, sf):
    """Basket rates by period and subfield from tokens that are stored by year and subfield. The years of the periods are found by Spark as the query runs, and only their
    files are read."""
    path = fresh_path(spark, "tokens")
    corpus.store(documents(spark, sf), path)
    years = spark.range(2015, 2027).select(F.col("id").cast("int").alias("year")).withColumn("period", frequency.period((2018, 2021), RECENT)).where("period IS NOT NULL")
    found = corpus.stored(spark, path).join(F.broadcast(years), "year")  # twelve rows
    return frequency.basket_rate(found, MARKERS, "period", "subfield").withColumn("rate", r9("rate"))


PRICE_SHARES = [0.05, 0.5, 0.95]


@query(" UNION ALL ".join(f"SELECT l_returnflag, CAST({s} AS DOUBLE) AS share, round(quantile_cont(l_extendedprice, {s}), 6) AS percentile FROM lineitem GROUP BY l_returnflag" for s in PRICE_SHARES))
def exact_percentiles(spark, sf):
    found = selection.percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", PRICE_SHARES)
    return found.withColumn("percentile", F.round("percentile", 6))


@query(f"{C} SELECT CAST(GROUPING_ID(subfield, year) AS INTEGER) AS level, subfield, year, count(*) AS n, count(*) FILTER ({HIT}) AS hit, round(100 * count(*) FILTER ({HIT}) / count(*), 9) AS rate FROM c GROUP BY CUBE (subfield, year)")
def subfield_cube(spark, sf):
    return frequency.subfield_cube(documents(spark, sf), MARKERS).withColumn("rate", r9("rate"))
