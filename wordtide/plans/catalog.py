"""The registered queries and, for each that SQL can express, its SQL.

The driver's documents have no dates, so year and quarter derive from doc_id and the subfield is the language;
the lexicons are words of those texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.functions import stats
from wordtide.operators import audit, corpus, frequency
from wordtide.sources.shared import materialise
from wordtide.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MARKERS = ["tion", "thble", "thon", "menteux"]
CONTROLS = ["the", "and", "of", "in"]
WORDS = MARKERS + CONTROLS
PHRASES = ["of the", "in the", "and the", "to the"]
HYPE, HEDGE = ["tion", "thble", "the"], ["thon", "menteux", "of"]
BASE, RECENT = (2018, 2021), (2024, 2026)
PATTERNS = [(1, "<script"), (1, "cookie"), (2, "<title>"), (2, "href="), (2, "copyright")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, pattern: str = corpus.WORD) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return corpus.corpus(d, i, 2015 + i % 12, 1 + F.floor(i / 12) % 4, F.col("lang"), pattern)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def c_sql(pattern: str = corpus.WORD) -> str:
    return f"c AS (SELECT doc_id AS base_id, 2015 + doc_id % 12 AS year, 1 + (doc_id // 12) % 4 AS quarter, lang AS subfield, regexp_extract_all(lower(coalesce(text, '')), '{pattern}') AS toks FROM documents)"


C = f"WITH {c_sql()}"
HIT = f"list_has_any(toks, [{quoted(MARKERS)}])"
YEARLY = f"{C}, y AS (SELECT year, count(*) AS total, count(*) FILTER ({HIT}) AS hit, count(*) FILTER (list_has_any(toks, [{quoted(CONTROLS)}])) AS chit FROM c GROUP BY year), r AS (SELECT *, hit / total AS rate, chit / total AS crate FROM y)"
PERIODS = f"CASE WHEN year BETWEEN {BASE[0]} AND {BASE[1]} THEN 'base' WHEN year BETWEEN {RECENT[0]} AND {RECENT[1]} THEN 'recent' END"


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, rate of the markers and crate of the controls, from one pass."""
    d = documents(spark, sf_dir)
    return d.groupBy("year").agg(F.count("*").alias("total"), F.sum(frequency.has_any(MARKERS).cast("bigint")).alias("hit"), F.sum(frequency.has_any(CONTROLS).cast("bigint")).alias("chit")).withColumn("rate", F.col("hit") / F.col("total")).withColumn("crate", F.col("chit") / F.col("total"))


def r9(c: Column | str) -> Column:
    return F.round(c, 9)


# Frequencies


@query(f"{C} SELECT year, count(*) AS n_docs FROM c GROUP BY year")
def docs_per_year(spark, sf):
    return frequency.docs_per(documents(spark, sf), "year")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, year(o_orderdate) + (quarter(o_orderdate) - 1) / 4 AS yq, count(*) AS n_docs FROM orders GROUP BY ALL")
def docs_per_quarter(spark, sf):
    o, year, quarter = table(spark, sf, "orders"), F.year("o_orderdate"), F.quarter("o_orderdate")
    return frequency.docs_per(o.select(year.alias("year"), quarter.alias("quarter"), corpus.yq(year, quarter).alias("yq")), "year", "quarter", "yq")


@query(f"{C} SELECT year, word, count(*) AS n FROM (SELECT year, unnest(list_distinct(toks)) AS word FROM c) GROUP BY ALL")
def doc_frequency(spark, sf):
    return frequency.document_frequency(documents(spark, sf), "year")


def watch_sql(keys: str, words: list[str], units: str = "toks") -> str:
    return f"{C}, t AS (SELECT {keys}, count(*) AS total FROM c GROUP BY ALL) SELECT w.word, {', '.join('t.' + k for k in keys.split(', '))}, count(c.base_id) AS n, any_value(total) AS total, count(c.base_id) / any_value(total) AS freq FROM t CROSS JOIN (SELECT unnest([{quoted(words)}]) AS word) w LEFT JOIN c ON {' AND '.join(f'c.{k} = t.{k}' for k in keys.split(', '))} AND list_contains({units}, w.word) GROUP BY w.word, {', '.join('t.' + k for k in keys.split(', '))}"


@query(watch_sql("year", WORDS))
def watch_year(spark, sf):
    return frequency.watch(documents(spark, sf), WORDS, "year")


@query(watch_sql("year, quarter", WORDS))
def watch_quarter(spark, sf):
    return frequency.watch(documents(spark, sf), WORDS, "year", "quarter")


def excess_sql(floor: int, length: int, units: str = "toks") -> str:
    return f"""{C}, p AS (SELECT {PERIODS} AS period, {units} AS u FROM c), t AS (SELECT count(*) FILTER (period = 'base') AS bt, count(*) FILTER (period = 'recent') AS rt FROM p),
    x AS (SELECT word, count(*) FILTER (period = 'base') AS base_n, count(*) FILTER (period = 'recent') AS rec_n FROM (SELECT period, unnest(list_distinct(u)) AS word FROM p WHERE period IS NOT NULL) GROUP BY word)
    SELECT word, base_n, rec_n, base_n / bt AS base_freq, rec_n / rt AS rec_freq, rec_n / rt - base_n / bt AS abs_excess, (rec_n / rt + 1e-9) / (base_n / bt + 1e-9) AS ratio FROM x, t WHERE (base_n >= {floor} OR rec_n >= {floor}) AND length(word) >= {length}"""


@query(excess_sql(30, 3))
def excess_words(spark, sf):
    return frequency.excess_units(documents(spark, sf), BASE, RECENT, 30, 3)


@query(f"SELECT * FROM ({excess_sql(30, 3)}) ORDER BY abs_excess DESC, word LIMIT 25")
def top_excess(spark, sf):
    return excess_words(spark, sf).orderBy(F.desc("abs_excess"), "word").limit(25)


@query(f"SELECT word, CAST(rk AS BIGINT) AS rk FROM (SELECT word, row_number() OVER (ORDER BY ratio DESC, word) AS rk FROM ({excess_sql(30, 3)})) WHERE word IN ({quoted(WORDS)})")
def word_rank(spark, sf):
    """The rank of a listed word is one more than how many words come before it: no sort of all words in one task."""
    e = materialise(excess_words(spark, sf).select("word", "ratio"), "excess")
    listed = e.where(F.col("word").isin(WORDS)).select(F.col("word").alias("w"), F.col("ratio").alias("r"))
    before = (F.col("ratio") > F.col("r")) | ((F.col("ratio") == F.col("r")) & (F.col("word") < F.col("w")))
    return e.join(F.broadcast(listed)).groupBy("w").agg((F.sum(before.cast("bigint")) + 1).alias("rk")).withColumnRenamed("w", "word")


@query(f"SELECT year, round(avg(freq), 9) AS mean_freq FROM ({watch_sql('year', CONTROLS)}) GROUP BY year")
def control_mean(spark, sf):
    return frequency.watch(documents(spark, sf), CONTROLS, "year").groupBy("year").agg(r9(F.avg("freq")).alias("mean_freq"))


# Baskets


def basket_sql(keys: str, words: list[str]) -> str:
    return f"{C} SELECT {keys}, count(*) AS total, count(*) FILTER (list_has_any(toks, [{quoted(words)}])) AS hit, count(*) FILTER (list_has_any(toks, [{quoted(words)}])) / count(*) AS rate FROM c GROUP BY {keys}"


@query(basket_sql("year", MARKERS))
def basket_year(spark, sf):
    return frequency.basket_rate(documents(spark, sf), MARKERS, "year")


@query(basket_sql("year, quarter", MARKERS))
def basket_quarter(spark, sf):
    return frequency.basket_rate(documents(spark, sf), MARKERS, "year", "quarter")


@query(basket_sql("year, quarter", MARKERS[:3]))
def single_word_rate(spark, sf):
    """One word in its forms."""
    return frequency.basket_rate(documents(spark, sf), MARKERS[:3], "year", "quarter")


BASE_RATE = f"(SELECT sum(hit) / sum(total) FROM r WHERE year BETWEEN {BASE[0]} AND {BASE[1]})"


@query(f"{YEARLY} SELECT year, total, hit, rate, {BASE_RATE} AS base_rate, greatest(0.0, rate - {BASE_RATE}) AS excess FROM r")
def excess_year(spark, sf):
    return frequency.with_excess(frequency.basket_rate(documents(spark, sf), MARKERS, "year"), BASE)


@query(f"{YEARLY} SELECT {BASE_RATE} AS base_rate, sum(hit) / sum(total) AS rate, sum(hit) / sum(total) - {BASE_RATE} AS excess FROM r WHERE year BETWEEN {RECENT[0]} AND {RECENT[1]}")
def excess_headline(spark, sf):
    y = yearly(spark, sf)
    pool = lambda p: F.sum(F.when(F.col("year").between(*p), F.col("hit"))) / F.sum(F.when(F.col("year").between(*p), F.col("total")))
    return y.agg(pool(BASE).alias("base_rate"), pool(RECENT).alias("rate"), (pool(RECENT) - pool(BASE)).alias("excess"))


@query(basket_sql("subfield, year", MARKERS))
def subfield_rate(spark, sf):
    return frequency.basket_rate(documents(spark, sf), MARKERS, "subfield", "year")


@query(f"SELECT subfield, sum(hit) FILTER (year = 2025) / sum(total) FILTER (year = 2025) - sum(hit) FILTER (year BETWEEN 2018 AND 2021) / sum(total) FILTER (year BETWEEN 2018 AND 2021) AS excess FROM ({basket_sql('subfield, year', MARKERS)}) GROUP BY subfield")
def subfield_excess_rank(spark, sf):
    of = lambda a, b: F.sum(F.when(F.col("year").between(a, b), F.col("hit"))) / F.sum(F.when(F.col("year").between(a, b), F.col("total")))
    return subfield_rate(spark, sf).groupBy("subfield").agg((of(2025, 2025) - of(*BASE)).alias("excess")).orderBy(F.desc("excess"), "subfield")


LOO = " UNION ALL ".join(
    f"SELECT '{w}' AS word, count(*) FILTER (period = 'recent' AND list_has_any(toks, [{quoted([m for m in MARKERS if m != w])}])) / count(*) FILTER (period = 'recent') - count(*) FILTER (period = 'base' AND list_has_any(toks, [{quoted([m for m in MARKERS if m != w])}])) / count(*) FILTER (period = 'base') AS alpha FROM p"
    for w in MARKERS
)


@query(f"{C}, p AS (SELECT {PERIODS} AS period, toks FROM c) {LOO}")
def loo_alpha(spark, sf):
    return frequency.leave_one_out(documents(spark, sf), MARKERS, BASE, RECENT)


# Inference


@query(f"""{YEARLY} SELECT year, hit, total, round((p + 1.9208 / total) / d - h, 9) AS low, round((p + 1.9208 / total) / d + h, 9) AS high FROM (
  SELECT *, 1.96 * sqrt(p * (1 - p) / total + 3.8416 / (4.0 * total * total)) / d AS h FROM (SELECT *, CAST(hit AS DOUBLE) / total AS p, 1 + CAST(3.8416 AS DOUBLE) / total AS d FROM r))""")
def wilson_year(spark, sf):
    low, high = stats.wilson(F.col("hit"), F.col("total"))
    return yearly(spark, sf).select("year", "hit", "total", r9(low).alias("low"), r9(high).alias("high"))


POOL = f"{YEARLY}, q AS (SELECT sum(hit) FILTER (year BETWEEN 2018 AND 2021) AS kb, sum(total) FILTER (year BETWEEN 2018 AND 2021) AS nb, sum(hit) FILTER (year BETWEEN 2024 AND 2026) AS kr, sum(total) FILTER (year BETWEEN 2024 AND 2026) AS nr FROM r)"


def pooled(spark, sf, base=BASE):
    of = lambda c, p, a: F.sum(F.when(F.col("year").between(*p), F.col(c))).alias(a)
    return yearly(spark, sf).agg(of("hit", base, "kb"), of("total", base, "nb"), of("hit", RECENT, "kr"), of("total", RECENT, "nr"))


@query(f"{POOL} SELECT round((kr / nr - kb / nb) / sqrt((kr + kb) / (nr + nb) * (1 - (kr + kb) / (nr + nb)) * (1 / nr + 1 / nb)), 9) AS z FROM q")
def ztest_recent_vs_base(spark, sf):
    return pooled(spark, sf).select(r9(stats.two_proportion_z(F.col("kr"), F.col("nr"), F.col("kb"), F.col("nb"))).alias("z"))


WINDOWS = [(2018, 2021), (2015, 2021), (2019, 2022), (2015, 2019)]


@query(f"{YEARLY}, w AS (SELECT * FROM (VALUES {', '.join(map(str, WINDOWS))}) AS w(first, last)), q AS (SELECT first, last, sum(hit) FILTER (year BETWEEN first AND last) AS kb, sum(total) FILTER (year BETWEEN first AND last) AS nb, sum(hit) FILTER (year BETWEEN 2024 AND 2026) AS kr, sum(total) FILTER (year BETWEEN 2024 AND 2026) AS nr FROM r, w GROUP BY ALL) SELECT first, last, round(kr / nr - kb / nb, 9) AS alpha, round(sqrt(kr / nr * (1 - kr / nr) / nr + kb / nb * (1 - kb / nb) / nb), 9) AS se FROM q")
def alpha_windows(spark, sf):
    w = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in WINDOWS])).alias("w")
    y = yearly(spark, sf).select("year", "hit", "total", w).select("*", "w.*")
    of = lambda c, cond: F.sum(F.when(cond, F.col(c)))
    base, recent = F.col("year").between(F.col("first"), F.col("last")), F.col("year").between(*RECENT)
    q = y.groupBy("first", "last").agg(of("hit", base).alias("kb"), of("total", base).alias("nb"), of("hit", recent).alias("kr"), of("total", recent).alias("nr"))
    p0, p1 = F.col("kb") / F.col("nb"), F.col("kr") / F.col("nr")
    return q.select("first", "last", r9(p1 - p0).alias("alpha"), r9(F.sqrt(p1 * (1 - p1) / F.col("nr") + p0 * (1 - p0) / F.col("nb"))).alias("se"))


QS = [0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]


@query(f"{POOL} SELECT CAST(x AS DOUBLE) AS q, round((kr / nr - kb / nb) / (CAST(x AS DOUBLE) - kb / nb), 9) AS alpha FROM q, (SELECT unnest({QS}) AS x)")
def q_sensitivity(spark, sf):
    p = pooled(spark, sf).select((F.col("kb") / F.col("nb")).alias("f0"), (F.col("kr") / F.col("nr")).alias("ft"), F.explode(F.array(*map(F.lit, QS))).alias("q"))
    return p.select("q", r9((F.col("ft") - F.col("f0")) / (F.col("q") - F.col("f0"))).alias("alpha"))


@query(f"{YEARLY} SELECT count(*) AS n, round(corr(rate, crate), 6) AS r FROM r")
def pearson(spark, sf):
    return yearly(spark, sf).agg(F.count("*").alias("n"), F.round(F.corr("rate", "crate"), 6).alias("r"))


@query(f"{YEARLY}, f AS (SELECT regr_slope(rate, year) AS a, regr_intercept(rate, year) AS b, regr_slope(crate, year) AS ca, regr_intercept(crate, year) AS cb FROM r) SELECT round(corr(rate - a * year - b, crate - ca * year - cb), 6) AS r FROM r, f")
def detrended_corr(spark, sf):
    return stats.residuals(yearly(spark, sf), "year", "rate", "crate").agg(F.round(F.corr("r_rate", "r_crate"), 6).alias("r"))


@query(f"{YEARLY}, l AS (SELECT rate - lag(rate) OVER (ORDER BY year) AS a, crate - lag(crate) OVER (ORDER BY year) AS b FROM r) SELECT round(corr(a, b), 6) AS r FROM l")
def first_diff_corr(spark, sf):
    return stats.differences(yearly(spark, sf), "year", "rate", "crate").agg(F.round(F.corr("rate", "crate"), 6).alias("r"))


@query(f"{YEARLY}, f AS (SELECT regr_slope(rate, year) AS a, regr_intercept(rate, year) AS b FROM r WHERE year BETWEEN 2015 AND 2021) SELECT year, round(rate, 6) AS rate, round(greatest(0, b + a * year), 6) AS expected FROM r, f")
def trend_extrapolation(spark, sf):
    y = yearly(spark, sf)
    fit = y.where(F.col("year").between(2015, 2021)).agg(F.regr_slope("rate", "year").alias("a"), F.regr_intercept("rate", "year").alias("b"))
    return y.join(F.broadcast(fit)).select("year", F.round("rate", 6).alias("rate"), F.round(F.greatest(F.lit(0.0), F.col("b") + F.col("a") * F.col("year")), 6).alias("expected"))


@query(f"{YEARLY} SELECT year, round(100 * rate / (SELECT avg(rate) FROM r WHERE year BETWEEN 2015 AND 2019), 6) AS idx FROM r")
def index_to_base(spark, sf):
    y = yearly(spark, sf)
    base = y.where(F.col("year").between(2015, 2019)).agg(F.avg("rate").alias("b"))
    return y.join(F.broadcast(base)).select("year", F.round(100 * F.col("rate") / F.col("b"), 6).alias("idx"))


# Word pairs

BI = "list_transform(range(1, greatest(len(toks), 1)), lambda i: toks[i] || ' ' || toks[i + 1])"


@query(f"SELECT word, year, n, total, round(100 * freq, 9) AS pct FROM ({watch_sql('year', PHRASES, BI)})")
def bigram_watch(spark, sf):
    w = frequency.watch(documents(spark, sf).withColumn("pairs", frequency.bigrams(F.col("toks"))), PHRASES, "year", units=F.col("pairs"))
    return w.select("word", "year", "n", "total", r9(100 * F.col("freq")).alias("pct"))


@query(excess_sql(25, 0, BI))
def bigram_excess(spark, sf):
    return frequency.excess_units(documents(spark, sf), BASE, RECENT, 25, units=frequency.bigrams(F.col("toks")))


RECENT_ONLY = f"{C}, rc AS (SELECT * FROM c WHERE year BETWEEN {RECENT[0]} AND {RECENT[1]})"


def recent(spark, sf):
    return documents(spark, sf).where(F.col("year").between(*RECENT))


@query(f"{RECENT_ONLY} SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(toks)) AS word FROM rc) WHERE word IN ({quoted(WORDS)}) GROUP BY word")
def marker_singles(spark, sf):
    return frequency.document_frequency(recent(spark, sf), among=WORDS)


PAIRS = f"{RECENT_ONLY}, s AS (SELECT base_id, unnest(list_distinct(toks)) AS w FROM rc), m AS (SELECT * FROM s WHERE w IN ({quoted(WORDS)})), n AS (SELECT w, count(*) AS n FROM m GROUP BY w), k AS (SELECT a.w AS w1, b.w AS w2, count(*) AS pairs FROM m a JOIN m b ON a.base_id = b.base_id AND a.w < b.w GROUP BY ALL), d AS (SELECT count(*) AS docs FROM rc)"
EVERY = f"l AS (SELECT unnest([{quoted(WORDS)}]) AS w), p AS (SELECT a.w AS w1, b.w AS w2, coalesce(k.pairs, 0) AS pairs, coalesce(n1.n, 0) AS n1, coalesce(n2.n, 0) AS n2, docs FROM l a JOIN l b ON a.w < b.w CROSS JOIN d LEFT JOIN k ON k.w1 = a.w AND k.w2 = b.w LEFT JOIN n n1 ON n1.w = a.w LEFT JOIN n n2 ON n2.w = b.w), e AS (SELECT *, n1 * n2 / docs AS expected FROM p)"


@query(f"{PAIRS} SELECT * FROM k")
def marker_pairs(spark, sf):
    return frequency.pair_counts(recent(spark, sf), WORDS)


@query(f"{PAIRS}, {EVERY} SELECT w1, w2, pairs, n1, n2, docs, round(expected, 9) AS expected, CASE WHEN expected > 0 THEN round(pairs / expected, 9) END AS lift FROM e")
def lift(spark, sf):
    return frequency.lift(recent(spark, sf), WORDS).withColumns({"expected": r9("expected"), "lift": r9("lift")})


POISSON = "CASE WHEN pairs <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, pairs), lambda j: exp(j * ln(expected) - expected - lgamma(j + 1))))) END"


@query(f"{PAIRS}, {EVERY}, z AS (SELECT *, {POISSON} AS p FROM e) SELECT w1, w2, pairs, round(expected, 9) AS expected, round(p, 7) AS p, p < 0.01 AS significant FROM z")
def significant_pairs(spark, sf):
    return frequency.significant_pairs(recent(spark, sf), WORDS).select("w1", "w2", "pairs", r9("expected").alias("expected"), F.round("p", 7).alias("p"), "significant")


# Tone and length

TONE = f"WITH {c_sql(corpus.HYPHENATED)}, t AS (SELECT year, len(toks) AS ntok, len(list_filter(toks, lambda t: t IN ({quoted(HYPE)}))) AS hype, len(list_filter(toks, lambda t: t IN ({quoted(HEDGE)}))) AS hedge FROM c), y AS (SELECT year, count(*) AS n, CAST(sum(ntok) AS BIGINT) AS tokens, " + ", ".join(f"round(count(*) FILTER ({k} > 0) * 100.0 / count(*), 9) AS {k}_docpct, round(sum({k}) * 1000.0 / nullif(sum(ntok), 0), 9) AS {k}_per1k" for k in ("hype", "hedge")) + " FROM t GROUP BY year)"


@query(f"{TONE} SELECT * FROM y")
def tone_year(spark, sf):
    t = frequency.tone(documents(spark, sf, corpus.HYPHENATED), {"hype": HYPE, "hedge": HEDGE}, "year")
    return t.withColumns({c: r9(c) for c in t.columns if c.startswith("h")})


TONE_CHANGE = ", ".join(f"round(avg({c}) FILTER (year BETWEEN 2015 AND 2021), 6) AS {c}_pre, round(avg({c}) FILTER (year BETWEEN 2023 AND 2025), 6) AS {c}_post, round(100 * (avg({c}) FILTER (year BETWEEN 2023 AND 2025) / avg({c}) FILTER (year BETWEEN 2015 AND 2021) - 1), 4) AS {c}_change" for c in ("hype_per1k", "hedge_per1k"))


@query(f"{TONE} SELECT {TONE_CHANGE} FROM y")
def tone_pre_post(spark, sf):
    out = [c for k in ("hype_per1k", "hedge_per1k") for c in frequency.tone_change(tone_year(spark, sf), k)]
    t = tone_year(spark, sf).agg(*out)
    return t.withColumns({c: F.round(c, 4 if c.endswith("change") else 6) for c in t.columns})


@query(f"{C} SELECT year, round(avg(len(toks)), 6) AS mean_tokens FROM c GROUP BY year")
def length_by_year(spark, sf):
    return documents(spark, sf).groupBy("year").agg(F.round(F.avg(F.size("toks")), 6).alias("mean_tokens"))


# Audits


@query(r"""SELECT doc_id, list_aggregate(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(^|[^\\])%')), lambda x: regexp_extract(x, '(?:^|[^\\])%(.*)$', 1)), 'string_agg', chr(10)) AS comments FROM documents WHERE regexp_matches(text, '(^|[^\\])%')""")
def comment_extract(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike(r"(?<!\\)%"))
    return d.select("doc_id", audit.comments(F.col("text")).alias("comments"))


@query(" UNION ALL ".join(f"SELECT page_id, CAST({t} AS INTEGER) AS tier, '{p}' AS pattern FROM pages WHERE regexp_matches(html, '(?i){p}')" for t, p in PATTERNS))
def pattern_scan(spark, sf):
    return audit.pattern_hits(table(spark, sf, "pages"), "page_id", "html", PATTERNS).drop("snippet")


@query("SELECT DISTINCT b.text FROM benchmark b ANTI JOIN documents d ON b.text = d.text")
def missing_refs(spark, sf):
    return audit.missing(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "text")


# Composition


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\b(the|and)\\b') AND regexp_matches(text, '(?i)\\bof\\b') AND NOT regexp_matches(text, '(?i)\\btion\\b')")
def boolean_fulltext(spark, sf):
    return table(spark, sf, "documents").where(audit.full_text(F.col("text"), ["the", "and"], ["of"], ["tion"])).select("doc_id")


COUNTRY = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def placed_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), (F.col("o_orderpriority") == "1-URGENT").alias("mark"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


@query(f"SELECT n_name AS country, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS marker, round(count(*) FILTER (o_orderpriority = '1-URGENT') * 100.0 / count(*), 9) AS marker_pct {COUNTRY} GROUP BY ALL")
def country_rate(spark, sf):
    g = placed_orders(spark, sf).groupBy(F.col("n_name").alias("country"), "year").agg(F.count("*").alias("total"), F.sum(F.col("mark").cast("bigint")).alias("marker"))
    return g.withColumn("marker_pct", r9(F.col("marker") * 100.0 / F.col("total")))


@query(f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_all, count(*) FILTER (r_name = 'EUROPE') AS n_native, count(*) FILTER (r_name = 'EUROPE' AND o_orderpriority <> '1-URGENT') AS n_strict {COUNTRY} GROUP BY ALL")
def native_strict(spark, sf):
    native = F.col("r_name") == "EUROPE"
    return placed_orders(spark, sf).groupBy("year").agg(F.count("*").alias("n_all"), F.count(F.when(native, 1)).alias("n_native"), F.count(F.when(native & ~F.col("mark"), 1)).alias("n_strict"))


DISCLOSED = "SELECT 2015 + doc_id % 12 AS year, count(*) AS total, count(*) FILTER (toxic = 1) AS ack, count(*) FILTER (quality = 0) AS confounded FROM labels GROUP BY year"


@query(DISCLOSED.replace("GROUP BY year", "GROUP BY ALL"))
def disclosure_year(spark, sf):
    l = table(spark, sf, "labels").withColumn("year", 2015 + F.col("doc_id") % 12)  # noqa: E741
    return l.groupBy("year").agg(F.count("*").alias("total"), F.count(F.when(F.col("toxic") == 1, 1)).alias("ack"), F.count(F.when(F.col("quality") == 0, 1)).alias("confounded"))


@query(f"{YEARLY}, l AS ({DISCLOSED.replace('GROUP BY year', 'GROUP BY ALL')}) SELECT year, rate, l.ack / l.total AS disclosed FROM r JOIN l USING (year)")
def adoption_vs_disclosure(spark, sf):
    return yearly(spark, sf).select("year", "rate").join(disclosure_year(spark, sf).select("year", (F.col("ack") / F.col("total")).alias("disclosed")), "year")


def disclosure_sql(more: str = "") -> str:
    """Texts with a marker in their last line (ack) or anywhere (full), per year."""
    has = lambda c: "(" + " OR ".join(f"regexp_matches({c}, '(?i)(^|\\W){t}($|\\W)')" for t in MARKERS) + ")"
    return f"SELECT year, count(*) AS total, count(*) FILTER ({has('ack')}) AS ack, count(*) FILTER ({has('body')}) AS \"full\"{', ' + more if more else ''} FROM (SELECT 2015 + doc_id % 12 AS year, string_split(text, chr(10))[-1] AS ack, text AS body FROM documents) GROUP BY year"


# Duplicates and samples

VERSIONS = "SELECT doc_id // 2 AS base, doc_id AS seq, lang FROM documents"


def versions(spark, sf):
    return table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 2).alias("base"), F.col("doc_id").alias("seq"), "lang")


@query(f"SELECT base, min(seq) AS seq, arg_min(lang, seq) AS lang FROM ({VERSIONS}) GROUP BY base")
def dedup_first(spark, sf):
    return corpus.first_versions(versions(spark, sf), "base", "seq")


@query(f"SELECT count(*) AS n_records, count(DISTINCT base) AS n_keys, count(*) - count(DISTINCT base) AS n_duplicates FROM ({VERSIONS})")
def dup_count(spark, sf):
    return corpus.duplicates(versions(spark, sf), "base")


@query(f"{C}, o AS (SELECT year, base_id, row_number() OVER (PARTITION BY year ORDER BY base_id) - 1 AS rn, count(*) OVER (PARTITION BY year) AS cnt FROM c) SELECT DISTINCT year, base_id FROM o WHERE cnt <= 10 OR rn IN (SELECT (k * o.cnt) // 10 FROM range(10) t(k))")
def stride_sample(spark, sf):
    return corpus.stride_sample(documents(spark, sf), "year", "base_id", 10)


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def hash_sample(spark, sf):
    return corpus.hash_sample(table(spark, sf, "documents"), "doc_id", 100)


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return live.counts(table(spark, sf, "events"), "ts", "event_id", "1 day", "1 hour", "event_type")
