"""More queries with their SQL: trajectories, checks against chance, audits, samples, sources and sinks, report frames.

Where the driver's texts hold none of what an operator looks for, a query puts it together from their columns, in the same way in its SQL."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordtide.functions import lexicons, stats
from wordtide.operators import audit, corpus, frequency, report
from wordtide.sources import feed, readers
from wordtide.sources.shared import fresh_path, materialise
from wordtide.streaming import live

from .catalog import BASE, BASE_RATE, C, CONTROLS, HIT, MARKERS, PATTERNS, PERIODS, RECENT, TONE, WORDS, YEARLY, disclosure_sql, documents, excess_sql, excess_words, query, quoted, r9, table, watch_sql, yearly

# Trajectories: the spine's quarters, zeros included

SPINE = "spine AS (SELECT CAST(y AS INTEGER) AS year, CAST(q AS INTEGER) AS quarter FROM range(2022, 2027) a(y), range(1, 5) b(q) WHERE y * 4 + q BETWEEN 8089 AND 8106)"
COURSE = (
    f"{C}, {SPINE}, t AS (SELECT s.year, s.quarter, count(c.base_id) AS total, "
    + ", ".join(f"count(*) FILTER (list_contains(toks, '{w}')) AS w{k}" for k, w in enumerate(MARKERS))
    + " FROM spine s LEFT JOIN c ON c.year = s.year AND c.quarter = s.quarter GROUP BY ALL), s AS (SELECT *, CASE WHEN total > 0 THEN n / total ELSE 0.0 END AS freq FROM ("
    + " UNION ALL ".join(f"SELECT '{w}' AS word, year, quarter, w{k} AS n, total FROM t" for k, w in enumerate(MARKERS))
    + ")), o AS (SELECT *, year * 4 + quarter AS q, row_number() OVER (PARTITION BY word ORDER BY year * 4 + quarter DESC) AS back FROM s), p0 AS (SELECT word, arg_max(q, (freq, -q)) AS pq, max(freq) AS peak_val, avg(freq) FILTER (back <= 4) AS recent FROM o GROUP BY word), "
    + "p AS (SELECT *, CASE WHEN peak_val < 0.001 THEN 'rare' WHEN pq <= 8100 THEN 'early' ELSE 'late' END AS cluster FROM p0), "
    + "k AS (SELECT year, quarter, any_value(total) AS total, sum(n) AS n, coalesce(sum(n) FILTER (cluster = 'early'), 0) AS n_early, coalesce(sum(n) FILTER (cluster = 'late'), 0) AS n_late FROM s JOIN p USING (word) GROUP BY year, quarter), "
    + "ks AS (SELECT year, quarter, year + (quarter - 1) / 4 AS yq, year || 'Q' || quarter AS label, total, n / nullif(total, 0) AS all_markers, n_early / nullif(total, 0) AS early, n_late / nullif(total, 0) AS late FROM k)"
)


def course(spark, sf):
    return frequency.trajectories(documents(spark, sf), MARKERS)


def clustered(spark, sf):
    series = materialise(course(spark, sf), "course")
    return frequency.cluster_series(series, frequency.peaks(series))


@query(f"{COURSE} SELECT word, year, quarter, n, total, freq FROM s")
def trajectory(spark, sf):
    return course(spark, sf)


@query(f"{COURSE} SELECT word, ((pq - 1) // 4) || 'Q' || ((pq - 1) % 4 + 1) AS peak_q, peak_val, round(recent, 9) AS recent, cluster FROM p")
def word_peak(spark, sf):
    return frequency.peaks(course(spark, sf)).withColumn("recent", r9("recent"))


@query(f"{COURSE} SELECT year, quarter, yq, label, total, round(all_markers, 9) AS all_markers, round(early, 9) AS early, round(late, 9) AS late FROM ks")
def cluster_series(spark, sf):
    return clustered(spark, sf).withColumns({c: r9(c) for c in ("all_markers", "early", "late")})


DELTA = ", ".join(f"max({c}) FILTER (label = '2025Q2') - max({c}) FILTER (label = '2026Q2') AS d_{c}" for c in ("all_markers", "early", "late"))


@query(f"{COURSE}, d AS (SELECT {DELTA} FROM ks) SELECT round(d_all_markers, 9) AS d_all_markers, round(d_early, 9) AS d_early, round(d_late, 9) AS d_late, CASE WHEN abs(d_all_markers) > 1e-9 THEN round(d_early / d_all_markers, 6) END AS explained FROM d")
def cluster_delta(spark, sf):
    d = frequency.cluster_delta(clustered(spark, sf))
    return d.select(*[r9(f"d_{c}").alias(f"d_{c}") for c in ("all_markers", "early", "late")], F.round("explained", 6).alias("explained"))


# Checks: controls, leave-one-out, lengths, tails, chance

CONTROL_EXCESS = " UNION ALL ".join(f"SELECT '{w}' AS word, count(*) FILTER (period = 'recent' AND list_contains(toks, '{w}')) / count(*) FILTER (period = 'recent') - count(*) FILTER (period = 'base' AND list_contains(toks, '{w}')) / count(*) FILTER (period = 'base') AS excess FROM p" for w in CONTROLS)


@query(f"{C}, p AS (SELECT {PERIODS} AS period, toks FROM c), x AS ({CONTROL_EXCESS}) SELECT word, round(excess, 9) AS excess, round((SELECT max(abs(excess)) FROM x), 9) AS max_abs FROM x")
def control_excess(spark, sf):
    e = frequency.control_excess(documents(spark, sf), BASE, RECENT, CONTROLS)
    return e.withColumns({c: r9(c) for c in ("excess", "max_abs")})


def alpha_without(words: list[str]) -> str:
    return f"count(*) FILTER (period = 'recent' AND list_has_any(toks, [{quoted(words)}])) / count(*) FILTER (period = 'recent') - count(*) FILTER (period = 'base' AND list_has_any(toks, [{quoted(words)}])) / count(*) FILTER (period = 'base')"


@query(
    f"{C}, p AS (SELECT {PERIODS} AS period, toks FROM c), x AS ("
    + " UNION ALL ".join(f"SELECT '{w}' AS word, {alpha_without([m for m in MARKERS if m != w])} AS alpha FROM p" for w in MARKERS)
    + f") SELECT round((SELECT {alpha_without(MARKERS)} FROM p), 9) AS alpha_full, round(min(alpha), 9) AS least, round(max(alpha), 9) AS largest, (SELECT word FROM x ORDER BY alpha, word LIMIT 1) AS least_word, (SELECT word FROM x ORDER BY alpha DESC, word LIMIT 1) AS largest_word FROM x"
)
def loo_range(spark, sf):
    return frequency.leave_one_out_range(documents(spark, sf), MARKERS, BASE, RECENT).withColumns({c: r9(c) for c in ("alpha_full", "least", "largest")})


@query(f"{C}, l AS (SELECT year, len(toks) AS ntok, len(list_filter(toks, lambda t: t IN ({quoted(MARKERS)}))) AS own FROM c) SELECT year, round(avg(ntok), 6) AS mean_tokens, round(sum(own) * 1000.0 / nullif(sum(ntok), 0), 9) AS per1000, round(count(*) FILTER (own > 0) * 100.0 / count(*), 9) AS docpct FROM l GROUP BY year")
def occurrences_per_1000(spark, sf):
    return frequency.lengths(documents(spark, sf), MARKERS, "year").withColumns({"mean_tokens": F.round("mean_tokens", 6), "per1000": r9("per1000"), "docpct": r9("docpct")})


LOW, RATIO, TOP, OTHERS = 0.02, 1.2, 50, ["erer", "thea", "the", "onhe"]
RISEN = f"x AS ({excess_sql(30, 3)}), tl AS (SELECT * FROM x WHERE base_freq > {LOW} AND ratio >= {RATIO})"
IN_B, IN_I = f"word IN ({quoted(WORDS)})", f"word IN ({quoted(OTHERS)})"


@query(f"WITH {RISEN} SELECT word, base_freq, rec_freq, ratio FROM tl")
def vocabulary_tail(spark, sf):
    return frequency.tail(excess_words(spark, sf), LOW, RATIO).select("word", "base_freq", "rec_freq", "ratio")


@query(f"WITH {RISEN}, tp AS (SELECT word FROM x WHERE base_freq > {LOW} ORDER BY ratio DESC, word LIMIT {TOP}) SELECT (SELECT count(*) FROM tl) AS tail_size, (SELECT count(*) FROM tl WHERE {IN_B}) AS basket_in_tail, (SELECT count(*) FROM tl WHERE {IN_B} OR {IN_I}) AS listed_in_tail, (SELECT count(*) FROM tl WHERE NOT ({IN_B} OR {IN_I})) AS unlisted_in_tail, (SELECT count(*) FROM tp WHERE {IN_B}) AS basket_in_top, (SELECT count(*) FROM tp WHERE {IN_I}) AS instruments_in_top")
def tail_sets(spark, sf):
    return frequency.tail_sets(materialise(excess_words(spark, sf), "excess"), WORDS, OTHERS, LOW, RATIO, TOP)


POOL_WORDS = f"pool AS (SELECT word FROM ({excess_sql(30, 3)}) WHERE base_freq > 0.02 AND base_freq < 0.2 AND regexp_full_match(word, '[a-z]+') AND length(word) >= 4 AND word NOT IN ({quoted(WORDS)}))"
N_BASKETS, BASKET_SIZE = 50, 38
BASKETS = f"b AS (SELECT k, word FROM (SELECT k, word, row_number() OVER (PARTITION BY k ORDER BY md5(word || ':' || k || ':7'), word) AS rn FROM pool, range(1, {N_BASKETS + 1}) t(k)) WHERE rn <= {BASKET_SIZE})"


def placebo_baskets(spark, sf):
    return frequency.placebo_pool(excess_words(spark, sf), 0.02, 0.2, 4, WORDS), N_BASKETS, BASKET_SIZE


@query(f"WITH {POOL_WORDS}, {BASKETS} SELECT CAST(k AS INTEGER) AS k, word FROM b")
def seeded_baskets(spark, sf):
    return corpus.seeded_baskets(*placebo_baskets(spark, sf))


@query(
    f"{C}, {POOL_WORDS}, {BASKETS}, p AS (SELECT base_id, CASE WHEN year BETWEEN 2018 AND 2021 THEN 'base' WHEN year = 2025 THEN 'recent' END AS period, toks FROM c), w AS (SELECT base_id, period, unnest(list_distinct(toks)) AS word FROM p WHERE period IS NOT NULL), h AS (SELECT k, period, count(DISTINCT base_id) AS n FROM w JOIN b USING (word) GROUP BY ALL), "
    "n AS (SELECT count(*) FILTER (period = 'base') AS nb, count(*) FILTER (period = 'recent') AS nr FROM p), a AS (SELECT k, 100 * coalesce(max(h.n) FILTER (h.period = 'recent'), 0) / any_value(nr) - 100 * coalesce(max(h.n) FILTER (h.period = 'base'), 0) / any_value(nb) AS alpha FROM (SELECT DISTINCT k FROM b) LEFT JOIN h USING (k), n GROUP BY k) "
    "SELECT count(*) AS n_baskets, round(avg(alpha), 6) AS mean_pp, round(stddev_pop(alpha), 6) AS sd_pp, round(max(alpha), 6) AS max_pp FROM a"
)
def placebo(spark, sf):
    drawn = materialise(corpus.seeded_baskets(*placebo_baskets(spark, sf)), "baskets")
    a = frequency.placebo_by_bits(documents(spark, sf), drawn)
    return a.agg(F.count("*").alias("n_baskets"), F.round(F.avg("alpha"), 6).alias("mean_pp"), F.round(F.stddev_pop("alpha"), 6).alias("sd_pp"), F.round(F.max("alpha"), 6).alias("max_pp"))


def tail_p(x: str, mu: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, {x}), lambda j: exp(j * ln({mu}) - {mu} - lgamma(j + 1))))) END"


M = sorted(MARKERS)
ALL_PAIRS = f"(SELECT a.w AS w1, b.w AS w2 FROM (SELECT unnest([{quoted(M)}]) AS w) a, (SELECT unnest([{quoted(M)}]) AS w) b WHERE a.w < b.w)"
RECENT_DOCS = f"{C}, d AS (SELECT * FROM c WHERE year BETWEEN {RECENT[0]} AND {RECENT[1]})"
N_PERM = 20


@query(
    f"""{RECENT_DOCS}, h AS (SELECT base_id, subfield, unnest(list_distinct(list_filter(toks, lambda t: t IN ({quoted(M)})))) AS w FROM d), c1 AS (SELECT subfield, w, count(*) AS c FROM h GROUP BY ALL),
    dealt AS (SELECT perm, subfield, w, base_id, row_number() OVER (PARTITION BY perm, subfield, w ORDER BY md5('0:' || perm || ':' || w || ':' || base_id), base_id) AS rn FROM d, range(1, {N_PERM + 1}) p(perm), (SELECT unnest([{quoted(M)}]) AS w)),
    g AS (SELECT perm, base_id, w FROM dealt JOIN c1 USING (subfield, w) WHERE rn <= c UNION ALL SELECT 0, base_id, w FROM h),
    pc AS (SELECT a.perm, a.w AS w1, b.w AS w2, count(*) AS pairs FROM g a JOIN g b ON a.perm = b.perm AND a.base_id = b.base_id AND a.w < b.w GROUP BY ALL),
    n1 AS (SELECT w, count(*) AS n FROM h GROUP BY w), e AS (SELECT w1, w2, x.n * y.n / (SELECT count(*) FROM d) AS mu FROM {ALL_PAIRS} JOIN n1 x ON x.w = w1 JOIN n1 y ON y.w = w2),
    s AS (SELECT perm, count(*) FILTER ({tail_p("pairs", "mu")} < 0.01) AS sig FROM pc JOIN e USING (w1, w2) GROUP BY perm), f AS (SELECT perm, coalesce(sig, 0) AS sig FROM range(0, {N_PERM + 1}) r(perm) LEFT JOIN s USING (perm)), ob AS (SELECT sig AS observed FROM f WHERE perm = 0)
    SELECT (SELECT count(*) FROM d) AS n, (SELECT count(DISTINCT subfield) FROM d) AS n_subfields, {N_PERM} AS n_perm, any_value(observed) AS observed, round(avg(sig), 9) AS null_mean, round(quantile_cont(sig, 0.95), 9) AS null_p95, round(avg(CASE WHEN sig >= observed THEN 1.0 ELSE 0.0 END), 9) AS p FROM f, ob WHERE perm > 0"""
)
def permutation_null(spark, sf):
    d = documents(spark, sf).where(F.col("year").between(*RECENT))
    return frequency.permutation_null(d, MARKERS, N_PERM).withColumns({c: r9(c) for c in ("null_mean", "null_p95", "p")})


def t_p(t: str, nu: str) -> str:
    """The two-sided p of t for whole degrees of freedom, by the finite sums of sines and cosines."""
    th = f"atan(abs({t}) / sqrt({nu}))"
    even = f"sin({th}) * list_sum(list_transform(range(0, {nu} // 2), lambda j: coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: (2 * i - 1) / (2.0 * i)), 'product'), 1.0) * pow(cos({th}), 2 * j)))"
    odd = f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(0, ({nu} - 1) // 2), lambda j: coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: (2.0 * i) / (2 * i + 1)), 'product'), 1.0) * pow(cos({th}), 2 * j + 1))), 0.0))"
    return f"1 - (CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)"


@query(f"{YEARLY}, k AS (SELECT count(*) AS n, corr(rate, crate) AS r FROM r), t AS (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM k) SELECT n, round(r, 6) AS r, round(t, 6) AS t, round({t_p('t', '(n - 2)')}, 6) AS p FROM t")
def correlation_test(spark, sf):
    return stats.correlation(yearly(spark, sf), "rate", "crate").withColumns({c: F.round(c, 6) for c in ("r", "t", "p")})


@query(
    f"""{C}, q AS (SELECT year + (quarter - 1) / 4 AS x, count(*) FILTER ({HIT}) / count(*) AS y FROM c GROUP BY year, quarter), z AS (SELECT *, CASE WHEN x >= 2022.75 THEN 1.0 ELSE 0.0 END AS s FROM q),
    f AS (SELECT regr_slope(y, x) AS sy, regr_intercept(y, x) AS iy, regr_slope(s, x) AS ss, regr_intercept(s, x) AS si FROM z), r AS (SELECT y - iy - sy * x AS ry, s - si - ss * x AS rs FROM z, f),
    u AS (SELECT count(*) AS n, sum(ry * rs) AS ys, sum(rs * rs) AS ss, sum(ry * ry) AS l FROM r), v AS (SELECT n, ys / ss AS step, l, l - ys * ys / ss AS w FROM u), x AS (SELECT *, (l - w) / (w / (n - 3)) AS f FROM v)
    SELECT n, round(step, 8) AS step, round(l, 8) AS rss_line, round(w, 8) AS rss_step, round(f, 5) AS f, round({t_p('sqrt(f)', '(n - 3)')}, 6) AS p FROM x"""
)
def step_test(spark, sf):
    q = frequency.basket_rate(documents(spark, sf), MARKERS, "year", "quarter").select(corpus.yq(F.col("year"), F.col("quarter")).alias("x"), "rate")
    return stats.step_test(q, "x", "rate", 2022.75).withColumns({"step": F.round("step", 8), "rss_line": F.round("rss_line", 8), "rss_step": F.round("rss_step", 8), "f": F.round("f", 5), "p": F.round("p", 6)})


@query(f"{C} SELECT year, count(*) AS n, count(*) FILTER (list_contains(toks, 'qqqq')) AS k, CASE WHEN count(*) FILTER (list_contains(toks, 'qqqq')) = 0 THEN round(least(3 / count(*), 1.0), 9) END AS upper_limit FROM c GROUP BY year")
def upper_limits(spark, sf):
    d = documents(spark, sf).groupBy("year").agg(F.count("*").alias("n"), F.sum(F.array_contains("toks", "qqqq").cast("bigint")).alias("k"))
    return d.withColumn("upper_limit", r9(stats.upper_limit(F.col("k"), F.col("n"))))


@query(f"{C} SELECT year, round(quantile_cont(len(toks), 0.05), 6) AS p05, round(quantile_cont(len(toks), 0.5), 6) AS p50, round(quantile_cont(len(toks), 0.95), 6) AS p95 FROM c GROUP BY year")
def length_percentiles(spark, sf):
    return documents(spark, sf).select("year", F.size("toks").alias("n")).groupBy("year").agg(*[F.round(F.percentile("n", p), 6).alias(f"p{int(100 * p):02d}") for p in (0.05, 0.5, 0.95)])


# Subfields, groups and classes

LABELS = {"en": "English", "fr": "French", "it": "Italian"}


@query(f"{C}, k AS (SELECT cat, label, CAST(y AS INTEGER) AS year FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in LABELS.items())}) AS l(cat, label), range(2018, 2027) t(y)) SELECT cat, label, k.year, count(c.base_id) AS n, CASE WHEN count(c.base_id) > 0 THEN round(100 * count(*) FILTER ({HIT}) / count(c.base_id), 9) ELSE 0.0 END AS rate FROM k LEFT JOIN c ON c.subfield = cat AND c.year = k.year GROUP BY ALL")
def subfield_table(spark, sf):
    return frequency.subfield_table(documents(spark, sf), MARKERS, LABELS).withColumn("rate", r9("rate"))


GROUPS = {"strong": MARKERS[:2], "soft": MARKERS[1:], "control": CONTROLS}
GROUP_SQL = "CASE " + " ".join(f"WHEN word IN ({quoted(ws)}) THEN '{g}'" for g, ws in GROUPS.items()) + " END"


@query(f"SELECT word, {GROUP_SQL} AS grp, year, quarter, year + (quarter - 1) / 4 AS yq, n, total, freq FROM ({watch_sql('year, quarter', WORDS)})")
def watch_groups(spark, sf):
    w = frequency.watch(documents(spark, sf), WORDS, "year", "quarter")
    return w.select("word", audit.listed(F.col("word"), GROUPS).alias("grp"), "year", "quarter", corpus.yq(F.col("year"), F.col("quarter")).alias("yq"), "n", "total", "freq")


WORD_LISTS, TOPICS = {"inst": ["erer", "thea", "onhe"], "ml": ["and", "tion"], "sty": ["the", "of", "tion"]}, ["the", "tion"]
BI = "list_transform(range(1, greatest(len(toks), 1)), lambda i: toks[i] || ' ' || toks[i + 1])"


def two_frequencies(spark, sf):
    d = documents(spark, sf)
    return excess_words(spark, sf), frequency.excess_units(d, BASE, RECENT, 25, units=frequency.bigrams(F.col("toks")))


CLASS_SQL = "CASE " + " ".join(f"WHEN word IN ({quoted(ws)}) THEN '{g}'" for g, ws in WORD_LISTS.items()) + " END"
PAIR_SQL = f"CASE WHEN list_has_any(string_split(word, ' '), [{quoted(TOPICS)}]) THEN 'inst' ELSE 'sty' END"


@query(f"SELECT 'word' AS kind, word, base_freq, rec_freq, ratio, CASE WHEN (base_freq > 0.05 OR word IN ('thon')) AND ratio >= 1.05 THEN {CLASS_SQL} END AS class FROM ({excess_sql(30, 3)}) WHERE rec_freq > 0 AND ratio > 0 UNION ALL SELECT 'pair', word, base_freq, rec_freq, ratio, CASE WHEN base_freq > 0.05 AND ratio >= 1.05 THEN {PAIR_SQL} END FROM ({excess_sql(25, 0, BI)}) WHERE rec_freq > 0 AND ratio > 0")
def volcano(spark, sf):
    words, pairs = two_frequencies(spark, sf)
    return report.volcano(words, pairs, audit.word_class(F.col("word"), WORD_LISTS), audit.phrase_class(F.col("word"), TOPICS), ["thon"], 0.05, 1.05)


# Audits

SCAN = (
    r"sc AS (SELECT page_id AS id, 2015 + page_id % 12 AS year, html AS full_text, coalesce(list_aggregate(list_transform(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '(^|[^\\])%')), lambda x: regexp_extract(x, '(?:^|[^\\])%(.*)$', 1)), 'string_agg', chr(10)), '') AS comments FROM pages), "
    "h AS ("
    + " UNION ALL ".join(f"SELECT id, year, {t} AS tier, '{p}' AS pattern, '{w}' AS where_, {c} AS body FROM sc WHERE strpos(lower({c}), '{p}') > 0" for t, p, w, c in [(t, p, "body_or_comment", "full_text") for t, p in PATTERNS if t == 1] + [(t, p, "comment", "comments") for t, p in PATTERNS if t == 2] + [(2, "a", "comment", "comments")])
    + "), hd AS (SELECT id, year, tier, pattern, where_ AS \"where\", replace(substring(body, greatest(strpos(lower(body), pattern) - 40, 1), strpos(lower(body), pattern) + length(pattern) + 40 - greatest(strpos(lower(body), pattern) - 40, 1)), chr(10), ' ') AS snippet FROM h)"
)


def scans(spark, sf):
    p = table(spark, sf, "pages")
    found = audit.hits(F.coalesce(F.col("html"), F.lit("")), [x for x in PATTERNS if x[0] == 1], [*[x for x in PATTERNS if x[0] == 2], (2, "a")])
    return p.select(F.col("page_id").alias("id"), (2015 + F.col("page_id") % 12).alias("year"), F.lit(True).alias("ok"), readers.has_source(F.lit(0), F.col("html")).alias("has_source"), found.alias("hits"))


@query(f"WITH {SCAN} SELECT id, year, tier, pattern, \"where\", snippet FROM hd")
def hit_detail(spark, sf):
    return audit.hit_detail(scans(spark, sf))


BY_YEAR = f"{SCAN}, sy AS (SELECT year, count(*) AS scanned, count(*) FILTER (length(full_text) > 200) AS with_source, count(*) FILTER (id IN (SELECT id FROM h WHERE tier = 1)) AS tier1, count(*) FILTER (id IN (SELECT id FROM h WHERE tier = 2)) AS tier2 FROM sc GROUP BY year)"


@query(f"WITH {BY_YEAR} SELECT *, round(100.0 * with_source / scanned, 9) AS src_pct, round(100.0 * tier1 / scanned, 9) AS tier1_pct, round(100.0 * tier2 / scanned, 9) AS tier2_pct FROM sy")
def scan_by_year(spark, sf):
    return audit.scan_by_year(scans(spark, sf)).withColumns({c: r9(c) for c in ("src_pct", "tier1_pct", "tier2_pct")})


WINDOWS_OF = {"pre": (2015, 2022), "recent": (2024, 2026)}


def wilson_sql(k: str, n: str, sign: str) -> str:
    return f"round(({k} / {n} + 1.9208 / {n}) / (1 + 3.8416 / {n}) {sign} 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}), 9)"


@query(f"WITH {BY_YEAR}, x AS (" + " UNION ALL ".join(f"SELECT '{w}' AS \"window\", {t} AS tier, sum(tier{t}) AS hits, sum(scanned) AS scanned FROM sy WHERE year BETWEEN {a} AND {b}" for w, (a, b) in WINDOWS_OF.items() for t in (1, 2)) + f"), d AS (SELECT \"window\", tier, CAST(hits AS DOUBLE) AS k, CAST(scanned AS DOUBLE) AS m, CAST(hits AS BIGINT) AS hits, CAST(scanned AS BIGINT) AS scanned FROM x) SELECT \"window\", tier, hits, scanned, round(k / m, 9) AS rate, {wilson_sql('k', 'm', '-')} AS low, {wilson_sql('k', 'm', '+')} AS high, CASE WHEN hits = 0 THEN round(least(3 / m, 1.0), 9) END AS upper_limit FROM d")
def pooled_rates(spark, sf):
    return audit.pooled_rates(audit.scan_by_year(scans(spark, sf)), WINDOWS_OF).withColumns({c: r9(c) for c in ("rate", "low", "high", "upper_limit")})


CITED = "ci AS (SELECT page_id AS id, 2015 + page_id % 12 AS year, list_distinct(regexp_extract_all(html, '[0-9]{2,4}')) AS cited FROM pages)"


def citing(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), (2015 + F.col("page_id") % 12).alias("year"), F.array_distinct(F.regexp_extract_all("html", F.lit("[0-9]{2,4}"), F.lit(0))).alias("cited"))


@query(f"WITH {CITED}, g AS (SELECT id, year, unnest(cited) AS k FROM ci), m AS (SELECT g.*, k NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) AS gone FROM g), py AS (SELECT year, count(*) AS papers FROM ci GROUP BY year), cy AS (SELECT year, count(*) AS cited, count(*) FILTER (gone) AS missing, count(DISTINCT id) FILTER (gone) AS papers_with_missing FROM m GROUP BY year) SELECT year, papers, coalesce(cited, 0) AS cited, coalesce(missing, 0) AS missing, coalesce(papers_with_missing, 0) AS papers_with_missing, CASE WHEN coalesce(cited, 0) > 0 THEN round(100.0 * missing / cited, 9) ELSE 0.0 END AS missing_pct FROM py LEFT JOIN cy USING (year)")
def citation_year(spark, sf):
    authority = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("cited"))
    return audit.citations_by_year(citing(spark, sf), authority).withColumn("missing_pct", r9("missing_pct"))


@query(f"WITH {CITED}, g AS (SELECT DISTINCT unnest(cited) AS k FROM ci), a AS (SELECT CAST(doc_id AS VARCHAR) AS k, CASE doc_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 429 ELSE 200 END AS status FROM documents) SELECT k, CASE status WHEN 200 THEN true WHEN 404 THEN false END AS \"exists\" FROM g LEFT JOIN a USING (k)")
def existence(spark, sf):
    d = table(spark, sf, "documents")
    answers = d.select(F.col("doc_id").cast("string").alias("k"), F.when(F.col("doc_id") % 5 == 0, 404).when(F.col("doc_id") % 5 == 1, 429).otherwise(200).alias("status"))
    return audit.existence(citing(spark, sf).select(F.explode("cited").alias("k")), answers, "k")


REFS = "rf AS (SELECT doc_id, 'see doi:10.' || (1000 + doc_id % 9000) || '/Ab' || doc_id || '.), 10.48550/arXiv.' || doc_id || '; 10.12/no 10.5281/Zenodo.' || (doc_id % 7) || '}' || ' arXiv:2' || (101 + doc_id % 12) || '.0' || (1000 + doc_id % 10) || ' ARXIV: 1' || (101 + doc_id % 3) || '.12345 Cond-mat/060' || (1001 + doc_id % 9) || ' math/0601001 x/0601001' AS body FROM documents)"


def references(spark, sf):
    i = F.col("doc_id")
    parts = ["see doi:10.", 1000 + i % 9000, "/Ab", i, ".), 10.48550/arXiv.", i, "; 10.12/no 10.5281/Zenodo.", i % 7, "}", " arXiv:2", 101 + i % 12, ".0", 1000 + i % 10, " ARXIV: 1", 101 + i % 3, ".12345 Cond-mat/060", 1001 + i % 9, " math/0601001 x/0601001"]
    return table(spark, sf, "documents").select("doc_id", F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("body"))


ID_LIST = "list_sort(list_distinct(list_concat(regexp_extract_all(lower(body), 'arxiv[:\\s]*?(\\d{4}\\.\\d{4,5})', 1), regexp_extract_all(lower(body), '(?:astro-ph|gr-qc|hep-ph|hep-th|math|cond-mat|physics)/\\d{7}', 0))))"


@query(f"WITH {REFS} SELECT doc_id, array_to_string({ID_LIST}, ' ') AS ids, CAST(len({ID_LIST}) AS INTEGER) AS n_ids FROM rf")
def id_extract(spark, sf):
    r = references(spark, sf).withColumn("ids", audit.preprint_ids(F.col("body")))
    return r.select("doc_id", F.array_join("ids", " ").alias("ids"), F.size("ids").alias("n_ids"))


@query(f"WITH {REFS}, x AS (SELECT doc_id, unnest({ID_LIST}) AS id FROM rf) SELECT doc_id, id, regexp_full_match(id, '\\d{{4}}\\.\\d{{4,5}}') AS checkable FROM x")
def checkable_ids(spark, sf):
    return references(spark, sf).select("doc_id", F.explode(audit.preprint_ids(F.col("body"))).alias("id")).withColumn("checkable", audit.is_new_id(F.col("id")))


DOIS = "list_sort(list_distinct(list_transform(regexp_extract_all(body, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+'), lambda d: lower(rtrim(d, '.,;)}\"')))))"


@query(f"WITH {REFS} SELECT doc_id, array_to_string({DOIS}[1:200], ' ') AS dois, CAST(len({DOIS}) AS INTEGER) AS n_doi FROM rf")
def doi_extract(spark, sf):
    return references(spark, sf).select("doc_id", F.array_join(audit.dois(F.col("body")), " ").alias("dois"), audit.n_dois(F.col("body")).alias("n_doi"))


@query(f"WITH {REFS}, x AS (SELECT unnest({DOIS}) || '.}}x%y' AS d FROM rf), k AS (SELECT DISTINCT regexp_replace(rtrim(d, '.,;)}}]'), '[\\\\{{}}%].*$', '') AS d FROM x) SELECT d AS doi, regexp_matches(d, '^10\\.\\d{{4,9}}/\\S{{3,}}') AS valid FROM k")
def doi_clean(spark, sf):
    raw = references(spark, sf).select(F.explode(audit.dois(F.col("body"))).alias("d"))
    return raw.withColumn("d", F.concat("d", F.lit(".}x%y"))).select(audit.clean_doi(F.col("d")).alias("doi")).distinct().withColumn("valid", audit.is_doi(F.col("doi")))


@query(f"WITH {REFS}, x AS (SELECT DISTINCT unnest({DOIS}) AS d FROM rf) SELECT CASE WHEN contains(substring(d, 9), '10.48550/arxiv') THEN 'extraction artifact' WHEN starts_with(d, '10.48550/arxiv') THEN 'preprint' WHEN starts_with(d, '10.5281/zenodo') THEN 'archive' ELSE 'other' END AS bucket, count(*) AS n FROM x GROUP BY ALL")
def bucket(spark, sf):
    d = references(spark, sf).select(F.explode(audit.dois(F.col("body"))).alias("d")).distinct()
    return d.groupBy(audit.identifier_class(F.col("d")).alias("bucket")).agg(F.count("*").alias("n"))


SPOILT = "repeat(chr(1), CAST(page_id % 200 AS INTEGER)) || html"


@query(rf"SELECT page_id, length(regexp_replace(substring(html, 1, 4000), '[^\x00-\x08\x0E-\x1F]', '', 'g')) > 0.02 * length(substring(html, 1, 4000)) AS garbage, length(regexp_replace(substring({SPOILT}, 1, 4000), '[^\x00-\x08\x0E-\x1F]', '', 'g')) > 0.02 * length(substring({SPOILT}, 1, 4000)) AS spoilt FROM pages")
def garbage(spark, sf):
    spoilt = F.concat(F.repeat(F.lit("\x01"), (F.col("page_id") % 200).cast("int")), F.col("html"))
    return table(spark, sf, "pages").select("page_id", audit.is_garbage(F.col("html")).alias("garbage"), audit.is_garbage(spoilt).alias("spoilt"))


MARKED = "'**' || role || '** <a & b> [' || conv_id || '](http://x/' || turn || ') *' || text || '*'"


@query(rf"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace({MARKED}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\[([^\]]+)\]\(([^)]+)\)', '<a href="\2">\1</a>', 'g'), '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g'), '\*([^*]+)\*', '<em>\1</em>', 'g') AS html FROM conversations""")
def markdown_inline(spark, sf):
    c = table(spark, sf, "conversations")
    text = F.concat(F.lit("**"), "role", F.lit("** <a & b> ["), F.col("conv_id").cast("string"), F.lit("](http://x/"), F.col("turn").cast("string"), F.lit(") *"), "text", F.lit("*"))
    return c.select("conv_id", "turn", audit.markdown_inline(text).alias("html"))


# Boolean searches, places, versions


def term_sql(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(?i)(^|\\W){t}($|\\W)')" for t in terms) + ")"


@query(f"SELECT 2015 + doc_id % 12 AS year, count(*) AS total, count(*) FILTER ({term_sql('text', MARKERS)}) AS marked, count(*) FILTER ({term_sql('text', ['the'])} AND NOT {term_sql('text', MARKERS)}) AS plain, count(*) FILTER ({term_sql('text', ['of the'])} AND {term_sql('text', ['tion'])}) AS both FROM documents GROUP BY ALL")
def count_queries(spark, sf):
    d, t = table(spark, sf, "documents").withColumn("year", 2015 + F.col("doc_id") % 12), F.col("text")
    return audit.counts(d, {"total": F.lit(True), "marked": audit.any_term(t, MARKERS), "plain": audit.full_text(t, ["the"], none_of=MARKERS), "both": audit.full_text(t, ["of the"], ["tion"])}, "year")


@query(disclosure_sql(f"count(*) FILTER ({term_sql('ack', ['tion'])}) AS ack_tion, count(*) FILTER ({term_sql('ack', ['of'])}) AS confounded_of"))
def disclosure_terms(spark, sf):
    return audit.disclosure(with_ack(spark, sf), terms=MARKERS, singly=["tion"], confounded=["of"])


def with_ack(spark, sf):
    """The last line of a text stands in for its acknowledgements."""
    d = table(spark, sf, "documents")
    return d.select((2015 + F.col("doc_id") % 12).alias("year"), F.element_at(F.split("text", "\n"), -1).alias("ack"), F.col("text").alias("full"))


SHARES = f"sh AS (SELECT year, total, ack, \"full\", 100.0 * ack / total AS ack_pct, 100.0 * \"full\" / total AS full_pct FROM ({disclosure_sql()}))"


def shares(spark, sf):
    return report.disclosure_share(audit.disclosure(with_ack(spark, sf), terms=MARKERS, singly=[], confounded=[]))


@query(f"WITH {SHARES} SELECT year, total, ack, \"full\", round(ack_pct, 9) AS ack_pct, round(full_pct, 9) AS full_pct FROM sh")
def disclosure_share(spark, sf):
    return shares(spark, sf).withColumns({c: r9(c) for c in ("ack_pct", "full_pct")})


PLACES = "pl AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority = '1-URGENT' AS m, o_orderstatus = 'F' AS d, n_name AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey UNION SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER), o_orderpriority = '1-URGENT', o_orderstatus = 'F', n_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
GEO = f"{PLACES}, ge AS (SELECT place, year, count(*) AS total, count(*) FILTER (m) AS marker, count(*) FILTER (d) AS disc, 100.0 * count(*) FILTER (m) / count(*) AS marker_pct, 100.0 * count(*) FILTER (d) / count(*) AS disc_pct FROM pl GROUP BY ALL)"


def papers(spark, sf) -> DataFrame:
    """Orders with the nations of customer and suppliers as places."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), (F.col("o_orderpriority") == "1-URGENT").alias("m"), (F.col("o_orderstatus") == "F").alias("d"))
    own = o.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    of = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("s_name"))
    sold = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(of, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.collect_set("s_name").alias("names"))
    joined = own.join(sold, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "year", "m", "d", F.concat(F.array("n_name"), F.coalesce("names", F.array().cast("array<string>"))).alias("places"))


def places(spark, sf):
    g = audit.geography(papers(spark, sf), "o_orderkey", "places", "m", "d")
    return g


@query(f"WITH {GEO} SELECT place, year, total, marker, disc, round(marker_pct, 9) AS marker_pct, round(disc_pct, 9) AS disc_pct FROM ge")
def geography(spark, sf):
    return places(spark, sf).withColumns({c: r9(c) for c in ("marker_pct", "disc_pct")})


NATIVES, FOREIGN = ["NATION_1", "NATION_2"], ["NATION_3", "NATION_4", "NATION_5"]


@query(f"WITH {PLACES}, o AS (SELECT o_orderkey, any_value(year) AS year, any_value(m) AS m, bool_or(place IN ({quoted(NATIVES)})) AS nat, bool_or(place IN ({quoted(FOREIGN)})) AS oth FROM pl GROUP BY o_orderkey) SELECT year, count(*) AS all_total, count(*) FILTER (m) AS all_marker, count(*) FILTER (nat) AS native_total, count(*) FILTER (nat AND m) AS native_marker, count(*) FILTER (nat AND NOT oth) AS strict_total, count(*) FILTER (nat AND NOT oth AND m) AS strict_marker FROM o GROUP BY year")
def composition(spark, sf):
    return audit.composition(papers(spark, sf), "places", "m", NATIVES, FOREIGN)


LEAST = 5


@query(f"WITH {GEO}, x AS (SELECT *, CAST(marker AS DOUBLE) AS k, CAST(total AS DOUBLE) AS z FROM ge WHERE year = 1996 AND total >= {LEAST}) SELECT place, total, round(marker_pct, 9) AS marker_pct, round(disc_pct, 9) AS disc_pct, round(100 * {wilson_sql('k', 'z', '-').removeprefix('round').removesuffix(', 9)')}), 7) AS low, round(100 * {wilson_sql('k', 'z', '+').removeprefix('round').removesuffix(', 9)')}), 7) AS high, place IN ({quoted(NATIVES)}) AS native, round((SELECT quantile_cont(marker_pct, 0.5) FROM x), 7) AS median_marker, round((SELECT quantile_cont(disc_pct, 0.5) FROM x), 7) AS median_disc FROM x")
def country_scatter(spark, sf):
    s = report.scatter(materialise(places(spark, sf), "places"), 1996, LEAST, NATIVES)
    return s.withColumns({"marker_pct": r9("marker_pct"), "disc_pct": r9("disc_pct")} | {c: F.round(c, 7) for c in ("low", "high", "median_marker", "median_disc")})


STEPPED = f"{C}, e AS (SELECT base_id FROM c WHERE year BETWEEN 2018 AND 2021), o AS (SELECT base_id, row_number() OVER (ORDER BY base_id) - 1 AS rn, greatest(count(*) OVER () // 2500, 1) AS step FROM e), st AS (SELECT base_id FROM o WHERE rn % step = 0 AND rn / step < 2500)"


def early_ids(spark, sf):
    return documents(spark, sf).where(F.col("year").between(2018, 2021)).select("base_id")


@query(f"{STEPPED} SELECT base_id FROM st")
def step_sample(spark, sf):
    return corpus.step_sample(early_ids(spark, sf), "base_id")


@query(f"{STEPPED}, v AS (SELECT base_id, 2015 + (base_id // 7) % 12 AS u, {HIT} AS hit FROM c JOIN st USING (base_id)), g AS (SELECT count(*) FILTER (u >= 2023) AS rn, count(*) FILTER (u >= 2023 AND hit) AS rh, count(*) FILTER (u < 2023) AS n, count(*) FILTER (u < 2023 AND hit) AS h FROM v) SELECT rn AS revised_n, rh AS revised_hit, n AS other_n, h AS other_hit, round(100.0 * rh / rn, 9) AS revised_pct, round(100.0 * h / n, 9) AS other_pct, round(100.0 * rh / rn - 100.0 * h / n, 9) AS smear_pp FROM g")
def revision_smear(spark, sf):
    versions = documents(spark, sf).select("base_id", (2015 + F.floor(F.col("base_id") / 7) % 12).alias("updated_year"), frequency.has_any(MARKERS).alias("hit"))
    return audit.smear(corpus.step_sample(early_ids(spark, sf), "base_id"), versions, "base_id", "hit").withColumns({c: r9(c) for c in ("revised_pct", "other_pct", "smear_pp")})


# Records: identifiers, dates, work that is left, set operations


@query("WITH v AS (SELECT (doc_id // 2) || 'v' || (1 + doc_id % 2) AS id, doc_id AS seq, lang FROM documents) SELECT string_split(id, 'v')[1] AS base, min(seq) AS seq, arg_min(id, seq) AS id, arg_min(lang, seq) AS lang FROM v GROUP BY ALL")
def versioned_first(spark, sf):
    i = F.col("doc_id")
    v = table(spark, sf, "documents").select(F.concat(F.floor(i / 2).cast("string"), F.lit("v"), (1 + i % 2).cast("string")).alias("id"), i.alias("seq"), "lang")
    return corpus.first_versions(v.withColumn("base", corpus.base_id(F.col("id"))), "base", "seq")


PUBLISHED = "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') END"


@query(f"WITH p AS (SELECT {PUBLISHED} AS published FROM orders), d AS (SELECT CAST(substring(published, 1, 4) AS INTEGER) AS year, CAST((CAST(substring(published, 6, 2) AS INTEGER) - 1) // 3 + 1 AS INTEGER) AS quarter FROM p WHERE length(published) >= 7) SELECT year, quarter, count(*) AS n_docs FROM d WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL")
def dated_orders(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    published = F.when(k % 7 == 0, "").when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.date_format(day, "yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd'T00:00:00Z'"))
    return frequency.docs_per(corpus.dated(table(spark, sf, "orders").select(published.alias("published")), first=1996, last=1999), "year", "quarter")


@query(f"{C}, d AS (SELECT year, base_id AS id FROM c WHERE subfield <> 'fr') SELECT year, id, CAST(row_number() OVER (ORDER BY year DESC, id) - 1 AS BIGINT) AS place FROM d")
def work_order(spark, sf):
    d = documents(spark, sf).select("year", F.col("base_id").alias("id"), "subfield")
    done = d.where("subfield = 'fr'").select("id")
    return corpus.work_order(readers.not_done(d.select("year", "id"), done))


VOCABULARY = f"{C}, p AS (SELECT {PERIODS} AS period, unnest(list_distinct(toks)) AS word FROM c), b AS (SELECT DISTINCT word FROM p WHERE period = 'base'), r AS (SELECT DISTINCT word FROM p WHERE period = 'recent')"


@query(f"{VOCABULARY} SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM b UNION SELECT * FROM r) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM r) UNION ALL SELECT 'base only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM r) UNION ALL SELECT 'recent only', count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM b)")
def set_operations(spark, sf):
    words = materialise(frequency.document_frequency(documents(spark, sf).withColumn("period", frequency.period(BASE, RECENT)).where("period IS NOT NULL"), "period").select("period", "word"), "vocabulary")
    b, r = (words.where(F.col("period") == p).select("word") for p in ("base", "recent"))
    n = lambda op, df: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return n("union", b.union(r).distinct()).union(n("intersect", b.intersect(r))).union(n("base only", b.subtract(r))).union(n("recent only", r.subtract(b)))


@query(f"{VOCABULARY} SELECT word FROM b SEMI JOIN (SELECT unnest([{quoted(WORDS + ['qqqq'])}]) AS word) USING (word)")
def lexicon_semi_join(spark, sf):
    words = frequency.document_frequency(documents(spark, sf).where(F.col("year").between(*BASE))).select("word")
    lexicon = spark.range(1).select(F.explode(frequency.literals([*WORDS, "qqqq"])).alias("word"))
    return words.join(F.broadcast(lexicon), "word", "left_semi")  # a row per listed word


# Sources and sinks


def records(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(F.concat(i.cast("string"), F.lit("v1")).alias("id"), F.concat((2015 + i % 12).cast("string"), F.lit("-03-01T00:00:00Z")).alias("published"), F.col("lang").alias("primary_category"), F.array("lang", "source").alias("categories"), F.substring("text", 1, 30).alias("title"), F.col("text").alias("abstract"))


@query("SELECT doc_id || 'v1' AS id, (2015 + doc_id % 12) || '-03-01T00:00:00Z' AS published, lang AS primary_category, lang || ' ' || source AS categories, substring(text, 1, 30) AS title, md5(text) AS abstract_md5 FROM documents")
def jsonl_roundtrip(spark, sf):
    """Records are appended in two runs, the second of what the first left."""
    path, r = fresh_path(spark, "records"), records(spark, sf)
    readers.append_records(r.where("primary_category = 'en'"), path)
    readers.append_records(readers.not_done(r, readers.read_records(spark, path)), path)
    return readers.read_records(spark, path).select("id", "published", "primary_category", F.array_join("categories", " ").alias("categories"), "title", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"))


@query(excess_sql(30, 3))
def table_roundtrip(spark, sf):
    path, e = fresh_path(spark, "table"), excess_words(spark, sf)
    readers.write_table(e, path)
    return readers.read_table(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema))


@query(f"{YEARLY} SELECT CAST(year AS VARCHAR) AS key, total, hit, rate FROM r")
def summary_roundtrip(spark, sf):
    path = fresh_path(spark, "summary")
    readers.write_summary(readers.summary(yearly(spark, sf), "year", ["total", "hit", "rate"], "by_year"), path)
    return readers.read_summary(spark, path, "by_year", "total:bigint,hit:bigint,rate:double")


PAIR_N = f"{RECENT_DOCS}, s AS (SELECT base_id, unnest(list_distinct(toks)) AS w FROM d), m AS (SELECT * FROM s WHERE w IN ({quoted(M)})), k AS (SELECT a.w AS w1, b.w AS w2, count(*) AS n FROM m a JOIN m b ON a.base_id = b.base_id AND a.w <> b.w GROUP BY ALL)"


@query(f"{PAIR_N} SELECT x.w AS w1, " + ", ".join(f"CASE WHEN x.w <> '{w}' THEN coalesce(max(n) FILTER (w2 = '{w}'), 0) END AS \"{w}\"" for w in M) + f" FROM (SELECT unnest([{quoted(M)}]) AS w) x LEFT JOIN k ON k.w1 = x.w GROUP BY x.w")
def matrix_roundtrip(spark, sf):
    path = fresh_path(spark, "matrix")
    d = documents(spark, sf).where(F.col("year").between(*RECENT))
    readers.write_matrix(frequency.lift(d, M).select("w1", "w2", "pairs"), path)
    return readers.read_matrix(spark, path, M, "pairs")


FEED_SQL = "SELECT item_id || 'v1' AS id, '2024-0' || (1 + item_id % 6) || '-1' || (item_id % 9) || 'T00:00:00Z' AS published, CASE WHEN item_id % 2 = 0 THEN 'a.GA' ELSE 'a.CO' END AS primary_category, md5(trim(text)) AS abstract_md5, '2024-0' || (1 + item_id % 6) AS month FROM benchmark"


def feed_entries(spark, sf):
    """The benchmark as the records of a feed."""
    i = F.col("item_id")
    month = F.concat(F.lit("2024-0"), (1 + i % 6).cast("string"))
    category = F.when(i % 2 == 0, "a.GA").otherwise("a.CO")
    return table(spark, sf, "benchmark").select(F.concat(i.cast("string"), F.lit("v1")).alias("id"), F.concat(month, F.lit("-1"), (i % 9).cast("string"), F.lit("T00:00:00Z")).alias("published"), category.alias("primary_category"), F.array(category, F.lit("a.XX")).alias("categories"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("abstract"), month.alias("month"))


@query(f"SELECT * FROM ({FEED_SQL}) WHERE month IN ('2024-02', '2024-03', '2024-05') AND published < '2024-05-15'")
def feed_scan(spark, sf):
    """The benchmark as a paged feed: a range of dates reaches the reader, and a month that is done is left out."""
    root = fresh_path(spark, "feed")
    feed.write_pages(feed_entries(spark, sf), root, 3)
    feed.register(spark)
    pages = spark.read.format("paged_feed").options(root=root, first="2024-01", last="2024-06", page="3", done="2024-04", wait="0", pause="0").load()
    found = pages.where((F.col("published") >= "2024-02-01") & (F.col("published") < "2024-05-15"))
    return found.select("id", "published", "primary_category", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "month")


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content) of (key, text): tar, compressed tar, gzip, raw, bytes that are no text and a spoilt gzip, in turn."""
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            body, kind = text.encode(), key % 6
            if kind < 2:
                buffer = io.BytesIO()
                with tarfile.open(fileobj=buffer, mode="w:gz" if kind else "w") as t:
                    for name, data in (("a.tex", body), ("fig.png", b"\x89PNG"), ("b.BBL", b"refs"), ("c.sty", b"no"), ("d.tex", b"\x00\x01" * 99)):
                        info = tarfile.TarInfo(name)
                        info.size = len(data)
                        t.addfile(info, io.BytesIO(data))
                out.append(buffer.getvalue())
            else:
                out.append([gzip.compress(body), body, b"\x00\x01\x02" * 500, gzip.compress(body)[:-12] + b"spoilt, and no more"][kind - 2])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page_id", "content"])


KIND = "page_id % 6"


@query(f"SELECT page_id, CAST(CASE WHEN {KIND} IN (0, 1, 2) THEN 1 ELSE 0 END AS INTEGER) AS n_tex, CASE WHEN {KIND} < 2 THEN md5(html || chr(10) || 'refs') WHEN {KIND} IN (2, 3) THEN md5(html) ELSE md5('') END AS text_md5, {KIND} IN (0, 1, 2) OR {KIND} = 3 AND length(html) > 200 AS has_source FROM pages")
def archive_scan(spark, sf):
    read = readers.unpack(table(spark, sf, "pages").select("page_id", "html").mapInArrow(pack, "page_id bigint, content binary"))
    return read.select("page_id", "n_tex", F.md5(F.col("text").cast("binary")).alias("text_md5"), "has_source")


@query("SELECT page_id, octet_length(encode(html)) AS bytes, octet_length(encode(html)) > 3000 AS skipped_large, CASE WHEN octet_length(encode(html)) <= 3000 THEN md5(html) END AS text_md5 FROM pages")
def size_cap(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return readers.unpack(p, most_bytes=3000).select("page_id", "bytes", "skipped_large", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def stream_equals_batch(spark, sf):
    """``event_windows`` of the events read as a stream."""
    schema = table(spark, sf, "events").schema
    found = live.counts_from_stream(spark, f"{sf}/event[s].parquet", schema, fresh_path(spark, "stream"), "ts", "event_id", "1 day", "event_type")
    return found.withColumn("start", F.col("start").cast(schema["ts"].dataType))


# Report frames

CONTROL_MEAN = f"cm AS (SELECT year, avg(freq) AS control FROM ({watch_sql('year', CONTROLS)}) GROUP BY year)"
TREND = "tr AS (SELECT regr_slope(rate, year) AS a, regr_intercept(rate, year) AS b FROM r WHERE year BETWEEN 2015 AND 2021)"


@query(f"{YEARLY}, {CONTROL_MEAN}, {TREND}, x AS (SELECT year, hit, total, rate, control, b + a * year AS trend, CAST(hit AS DOUBLE) AS k, CAST(total AS DOUBLE) AS z FROM r JOIN cm USING (year), tr WHERE year <= 2025) SELECT year, hit, total, rate, {wilson_sql('k', 'z', '-')} AS low, {wilson_sql('k', 'z', '+')} AS high, round(control, 9) AS control, round(trend, 7) AS trend FROM x")
def markers_and_controls(spark, sf):
    d = documents(spark, sf)
    m = report.markers_and_controls(frequency.basket_rate(d, MARKERS, "year"), frequency.watch(d, CONTROLS, "year"))
    return m.withColumns({"low": r9("low"), "high": r9("high"), "control": r9("control"), "trend": F.round("trend", 7)})


@query(f"{COURSE}, wy AS ({watch_sql('year', MARKERS)}), fi AS (SELECT word, regr_slope(freq, year) AS a, regr_intercept(freq, year) AS b FROM wy WHERE year BETWEEN 2015 AND 2021 GROUP BY word) SELECT word, year + (quarter - 1) / 4 AS yq, freq, round(greatest(0.0, b + a * (year + (quarter - 1) / 4)), 7) AS expected FROM s JOIN fi USING (word)")
def counterfactual(spark, sf):
    yearly_words = frequency.watch(documents(spark, sf), MARKERS, "year")
    return report.counterfactual(course(spark, sf), yearly_words, MARKERS).withColumn("expected", F.round("expected", 7))


EXCESS = f"ex AS (SELECT year, greatest(0.0, rate - {BASE_RATE}) AS excess FROM r)"


def excess(spark, sf):
    return frequency.with_excess(frequency.basket_rate(documents(spark, sf), MARKERS, "year"), BASE)


LITERATURE_SQL = " UNION ALL ".join(f"SELECT '{k}' AS label, CAST({v} AS DOUBLE) AS value, 'literature' AS kind" for k, v in lexicons.LITERATURE.items())


@query(f"{YEARLY}, {EXCESS}, {SHARES} {LITERATURE_SQL} UNION ALL SELECT 'marker words', round(100 * excess, 7), 'lower bound' FROM ex WHERE year = 2025 UNION ALL SELECT 'any mention in the text', round(full_pct, 7), 'disclosed' FROM sh WHERE year = 2025 UNION ALL SELECT 'in the acknowledgements', round(ack_pct, 7), 'disclosed' FROM sh WHERE year = 2025")
def gap(spark, sf):
    return report.gap(excess(spark, sf), shares(spark, sf)).withColumn("value", F.round("value", 7))


@query(f"{TONE}, g AS (SELECT avg(hype_per1k) FILTER (year BETWEEN 2015 AND 2019) AS hb, avg(hedge_per1k) FILTER (year BETWEEN 2015 AND 2019) AS eb FROM y) SELECT year, round(100 * hype_per1k / hb, 6) AS hype_per1k_idx, round(100 * hedge_per1k / eb, 6) AS hedge_per1k_idx FROM y, g")
def indexed_tone(spark, sf):
    from .catalog import tone_year

    return report.indexed(tone_year(spark, sf), ["hype_per1k", "hedge_per1k"]).withColumns({c: F.round(c, 6) for c in ("hype_per1k_idx", "hedge_per1k_idx")})


@query(f"{COURSE}, {SHARES} SELECT yq, label, round(100 * all_markers, 7) AS all_markers, round(100 * early, 7) AS early, round(100 * late, 7) AS late, round(full_pct, 7) AS full_pct FROM ks LEFT JOIN sh USING (year)")
def erosion(spark, sf):
    return report.erosion(clustered(spark, sf), shares(spark, sf)).withColumns({c: F.round(c, 7) for c in ("all_markers", "early", "late", "full_pct")})


@query(
    f"{YEARLY}, {EXCESS}, {SHARES}, {BY_YEAR} SELECT 0 AS place, 'source leaks' AS rung, round(100.0 * (sum(tier1) + sum(tier2)) / sum(scanned), 7) AS value FROM sy WHERE year BETWEEN 2024 AND 2026 UNION ALL SELECT 1, 'acknowledged', round(100.0 * sum(ack) / sum(total), 7) FROM sh WHERE year BETWEEN 2024 AND 2026 "
    "UNION ALL SELECT 2, 'mentioned in the text', round(100.0 * sum(\"full\") / sum(total), 7) FROM sh WHERE year BETWEEN 2024 AND 2026 UNION ALL SELECT 3, 'marker words', round(100 * excess, 7) FROM ex WHERE year = 2025 UNION ALL SELECT 4, 'biomedicine', 13.5"
)
def ladder(spark, sf):
    return report.ladder(audit.scan_by_year(scans(spark, sf)), shares(spark, sf), excess(spark, sf)).withColumn("value", F.round("value", 7))


@query(f"{PAIR_N}, n1 AS (SELECT w, count(*) AS n FROM m GROUP BY w), e AS (SELECT w1, w2, coalesce(k.n, 0) AS pairs, x.n * y.n / (SELECT count(*) FROM d) AS mu FROM {ALL_PAIRS} LEFT JOIN k USING (w1, w2) JOIN n1 x ON x.w = w1 JOIN n1 y ON y.w = w2), z AS (SELECT w1, w2, pairs, CASE WHEN {tail_p('pairs', 'mu')} < 0.01 THEN round(pairs / mu, 7) END AS lift FROM e) SELECT * FROM z UNION ALL SELECT w2, w1, pairs, lift FROM z")
def heat_map(spark, sf):
    d = documents(spark, sf).where(F.col("year").between(*RECENT))
    return report.heat_map(frequency.significant_pairs(d, M)).withColumn("lift", F.round("lift", 7))


@query(f"SELECT CAST(row_number() OVER (ORDER BY rec_freq DESC, word) AS INTEGER) AS place, word, round(100 * base_freq, 3) AS base_pct, round(100 * rec_freq, 3) AS rec_pct, round(ratio, 0) AS ratio FROM ({excess_sql(30, 3)}) WHERE word IN ({quoted(MARKERS)})")
def basket_table(spark, sf):
    return report.basket_table(excess_words(spark, sf), MARKERS)


@query(f"SELECT word, CAST(rk AS BIGINT) AS rk, class FROM (SELECT word, row_number() OVER (ORDER BY word) AS rk, {CLASS_SQL} AS class FROM ({excess_sql(30, 3)}) WHERE base_freq > {LOW} AND {CLASS_SQL} IS NOT NULL) WHERE rk <= 12")
def tail_examples(spark, sf):
    """The first twelve, in order, of the classed words that were not rare."""
    e = excess_words(spark, sf).where(F.col("base_freq") > LOW).select("word", audit.word_class(F.col("word"), WORD_LISTS).alias("class")).where("class IS NOT NULL")
    return e.orderBy("word").limit(12).withColumn("rk", F.row_number().over(Window.orderBy("word")).cast("bigint"))  # twelve rows
