"""Document frequencies, watch lists, baskets, word pairs and period comparison. The word lists default to ``lexicons``."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordtide.functions import lexicons, stats

from .corpus import quarter_label, quarters, yq

EPSILON = 1e-9


def literals(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))


def has_any(words: Sequence[str] = lexicons.BASKET) -> Column:
    return F.arrays_overlap("toks", literals(words))


def docs_per(corpus: DataFrame, *keys: str) -> DataFrame:
    return corpus.groupBy(*keys).agg(F.count("*").alias("n_docs"))


def document_frequency(corpus: DataFrame, *keys: str, units: Column | None = None, among: Sequence[str] | None = None) -> DataFrame:
    """In how many documents each word (or other unit) occurs, per ``keys``. ``among`` cuts the sets before they are exploded."""
    units = F.col("toks") if units is None else units
    units = F.array_distinct(units) if among is None else F.array_intersect(units, literals(among))
    return corpus.select(*keys, F.explode(units).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def watch(corpus: DataFrame, words: Sequence[str] = lexicons.WATCH, *keys: str, units: Column | None = None) -> DataFrame:
    """n, total and freq for every word and period, zeros included: sums of flags, then a row per word."""
    units = F.col("toks") if units is None else units
    flags = [F.sum(F.array_contains(units, w).cast("bigint")).alias(f"w{k}") for k, w in enumerate(words)]
    wide = corpus.groupBy(*keys).agg(F.count("*").alias("total"), *flags)
    return long_form(wide, words, *keys)


def long_form(wide: DataFrame, words: Sequence[str], *keys: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{k}").alias("n")) for k, w in enumerate(words)])).alias("x")
    freq = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0)
    return wide.select(*keys, "total", pairs).select("x.word", *keys, "x.n", "total").withColumn("freq", freq)


def trajectories(corpus: DataFrame, words: Sequence[str] = lexicons.TRAJECTORY, first: tuple[int, int] = (2022, 1), last: tuple[int, int] = (2026, 2)) -> DataFrame:
    """``watch`` by quarter on a full spine of quarters: one without documents has zeros."""
    flags = [F.sum(F.array_contains("toks", w).cast("bigint")).alias(f"w{k}") for k, w in enumerate(words)]
    wide = corpus.groupBy("year", "quarter").agg(F.count("*").alias("total"), *flags)
    spine = quarters(corpus, first, last).join(wide, ["year", "quarter"], "left")
    return long_form(spine.fillna(0), words, "year", "quarter")


def peaks(series: DataFrame, least: float = 0.001, early: tuple[int, int] = (2024, 4), back: int = 4) -> DataFrame:
    """Per word of ``trajectories``: its (first) peak quarter and value, the mean of the last ``back`` quarters and its cluster: rare, early or
    late by the peak."""
    s = series.withColumn("q", F.col("year") * 4 + F.col("quarter"))
    s = s.withColumn("back", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("q"))))  # a row per word and quarter
    out = s.groupBy("word").agg(F.max_by(F.struct("year", "quarter"), F.struct("freq", -F.col("q"))).alias("at"), F.max("freq").alias("peak_val"), F.avg(F.when(F.col("back") <= back, F.col("freq"))).alias("recent"))
    cluster = F.when(F.col("peak_val") < least, "rare").when(F.col("at.year") * 4 + F.col("at.quarter") <= early[0] * 4 + early[1], "early").otherwise("late")
    return out.select("word", quarter_label(F.col("at.year"), F.col("at.quarter")).alias("peak_q"), "peak_val", "recent", cluster.alias("cluster"))


def cluster_series(series: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per quarter: documents and, of all words and of each cluster, the sum of the words' documents over them."""
    s = series.join(F.broadcast(clusters.select("word", "cluster")), "word")  # a row per word
    of = lambda c: F.try_divide(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)), F.max("total"))
    out = s.groupBy("year", "quarter").agg(F.max("total").alias("total"), of(F.lit(True)).alias("all_markers"), of(F.col("cluster") == "early").alias("early"), of(F.col("cluster") == "late").alias("late"))
    return out.select("year", "quarter", yq(F.col("year"), F.col("quarter")).alias("yq"), quarter_label(F.col("year"), F.col("quarter")).alias("label"), "total", "all_markers", "early", "late")


def cluster_delta(series: DataFrame, before: tuple[int, int] = (2025, 2), after: tuple[int, int] = (2026, 2)) -> DataFrame:
    """How far each series of ``cluster_series`` fell between two quarters, and the early cluster's share of the whole fall."""
    at = lambda c, q: F.max(F.when((F.col("year") == q[0]) & (F.col("quarter") == q[1]), F.col(c)))
    out = series.agg(*[(at(c, before) - at(c, after)).alias(f"d_{c}") for c in ("all_markers", "early", "late")])
    return out.withColumn("explained", F.when(F.abs("d_all_markers") > 1e-9, F.col("d_early") / F.col("d_all_markers")))


def period(base: Sequence[int], recent: Sequence[int]) -> Column:
    return F.when(F.col("year").between(*base), "base").when(F.col("year").between(*recent), "recent")


def excess_units(corpus: DataFrame, base: Sequence[int], recent: Sequence[int], floor: int, min_length: int = 0, units: Column | None = None) -> DataFrame:
    """Per word: document counts and frequencies of two periods, their difference and ratio. The totals read the years only."""
    of = corpus.withColumn("period", period(base, recent)).where("period IS NOT NULL")
    counts = document_frequency(of, "period", units=units).groupBy("word").agg(*[F.sum(F.when(F.col("period") == p, F.col("n")).otherwise(0)).alias(f"{c}_n") for p, c in (("base", "base"), ("recent", "rec"))])
    totals = of.agg(*[F.count(F.when(F.col("period") == p, 1)).alias(f"{c}_total") for p, c in (("base", "base"), ("recent", "rec"))])
    rows = counts.where((F.col("base_n") >= floor) | (F.col("rec_n") >= floor)).where(F.length("word") >= min_length).join(F.broadcast(totals))  # one row
    rows = rows.withColumn("base_freq", F.try_divide("base_n", "base_total")).withColumn("rec_freq", F.try_divide("rec_n", "rec_total"))
    return rows.select("word", "base_n", "rec_n", "base_freq", "rec_freq", (F.col("rec_freq") - F.col("base_freq")).alias("abs_excess"), ((F.col("rec_freq") + EPSILON) / (F.col("base_freq") + EPSILON)).alias("ratio"))


def control_excess(corpus: DataFrame, base: Sequence[int], recent: Sequence[int], words: Sequence[str] = lexicons.CONTROL) -> DataFrame:
    """The difference of frequency of words that should not move, and the largest of all by amount."""
    of = corpus.withColumn("period", period(base, recent)).where("period IS NOT NULL")
    flag = lambda p, w: F.sum(((F.col("period") == p) & F.array_contains("toks", w)).cast("bigint")) / F.count(F.when(F.col("period") == p, 1))
    wide = of.agg(*[(flag("recent", w) - flag("base", w)).alias(f"w{k}") for k, w in enumerate(words)])
    most = F.greatest(*[F.abs(f"w{k}") for k in range(len(words))]) if len(words) > 1 else F.abs("w0")
    pairs = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{k}").alias("excess")) for k, w in enumerate(words)])).alias("x")
    return wide.select(most.alias("max_abs"), pairs).select("x.*", "max_abs")


def basket_rate(corpus: DataFrame, words: Sequence[str] = lexicons.BASKET, *keys: str) -> DataFrame:
    """total, hit (documents with a word of the basket) and rate."""
    return corpus.groupBy(*keys).agg(F.count("*").alias("total"), F.sum(has_any(words).cast("bigint")).alias("hit")).withColumn("rate", F.col("hit") / F.col("total"))


def subfield_table(corpus: DataFrame, words: Sequence[str] = lexicons.BASKET, subfields: Mapping[str, str] = lexicons.SUBFIELDS, first: int = 2018, last: int = 2026) -> DataFrame:
    """Per listed subfield and year, zeros included: its label, documents and the percentage with a word of the basket."""
    of = corpus.where(F.col("subfield").isin(*subfields) & F.col("year").between(first, last)).groupBy(F.col("subfield").alias("cat"), "year").agg(F.count("*").alias("n"), F.sum(has_any(words).cast("bigint")).alias("hit"))
    labels = F.explode(F.array(*[F.struct(F.lit(c).alias("cat"), F.lit(label).alias("label")) for c, label in subfields.items()])).alias("l")
    spine = corpus.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"), labels).select("l.cat", "l.label", "year")
    rate = F.when(F.col("n") > 0, 100 * F.col("hit") / F.col("n")).otherwise(0.0)
    return spine.join(of, ["cat", "year"], "left").fillna(0, ["n", "hit"]).select("cat", "label", "year", "n", rate.alias("rate"))


def subfield_cube(corpus: DataFrame, words: Sequence[str] = lexicons.BASKET) -> DataFrame:
    """Cells, margins and grand total in one plan: n, hit and rate (percent) by subfield and year, by either and overall; ``level`` (the grouping id) is
    0 for a cell, 1 for a subfield, 2 for a year and 3 for all. A null subfield of a cell is a value, one of a margin means all."""
    counted = corpus.cube("subfield", "year").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum(has_any(words).cast("bigint")).alias("hit"))
    return counted.select("level", "subfield", "year", "n", "hit", (100 * F.col("hit") / F.col("n")).alias("rate"))


def with_excess(rates: DataFrame, base: Sequence[int]) -> DataFrame:
    """Adds base_rate (pooled over the base years) and the excess over it, not below zero. ``rates`` has a row per period."""
    pooled = rates.where(F.col("year").between(*base)).agg((F.sum("hit") / F.sum("total")).alias("base_rate"))
    return rates.join(F.broadcast(pooled)).withColumn("excess", F.greatest(F.lit(0.0), F.col("rate") - F.col("base_rate")))


def patterns(corpus: DataFrame, words: Sequence[str], *keys: str) -> DataFrame:
    """(keys, mask, c): how many documents hold exactly the words whose bits are set in mask (at most 62 words). One pass of the corpus;
    what follows from it is worked out on the masks that occur."""
    mask = sum((F.when(F.array_contains("toks", w), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, w in enumerate(words)), F.lit(0).cast("bigint"))
    return corpus.select(*keys, mask.alias("mask")).groupBy(*keys, "mask").agg(F.count("*").alias("c"))


def leave_one_out(corpus: DataFrame, words: Sequence[str], base: Sequence[int], recent: Sequence[int]) -> DataFrame:
    """The recent excess of the basket without each of its words, from a histogram of word patterns."""
    of = patterns(corpus.withColumn("period", period(base, recent)).where("period IS NOT NULL"), words, "period")
    rows = of.select("*", F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(~(1 << k)).cast("bigint").alias("keep")) for k, w in enumerate(words)])).alias("x")).select("period", "mask", "c", "x.*")
    hit = F.when(F.col("mask").bitwiseAND(F.col("keep")) != 0, F.col("c")).otherwise(0)
    rate = lambda p: F.sum(F.when(F.col("period") == p, hit).otherwise(0)) / F.sum(F.when(F.col("period") == p, F.col("c")).otherwise(0))
    return rows.groupBy("word").agg((rate("recent") - rate("base")).alias("alpha"))


def leave_one_out_range(corpus: DataFrame, words: Sequence[str], base: Sequence[int], recent: Sequence[int]) -> DataFrame:
    """The excess of the whole basket, the least and the largest without one word, and those words (ties: the first)."""
    alphas = leave_one_out(corpus, [*words, ""], base, recent)  # no document holds the empty word, so without it the basket is whole
    one = F.col("word") != ""
    named = lambda f, order: f(F.when(one, F.col("word")), F.when(one, order))
    lowest, highest = F.struct("alpha", "word"), F.struct(-F.col("alpha"), F.col("word"))
    return alphas.agg(F.max(F.when(~one, F.col("alpha"))).alias("alpha_full"), F.min(F.when(one, F.col("alpha"))).alias("least"), F.max(F.when(one, F.col("alpha"))).alias("largest"), named(F.min_by, lowest).alias("least_word"), named(F.min_by, highest).alias("largest_word"))


def bigrams(toks: Column) -> Column:
    """Neighbouring pairs, joined by a space."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.zip_with(F.slice(toks, 1, n), F.slice(toks, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def pair_counts(corpus: DataFrame, words: Sequence[str] = lexicons.PAIRED) -> DataFrame:
    """w1 < w2: in how many documents both occur. At most len(words) choose 2 rows leave a document."""
    s = corpus.select(F.array_sort(F.array_intersect("toks", literals(words))).alias("s")).where(F.size("s") > 1)
    first = s.select(F.col("s"), F.explode("s").alias("w1"))
    return first.select("w1", F.explode(F.filter("s", lambda x: x > F.col("w1"))).alias("w2")).groupBy("w1", "w2").agg(F.count("*").alias("pairs"))


def _pairs_of(masks: DataFrame, words: Sequence[str], *keys: str) -> DataFrame:
    """(keys, w1, w2, pairs, n1, n2, docs) of every two words, from ``patterns``."""
    words = sorted(words)
    bit = {w: 1 << k for k, w in enumerate(words)}
    two = F.explode(F.array(*[F.struct(F.lit(a).alias("w1"), F.lit(b).alias("w2"), F.lit(bit[a]).cast("bigint").alias("b1"), F.lit(bit[b]).cast("bigint").alias("b2")) for i, a in enumerate(words) for b in words[i + 1 :]])).alias("x")
    has = lambda b: F.col("mask").bitwiseAND(F.col(b)) != 0
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    return masks.select(*keys, "mask", "c", two).select(*keys, "mask", "c", "x.*").groupBy(*keys, "w1", "w2").agg(n(has("b1") & has("b2")).alias("pairs"), n(has("b1")).alias("n1"), n(has("b2")).alias("n2"), F.sum("c").alias("docs"))


def with_lift(pairs: DataFrame) -> DataFrame:
    """Adds the pairs expected of independent words and the ratio to them; null where a word does not occur."""
    expected = F.col("n1") * F.col("n2") / F.col("docs")
    return pairs.withColumn("expected", expected).withColumn("lift", F.when(expected > 0, F.col("pairs") / expected))


def lift(corpus: DataFrame, words: Sequence[str] = lexicons.PAIRED) -> DataFrame:
    """Every two of the words, those that never meet included: observed pairs against those of independent words."""
    return with_lift(_pairs_of(patterns(corpus, sorted(words)), words))


def significant_pairs(corpus: DataFrame, words: Sequence[str] = lexicons.PAIRED, below: float = 0.01) -> DataFrame:
    """``lift`` with p, the chance of as many pairs or more among independent words, and whether it is below the bound."""
    p = stats.poisson_tail(F.col("pairs"), F.col("expected"))
    return lift(corpus, words).withColumn("p", p).withColumn("significant", F.col("p") < below)


def _occurrences(words: Sequence[str]) -> Column:
    return F.size(F.filter("toks", lambda t: t.isin(*words)))


TONES = {"hype": lexicons.HYPE, "hedge": lexicons.HEDGE}


def tone(corpus: DataFrame, sets: Mapping[str, Sequence[str]] = TONES, *keys: str) -> DataFrame:
    """Per word list: percent of documents with a word of it, and its occurrences per 1,000 tokens (a ratio of sums)."""
    count = {k: _occurrences(w) for k, w in sets.items()}
    rows = corpus.select(*keys, F.size("toks").alias("ntok"), *[c.alias(k) for k, c in count.items()])
    out = [F.count("*").alias("n"), F.sum("ntok").alias("tokens")]
    for k in sets:
        out += [(F.sum((F.col(k) > 0).cast("bigint")) * 100.0 / F.count("*")).alias(f"{k}_docpct"), (F.sum(k) * 1000.0 / F.nullif(F.sum("ntok"), F.lit(0))).alias(f"{k}_per1k")]
    return rows.groupBy(*keys).agg(*out)


def tone_change(yearly: DataFrame, column: str, pre: Sequence[int] = (2015, 2021), post: Sequence[int] = (2023, 2025)) -> list[Column]:
    """The unweighted means of a yearly column in two windows, and the change in percent."""
    of = lambda p: F.avg(F.when(F.col("year").between(*p), F.col(column)))
    return [of(pre).alias(f"{column}_pre"), of(post).alias(f"{column}_post"), F.try_multiply(F.lit(100.0), F.try_divide(of(post) - of(pre), of(pre))).alias(f"{column}_change")]


def lengths(corpus: DataFrame, words: Sequence[str] = lexicons.BASKET, *keys: str) -> DataFrame:
    """Mean tokens of a document, basket tokens per 1,000 tokens, and percent of documents with a word of the basket."""
    rows = corpus.select(*keys, F.size("toks").alias("ntok"), _occurrences(words).alias("own"))
    return rows.groupBy(*keys).agg(F.avg("ntok").alias("mean_tokens"), (F.sum("own") * 1000.0 / F.nullif(F.sum("ntok"), F.lit(0))).alias("per1000"), (F.sum((F.col("own") > 0).cast("bigint")) * 100.0 / F.count("*")).alias("docpct"))


def placebo_pool(excess: DataFrame, low: float = 0.0003, high: float = 0.005, min_length: int = 4, without: Sequence[str] = (*lexicons.BASKET, *lexicons.INSTRUMENTS)) -> DataFrame:
    """Words of middling base frequency that no list holds."""
    plain = F.col("word").rlike("^[a-z]+$") & (F.length("word") >= min_length) & ~F.col("word").isin(*without)
    return excess.where((F.col("base_freq") > low) & (F.col("base_freq") < high) & plain).select("word")


def placebo(corpus: DataFrame, baskets: DataFrame, base: Sequence[int] = (2018, 2021), recent: Sequence[int] = (2025, 2025)) -> DataFrame:
    """(k, alpha): the recent excess, in points, of each basket (k, word) of the few thousand words that were drawn.

    Documents are cut to those words before they are exploded; the word table, of as many rows as were drawn, is broadcast."""
    of = corpus.withColumn("period", period(base, recent)).where("period IS NOT NULL")
    totals = of.agg(*[F.count(F.when(F.col("period") == p, 1)).alias(p) for p in ("base", "recent")])
    per_word = baskets.groupBy("word").agg(F.collect_set("k").alias("ks"))
    words = of.select("base_id", "period", F.explode(F.array_distinct("toks")).alias("word")).join(F.broadcast(per_word), "word")
    hits = words.select("base_id", "period", F.explode("ks").alias("k")).distinct().groupBy("k").agg(*[F.count(F.when(F.col("period") == p, 1)).alias(f"h_{p}") for p in ("base", "recent")])
    every = baskets.select("k").distinct().join(hits, "k", "left").fillna(0).join(F.broadcast(totals))  # one row
    return every.select("k", (100 * F.col("h_recent") / F.col("recent") - 100 * F.col("h_base") / F.col("base")).alias("alpha"))


#: Bits of one number of a bitset.
BITS = 62


def bitsets(baskets: Sequence[tuple[int, str]]) -> tuple[list[int], dict[str, list[int]]]:
    """The baskets' numbers in order, and for each word the numbers whose bits say which baskets hold it."""
    ks = sorted({k for k, _ in baskets})
    place, wide = {k: i for i, k in enumerate(ks)}, -(-len(ks) // BITS)
    of: dict[str, list[int]] = {}
    for k, word in baskets:
        of.setdefault(word, [0] * wide)[place[k] // BITS] |= 1 << place[k] % BITS
    return ks, of


def baskets_hit(toks: Column, of: Mapping[str, Sequence[int]], n_buckets: int = 64) -> list[Column]:
    """Bitsets of the baskets of which a document holds a word: each of its distinct drawn words is looked up and folded in by bit-or, all within
    the row. The dictionary is a literal, dealt into buckets by a hash, as a literal map is searched from its start."""
    wide = len(next(iter(of.values())))
    words = sorted(of)
    drawn = F.array_intersect(toks, literals(words))
    bucket = lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(n_buckets)).cast("int")
    held: list[list[str]] = [[] for _ in range(n_buckets)]
    for w in words:
        held[zlib.crc32(w.encode()) % n_buckets].append(w)

    def folded(part: int) -> Column:
        maps = F.array(*[F.create_map(*[x for w in ws for x in (F.lit(w), F.lit(of[w][part]).cast("bigint"))]) if ws else F.create_map(F.lit(""), F.lit(0).cast("bigint")) for ws in held])
        return F.aggregate(drawn, F.lit(0).cast("bigint"), lambda acc, w: acc.bitwiseOR(F.element_at(F.get(maps, bucket(w)), w)))

    return [folded(part) for part in range(wide)]


def placebo_by_bits(corpus: DataFrame, baskets: DataFrame, base: Sequence[int] = (2018, 2021), recent: Sequence[int] = (2025, 2025)) -> DataFrame:
    """``placebo`` without a row per word: a document becomes its bitset of baskets, and a pass adds up the bits. Nothing is shuffled by
    document or word. ``baskets`` has as many rows as were drawn (number times size) and goes to the driver."""
    drawn = [(r["k"], r["word"]) for r in baskets.select("k", "word").collect()]
    if not drawn:
        return corpus.sparkSession.createDataFrame([], f"k {dict(baskets.dtypes)['k']}, alpha double")
    ks, of = bitsets(drawn)
    rows = corpus.withColumn("period", period(base, recent)).where("period IS NOT NULL")
    rows = rows.select("period", F.array(*baskets_hit(F.col("toks"), of)).alias("bits"))
    flags = [F.sum(F.getbit(F.get("bits", F.lit(i // BITS)), F.lit(i % BITS)).cast("bigint")).alias(f"b{i}") for i in range(len(ks))]
    wide = rows.groupBy("period").agg(F.count("*").alias("total"), *flags)  # two rows
    pairs = F.inline(F.array(*[F.struct(F.lit(k).cast(baskets.schema["k"].dataType).alias("k"), F.col(f"b{i}").alias("hit")) for i, k in enumerate(ks)]))
    rates = wide.select("period", "total", pairs)
    share = lambda p: F.coalesce(F.sum(F.when(F.col("period") == p, 100 * F.col("hit") / F.col("total"))), F.lit(0.0))
    return rates.groupBy("k").agg((share("recent") - share("base")).alias("alpha"))


def tail(excess: DataFrame, low: float = 0.0005, ratio: float = 5.0) -> DataFrame:
    """Words that were not rare in the base period and have risen by a factor."""
    return excess.where((F.col("base_freq") > low) & (F.col("ratio") >= ratio))


def tail_sets(excess: DataFrame, basket: Sequence[str] = lexicons.BASKET, instruments: Sequence[str] = lexicons.INSTRUMENTS, low: float = 0.0005, ratio: float = 5.0, top: int = 50) -> DataFrame:
    """How the tail of risen words meets the two lists, and how the ``top`` of the ratio order does."""
    risen = tail(excess, low, ratio).select("word")
    first = excess.where(F.col("base_freq") > low).orderBy(F.desc("ratio"), "word").limit(top).select("word")
    b, i = F.col("word").isin(*basket), F.col("word").isin(*instruments)
    n = lambda c: F.count(F.when(c, 1))
    a = risen.agg(F.count("*").alias("tail_size"), n(b).alias("basket_in_tail"), n(b | i).alias("listed_in_tail"), n(~(b | i)).alias("unlisted_in_tail"))
    return a.join(F.broadcast(first.agg(n(b).alias("basket_in_top"), n(i).alias("instruments_in_top"))))  # one row


#: The largest population that numpy draws from without replacement.
LARGEST_DRAW = 10**9 - 1


def _given(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among n drawn without replacement. Above ``LARGEST_DRAW`` a count is a rounded normal variate of the
    same mean and variance, kept within its range."""
    if counts.sum() <= LARGEST_DRAW:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out, rest = np.zeros_like(counts), int(counts.sum())
    for k, have in enumerate(counts.tolist()):
        if rest - have <= 0:
            got = n
        elif rest <= LARGEST_DRAW:
            got = int(rng.hypergeometric(have, rest - have, n))
        else:
            share = have / rest
            got = round(rng.normal(n * share, math.sqrt(n * share * (1 - share) * (rest - n) / (rest - 1))))
        got = min(max(got, n - (rest - have), 0), have, n)
        out[k], n, rest = got, n - got, rest - have
    return out


def split_pairs(n_docs: int, held: Sequence[int], seed: Sequence[int]) -> np.ndarray:
    """Pair counts (words by words) after every word has been dealt anew to as many of n_docs documents.

    Documents are never touched: they are counts by the set of words that they hold so far, and a word falls on each count by a
    multivariate hypergeometric draw. So a permutation costs as many draws as there are sets, at most 2 to the number of words."""
    rng = np.random.default_rng(seed)
    masks, counts = np.zeros(1, np.int64), np.array([n_docs], np.int64)
    pairs = np.zeros((len(held), len(held)), np.int64)
    for k, n in enumerate(held):
        got = _given(rng, counts, n)
        for j in range(k):
            pairs[j, k] = got[masks >> j & 1 == 1].sum()
        masks, counts = np.concatenate([masks, masks | 1 << k]), np.concatenate([counts - got, got])
        masks, counts = masks[counts > 0], counts[counts > 0]
    return pairs


def permuted_pairs(corpus: DataFrame, words: Sequence[str] = lexicons.PAIRED, n_perm: int = 300, seed: int = 0) -> DataFrame:
    """(perm, w1, w2, pairs): in how many documents two words meet when each word's documents are dealt anew within every subfield. One pass of
    the corpus counts words by subfield; what follows costs as much for any number of documents. A row per permutation and subfield is
    dealt over the tasks."""
    words = sorted(words)
    flags = [F.sum(F.array_contains("toks", w).cast("bigint")).alias(f"w{k}") for k, w in enumerate(words)]
    held = corpus.groupBy("subfield").agg(F.count("*").alias("n"), *flags).select(F.xxhash64("subfield").alias("field"), "n", F.array(*[f"w{k}" for k in range(len(words))]).alias("held"))
    grid = held.crossJoin(corpus.sparkSession.range(1, n_perm + 1).select(F.col("id").cast("int").alias("perm"))).repartition("perm", "field")  # n_perm rows a subfield
    two = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words))]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            met = [split_pairs(int(n), [int(x) for x in h], [seed, int(p), int(f) % (1 << 63)]) for n, h, p, f in zip(batch["n"], batch["held"], batch["perm"], batch["field"], strict=True)]
            yield pd.DataFrame({"perm": batch["perm"], "pairs": [[int(m[i, j]) for i, j in two] for m in met]})

    drawn = grid.mapInPandas(split, "perm int, pairs array<bigint>")
    names = F.array(*[F.struct(F.lit(words[i]).alias("w1"), F.lit(words[j]).alias("w2")) for i, j in two])
    rows = drawn.select("perm", F.inline(F.arrays_zip(names.alias("w"), F.col("pairs").alias("pairs"))))
    return rows.groupBy("perm", "w.w1", "w.w2").agg(F.sum("pairs").alias("pairs"))


def permuted_null(corpus: DataFrame, words: Sequence[str] = lexicons.PAIRED, n_perm: int = 300, below: float = 0.01, seed: int = 0) -> DataFrame:
    """What ``permutation_null`` returns, from ``permuted_pairs``."""
    observed = lift(corpus, words)
    p = stats.poisson_tail(F.col("pairs"), F.col("expected"))
    null = permuted_pairs(corpus, words, n_perm, seed).join(F.broadcast(observed.select("w1", "w2", "n1", "n2", "docs")), ["w1", "w2"])  # a row per pair
    sig = with_lift(null).groupBy("perm").agg(F.count(F.when(p < below, 1)).alias("sig"))
    seen = observed.agg(F.count(F.when(p < below, 1)).alias("observed"))
    docs = corpus.agg(F.count("*").alias("n"), F.count_distinct("subfield").alias("n_subfields"))
    out = sig.join(F.broadcast(seen)).agg(F.max("observed").alias("observed"), F.avg("sig").alias("null_mean"), F.percentile("sig", 0.95).alias("null_p95"), F.avg((F.col("sig") >= F.col("observed")).cast("double")).alias("p"))
    return out.join(F.broadcast(docs)).select("n", "n_subfields", F.lit(n_perm).alias("n_perm"), "observed", "null_mean", "null_p95", "p")  # one row each


def permutation_null(corpus: DataFrame, words: Sequence[str] = lexicons.PAIRED, n_perm: int = 300, below: float = 0.01, seed: int = 0) -> DataFrame:
    """Whether words meet more often than subfields explain: n, n_subfields, the significant pairs observed, their mean, 95th percentile
    and share of as many or more in permutations that deal each word's documents anew within each subfield.

    A permutation gives a word to the first c documents of the subfield by a seeded hash, c being how many have it. Places
    come from ``ranked``, so a subfield may hold any share of the rows."""
    from .corpus import ranked, seeded

    words = sorted(words)
    rows = corpus.select("base_id", "subfield", F.array_intersect("toks", literals(words)).alias("own"))
    held = rows.select("subfield", F.explode("own").alias("word")).groupBy("subfield", "word").agg(F.count("*").alias("c"))
    observed = _pairs_of(patterns(corpus, words).withColumn("perm", F.lit(0)), words, "perm")
    dealt = rows.select("base_id", "subfield", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm")).select("*", F.explode(literals(words)).alias("word"))
    dealt = ranked(dealt.withColumn("h", seeded(seed, F.col("perm"), F.col("word"), F.col("base_id"))), ["perm", "subfield", "word"], ["h", "base_id"])
    bit = F.element_at(F.create_map(*[F.lit(x) for k, w in enumerate(words) for x in (w, 1 << k)]), F.col("word")).cast("bigint")
    held = held.select(F.col("subfield").alias("of_field"), F.col("word").alias("of_word"), "c")  # a row per subfield, null too, and word
    given = dealt.join(F.broadcast(held), (F.col("word") == F.col("of_word")) & F.col("subfield").eqNullSafe(F.col("of_field"))).where(F.col("rn") < F.col("c"))
    masks = given.groupBy("perm", "base_id").agg(F.bit_or(bit).alias("mask")).groupBy("perm", "mask").agg(F.count("*").alias("c"))
    docs = corpus.agg(F.count("*").alias("docs"), F.count_distinct("subfield").alias("n_subfields"))
    null = _pairs_of(masks, words, "perm").drop("docs", "n1", "n2").join(F.broadcast(observed.select("w1", "w2", "n1", "n2", "docs")), ["w1", "w2"])
    p = stats.poisson_tail(F.col("pairs"), F.col("expected"))
    counted = with_lift(null.unionByName(observed)).groupBy("perm").agg(F.count(F.when(p < below, 1)).alias("sig"))
    perms = corpus.sparkSession.range(0, n_perm + 1).select(F.col("id").cast("int").alias("perm")).join(counted, "perm", "left").fillna(0)
    seen = F.max(F.when(F.col("perm") == 0, F.col("sig"))).over(Window.partitionBy())  # n_perm + 1 rows
    out = perms.withColumn("observed", seen).where("perm > 0").agg(F.max("observed").alias("observed"), F.avg("sig").alias("null_mean"), F.percentile("sig", 0.95).alias("null_p95"), F.avg((F.col("sig") >= F.col("observed")).cast("double")).alias("p"))
    return out.join(F.broadcast(docs)).select(F.col("docs").alias("n"), "n_subfields", F.lit(n_perm).alias("n_perm"), "observed", "null_mean", "null_p95", "p")
