"""The data frames behind a report's figures and tables, from the operators' results. All have a row per period, word or class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordtide.functions import lexicons, stats

from .corpus import yq


def _fit(series: DataFrame, x: str, y: str, first: int, last: int, *keys: str) -> DataFrame:
    """Slope and intercept of y over the years from first to last."""
    rows = series.where(F.col("year").between(first, last))
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def markers_and_controls(rates: DataFrame, controls: DataFrame, first: int = 2015, last: int = 2021, full_year: int = 2025) -> DataFrame:
    """Per full year: the basket's rate with its Wilson bounds, the controls' mean and the basket's trend of the early years, carried on."""
    low, high = stats.wilson(F.col("hit"), F.col("total"))
    rows = rates.where(F.col("year") <= full_year).join(controls.groupBy("year").agg(F.avg("freq").alias("control")), "year", "left")
    trend = F.col("intercept") + F.col("slope") * F.col("year")
    return rows.join(F.broadcast(_fit(rates, "year", "rate", first, last))).select("year", "hit", "total", "rate", low.alias("low"), high.alias("high"), "control", trend.alias("trend"))


def counterfactual(series: DataFrame, yearly: DataFrame, words: Sequence[str], first: int = 2015, last: int = 2021) -> DataFrame:
    """Per word and quarter: its frequency and the line of its yearly frequencies in the early years, carried on and not below zero."""
    fits = _fit(yearly.where(F.col("word").isin(*words)), "year", "freq", first, last, "word")
    rows = series.where(F.col("word").isin(*words)).withColumn("yq", yq(F.col("year"), F.col("quarter")))
    return rows.join(F.broadcast(fits), "word").select("word", "yq", "freq", F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.col("yq")).alias("expected"))


def volcano(words: DataFrame, pairs: DataFrame, word_class: Column, pair_class: Column, iconic: Sequence[str] = tuple(lexicons.ICONIC), low: float = 0.0005, ratio: float = 4.0) -> DataFrame:
    """Every word and pair with both frequencies: its ratio and, if it has risen enough from a base, its class."""
    shown = lambda extra: ((F.col("base_freq") > low) | extra) & (F.col("ratio") >= ratio)
    rows = lambda df, kind, cls, extra: df.where("rec_freq > 0 AND ratio > 0").select(F.lit(kind).alias("kind"), "word", "base_freq", "rec_freq", "ratio", F.when(shown(extra), cls).alias("class"))
    return rows(words, "word", word_class, F.col("word").isin(*iconic)).unionByName(rows(pairs, "pair", pair_class, F.lit(False)))


def disclosure_share(yearly: DataFrame) -> DataFrame:
    share = lambda c: F.when(F.col("total") > 0, 100.0 * F.col(c) / F.col("total")).otherwise(0.0)
    return yearly.select("year", "total", "ack", "full", share("ack").alias("ack_pct"), share("full").alias("full_pct"))


def gap(excess: DataFrame, shares: DataFrame, year: int = 2025, literature: Mapping[str, float] = lexicons.LITERATURE) -> DataFrame:
    """Published estimates beside this one and the disclosed shares of a year: label, percent and kind."""
    known = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(float(v)).alias("value"), F.lit("literature").alias("kind")) for k, v in literature.items()])
    own = lambda label, value, kind: F.struct(F.lit(label).alias("label"), value.cast("double").alias("value"), F.lit(kind).alias("kind"))
    rows = excess.where(F.col("year") == year).select("excess").join(F.broadcast(shares.where(F.col("year") == year).select("ack_pct", "full_pct")))
    mine = F.array(own("marker words", 100 * F.col("excess"), "lower bound"), own("any mention in the text", F.col("full_pct"), "disclosed"), own("in the acknowledgements", F.col("ack_pct"), "disclosed"))
    return rows.select(F.explode(F.concat(known, mine)).alias("r")).select("r.*")


def indexed(series: DataFrame, columns: Sequence[str], first: int = 2015, last: int = 2019) -> DataFrame:
    """Each column as a percentage of its mean over the base years."""
    base = series.where(F.col("year").between(first, last)).agg(*[F.avg(c).alias(f"b_{c}") for c in columns])
    return series.join(F.broadcast(base)).select("year", *[F.try_divide(100 * F.col(c), F.col(f"b_{c}")).alias(f"{c}_idx") for c in columns])


def erosion(clusters: DataFrame, shares: DataFrame) -> DataFrame:
    """The cluster series by quarter, in percent, beside the share that discloses in that year."""
    pct = lambda c: (100 * F.col(c)).alias(c)
    return clusters.join(shares.select("year", "full_pct"), "year", "left").select("yq", "label", pct("all_markers"), pct("early"), pct("late"), "full_pct")


def ladder(scans: DataFrame, shares: DataFrame, excess: DataFrame, first: int = 2024, last: int = 2026, year: int = 2025, benchmark: float = lexicons.LITERATURE["biomedicine"]) -> DataFrame:
    """What each way of looking reveals, in percent, pooled over the recent years."""
    recent = lambda df: df.where(F.col("year").between(first, last))
    leak = recent(scans).agg(F.try_divide(100.0 * (F.sum("tier1") + F.sum("tier2")), F.sum("scanned")).alias("leaks"))
    said = recent(shares).agg(F.try_divide(100.0 * F.sum("ack"), F.sum("total")).alias("ack"), F.try_divide(100.0 * F.sum("full"), F.sum("total")).alias("full"))
    est = excess.where(F.col("year") == year).select((100 * F.col("excess")).alias("alpha"))
    rungs = [("source leaks", "leaks"), ("acknowledged", "ack"), ("mentioned in the text", "full"), ("marker words", "alpha"), ("biomedicine", "known")]
    one = leak.join(F.broadcast(said)).join(F.broadcast(est)).withColumn("known", F.lit(float(benchmark)))
    return one.select(F.posexplode(F.array(*[F.struct(F.lit(label).alias("rung"), F.col(c).cast("double").alias("value")) for label, c in rungs])).alias("place", "r")).select("place", "r.*")


def scatter(places: DataFrame, year: int, least: int = 300, native: Sequence[str] = lexicons.NATIVE) -> DataFrame:
    """Places with enough papers in a year: both percentages, the first's Wilson bounds, whether native, and the medians of both."""
    low, high = stats.wilson(F.col("marker"), F.col("total"))
    rows = places.where((F.col("year") == year) & (F.col("total") >= least))
    medians = rows.agg(F.median("marker_pct").alias("median_marker"), F.median("disc_pct").alias("median_disc"))
    return rows.join(F.broadcast(medians)).select("place", "total", "marker_pct", "disc_pct", (100 * low).alias("low"), (100 * high).alias("high"), F.col("place").isin(*native).alias("native"), "median_marker", "median_disc")


def heat_map(pairs: DataFrame) -> DataFrame:
    """Both halves of the lift matrix, masked where the pair is not significant."""
    masked = pairs.select("w1", "w2", "pairs", F.when(F.col("significant"), F.col("lift")).alias("lift"))
    return masked.unionByName(masked.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "pairs", "lift"))


def basket_table(excess: DataFrame, words: Sequence[str] = lexicons.BASKET) -> DataFrame:
    """The basket's words, the most frequent first: percentages of both periods, to three places, and the ratio, rounded."""
    rows = excess.where(F.col("word").isin(*words))
    place = F.row_number().over(Window.orderBy(F.desc("rec_freq"), "word"))  # a row per word of the basket
    return rows.select(place.alias("place"), "word", F.round(100 * F.col("base_freq"), 3).alias("base_pct"), F.round(100 * F.col("rec_freq"), 3).alias("rec_pct"), F.round("ratio", 0).alias("ratio"))
