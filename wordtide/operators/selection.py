"""Exact percentiles by rounds of histograms: no task holds a group's values.

A percentile with linear interpolation lies between two order statistics. For each, a round counts the values of its present
interval in ``BINS`` bins, picks the bin that holds its rank, and goes on with that bin's least and largest value. An interval shrinks
by the number of bins a round, or at once to one value where few are left, so a handful of rounds do for any data. A round shuffles a
row for each task, target and bin; the targets, two for each group and percentile, are joined to the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordtide.sources.shared import materialise

BINS = 512


def percentiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """(groups, share, percentile) of a numeric column, as ``percentile`` gives it; nulls do not count, and a group of nulls only has none.

    Null is a group like others. NaN is larger than any number, as in Spark's order, and stays out of the bins: a rank among the NaNs gives NaN."""
    v = F.col(value).cast("double")
    keys = [F.col(g).alias(f"g{k}") for k, g in enumerate(groups)]
    names = [f"g{k}" for k in range(len(groups))]
    values = materialise(df.select(*keys, v.alias("v")).where("v IS NOT NULL"), "values")
    number = ~F.isnan("v")
    sizes = values.groupBy(*names).agg(F.count("*").alias("n"), F.count(F.when(number, 1)).alias("m"), F.min(F.when(number, F.col("v"))).alias("low"), F.max(F.when(number, F.col("v"))).alias("high"))
    ranks = sizes.select(*names, "n", "m", "low", "high", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    place = F.col("share") * (F.col("n") - 1)
    ranks = ranks.select(*names, "m", "low", "high", "share", (place - F.floor(place)).alias("part"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank")).distinct()
    nan = F.col("rank") >= F.col("m")
    targets = ranks.select(*names, "share", "part", "rank", F.lit(0).cast("bigint").alias("below"), F.when(nan, F.lit(float("nan"))).otherwise(F.col("low")).alias("low"), F.when(nan, F.lit(float("nan"))).otherwise(F.col("high")).alias("high"))
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"x.{name}").eqNullSafe(F.col(f"t.{name}"))
    found = []
    while True:
        targets = materialise(targets, "targets")
        found.append(targets.where("low = high"))
        targets = targets.where("low < high")
        if targets.isEmpty():
            break
        open_ranks = targets.select(*names, "rank", "below", "low", "high").distinct()
        inside = values.alias("x").where(number).join(open_ranks.alias("t"), same & F.col("x.v").between(F.col("t.low"), F.col("t.high")))
        at = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins), F.lit(bins - 1)).cast("int")
        counted = inside.select(*[f"t.{c}" for c in (*names, "rank", "below")], at.alias("bin"), "v").groupBy(*names, "rank", "below", "bin").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*names, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")  # at most ``bins`` rows
        picked = counted.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        picked = picked.select(*names, "rank", F.col("before").alias("below"), "low", "high")
        both = F.lit(True)
        for name in (*names, "rank"):
            both = both & F.col(f"t.{name}").eqNullSafe(F.col(f"p.{name}"))
        targets = targets.alias("t").join(picked.alias("p"), both).select(*[f"t.{c}" for c in (*names, "share", "part", "rank")], "p.below", "p.low", "p.high")
    ends = found[0]
    for more in found[1:]:
        ends = ends.unionByName(more)
    low, high = F.min(F.struct("rank", F.col("low").alias("v")))["v"], F.max(F.struct("rank", F.col("low").alias("v")))["v"]
    joined = ends.groupBy(*names, "share").agg(low.alias("a"), high.alias("b"), F.max("part").alias("part"))
    out = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    return joined.select(*[F.col(n).alias(g) for n, g in zip(names, groups, strict=True)], "share", out.alias("percentile"))
