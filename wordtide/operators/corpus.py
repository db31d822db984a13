"""The corpus frame: one row per document with its period, subfield and tokens; versions, ranks and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordtide.sources.shared import materialise

WORD = "[a-z]+"
HYPHENATED = "[a-z][a-z-]*"


def tokens(text: Column, pattern: str = WORD) -> Column:
    """All matches of ``pattern`` in the lower-cased text; null is empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def yq(year: Column, quarter: Column) -> Column:
    return year + (quarter - 1) / 4


def quarter_label(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string"))


def corpus(docs: DataFrame, base_id: Column, year: Column, quarter: Column, subfield: Column, pattern: str = WORD) -> DataFrame:
    """base_id, year, quarter, subfield and toks (with repeats, in order)."""
    return docs.select(base_id.alias("base_id"), year.alias("year"), quarter.alias("quarter"), subfield.alias("subfield"), tokens(F.col("text"), pattern).alias("toks"))


def store(frame: DataFrame, path: str) -> None:
    """The corpus frame as Parquet by year and subfield, tokenised once: what asks for some years or subfields reads their files only. Rows are
    dealt by (year, subfield, a hash of base_id), so that a large subfield is many files of many tasks."""
    spread = F.pmod(F.xxhash64("base_id"), F.lit(16))
    frame.withColumn("__spread", spread).repartition("year", "subfield", "__spread").drop("__spread").write.partitionBy("year", "subfield").parquet(path)


def stored(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The frame that ``store`` wrote."""
    return spark.read.schema(f"base_id {id_type}, quarter bigint, toks array<string>, year int, subfield string").parquet(path)


def base_id(column: Column) -> Column:
    """An identifier without its version suffix."""
    return F.split_part(column, F.lit("v"), F.lit(1))


def dated(records: DataFrame, published: str = "published", first: int = 2015, last: int = 2026) -> DataFrame:
    """Rows whose ISO date has a month and a year in range, with year and quarter."""
    year = F.substring(published, 1, 4).cast("int")
    rows = records.where(F.length(published) >= 7).withColumn("year", year).where(F.col("year").between(first, last))
    return rows.withColumn("quarter", F.floor((F.substring(published, 6, 2).cast("int") - 1) / 3).cast("int") + 1)


def quarters(records: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """year and quarter of every quarter from first to last, whether ``records`` has rows for it or not."""
    start, stop = (F.make_date(F.lit(y), F.lit(3 * q - 2), F.lit(1)) for y, q in (first, last))
    days = records.sparkSession.range(1).select(F.explode(F.sequence(start, stop, F.expr("interval 3 months"))).alias("d"))
    return days.select(F.year("d").alias("year"), F.quarter("d").alias("quarter"))


def first_versions(records: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of each key by ``order``; apply it before any filter, as a later copy never replaces a bad first one.

    An aggregate, so copies are reduced before the shuffle and a key of many copies does no harm."""
    return records.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*records.columns), order).alias("r")).select("r.*")


def duplicates(records: DataFrame, key: str) -> DataFrame:
    counted = records.groupBy(key).count()
    return counted.agg(F.sum("count").alias("n_records"), F.count("*").alias("n_keys"), (F.sum("count") - F.count("*")).alias("n_duplicates"))


def ranked(records: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``records`` with rn, the place (from 0) within the group by ``order``, and cnt, the group's size.

    A window would put a group in one task. Here rows are dealt by ranges of (group, order) and sorted; a row's place is its place
    in its partition, less the partition's first row of the group, plus the group's rows in the partitions before.
    The table of those offsets has a row per partition and group."""
    rows = records.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__at", F.monotonically_increasing_id())
    rows = materialise(rows, "ranked").withColumn("__part", F.shiftrightunsigned("__at", 33))
    parts = rows.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy(*group)
    before = F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__p"), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(w).alias("cnt"))
    same = F.col("__part") == F.col("__p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return rows.join(parts, same).select(*records.columns, (F.col("__at") + F.col("__shift")).alias("rn"), "cnt")


def stride_sample(records: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Per group, n evenly spaced records in key order (all, if there are no more than n): places floor(k * count / n), k < n."""
    rows = ranked(records.select(group, key), [group], [key])
    # The place rn is taken if some k has floor(k * cnt / n) = rn: the least k with k * cnt >= rn * n will do.
    k = F.ceil(F.col("rn") * n / F.col("cnt")).cast("bigint")
    return rows.where((F.col("cnt") <= n) | ((k < n) & (F.floor(k * F.col("cnt") / n) == F.col("rn")))).select(group, key)


def step_sample(records: DataFrame, key: str, most: int = 2500) -> DataFrame:
    """Every step-th record in key order, the step being count / most (1 at least), and ``most`` of them."""
    rows = ranked(records, [], [key])
    step = F.greatest(F.expr(f"cnt DIV {most}"), F.lit(1))
    return rows.where((F.col("rn") % step == 0) & (F.col("rn") / step < most)).drop("rn", "cnt")


def work_order(records: DataFrame, year: str = "year", key: str = "id") -> DataFrame:
    """``records`` with their place in the order of work: latest years first, then by key."""
    return ranked(records, [], [F.desc(year), key]).drop("cnt").withColumnRenamed("rn", "place")


def hash_sample(records: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n records, the first by a seeded MD5 of the key."""
    return records.select(key, seeded(F.col(key), seed).alias("h")).orderBy("h", key).limit(n).select(key)


def seeded(*parts: Column | int | str) -> Column:
    """An MD5 of the parts, joined by colons: an order that a seed fixes whatever the partitions."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *texts).cast("binary"))


def seeded_baskets(words: DataFrame, n: int, size: int, seed: int = 7) -> DataFrame:
    """(k, word): n baskets of ``size`` of the words, drawn without replacement. At most ``size`` words a basket leave a task."""
    drawn = words.select("word", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    w = Window.partitionBy("k").orderBy("h", "word")
    return drawn.withColumn("h", seeded(F.col("word"), F.col("k"), seed)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= size).select("k", "word")
