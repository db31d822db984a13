"""Document fingerprints: consistent weighted sampling of a text's words, weighted by their counts.

Each of K samples gives every word its own variates r, c ~ Gamma(2, 1) and b ~ U(0, 1), made from hashes of the word and the
sample's number. A word of weight S has t = floor(ln S / r + b) and the value ln a = ln c - r (t - b + 1); the sample is the pair
(word, t) of the least value. Two texts agree in a sample with a probability that is the generalised Jaccard similarity of their
weights: the sum of the smaller weights over that of the larger. So the share of agreeing samples estimates it, with a standard
deviation of at most 0.5 / sqrt(K).

``fingerprints`` fingerprints every text and its edited text, whose last quarter gives way to the start of the next document's text.
Main path: DataFrame functions only. Texts are shuffled twice: once to cut the pieces that go to their neighbours, once into
buckets of documents, in which everything up to the samples happens. A value depends on word, weight and sample only, so it is
made once for each (word, weight) of a bucket and then handed to the documents that have it. Order comes from ranks
(``corpus.ranked``) of a narrow table of digests.

Defined results: null texts are empty; words are what white space separates, lower-cased; texts without words have an empty
fingerprint, alike to one another (1.0) and unlike any other (0.0); documents follow one another by doc_id, null ids first,
then by digest; rows of equal doc_id and text have equal results and count once in that order, so the only document's next one
is itself; an empty table gives no rows; extra columns are ignored. A very long text stays in one task, with a few
times its size in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.operators.corpus import ranked

from .storage import settle

#: Samples of a fingerprint, taken ``STEP`` at a time: a row holds as many values.
SAMPLES, STEP = 48, 4
_SCALE = 1 << 23
_LOW = (1 << 31) - 1


def _uniform(h: Column, shift: int) -> Column:
    """26 bits of a hash as a number within (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 26) - 1)).cast("double") + 0.5) * F.lit(2.0**-26)


def value(word: Column, weight: Column, sample: Column) -> Column:
    """A sample's value of a word of that weight, in 31 bits, over 31 bits that name the pair (word, t): the least stands for both."""
    first = F.xxhash64(word, sample)
    second = F.xxhash64(first)
    r = -F.ln(_uniform(first, 0) * _uniform(first, 32))
    log_c = F.ln(-F.ln(_uniform(second, 0) * _uniform(second, 32)))
    b = _uniform(F.xxhash64(second), 0)
    t = F.floor(F.ln(weight.cast("double")) / r + b)
    # ln a lies between -80 and 10 for weights up to 2^60, as uniforms have 26 bits.
    log_a = F.greatest(log_c - r * (t.cast("double") - b + 1) + 200, F.lit(0.0))
    return F.shiftleft((log_a * F.lit(float(_SCALE))).cast("bigint"), 31).bitwiseOR(F.xxhash64(first, t).bitwiseAND(F.lit(_LOW)))


def _spaced(text: Column) -> Column:
    return F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")


def likeness(one: Column, other: Column) -> Column:
    """The share of equal samples; null stands for the fingerprint of a text without words."""
    same = F.size(F.filter(F.zip_with(one, other, lambda x, y: x == y), lambda equal: equal)) / F.lit(float(SAMPLES))
    return F.when(one.isNull() & other.isNull(), F.lit(1.0)).when(one.isNull() | other.isNull(), F.lit(0.0)).otherwise(same)


def as_text(samples: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def _samples(terms: DataFrame, *group: str) -> DataFrame:
    """(group, ``of``, term, weight, ``sides``: 0 if it stands in both texts, 1 in the text, 2 in the edited one) to a row for each
    document: ``samples`` and ``edited_samples``."""
    shared = terms.groupBy(*group, "term", "weight").agg(F.collect_list(F.col("of") * 3 + F.col("sides")).alias("holders"))
    steps = shared.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // STEP - 1))))
    values = [value(F.col("term"), F.col("weight"), F.col("step") * STEP + k).alias(f"v{k}") for k in range(STEP)]
    held = steps.select(*group, "step", "holders", *values).select(*group, "step", F.explode("holders").alias("holder"), *[f"v{k}" for k in range(STEP)])
    least = held.groupBy(*group, "holder", "step").agg(*[F.min(f"v{k}").alias(f"v{k}") for k in range(STEP)])
    side = F.col("holder") % 3
    both = [F.min(F.when(side != other, F.col(f"v{k}"))).alias(f"{name}{k}") for name, other in (("a", 2), ("b", 1)) for k in range(STEP)]
    both = least.withColumn("of", F.expr("holder DIV 3")).groupBy(*group, "of", "step").agg(*both)

    def signature(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct("step", *[f"{name}{k}" for k in range(STEP)])))
        all_of = F.flatten(F.transform(rows, lambda r: F.array(*[r[f"{name}{k}"].bitwiseAND(F.lit(_LOW)) for k in range(STEP)])))
        return F.when(F.get(all_of, F.lit(0)).isNotNull(), all_of)

    return both.groupBy(*group, "of").agg(signature("a").alias("samples"), signature("b").alias("edited_samples"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text), 256))
    keyed = docs.select("doc_id", text.alias("text"), key.alias("key"))
    rows = keyed.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first(F.length("text")).alias("n_chars"))
    order = settle(ranked(rows, [], ["doc_id", "key"]).select("key", "doc_id", "rn", "cnt", F.expr("n_chars DIV 4").alias("k")), "order")
    follows = order.select(F.col("key").alias("to"), F.col("rn").alias("of"), "k", F.pmod(F.col("rn") + 1, F.col("cnt")).alias("next"))
    follows = follows.join(order.select(F.col("rn").alias("next"), "key"), "next").select("key", "to", "of", "k")
    pieces = keyed.dropDuplicates(["key"]).join(settle(follows, "follows"), "key")
    pieces = settle(pieces.select(F.col("to").alias("key"), "of", F.expr("substring(text, 1, k)").alias("piece")), "pieces")

    n_buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Both uses of ``whole`` below need the same columns, and no filter of nulls (hence the coalesce), so that one shuffle serves them.
    own = keyed.select("key", "text", F.lit(None).cast("bigint").alias("of"), F.lit(None).cast("string").alias("piece"))
    given = pieces.select("key", F.lit(None).cast("string").alias("text"), "of", "piece")
    dealt = own.unionByName(given).withColumn("bucket", F.coalesce(F.pmod(F.xxhash64("key"), F.lit(n_buckets)), F.lit(0).cast("bigint"))).repartition(n_buckets // 2, "bucket")
    whole = dealt.groupBy("bucket", "key").agg(*[F.first(c, True).alias(c) for c in ("text", "of", "piece")], F.count("text").alias("copies"))
    kept = F.expr("substring(text, 1, length(text) - length(text) DIV 4)")
    edited = F.concat(F.col("kept"), F.col("piece"))
    whole = whole.withColumn("kept", kept)
    # A word may reach over the cut, so what both texts share ends after the last space before it.
    head = F.length("kept") - F.length(F.substring_index(_spaced(F.col("kept")), " ", -1))
    parts = whole.select("bucket", "of", F.substring(F.col("text"), F.lit(1), head).alias("shared"), F.substring(F.col("text"), head + 1, F.length("text")).alias("rest"), F.substring(edited, head + 1, F.length(edited)).alias("other"))
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.split(_spaced(F.col(c)), " ").alias("words")) for n, c in enumerate(("shared", "rest", "other"))])
    words = parts.select("bucket", "of", F.inline(sides)).select("bucket", "of", "side", F.explode("words").alias("word")).where("word != ''")
    counts = words.groupBy("bucket", "of", F.xxhash64("word").alias("term")).agg(F.sum(F.when(F.col("side") < 2, 1).otherwise(0)).alias("one"), F.sum(F.when(F.col("side") != 1, 1).otherwise(0)).alias("two"))
    split = F.when(F.col("one") == F.col("two"), F.array(F.struct(F.lit(0).alias("sides"), F.col("one").alias("weight")))).otherwise(F.array(F.struct(F.lit(1).alias("sides"), F.col("one").alias("weight")), F.struct(F.lit(2).alias("sides"), F.col("two").alias("weight"))))
    terms = counts.select("bucket", "of", "term", F.inline(split)).where("weight > 0")
    sampled = _samples(terms, "bucket")
    about = whole.select("bucket", "of", "copies", F.length("text").cast("bigint").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    both = settle(about.join(sampled, ["bucket", "of"], "left").drop("bucket"), "fingerprints")

    before = both.select(F.col("of").alias("next"), F.col("samples").alias("next_samples"))
    named = order.select("doc_id", F.col("rn").alias("of"), F.pmod(F.col("rn") + 1, F.col("cnt")).alias("next"))
    linked = both.join(named, "of").join(before, "next")
    return linked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("samples")).alias("fingerprint"),
        as_text(F.col("edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        likeness(F.col("samples"), F.col("next_samples")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
