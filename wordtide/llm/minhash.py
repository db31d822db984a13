"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct 5-word shingles. Each of 64 permutations is evaluated once per
shingle, and both its smallest and its largest value are kept: 128 values from 64 evaluations. Both
agree between two sets with a probability equal to their Jaccard similarity, so the share of agreeing values is an unbiased
estimate, of lower variance than 64 minima give. Bands of two minima and two maxima propose candidates;
links are confirmed on full sets.

Steps (``components``):

1. one pass over the texts makes a profile per document; copies of one word sequence collapse into a
   class with the smallest doc_id, pre-aggregated before the shuffle;
2. classes that share a bucket are candidates. Each bucket is first tested against its pivot (its
   smallest id), one pair per member, never all pairs;
3. confirmed links are contracted to connected components by alternating star contractions;
4. in buckets that still hold several components, the members outside the bucket's largest component
   are tested against the members of other components, each pair in one bucket only. Pairs within a component are never
   made, so a large group of copies costs its stragglers times its size at most.

No pair that a bucket proposes is dropped on an estimate. Step 4 leaves out only pairs that cannot link: sets of sizes m and n
link if they differ in at most (m + n) / 7 shingles, and the bits in which their parity bitmaps differ are a lower bound of
that number. A coarse bitmap of 1,024 bits stands in the profile; one of 8 bits a shingle is made for the members
of mixed buckets. What is left is confirmed on full sets.

Buckets: with 32 bands of four values a link at similarity 0.75 of long texts stays unproposed with a probability of 5e-6, and
below that for closer texts. In small sets minimum and maximum depend on each other, so sets of up to ``SMALL`` shingles
get the shingles of their prefix (all but three quarters of the set, in hash order, and one) as buckets instead, and those up to
4/3 of that size both kinds: two such sets that link always share one.

Defined results: null, empty or wordless texts have the empty set, link with nothing and are their own
component; fewer than five words make one shingle of the whole sequence; repeated rows are copies; rows of one doc_id
with several texts are one node with the links of each; a null doc_id has a null component; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import clear, drop, packed, save, trimmed

SHINGLE = 5
PERMUTATIONS = 64
BANDS = 32
NUMERATOR, DENOMINATOR = 75, 100
#: Sets of up to so many shingles are proposed exactly, by their prefixes.
SMALL = 32
#: Bits of the parity bitmap in a profile, and bits a shingle (and at most) of the bitmaps of members of mixed buckets.
COARSE = 1024
FINE_PER_SHINGLE, FINE_MOST = 8, 1 << 18
_CHUNK = 8192
_ROWS = 1000
_VOCABULARY = 200_000


class WordHashes(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < _VOCABULARY and len(word) < 64:
            self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _constants(n: int, salt: str) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{salt}{i}".encode(), digest_size=8).digest(), "little") for i in range(n)], dtype=np.uint64)


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    factor = _constants(SHINGLE, "shingle") | np.uint64(1)
    n = max(1, len(words) - SHINGLE + 1)
    mixed = np.full(n, min(len(words), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(words))):
        mixed += h[k : k + n] * factor[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def min_max_signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of all permutations, then their maxima, as uint32."""
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(x), _CHUNK):
        values = x[start : start + _CHUNK][None, :] * a[:, None]
        values += b[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) int64 keys: band j hashes minima and maxima 2j and 2j + 1."""
    s = signatures.astype(np.uint64).reshape(len(signatures), 2, BANDS, PERMUTATIONS // BANDS)
    factor = _constants(4, "band") | np.uint64(1)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(s), BANDS)).copy()
    for k, part in enumerate((s[:, 0, :, 0], s[:, 0, :, 1], s[:, 1, :, 0], s[:, 1, :, 1])):
        key ^= part * factor[k]
        key ^= key >> np.uint64(31)
        key *= np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def prefix_keys(shingles: np.ndarray) -> np.ndarray:
    """Buckets of a small set: of its shingles in hash order, as many as any set that links must share one of."""
    n = len(shingles)
    kept = shingles[: n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1]
    mixed = (kept ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def parity(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Which hash values modulo ``bits`` are hit an odd number of times, as longs. Half the bits: the two halves, xored."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


PROFILE = "doc_id bigint, digest binary, n_shingles bigint, keys array<bigint>, parity array<bigint>"


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def digest_of(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    a = (_constants(PERMUTATIONS, "a") >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (_constants(PERMUTATIONS, "b") >> np.uint64(32)).astype(np.uint32)
    both = SMALL * DENOMINATOR // NUMERATOR
    for batch in batches:
        digests, sizes, keys, parities = [], [], [], []
        for text in batch.column(1):
            words = words_of(text.as_py())
            shingles = shingle_set(words, hashes)
            sizes.append(len(shingles))
            digests.append(digest_of(words))
            own = [prefix_keys(shingles)] if 0 < len(shingles) <= both else []
            if len(shingles) > SMALL:
                own.append(band_keys(min_max_signature(shingles, a, b)[None])[0])
            keys.append(np.concatenate([np.empty(0, np.int64), *own]))
            parities.append(parity(shingles, COARSE))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), _lists(keys), _lists(parities)],
            names=["doc_id", "digest", "n_shingles", "keys", "parity"],
        )


SETS = "id bigint, digest binary, shingles array<bigint>"


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the rows (id, digest, text) whose text is the one that the digest names."""
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            ids, digests, sets = [], [], []
            for name, digest, text in zip(*batch.slice(at, _ROWS).columns, strict=True):
                words = words_of(text.as_py())
                if digest_of(words) == digest.as_py():
                    ids.append(name.as_py())
                    digests.append(digest.as_py())
                    sets.append(shingle_set(words, hashes).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), _lists(sets)], names=["id", "digest", "shingles"])


def fine_parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch, rows = whole.slice(at, _ROWS), []
            for s in batch.column(2):
                shingles = s.values.to_numpy().view(np.uint64)
                bits = 1 << (FINE_PER_SHINGLE * len(shingles) - 1).bit_length()
                rows.append(parity(shingles, max(COARSE, min(FINE_MOST, bits))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(rows)], names=["id", "digest", "fine"])


def coarse_difference(x: str, y: str) -> F.Column:
    """In how many bits two coarse bitmaps differ."""
    total = F.lit(0)
    for k in range(COARSE // 64):
        total = total + F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k]))
    return total


def fine_difference(x: str, y: str) -> F.Column:
    """The same of two fine ones. Sets that may link are of like sizes, so one bitmap has at most twice the other's bits; it is folded."""
    xor = lambda p, q: p.bitwiseXOR(q)
    n = F.least(F.size(x), F.size(y))
    folded = lambda c: F.when(F.size(c) > n, F.zip_with(F.slice(c, 1, n), F.slice(c, n + 1, n), xor)).otherwise(F.col(c))
    return F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda total, k: total + k)


def _not_above(difference: F.Column, m: F.Column, n: F.Column) -> F.Column:
    """Whether sets of sizes m and n that differ in so many shingles at least may still link."""
    return F.lit(DENOMINATOR + NUMERATOR) * difference <= F.lit(DENOMINATOR - NUMERATOR) * (m + n)


def _may_link(m: F.Column, n: F.Column) -> F.Column:
    return F.lit(DENOMINATOR) * F.least(m, n) >= F.lit(NUMERATOR) * F.greatest(m, n)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    linked = DENOMINATOR * both >= NUMERATOR * (F.size("x") + F.size("y") - both)
    return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    profile, _ = save(texts.mapInArrow(trimmed(profiles), PROFILE), "profiles")
    classes = profile.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
    classes, _ = save(classes.agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("parity").alias("parity")), "classes")

    keyed = classes.select("id", "digest", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("pivot")).where("members > 1").drop("members")
    members, of_members = save(keyed.join(buckets, "key"), "members")
    clear(spark)

    wanted = members.select("id", "digest").distinct()
    sets = texts.join(wanted, texts["doc_id"] == wanted["id"]).select("id", "digest", "text").mapInArrow(trimmed(shingle_sets), SETS)
    sets, of_sets = save(sets.dropDuplicates(["id", "digest"]), "sets")
    clear(spark)

    tested = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links, of_links = save(confirmed(tested, sets), "links")
    clear(spark)
    labels = connected_components(links)

    unused = [of_members, of_sets, of_links]
    if (rows := _mixed(members, labels)) is not None:
        signed, of_signed = save(_signed(rows[0], classes, sets), "signed")
        more, of_more = save(_across_components(rows[0], signed), "more")
        clear(spark)
        found, of_found = save(confirmed(more, sets), "found")
        labels = connected_components(links.unionByName(found))
        unused += [rows[1], of_signed, of_more, of_found]
    # All that still is to come reads profiles, classes and labels only.
    for path in unused:
        drop(spark, path)
    clear(spark)

    component = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = profile.select("doc_id", "digest", "n_shingles").join(component, "digest", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), (F.col("doc_id") == component_id).alias("kept"))


def _mixed(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, str] | None:
    """The members of buckets that hold several components, with their own and the largest one, stored; None if there are none."""
    rows = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_component = rows.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = by_component.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("most")).where("parts > 1")
    rows, path = save(rows.join(mixed.select("key", F.col("most.component").alias("main")), "key"), "mixed")
    return None if rows.isEmpty() else (rows, path)


def _signed(rows: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Sizes, buckets and bitmaps of the classes in ``rows``."""
    named = rows.select("id", "digest").distinct()
    fine = sets.join(named, ["id", "digest"], "left_semi").mapInArrow(trimmed(fine_parities), "id bigint, digest binary, fine array<bigint>")
    return classes.select("id", "digest", "n", "keys", "parity").join(fine, ["id", "digest"])


def _across_components(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Untested pairs (a, b) of one bucket and different components whose sizes and bitmaps allow a link."""
    rows = rows.join(signed, ["id", "digest"])
    stray = rows.where("component <> main").select(*[F.col(c).alias(f"s_{c}") for c in ("key", "id", "component", "n", "keys", "parity", "fine")])
    # The bucket in which a pair is made is the least that both share.
    least = F.array_min(F.array_intersect("s_keys", "keys"))
    joined = stray.join(
        rows,
        (F.col("s_key") == F.col("key"))
        & (F.col("s_component") != F.col("component"))
        & ((F.col("component") == F.col("main")) | (F.col("s_id") < F.col("id")))
        & _may_link(F.col("s_n"), F.col("n"))
        & _not_above(coarse_difference("s_parity", "parity"), F.col("s_n"), F.col("n"))
        & _not_above(fine_difference("s_fine", "fine"), F.col("s_n"), F.col("n"))
        & (least == F.col("key")),
    )
    return joined.where("s_id <> pivot AND id <> pivot").select(F.least("s_id", "id").alias("a"), F.greatest("s_id", "id").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, one row (the least) per doc_id; rows of null doc_id stay.

    An empty table stays empty; extra columns pass through, whatever their names."""
    safe, restore = packed(docs, "doc_id", "text")
    kept = components(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = safe.join(kept, safe["doc_id"] == kept["kept_id"], "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct(*safe.columns)).alias("row")).select("row.*")
    return restore(rows.unionByName(safe.where("doc_id IS NULL")))
