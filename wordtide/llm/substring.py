"""Substring dedup by line or paragraph hashing.

Units are a text's lines (or paragraphs, parted by blank lines). A unit is normalised (A-Z lower-cased, runs of white
space made one space), digested to 128 bits, and grouped with all equal units. The occurrence that comes first by
(rank, document, place) stays, the others are removed; the removed stretches keep their offsets in the
original text. Digests are pre-aggregated before they are shuffled. The join back to the occurrences shuffles none of the units
that occur ``HOT`` times or more: of those there are few, and their digests are broadcast.

A passage that stands within other text is no line of its own. So the sentences of all lines are digested and grouped as well. A
run of neighbouring sentences that all stand in another document, too, is a passage if it has ``PASSAGE_WORDS`` words or more.
Passages are reported (``passages``) in every document that holds them, the earliest included, and a run of sentences whose
first document is an earlier one is removed in the same way. A repeated passage loses the sentences
at its two ends that its surroundings complete differently, so one of over 50 words is found if these have 15 words or fewer.

Sentences are read twice, not stored: once for the groups, once for the places of those that repeat, which a bitmap of fixed
size picks before the join.

Defined results: null text has no units and stays null; every unit that holds a word counts, unless ``min_words`` is raised (shorter
units then stay); a text without removals is returned as it is; rows that repeat both doc_id and text are one document; rows that
share a doc_id alone are told apart by a hash of their texts; ties of rank go to the smaller doc_id, null last; an
empty table gives no rows; extra columns pass through ``drop_repeats`` by name, and those named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import clear, drop, packed, save, trimmed

MIN_WORDS = 1
#: Words from which a run of repeated sentences is a passage.
PASSAGE_WORDS = 35
#: Occurrences from which a unit is joined by broadcast.
HOT = 4096
#: Entries of the bitmap of repeated sentences.
TABLE = 1 << 23
LAST = 2**63 - 1
_SEPARATOR = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[ \t]*(?:\n[ \t]*)+")}
_SENTENCE = re.compile(r"[^\n.!?]+[.!?]*")
UNIT = "rank bigint, doc_id bigint, mark bigint, unit int, start int, stop int, h1 bigint, h2 bigint"
SENTENCE = "rank bigint, doc_id bigint, mark bigint, h1 bigint, h2 bigint"
PIECE = "doc_id bigint, mark bigint, piece int, start int, stop int, words int, h1 bigint, h2 bigint"


def units_of(text: str, kind: str = "line") -> Iterator[tuple[int, int]]:
    """(start, stop) of each unit, separators left out."""
    at = 0
    for m in _SEPARATOR[kind].finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def normalised(unit: str) -> bytes:
    return b" ".join(unit.encode("utf-8", "surrogatepass").lower().split())


def digest_of(body: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(body, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sentences_of(text: str) -> Iterator[tuple[int, int, int, tuple[int, int]]]:
    """(start, stop, words, digest) of each sentence that holds a word; none crosses a line break."""
    for m in _SENTENCE.finditer(text):
        if body := normalised(m.group()):
            yield m.start(), m.end(), body.count(b" ") + 1, digest_of(body)


def _rows_of(schema: str, rows: Callable[[tuple], Iterator[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that ``rows`` makes of each input row, in batches."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith("bigint") else pa.int32() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[-1] is not None:
                    found.extend(rows(row))
                if len(found) > 100_000:
                    yield flush()
                    found.clear()
        yield flush()

    return run


def _texts(docs: DataFrame, rank: str) -> DataFrame:
    return docs.select(F.col(rank).cast("bigint").alias("rank"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))


def _document() -> Column:
    return F.struct(F.coalesce("rank", F.lit(LAST)).alias("r"), F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("mark").alias("m"))


def _joined(rows: DataFrame, groups: DataFrame, hot: int) -> DataFrame:
    """The rows (h1, h2, ...) of a group, with its ``first``. ``rows`` is read once."""
    # At most one digest in ``hot`` occurrences is broadcast. Rows that find theirs are spread over the tasks of the second join.
    often = groups.where(F.col("n") >= hot).select("h1", "h2", F.col("first").alias("__hot"))
    rare = groups.where(F.col("n") < hot).select(F.col("h1").alias("__k1"), F.col("h2").alias("__k2"), F.col("first").alias("__cold"))
    found = rows.join(F.broadcast(often), ["h1", "h2"], "left")
    key = F.when(F.col("__hot").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id", "mark", "start", "h1"))
    found = found.withColumn("__h1", key).join(rare, (F.col("__h1") == F.col("__k1")) & (F.col("h2") == F.col("__k2")), "left")
    first = F.coalesce("__hot", "__cold")
    return found.withColumn("first", first).where("first IS NOT NULL").select(*rows.columns, "first")


def repeats(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, rank: str = "doc_id", hot: int = HOT) -> DataFrame:
    """The units to remove: doc_id, mark (a hash of the text), unit, start, stop."""

    def units(row: tuple) -> Iterator[tuple]:
        for unit, (start, stop) in enumerate(units_of(row[3], kind)):
            body = normalised(row[3][start:stop])
            if body and body.count(b" ") + 1 >= min_words:
                yield (*row[:3], unit, start, stop, *digest_of(body))

    found, _ = save(_texts(docs, rank).mapInArrow(trimmed(_rows_of(UNIT, units)), UNIT), "units")
    place = F.struct(_document().alias("of"), F.col("unit"))
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first, _ = save(first, "firsts")
    clear(docs.sparkSession)
    return _joined(found, first, hot).where(place != F.col("first")).select("doc_id", "mark", "unit", "start", "stop").distinct()


def _bitmap(names: DataFrame) -> bytes:
    found = names.select(F.col("h1").bitwiseAND(F.lit(TABLE - 1)).cast("int").alias("k")).distinct().toArrow()  # TABLE rows at most
    bits = np.zeros(TABLE, bool)
    bits[found.column("k").to_numpy()] = True
    return np.packbits(bits).tobytes()


def shared_sentences(docs: DataFrame, rank: str = "doc_id", hot: int = HOT) -> DataFrame:
    """The sentences that stand in several documents, at each of their places: doc_id, mark, piece (its number in the text), start, stop,
    words and later (whether an earlier document has it)."""

    def once(row: tuple) -> Iterator[tuple]:
        return ((*row[:3], *digest) for digest in dict.fromkeys(s[3] for s in sentences_of(row[3])))

    texts = _texts(docs, rank)
    groups = texts.mapInArrow(trimmed(_rows_of(SENTENCE, once)), SENTENCE).groupBy("h1", "h2")
    groups = groups.agg(F.min(_document()).alias("first"), F.max(_document()).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last")
    groups, _ = save(groups, "sentences")
    clear(docs.sparkSession)
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(groups))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits.value

        def pieces(row: tuple) -> Iterator[tuple]:
            for piece, (start, stop, words, digest) in enumerate(sentences_of(row[3])):
                k = digest[0] & (TABLE - 1)
                if wanted[k >> 3] & (128 >> (k & 7)):
                    yield (*row[:3], piece, start, stop, words, *digest)

        yield from _rows_of(f"rank bigint, {PIECE}", pieces)(batches)

    rows = _joined(texts.mapInArrow(trimmed(places), f"rank bigint, {PIECE}"), groups, hot)
    return rows.select("doc_id", "mark", "piece", "start", "stop", "words", (_document() != F.col("first")).alias("later")).distinct()


def runs_of(pieces: list[tuple[int, int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start, stop, words) of the runs of neighbouring pieces (number, start, stop, words) that have ``least`` words."""
    out: list[tuple[int, int, int]] = []
    last = None
    for number, start, stop, words in pieces:
        if last is not None and number == last + 1:
            out[-1] = (out[-1][0], stop, out[-1][2] + words)
        else:
            out.append((start, stop, words))
        last = number
    return [run for run in out if run[2] >= least]


def cut(text: str, units: list[tuple[int, int]], passages: list[tuple[int, int]], kind: str) -> tuple[str, list[tuple[int, int]]]:
    """``text`` without the given units and, in the others, without the passages; and the spans that are gone, none within another.

    Kept lines are joined by line breaks, kept paragraphs by blank lines; a unit of which only white space is left goes."""
    gone, spans, kept = set(units), [], []
    for a, b in units_of(text, kind):
        if (a, b) in gone:
            spans.append((a, b))
            continue
        inner = [(max(a, s), min(b, e)) for s, e in passages if s < b and e > a]
        at, left = a, []
        for s, e in inner:
            left.append(text[at:s])
            at = e
        left.append(text[at:b])
        spans += inner
        if not inner or "".join(left).strip():
            kept.append("".join(left))
    return ("\n" if kind == "line" else "\n\n").join(kept), spans


ADDED = {"removed": "array<struct<start:int,stop:int>>", "n_removed": "bigint", "passages": "array<struct<start:int,stop:int,words:int>>", "n_passages": "bigint"}
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_PASSAGE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32())]))


def drop_repeats(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, rank: str = "doc_id", passage_words: int = PASSAGE_WORDS, hot: int = HOT) -> DataFrame:
    """``docs`` with ``text`` cleaned, ``removed`` (start and stop of each removed stretch in the original text), ``passages`` (start, stop and
    words of each passage that other documents hold, the kept one included) and their numbers."""
    spark = docs.sparkSession
    units = repeats(docs, kind, min_words, rank, hot).select("doc_id", "mark", F.lit(-1).alias("piece"), "start", "stop", F.lit(0).alias("words"), F.lit(True).alias("later"))
    units, of_units = save(units, "repeats")
    clear(spark)
    found = units.unionByName(shared_sentences(docs, rank, hot)).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("piece", "start", "stop", "words", "later"))).alias("__found"))
    found, _ = save(found, "spans")
    drop(spark, of_units)
    clear(spark)
    found = found.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "__found")
    safe, restore = packed(docs, *dict.fromkeys(["doc_id", "text", rank]))
    joined = safe.join(found, safe["doc_id"].cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(safe["text"].cast("string")) == F.col("__mark")), "left")
    joined = joined.withColumn("text", F.col("text").cast("string")).select(*safe.columns, "__found")
    schema = joined.drop("__found").withColumns({c: F.lit(None).cast(kind_) for c, kind_ in ADDED.items()}).schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, own = batch.schema.get_field_index("text"), batch.schema.get_field_index("__found")
            cleaned, removed, passages = [], [], []
            for text, rows in zip(batch.column(k).to_pylist(), batch.column(own).to_pylist(), strict=True):
                rows = [tuple(r.values()) for r in rows or ()]
                pieces = [r for r in rows if r[0] >= 0]
                later = [run[:2] for run in runs_of([r[:4] for r in pieces if r[4]], passage_words)]
                lines = [r[1:3] for r in rows if r[0] < 0]
                out, spans = cut(text, lines, later, kind) if lines or later else (text, [])
                cleaned.append(out)
                removed.append([{"start": a, "stop": b} for a, b in spans])
                passages.append([{"start": a, "stop": b, "words": n} for a, b, n in runs_of([r[:4] for r in pieces], passage_words)])
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__found"]
            columns[k] = pa.array(cleaned, pa.string())
            counts = [pa.array([len(x) for x in of], pa.int64()) for of in (removed, passages)]
            columns += [pa.array(removed, _SPAN), counts[0], pa.array(passages, _PASSAGE), counts[1]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return restore(joined.mapInArrow(trimmed(clean), schema), *ADDED)
