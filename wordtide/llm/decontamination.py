"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` makes a table of index segments in the shared folder. A segment covers a run of
documents (about ``SEGMENT_WORDS`` words) and stores, for each term, the ascending list of its positions in the
segment's word stream (documents lie one position apart, so no phrase crosses from one into the
next). Segments are local to the texts: no posting list of a frequent word is ever gathered.

``search`` sends the benchmark, as windows of ``WINDOW`` consecutive words, to every segment. There each window
whose terms all occur starts from the positions of its rarest term, shifted by that term's offset, and is
intersected with the shifted positions of the next rarest, until nothing or the exact places are left. With
``slop`` it also finds proximity matches: stretches of at most window + slop words that hold every
word of the window as often as it does, in any order, within one document (so exact places are near ones, too).

The benchmark is cut into chunks of ``CHUNK`` windows, which a hash deals to blocks of about ``BLOCK_WORDS`` words; each block is
broadcast on its own and given back before the next, so what the driver and the executors hold of it has a bound, whatever
the size of an item.

Defined results: null or wordless texts have no words and no hits; items of fewer words than a window, but not
none, are one window; wordless items never match; repeated items count once by item_id; a null item_id
counts as the item ``null``; each document row gets its own result, repeated or null doc_ids included; empty tables give no hits
or no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, packed, save, trimmed

WINDOW = 10
#: Words that a near stretch may have beyond its window.
SLOP = 3
SEGMENT_WORDS = 400_000
BLOCK_WORDS = 200_000
CHUNK = 4096

#: Bytes that are no part of a word become spaces, A-Z become a-z; bytes from 128 belong to words.
_TO_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


SEGMENT = "segment bigint, doc_ids array<bigint>, marks array<bigint>, n_words array<int>, terms array<binary>, ends array<int>, gaps array<int>"


def _segment(doc_ids: list[int | None], marks: list[int], sizes: list[int], words: list[bytes]) -> pa.RecordBatch:
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    term = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    at = np.arange(len(words), dtype=np.int32) + np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=len(numbers))).astype(np.int32)
    gaps = at[order]
    starts = np.concatenate([[0], ends[:-1]])[: len(numbers)]
    gaps[1:] -= at[order][:-1].copy()
    gaps[starts] = at[order][starts]
    name = os.urandom(8)  # drawn when the index is written, which happens once
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([int.from_bytes(name, "little", signed=True)]), one(doc_ids, pa.int64()), one(marks, pa.int64()), one(sizes, pa.int32()), one(list(numbers), pa.binary()), one(ends, pa.int32()), one(gaps, pa.int32())],
        names=["segment", "doc_ids", "marks", "n_words", "terms", "ends", "gaps"],
    )


def _segments(segment_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list[int | None] = []
        marks: list[int] = []
        sizes: list[int] = []
        words: list[bytes] = []
        for batch in batches:
            for doc_id, mark, text in zip(*batch.columns, strict=True):
                own = words_of(text.as_py())
                doc_ids.append(doc_id.as_py())
                marks.append(mark.as_py())
                sizes.append(len(own))
                words += own
                if len(words) >= segment_words or len(sizes) >= segment_words:
                    yield _segment(doc_ids, marks, sizes, words)
                    doc_ids, marks, sizes, words = [], [], [], []
        if doc_ids:
            yield _segment(doc_ids, marks, sizes, words)

    return run


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of ``docs`` (doc_id, text), stored in the shared folder: one row per segment."""
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string"))
    return materialise(texts.mapInArrow(trimmed(_segments(segment_words)), SEGMENT), "index")


class Windows:
    """A block of the benchmark: its distinct windows over a vocabulary of its own, and their items."""

    def __init__(self, chunks: list[tuple[str, list[str]]], size: int):
        numbers: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in chunks})
        number = {name: k for k, name in enumerate(self.names)}
        parts, owners = [np.empty((0, size), np.int32)], [np.empty(0, np.int64)]
        for item, words in chunks:
            ids = np.array([numbers.setdefault(w.encode("utf-8", "surrogatepass"), len(numbers)) for w in words], np.int32)
            ids = np.concatenate([ids, np.full(max(0, size - len(ids)), -1, np.int32)])
            parts.append(np.lib.stride_tricks.sliding_window_view(ids, size))
            owners.append(np.full(len(parts[-1]), number[item]))
        self.vocabulary = list(numbers)
        self.terms, window = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        self.lengths = (self.terms >= 0).sum(axis=1)
        pairs = np.unique(np.stack([window.ravel(), np.concatenate(owners)]), axis=1)
        self.owner, self.ends = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.terms) + 1))


def items_of(windows: SimpleNamespace, w: int) -> list[str]:
    return [windows.names[k] for k in windows.owner[windows.ends[w] : windows.ends[w + 1]]]


class Postings:
    """The positions of the block's terms in one segment."""

    def __init__(self, terms: pa.Array, ends: np.ndarray, gaps: np.ndarray, vocabulary: pa.Array):
        self.row = pc.fill_null(pc.index_in(vocabulary, value_set=terms), -1).to_numpy(zero_copy_only=False)
        self.ends, self.gaps = ends, gaps
        self.starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        self.sizes = np.where(self.row >= 0, (ends - self.starts)[self.row] if len(ends) else 0, 0)
        self.known: dict[int, np.ndarray] = {}

    def __getitem__(self, term: int) -> np.ndarray:
        if term not in self.known:
            row = self.row[term]
            self.known[term] = np.cumsum(self.gaps[self.starts[row] : self.ends[row]], dtype=np.int64)
        return self.known[term]


def phrase_starts(postings: Postings, window: np.ndarray) -> np.ndarray:
    """Where the window's words stand consecutively: offset-adjusted lists, rarest first."""
    order = sorted(range(len(window)), key=lambda k: (postings.sizes[window[k]], k))
    starts = postings[window[order[0]]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        listed = postings[window[k]]
        found = np.searchsorted(listed, starts + k)
        found[found == len(listed)] = 0
        starts = starts[listed[found] == starts + k]
    return starts


def near_anchors(postings: Postings, window: np.ndarray, span: int, first: np.ndarray) -> np.ndarray:
    """Positions of the window's rarest term that lie in a stretch of at most ``span`` positions, within one document, with every
    term of the window as often as it has it. ``first``: where the documents start, ascending, one position apart, and one past the last."""
    wanted = Counter(window.tolist())
    terms = sorted(wanted, key=lambda t: (postings.sizes[t], t))
    anchors = postings[terms[0]]
    of = np.searchsorted(first, anchors, side="right")
    low, high = np.maximum(anchors - span + 1, first[of - 1]), np.minimum(anchors + span, first[of] - 1)
    for t in terms:
        if not len(anchors):
            return anchors
        listed = postings[t]
        ok = np.searchsorted(listed, high) - np.searchsorted(listed, low) >= wanted[t]
        anchors, low, high = anchors[ok], low[ok], high[ok]
    kept = []
    for p, start, stop in zip(anchors.tolist(), low.tolist(), high.tolist(), strict=True):
        around = sorted((int(x), t) for t in terms for x in postings[t][np.searchsorted(postings[t], start) : np.searchsorted(postings[t], stop)])
        missing, held, left = sum(wanted.values()), Counter(), 0
        for x, t in around:
            held[t] += 1
            missing -= held[t] <= wanted[t]
            while held[around[left][1]] > wanted[around[left][1]]:  # the shortest stretch that ends here
                held[around[left][1]] -= 1
                left += 1
            if not missing and around[left][0] <= p <= x and x - around[left][0] < span:
                kept.append(p)
                break
    return np.array(kept, np.int64)


MATCHES = "segment bigint, row int, doc_id bigint, mark bigint, n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>, near_items array<string>"


def _searcher(block, slop: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = SimpleNamespace(**block.value)
        vocabulary = pa.array(windows.vocabulary, pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                yield _search(batch.slice(k, 1), windows, vocabulary, slop)

    return run


def _flat(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))[0].values


def _search(batch: pa.RecordBatch, windows: SimpleNamespace, vocabulary: pa.Array, slop: int | None) -> pa.RecordBatch:
    doc_ids, sizes = _flat(batch, "doc_ids"), _flat(batch, "n_words").to_numpy()
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    postings = Postings(_flat(batch, "terms"), _flat(batch, "ends").to_numpy(), _flat(batch, "gaps").to_numpy(), vocabulary)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    near: dict[int, set[str]] = defaultdict(set)
    present = np.append(postings.row >= 0, True)  # at -1, beyond a short window's end, too
    for w in np.flatnonzero(present[windows.terms].all(axis=1)):
        window = windows.terms[w, : windows.lengths[w]]
        starts = phrase_starts(postings, window)
        if len(starts):
            rows = np.searchsorted(first, starts, side="right") - 1
            for row in np.unique(rows).tolist():
                items[row].update(items_of(windows, w))
            for row, start in zip(rows.tolist(), (starts - first[rows]).tolist(), strict=True):
                spans[row].append((start, start + len(window)))
        if slop is not None:
            for p in near_anchors(postings, window, len(window) + slop, first).tolist():
                near[int(np.searchsorted(first, p, side="right")) - 1].update(items_of(windows, w))
    n = len(sizes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([batch.column(0)[0].as_py()] * n, pa.int64()),
            pa.array(np.arange(n, dtype=np.int32)),
            doc_ids,
            _flat(batch, "marks"),
            pa.array(sizes.astype(np.int64)),
            pa.array([[{"start": a, "stop": b} for a, b in merged(spans[r])] if r in spans else [] for r in range(n)], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            pa.array([sorted(items[r]) if r in items else [] for r in range(n)], pa.list_(pa.string())),
            pa.array([sorted(near[r]) if r in near else [] for r in range(n)], pa.list_(pa.string())),
        ],
        names=["segment", "row", "doc_id", "mark", "n_words", "spans", "items", "near_items"],
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _merge_blocks(found: DataFrame) -> DataFrame:
    """One row per document from one per document and block."""
    rows = found.groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("mark").alias("mark"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    step = lambda out, s: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["stop"] >= s["start"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(out, F.lit(-1))["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(out, F.array(s)))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    return rows.withColumn("spans", F.aggregate("spans", empty, step))


def _chunks(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, words): the items' words, cut so that each window stands in one chunk."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words.alias("words")).where(F.size("words") > 0).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)), F.lit(CHUNK))
    return rows.select("item", F.explode(F.transform(starts, lambda at: F.slice("words", at, CHUNK + window - 1))).alias("words"))


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document row: doc_id, mark (a hash of the text), n_words, spans of hit words, items that occur and items that occur nearly."""
    spark = index.sparkSession
    chunks = materialise(_chunks(benchmark, window), "chunks")
    n_blocks = int((chunks.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words) + 1
    parts = []
    for k in range(n_blocks):
        rows = chunks.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == k).collect()
        block = spark.sparkContext.broadcast(vars(Windows([(r["item"], r["words"]) for r in rows], window)))
        found = index.mapInArrow(trimmed(_searcher(block, slop)), MATCHES)
        if n_blocks == 1:
            return found
        parts.append(save(found, "found")[0])
        block.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _merge_blocks(found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``search`` over an index of ``docs``, with counts, a digest of the items and the decision."""
    found = search(build_index(docs), benchmark, window, slop, block_words)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "items",
        "near_items",
        "spans",
        "mark",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a window occurs: a row is known by its doc_id and a hash of its text.

    Null and empty texts stay; repeated rows share their fate; extra columns pass through, whatever their names."""
    safe, restore = packed(docs, "doc_id", "text")
    bad = contamination(docs.select("doc_id", "text"), benchmark, window).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct()
    return restore(safe.join(bad, safe["doc_id"].cast("bigint").eqNullSafe(bad["bad_id"]) & (F.xxhash64(safe["text"].cast("string")) == bad["bad_mark"]), "left_anti"))
