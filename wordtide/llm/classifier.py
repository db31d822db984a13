"""Supervised subword embeddings for text classification.

A document's features are its words, their character n-grams and its word pairs, each hashed into one
of ``buckets`` embedding rows. The mean of their embeddings goes through a softmax layer. Embeddings and
layer are trained together by stochastic gradient descent in numpy.

Training runs on the driver over a bounded sample: at most ``max_docs`` labelled documents (the first by a hash of
doc_id), passing over texts above ``max_doc_bytes``. Executors make the features; only these reach the driver, and their memory is
given back when the model is trained. Everything else covers all rows: the trained model is folded
into one score per bucket and class, broadcast (``buckets`` x classes numbers) and applied to whole texts in one pass.

Defined results: null and empty texts have no features and get the score of the layer's bias alone; null labels are
passed over; a doc_id labelled more than once takes its largest label; with no labels every class is equally
likely, with one class that class is certain up to smoothing; repeated rows get equal scores; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Collection, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import give_back, packed, trimmed

BUCKETS = 1 << 18
DIM = 12
MIN_N, MAX_N = 3, 4
MAX_DOCS = 4096
MAX_DOC_BYTES = 128_000
EPOCHS = 3
RATE = 4.0
SEED = 13
_CACHE = 300_000
#: Words that are scored at a time; a longer text is scored by itself.
_RUN_WORDS = 50_000


def _modulo(h: np.ndarray, buckets: int) -> np.ndarray:
    """``h % buckets``, by a mask where that is the same."""
    return (h % np.uint64(buckets) if buckets & (buckets - 1) else h & np.uint64(buckets - 1)).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return _modulo(mixed ^ (mixed >> np.uint64(32)), buckets)


def subwords(words: Collection[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words; then the buckets of the words and of the n-grams of their framed bytes, and which word each is of."""
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    hashes = np.fromiter(map(zlib.crc32, coded), np.uint64, len(coded))
    text = np.frombuffer(b"<" + b"><".join(coded) + b">", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) + 2
    word = np.repeat(np.arange(len(coded)), sizes)
    left = np.cumsum(sizes)[word] - np.arange(len(word))
    ids, of = [_bucket(hashes + np.uint64(1 << 40), buckets)], [np.arange(len(coded))]
    for n in range(MIN_N, MAX_N + 1):
        h = np.full(max(0, len(text) - n + 1), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + text[k : k + len(h)]
        whole = left[: len(h)] >= n
        ids.append(_bucket(h[whole], buckets))
        of.append(word[: len(h)][whole])
    return hashes, np.concatenate(ids), np.concatenate(of)


def pair_buckets(word_hash: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of neighbouring words; a word that is repeated at once is the same feature whatever the word."""
    mixed = word_hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + word_hash[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed[word_hash[:-1] == word_hash[1:]] = 0
    return _modulo(mixed ^ (mixed >> np.uint64(33)), buckets)


def features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features and the share of each."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    hashes, ids, of = subwords(number, buckets)
    pairs = pair_buckets(hashes[at], buckets)
    found, place = np.unique(np.concatenate([ids, pairs]), return_inverse=True)
    n = np.bincount(place, np.concatenate([np.bincount(at)[of], np.ones(len(pairs))]))
    return found.astype(np.int32), (n / n.sum()).astype(np.float32)


def _featurise(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(text.as_py(), buckets) for text in batch.column(2)]
            columns = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "label", "ids", "shares"])

    return run


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_classes: int, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED, min_steps: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Scores per bucket (buckets, n_classes) and the bias, both already multiplied by the output layer. ``docs``: ``features`` of each."""
    counts = np.bincount(labels, minlength=n_classes) if labels else np.zeros(n_classes)
    prior = (counts + 0.5) / (counts.sum() + 0.5 * n_classes)
    bias = np.log(prior)
    if (counts > 0).sum() < 2:
        return np.zeros((buckets, n_classes), np.float32), bias.astype(np.float32)
    rng = np.random.default_rng(seed)
    target = np.eye(n_classes, dtype=np.float32)[labels]
    embedding = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer = rng.uniform(-1, 1, (dim, n_classes)).astype(np.float32)
    bias = bias.astype(np.float32)
    epochs = max(epochs, -(-min_steps // len(docs)))
    total, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share = docs[k]
            step = rate * (1 - done / total)
            done += 1
            if not len(ids):
                continue
            hidden = share @ embedding[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            grad = p / p.sum() - target[k]
            back = layer @ grad
            layer -= step * np.outer(hidden, grad)
            bias -= 0.1 * step * grad
            # The step for an embedding row is scaled by the inverse norm of the shares, so long texts do not learn slower.
            embedding[ids] -= (step / float(np.sqrt(share @ share))) * np.outer(share, back)
    return (embedding @ layer).astype(np.float32), bias


SCORED = "struct<probabilities:array<double>,n_words:bigint>"


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _runs(texts: pa.Array) -> Iterator[list[list[str]]]:
    """The words of each text, in runs of texts of about ``_RUN_WORDS`` words."""
    run: list[list[str]] = []
    n = 0
    for text in texts:
        run.append((text.as_py() or "").split())
        n += len(run[-1])
        if n >= _RUN_WORDS:
            yield run
            run, n = [], 0
    if run:
        yield run


def _scorer(model) -> Column:
    """A UDF from texts to class probabilities and word counts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        per_bucket, bias = model.value
        buckets, n_classes = per_bucket.shape
        of_class = np.ascontiguousarray(per_bucket.T)
        number = _Numbers()
        # Per known word: its hash, how many features it has, and their summed scores by class.
        size, hashes = 1024, np.zeros(1024, np.uint64)
        counts, sums = np.zeros(1024), [np.zeros(1024) for _ in range(n_classes)]
        for batch in batches:
            out, n_words = [np.empty((0, n_classes))], [np.empty(0, np.int64)]
            for words in _runs(batch):
                if len(number) > _CACHE:
                    number.clear()
                first = len(number)
                n = np.fromiter(map(len, words), np.int64, len(words))
                known = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, n.sum())
                if len(number) > first:
                    new = list(islice(reversed(number), len(number) - first))[::-1]
                    while len(number) > size:
                        size *= 2
                        hashes, counts, sums = np.resize(hashes, size), np.resize(counts, size), [np.resize(x, size) for x in sums]
                    at = slice(first, len(number))
                    hashes[at], ids, of = subwords(new, buckets)
                    counts[at] = np.bincount(of, minlength=len(new))
                    for k in range(n_classes):
                        sums[k][at] = np.bincount(of, of_class[k][ids], len(new))
                z = np.tile(bias.astype(np.float64), (len(words), 1))
                full = np.flatnonzero(n)
                stops = np.cumsum(n)[full]
                starts = stops - n[full]
                pairs = pair_buckets(hashes[known], buckets)
                if len(full):
                    features_of = np.add.reduceat(counts[known], starts) + n[full] - 1
                    for k in range(n_classes):
                        scores = sums[k][known]
                        of_pairs = of_class[k][pairs]
                        of_pairs[stops[:-1] - 1] = 0  # the last word of a text and the first of the next are no pair
                        scores[:-1] += of_pairs
                        z[full, k] += np.add.reduceat(scores, starts) / features_of
                p = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(p / p.sum(axis=1, keepdims=True))
                n_words.append(n)
            flat = np.concatenate(out).ravel()
            probabilities = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, n_classes, dtype=np.int32)), pa.array(flat))
            yield pa.StructArray.from_arrays([probabilities, pa.array(np.concatenate(n_words))], names=["probabilities", "n_words"])

    # Not deterministic for the planner only: a filter on the score must not evaluate it twice.
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(run)(batches)

    return F.arrow_udf(scored, SCORED).asNondeterministic()


class Classifier:
    """A trained model; ``score`` adds class probabilities to documents."""

    def __init__(self, per_bucket: np.ndarray, bias: np.ndarray, seen: np.ndarray):
        """``seen``: which classes the sample had an example of."""
        self.per_bucket, self.bias, self.seen = per_bucket, bias, seen

    @classmethod
    def fit(cls, docs: DataFrame, labelled: DataFrame, n_classes: int, max_docs: int = MAX_DOCS, max_doc_bytes: int = MAX_DOC_BYTES, buckets: int = BUCKETS, **options) -> Classifier:
        """``labelled``: doc_id and label (0 to n_classes - 1)."""
        sample = labelled.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
        # Labels of documents that are not there take no place of the sample.
        sample = sample.join(docs.select("doc_id").where("doc_id IS NOT NULL"), "doc_id", "left_semi")
        sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("text"))
        # At most max_docs rows of two numbers are broadcast.
        rows = texts.join(F.broadcast(sample), texts["__id"] == sample["doc_id"]).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_doc_bytes)
        rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", "text").mapInArrow(trimmed(_featurise(buckets)), "doc_id bigint, label int, ids binary, shares binary")
        # The driver gets features, not texts.
        found = sorted({(r[0], r[1], bytes(r[2]), bytes(r[3])) for r in rows.toLocalIterator()})
        labels = [x[1] for x in found]
        model = train([(np.frombuffer(x[2], np.int32), np.frombuffer(x[3], np.float32)) for x in found], labels, n_classes, buckets=buckets, **options)
        del found
        give_back()
        return cls(*model, np.bincount(np.array(labels, np.int64), minlength=n_classes) > 0)

    def without_unseen(self) -> Classifier:
        """The model in which classes of no example have the probability 0; as it is where there is no example at all."""
        if not self.seen.any():
            return self
        return Classifier(np.where(self.seen, self.per_bucket, 0).astype(np.float32), np.where(self.seen, self.bias, -np.inf).astype(np.float32), self.seen)

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the columns __probabilities and __n_words (words split at white space)."""
        model = docs.sparkSession.sparkContext.broadcast((self.per_bucket, self.bias))
        scored = docs.withColumn("__scored", _scorer(model)(F.col("text").cast("string")))
        return scored.select("*", F.col("__scored.probabilities").alias("__probabilities"), F.col("__scored.n_words").alias("__n_words")).drop("__scored")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def quality_model(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learns ``labels.quality`` from the rows outside fold 0."""
    return Classifier.fit(docs, labels.where(fold_of(F.col("doc_id")) != 0).select("doc_id", F.col("quality").alias("label")).where("label IN (0, 1)"), 2)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (probability of quality 1) and predicted for every document row."""
    scored = quality_model(docs, labels).score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    score = F.col("__probabilities")[1]
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns.

    Null and empty texts have the score of the bias and go or stay by it; repeated rows share their fate; without labels all
    scores are 0.5; extra columns pass through, whatever their names."""
    safe, restore = packed(docs, "doc_id", "text")
    return restore(quality_model(safe, labels).score(safe).where(F.col("__probabilities")[1] >= threshold))
