"""Mixing documents to target token weights by soft domain membership.

A classifier (subword embeddings) learns domains from a labelled table and gives every document a
posterior over them. Document rates r >= 0 are then fitted by projected-gradient least squares, so that the
expected tokens of each domain, the sum of r * tokens * posterior, match the targets.

Rates start at 1 and take projected-gradient steps, accelerated by momentum that is dropped whenever a step would raise the error. Errors of
the totals are weighed by the inverse of the posteriors' token-weighted Gram matrix, in which a step of length one is the best, so that
where no rate is cut at 0 one step reaches the targets. A step moves a rate by the product of its posterior with one vector, so the few
vectors taken so far are all that there is to a fit: each round is one pass over a compact stored table (tokens and posterior),
which replays the steps on its rows and sums the totals map-side. No state per document is kept between rounds, nothing but a few numbers
per round reaches the driver, and a lost executor costs the repetition of its tasks. Rounds go on until rates no longer move; a fit
that does not get there raises an error. Targets out of reach are logged with the totals reached.

Defined results: null and empty texts have no tokens and the posterior of the bias alone; repeated rows and equal
texts get equal rates; without labels all posteriors are equal, the targets are out of reach and the rates
are the least-squares ones; where only some domains have labelled examples, the others have the posterior 0 and their
targets go to the rest in proportion; a domain of no tokens stays empty; an empty table gives no rows; extra columns
pass through.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classifier import Classifier
from .storage import packed, save

#: Bound of the labelled sample that the classifier is fitted on.
MAX_DOCS = 3000
#: Gradient steps of its training at least, so that posteriors are sharp.
STEPS = 20_000
#: Share of all tokens within which a target counts as reached.
TOLERANCE = 1e-3
#: Mean move of a rate (by tokens) in a step at which a fit has converged, and rounds after which that is an error.
CONVERGED = 1e-7
MAX_ROUNDS = 1000
#: Directions of the posteriors below this share of the largest do not count as different.
FLAT = 1e-9

#: The steps of a fit: a vector that posteriors are multiplied with, and the momentum after it.
Steps = list[tuple[np.ndarray, float]]

_log = logging.getLogger(__name__)


def _posterior_matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


def replayed(posterior: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rates after the steps, the point that the next one starts from, and how far the last one has moved from its start."""
    rates = start = np.ones(len(posterior))
    moved = np.zeros(len(posterior))
    for vector, momentum in steps:
        new = np.maximum(start - posterior @ vector, 0)
        moved = np.abs(new - start)
        start, rates = new + momentum * (new - rates), new
    return rates, start, moved


def sums_of(tokens: np.ndarray, posterior: np.ndarray, steps: Steps) -> np.ndarray:
    """Expected tokens per domain at the rates and at the next start, tokens moved, and the posteriors' token-weighted Gram matrix."""
    rates, start, moved = replayed(posterior, steps)
    gram = (posterior * tokens[:, None]).T @ posterior
    return np.concatenate([(tokens * rates) @ posterior, (tokens * start) @ posterior, [tokens @ moved], gram.ravel()])


def _totals(scored: DataFrame, n: int, steps: Steps) -> np.ndarray:
    """``sums_of`` all rows."""
    size = 2 * n + 1 + n * n

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            total += sums_of(tokens, _posterior_matrix(batch.column(1), n), steps)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    rows = scored.select("__n_words", "__probabilities").mapInArrow(sums, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for row in rows:  # size of them
        out[row["k"]] = row["v"]
    return out


def solve(totals: Callable[[Steps], np.ndarray], shares: np.ndarray, max_rounds: int = MAX_ROUNDS) -> tuple[Steps, np.ndarray, np.ndarray, int]:
    """The steps, the totals reached, the targets and the rounds; ``totals`` is ``sums_of`` for all rows."""
    n, steps = len(shares), []
    sums = totals(steps)
    now, ahead, whole = sums[:n], sums[n : 2 * n], sums[:n].sum()
    targets = shares * whole
    if not whole:
        return steps, now, targets, 0
    weight = np.linalg.pinv(sums[2 * n + 1 :].reshape(n, n) / whole, rcond=FLAT, hermitian=True)
    energy = lambda at: float((at / whole - shares) @ weight @ (at / whole - shares))
    pace, least = 1.0, energy(now)
    for done in range(1, max_rounds + 1):
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        steps.append((weight @ (ahead / whole - shares), (pace - 1) / faster))
        sums = totals(steps)
        if len(steps) > 1 and steps[-2][1] and energy(sums[:n]) > least:
            # The momentum has gone too far: back to the rates before this step, from a standstill.
            steps = [*steps[:-2], (steps[-2][0], 0.0)]
            ahead, pace = now, 1.0
            continue
        now, ahead, pace, least = sums[:n], sums[n : 2 * n], faster, energy(sums[:n])
        if sums[2 * n] <= CONVERGED * whole:
            return steps, now, targets, done
    raise RuntimeError(f"mixing rates have not converged in {max_rounds} rounds: totals {now / whole}, targets {shares}, moved {sums[2 * n] / whole}")


def fit_rates(scored: DataFrame, shares: np.ndarray, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> tuple[Steps, np.ndarray, np.ndarray]:
    """The steps that bring the expected domain tokens to ``shares`` of the present total, the totals reached and the targets."""
    steps, now, targets, rounds = solve(lambda at: _totals(scored, len(shares), at), shares, max_rounds)
    whole = max(targets.sum(), 1)
    report = _log.warning if np.abs(now - targets).max() > tolerance * whole else _log.info
    report("mixing: shares %s reached of %s in %d rounds", now / whole, shares, rounds)
    return steps, now, targets


def rate_column(posterior: Column, n: int, steps: Steps) -> Column:
    def rates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(replayed(_posterior_matrix(batch, n), steps)[0])

    return F.arrow_udf(rates, "double").asNondeterministic()(posterior)


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], max_docs: int = MAX_DOCS, rates: str = "rate", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with __n_words, __probabilities (in the order of ``weights``) and the fitted rate.

    ``labelled``: doc_id and label (a name in ``weights``). ``columns``: those of ``docs`` to keep, all if None."""
    names = list(weights)
    index = F.coalesce(*[F.when(F.col("label") == name, F.lit(k)) for k, name in enumerate(names)])
    model = Classifier.fit(docs, labelled.select("doc_id", index.alias("label")), len(names), max_docs=max_docs, min_steps=STEPS)
    scored = model.without_unseen().score(docs).select(*(columns or docs.columns), "__n_words", "__probabilities")
    scored, _ = save(scored, "posteriors")
    shares = np.array(list(weights.values()), float)
    if model.seen.any():
        shares = np.where(model.seen, shares, 0)
        if not shares.sum():
            raise ValueError("no domain of positive weight has a labelled example")
    steps, _, _ = fit_rates(scored, shares / shares.sum())
    return scored.withColumn(rates, rate_column(F.col("__probabilities"), len(names), steps))


def copies(rate: Column, key: Column, seed: int = 17) -> Column:
    """How often a document is taken: its rate, rounded up with the probability of its fraction by a hash of the key."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def resample(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``docs`` with every row taken as often as its rate says, by a hash of its doc_id.

    Null and empty texts have no tokens and the rate of the bias alone; a null doc_id is a key like any other; repeated rows are taken
    equally often; an empty table stays empty; extra columns pass through, whatever their names."""
    safe, restore = packed(docs, "doc_id", "text")
    mixed = mix(safe, labelled, weights, rates="__rate").withColumn("__copies", copies(F.col("__rate"), F.coalesce(F.col("doc_id"), F.lit(-1))))
    taken = mixed.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return restore(taken)


def domain_totals(mixed: DataFrame, weights: Mapping[str, float], rates: str = "rate") -> DataFrame:
    """Per domain of ``mix``: its target, its present share of the expected tokens and that at the fitted rates."""
    names = F.array(*map(F.lit, weights))
    of = mixed.select("__n_words", rates, F.posexplode("__probabilities").alias("k", "p"))
    of = of.groupBy("k").agg(F.sum(F.col("__n_words") * F.col("p")).alias("now"), F.sum(F.col("__n_words") * F.col("p") * F.col(rates)).alias("then"))
    whole = of.agg(F.sum("now").alias("whole"))
    target = F.element_at(F.array(*[F.lit(float(w) / sum(weights.values())) for w in weights.values()]), F.col("k") + 1)
    return of.join(F.broadcast(whole)).select(F.element_at(names, F.col("k") + 1).alias("domain"), target.alias("target"), F.try_divide("now", "whole").alias("share"), F.try_divide("then", "whole").alias("mixed_share"))


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and label from quality and toxic: junk, toxic or clean."""
    label = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", label.alias("label")).where("label IS NOT NULL")
