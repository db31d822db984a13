"""Licence scan: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment.

A text becomes its word sequence. Only where one of a rule's keywords is one of the words is the rule's pattern tried. Of
the places found, one that lies within another of at least its priority is suppressed (of equal intervals and
priorities the rule that comes first stays). Base phrases are counted before suppression and their labels stay.

Main path: DataFrame expressions only, one pass, no shuffle: rules are a literal array, and a document's matches stay
in its row. Positions and the sweep over a document's n matches take about n^(4/3) steps.

Defined results: null and empty texts have no words and no labels; a rule counts where its words stand consecutively,
whatever separates them; repeated rows get equal results; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES, Rule

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
PRIORITIES = 5
_SPAN = "struct<start:int,stop:int,priority:int,rule:int,label:string,base:boolean>"


def _literal_rules(rules: Sequence[Rule]) -> Column:
    rows = (f"named_struct('rule', {k}, 'label', '{r.label}', 'priority', {r.priority}, 'keywords', split('{r.keywords}', ' '), 'base', {str(r.base).lower()}, 'pattern', r'(?<= )(?:{r.pattern})(?= )')" for k, r in enumerate(rules))
    return F.expr(f"array({', '.join(rows)})")


def _n_spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(state, item)`` of every item, ``state`` being what ``step`` has made of those before it.

    An array that grows in a fold is copied at each step, so the items are taken in about n^(2/3) blocks of n^(1/3): copies in all n^(4/3)."""
    empty = F.array().cast(f"array<{kind}>")

    def inner(block: Column, state: Column) -> Column:
        both = F.struct(state.alias("state"), empty.alias("out"))
        return F.aggregate(block, both, lambda s, x: F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], F.array(out(s["state"], x))).alias("out")), lambda s: s["out"])

    def cut(xs: Column) -> Column:
        width = F.greatest(F.ceil(F.cbrt(F.size(xs))), F.lit(1)).cast("int")
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), width)
        return _let(width, lambda w: F.transform(starts, lambda at: F.slice(xs, at, w)))

    def run(blocks: Column) -> Column:
        states = F.aggregate(blocks, F.array(start), lambda s, block: F.concat(s, F.array(F.aggregate(block, F.element_at(s, -1), step))))
        return F.flatten(F.zip_with(blocks, F.slice(states, F.lit(1), F.size(blocks)), inner))

    return _let(items, lambda xs: _let(cut(xs), run))


def _places(text: Column, rule: Column) -> Column:
    """The intervals (in words) where the rule's pattern matches: the pieces between matches give their positions."""

    def pairs(found: Column) -> Column:
        pieces = F.slice(F.split(text, rule["pattern"], -1), F.lit(1), F.size(found))
        return F.zip_with(pieces, found, lambda piece, match: F.struct(_n_spaces(piece).alias("before"), _n_spaces(match).alias("within")))

    def span(at: Column, pair: Column) -> Column:
        start = at + pair["before"]
        return F.struct(start.alias("start"), (start + pair["within"] + 1).alias("stop"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["base"].alias("base"))

    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    return _running(_let(found, pairs), F.lit(-1), lambda at, pair: at + pair["before"] + pair["within"], span, _SPAN)


def _unsuppressed(spans: Column) -> Column:
    """Sweeps the spans by start, longest and highest priority first, with the furthest stop so far at each priority or above."""
    order = F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).when(x["stop"] != y["stop"], y["stop"] - x["stop"]).when(x["priority"] != y["priority"], y["priority"] - x["priority"]).otherwise(x["rule"] - y["rule"]))

    def step(reach: Column, span: Column) -> Column:
        return F.array(*[F.when(span["priority"] >= p, F.greatest(reach[p - 1], span["stop"])).otherwise(reach[p - 1]) for p in range(1, PRIORITIES + 1)])

    def left(reach: Column, span: Column) -> Column:
        return F.when(F.element_at(reach, span["priority"]) < span["stop"], span)

    return F.filter(_running(order, F.array(*[F.lit(0)] * PRIORITIES), step, left, _SPAN), lambda s: s.isNotNull())


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, ``found`` (all places, before suppression) and ``kept`` (those left after it) for every row."""
    # Two letters beyond ASCII have lower-case forms within it; they give way to another one, so that only A-Z become a-z.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for letter in "\u0130\u212a":
        text = F.replace(text, F.lit(letter), F.lit("\u00e6"))
    words = docs.select("doc_id", F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("words"))
    keywords = F.expr("array(" + ", ".join(f"'{k}'" for k in sorted({k for r in rules for k in r.keywords.split()})) + ")")
    gated = words.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.when(F.arrays_overlap("words", keywords), F.col("words")).alias("words"))
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    hinted = F.array_intersect("words", keywords)
    gated = gated.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), F.struct(text.alias("text"), hinted.alias("hints"))).alias("gate"))
    tried = F.filter(_literal_rules(rules), lambda r: F.arrays_overlap(F.col("gate.hints"), r["keywords"]) & F.regexp_like(F.col("gate.text"), r["pattern"]))
    found = F.flatten(F.transform(tried, lambda r: _places(F.col("gate.text"), r)))
    empty = F.array().cast(f"array<{_SPAN}>")
    rows = gated.select("doc_id", "n_words", F.when(F.col("gate").isNotNull(), found).otherwise(empty).alias("found"))
    return rows.select("doc_id", "n_words", "found", F.when(F.size("found") > 1, _unsuppressed(F.col("found"))).otherwise(F.col("found")).alias("kept"))


def licenses(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``scan`` with counts, labels and a score: the highest priority kept, as a share of the highest there is."""
    base = F.filter("found", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"].cast("bigint"))
    label = lambda s: s["label"]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scan(docs, rules).select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(base, label)).alias("base_labels"),
        joined(F.concat(F.transform(base, label), F.transform("kept", label))).alias("labels"),
        (F.coalesce(F.array_max(F.transform("kept", lambda s: s["priority"])), F.lit(0)) / F.lit(float(PRIORITIES))).alias("score"),
        "kept",
    )
