"""Audits of raw text: comments, telltale patterns, identifiers and references; counts of boolean searches; classes by rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from re import _constants as rx
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordtide.functions import lexicons, stats
from wordtide.sources.shared import materialise, trimmed

# Texts


def comments(text: Column) -> Column:
    """What follows the first unescaped percent sign of each line, joined by newlines."""
    return F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)(?<!\\)%(.*)$"), F.lit(1)), "\n")


LEAKS = tuple((1, p) for p in lexicons.LEAKS)
MENTIONS = tuple((2, p) for p in lexicons.MENTIONS)


def _hits(text: Column, patterns: Sequence[tuple[int, str]], where: str, around: int, may: Column | None = None) -> Column:
    """An array of tier, pattern, where and a snippet around the first match (case-insensitive) of each pattern that matches; ``may`` has a flag for each
    pattern: where it is not set, the pattern is not tried."""

    def hit(k: int, tier: int, p: str) -> Column:
        rx = F.lit(f"(?i){p}")
        at, length = F.regexp_instr(text, rx), F.length(F.regexp_substr(text, rx))
        start = F.greatest(at - around, F.lit(1))
        snippet = F.translate(F.substring(text, start, at + length + around - start), "\n", " ")
        matches = text.rlike(f"(?i){p}") if may is None else F.when(F.get(may, F.lit(k)), text.rlike(f"(?i){p}"))
        return F.when(matches, F.struct(F.lit(tier).alias("tier"), F.lit(p).alias("pattern"), F.lit(where).alias("where"), snippet.alias("snippet")))

    return F.filter(F.array(*[hit(k, t, p) for k, (t, p) in enumerate(patterns)]), lambda x: x.isNotNull())


# Many patterns in one pass: an automaton of required literals names those worth trying


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match of the pattern holds one; None if that cannot be told."""

    def literal(c: int) -> str:
        return chr(c).lower()

    def best(parts) -> list[str] | None:
        """Of the things that must all stand there, the one whose shortest literal is longest."""
        options, run = [], ""
        for op, of in [*parts, (None, None)]:
            if op is rx.LITERAL:
                run += literal(of)
                continue
            if run:
                options.append([run])
            run = ""
            if op is rx.SUBPATTERN:
                options.append(best(of[-1]))
            elif op is rx.BRANCH:
                ways = [best(way) for way in of[1]]
                options.append(None if None in ways else [x for way in ways for x in way])
            elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT) and of[0] > 0:
                options.append(best(of[2]))
            elif op is rx.IN and all(o is rx.LITERAL for o, _ in of):
                options.append([literal(v) for _, v in of])
        return max((o for o in options if o), key=lambda o: min(map(len, o)), default=None)

    return best(_parser.parse(pattern))


def flagged(patterns: Sequence[str]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """From batches of texts to the flags of ``candidates``. One text at a time becomes a string, so a worker holds Spark's batch and little else."""
    needed = [required_literals(p) for p in patterns]
    always = [not n for n in needed]
    of: dict[str, list[int]] = {}
    for k, literals in enumerate(needed):
        for x in literals or ():
            of.setdefault(x, []).append(k)

    def flags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for x, ks in of.items():
            automaton.add_word(x, ks)
        automaton.make_automaton()
        for batch in batches:
            out = np.empty((len(batch), len(always)), bool)
            for row, text in enumerate(batch):
                t = text.as_py()
                found, left = list(always), len(always) - sum(always)
                for _, ks in automaton.iter(t.lower()) if t and of else ():
                    for k in ks:
                        left -= not found[k]
                        found[k] = True
                    if not left:
                        break
                out[row] = found
            ends = np.arange(len(batch) + 1, dtype=np.int32) * np.int32(len(always))
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return flags


def candidates(text: Column, patterns: Sequence[str]) -> Column:
    """An array of flags: which patterns have a required literal in the text (all flags of patterns without one are set). An Aho-Corasick automaton reads
    each text once, whatever the number of patterns; it ignores case more widely than the patterns do, so it names too many, never too few."""
    run = flagged(patterns)

    def flags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(run)(batches)

    return F.arrow_udf(flags, "array<boolean>")(text)


def gated_hits(texts: DataFrame, key: str, text: str, patterns: Sequence[tuple[int, str]], around: int = 40) -> DataFrame:
    """``pattern_hits``, with each pattern tried only on texts in which one of its required literals stands."""
    named = texts.select(key, text, candidates(F.col(text), [p for _, p in patterns]).alias("__may"))
    found = named.select(key, F.explode(_hits(F.col(text), patterns, "", around, F.col("__may"))).alias("h"))
    return found.select(key, "h.tier", "h.pattern", "h.snippet")


def hits(text: Column, leaks: Sequence[tuple[int, str]] = LEAKS, mentions: Sequence[tuple[int, str]] = MENTIONS, around: int = 40, may: Column | None = None) -> Column:
    """The leaks anywhere in the text, then the mentions in its comments. ``may``: ``candidates`` of the text for leaks and mentions together (what
    stands in a comment stands in the text)."""
    of = (None, None) if may is None else (F.slice(may, 1, len(leaks)), F.slice(may, len(leaks) + 1, len(mentions)))
    return F.concat(_hits(text, leaks, "body_or_comment", around, of[0]), _hits(comments(text), mentions, "comment", around, of[1]))


def pattern_hits(texts: DataFrame, key: str, text: str, patterns: Sequence[tuple[int, str]], around: int = 40) -> DataFrame:
    """A row per text and matching pattern: tier, pattern and a snippet around the first match (case-insensitive)."""
    found = texts.select(key, F.explode(_hits(F.col(text), patterns, "", around)).alias("h"))
    return found.select(key, "h.tier", "h.pattern", "h.snippet")


def is_garbage(text: Column, share: float = 0.02, head: int = 4000) -> Column:
    """Whether the head of a text holds more control characters than ``share``."""
    start = F.substring(text, 1, head)
    return F.length(F.regexp_replace(start, r"[^\x00-\x08\x0E-\x1F]", "")) > share * F.length(start)


def markdown_inline(text: Column) -> Column:
    """Escaped HTML with links, bold and emphasis."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    for p, r in ((r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"\*([^*]+)\*", "<em>$1</em>")):
        text = F.regexp_replace(text, p, r)
    return text


# Scans


def has_tier(found: Column, tier: int) -> Column:
    return F.exists(found, lambda h: h["tier"] == tier)


def scan_by_year(scans: DataFrame) -> DataFrame:
    """Per year of scans (year, ok, has_source, hits): scanned, with source and with a hit of each tier, with percentages."""
    n = lambda c: F.count(F.when(c, 1))
    out = scans.where("ok").groupBy("year").agg(F.count("*").alias("scanned"), n(F.col("has_source")).alias("with_source"), n(has_tier(F.col("hits"), 1)).alias("tier1"), n(has_tier(F.col("hits"), 2)).alias("tier2"))
    return out.withColumns({name: 100.0 * F.col(c) / F.col("scanned") for c, name in (("with_source", "src_pct"), ("tier1", "tier1_pct"), ("tier2", "tier2_pct"))})


def hit_detail(scans: DataFrame, key: str = "id") -> DataFrame:
    return scans.where("ok").select(key, "year", F.explode("hits").alias("h")).select(key, "year", "h.*")


def pooled_rates(yearly: DataFrame, windows: Mapping[str, Sequence[int]]) -> DataFrame:
    """Per window of years and tier of ``scan_by_year``: scans, hits, rate with its Wilson bounds and, where nothing was found, the upper limit."""
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("tier"), F.col(f"tier{t}").alias("k")) for w, (a, b) in windows.items() for t in (1, 2)])).alias("x")
    pooled = yearly.select("year", "scanned", rows).select("year", "scanned", "x.*").where("year BETWEEN a AND b").groupBy("window", "tier").agg(F.sum("k").alias("hits"), F.sum("scanned").alias("scanned"))
    low, high = stats.wilson(F.col("hits"), F.col("scanned"))
    return pooled.select("window", "tier", "hits", "scanned", F.try_divide("hits", "scanned").alias("rate"), low.alias("low"), high.alias("high"), stats.upper_limit(F.col("hits"), F.col("scanned")).alias("upper_limit"))


# Identifiers and references


def clean_doi(doi: Column) -> Column:
    """Closing punctuation goes, then all from a backslash, brace or percent sign on."""
    return F.regexp_replace(F.rtrim(F.lower(doi), F.lit(".,;)}]")), r"[\\{}%].*$", "")


def _all_dois(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: F.lower(F.rtrim(d, F.lit('.,;)}"'))))))


def dois(text: Column, most: int = 200) -> Column:
    """Distinct DOIs in order, at most ``most``."""
    return F.slice(_all_dois(text), 1, most)


def n_dois(text: Column) -> Column:
    """How many distinct DOIs there are, those beyond the first 200 included."""
    return F.size(_all_dois(text))


def is_doi(doi: Column) -> Column:
    """Whether a cleaned DOI begins like one that can be looked up."""
    return doi.rlike(r"^10\.\d{4,9}/\S{3,}")


ARCHIVES = "astro-ph|gr-qc|hep-ph|hep-th|math|cond-mat|physics"


def preprint_ids(text: Column) -> Column:
    """Distinct identifiers of both styles, in order."""
    text = F.lower(F.coalesce(text, F.lit("")))
    new = F.regexp_extract_all(text, F.lit(r"arxiv[:\s]*?(\d{4}\.\d{4,5})"), F.lit(1))
    old = F.regexp_extract_all(text, F.lit(rf"(?:{ARCHIVES})/\d{{7}}"), F.lit(0))
    return F.array_sort(F.array_union(new, old))


def is_new_id(identifier: Column) -> Column:
    return identifier.rlike(r"^\d{4}\.\d{4,5}$")


def classify(value: Column, rules: Sequence[tuple[str, str, str]], rest: str | None = None) -> Column:
    """The class of the first rule (test, value, class) that holds, else ``rest``."""
    tests = {"contains": lambda c, v: c.contains(v), "starts": lambda c, v: c.startswith(v), "contains after 8": lambda c, v: F.substring(c, 9, 1 << 30).contains(v), "is": lambda c, v: c == v}
    out = F
    for test, v, name in rules:
        out = out.when(tests[test](value, v), name)
    return out.otherwise(rest)


def identifier_class(doi: Column) -> Column:
    return classify(doi, lexicons.IDENTIFIER_CLASSES, lexicons.IDENTIFIER_REST)


def listed(value: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """The name of the first list that holds the value; null if none does."""
    out = F
    for name, words in lists.items():
        out = out.when(value.isin(*words), name)
    return out.otherwise(F.lit(None).cast("string"))


def word_group(word: Column) -> Column:
    return listed(word, {"strong": lexicons.MARKERS_STRONG, "soft": lexicons.MARKERS_SOFT, "control": lexicons.CONTROL})


def word_class(word: Column, lists: Mapping[str, Sequence[str]] | None = None) -> Column:
    return listed(word, lists or {"inst": lexicons.CLASS_INSTRUMENT, "ml": lexicons.CLASS_METHOD, "sty": lexicons.CLASS_STYLE})


def phrase_class(phrase: Column, topic: Sequence[str] = tuple(lexicons.TOPIC)) -> Column:
    """A phrase is of the topic if any of its words is."""
    return F.when(F.arrays_overlap(F.split(phrase, " "), F.array(*map(F.lit, topic))), "inst").otherwise("sty")


def missing(cited: DataFrame, authority: DataFrame, key: str) -> DataFrame:
    """The distinct keys that the authority lacks. Keys may be whole texts, so both sides are matched by 128 bits of their digests, and the
    authority is cut to the digests that are cited before it is shuffled any further."""
    digest = lambda df: df.select(key, F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))
    wanted = digest(cited.select(key).distinct().where(F.col(key).isNotNull()))
    there = digest(authority.select(key)).select("h1", "h2", F.sha2(F.col(key).cast("binary"), 256).alias("d"))
    found = there.join(wanted.select("h1", "h2"), ["h1", "h2"], "left_semi").select("d").distinct()
    return wanted.withColumn("d", F.sha2(F.col(key).cast("binary"), 256)).join(found, "d", "left_anti").select(key)


def existence(cited: DataFrame, answers: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Whether each cited key exists by an authority's answer: true for 200, false for 404, null for any other or none."""
    answer = answers.groupBy(F.col(key)).agg(F.min(status).alias("__status"))
    known = F.when(F.col("__status") == 200, F.lit(True)).when(F.col("__status") == 404, F.lit(False))
    return cited.select(key).distinct().join(answer, key, "left").select(key, known.alias("exists"))


#: Ids of more than this part of all citations, of which there are fewer than this number, are looked up by broadcast.
HOT_IDS = 10_000


def citations_by_year(records: DataFrame, authority: DataFrame, key: str = "id", cited: str = "cited") -> DataFrame:
    """Per year of records (key, year, cited: distinct ids): papers, cited ids, those the authority (``cited``) lacks, papers with such an id."""
    pairs = records.select(key, "year", F.explode(cited).alias("__c"))
    counts = pairs.groupBy("__c").agg(F.count("*").alias("__n"))  # map-side first, so that an id that all cite does no harm
    there = authority.select(F.col(cited).cast("string").alias("__c")).distinct().withColumn("__there", F.lit(1))
    known = materialise(counts.join(there, "__c", "left").select("__c", "__n", F.when(F.col("__there").isNull(), 1).alias("__gone")), "cited")
    whole = known.agg(F.sum("__n").alias("__all"))
    often = known.crossJoin(F.broadcast(whole)).where(F.col("__n") * HOT_IDS > F.col("__all")).select("__c", "__gone")  # one row; fewer than HOT_IDS
    rare = pairs.join(F.broadcast(often.select("__c")), "__c", "left_anti").join(known.where("__gone = 1").select("__c", "__gone"), "__c", "left")
    flagged = rare.unionByName(pairs.join(F.broadcast(often), "__c"))
    per_paper = flagged.groupBy(key, "year").agg(F.count("*").alias("n"), F.count("__gone").alias("m"))
    of_papers = per_paper.groupBy("year").agg(F.sum("n").alias("cited"), F.sum("m").alias("missing"), F.count(F.when(F.col("m") > 0, 1)).alias("papers_with_missing"))
    out = records.groupBy("year").agg(F.count("*").alias("papers")).join(of_papers, "year", "left").fillna(0)
    return out.withColumn("missing_pct", F.when(F.col("cited") > 0, 100.0 * F.col("missing") / F.col("cited")).otherwise(0.0))


# Boolean full-text search


def has_term(text: Column, term: str) -> Column:
    """Whole words, without regard to case."""
    quoted = "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)
    return F.coalesce(text.rlike(rf"(?i)(?<!\w){quoted}(?!\w)"), F.lit(False))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | has_term(text, t)
    return out


def full_text(text: Column, any_of: Sequence[str], all_of: Sequence[str] = (), none_of: Sequence[str] = ()) -> Column:
    """Whole-word search: one of ``any_of``, each of ``all_of``, none of ``none_of``."""
    out = any_term(text, any_of)
    for w in all_of:
        out = out & has_term(text, w)
    for w in none_of:
        out = out & ~has_term(text, w)
    return out


def counts(texts: DataFrame, searches: Mapping[str, Column], *keys: str) -> DataFrame:
    """How many rows each search finds, per keys: all in one pass, without the rows themselves."""
    return texts.groupBy(*keys).agg(*[F.count(F.when(c, 1)).alias(name) for name, c in searches.items()])


def disclosure(
    texts: DataFrame, ack: str = "ack", full: str = "full", terms: Sequence[str] = lexicons.DISCLOSED, singly: Sequence[str] = lexicons.DISCLOSED_SINGLY, confounded: Sequence[str] = lexicons.CONFOUNDED
) -> DataFrame:
    """Per year: all texts, those that disclose in the acknowledgements and anywhere, and in the acknowledgements by single and by confounded term."""
    a, f = F.col(ack), F.col(full)
    searches = {"total": F.lit(True), "ack": any_term(a, terms), "full": any_term(f, terms)}
    searches |= {f"ack_{t}": has_term(a, t) for t in singly} | {f"confounded_{t}": has_term(a, t) for t in confounded}
    return counts(texts, searches, "year")


def geography(papers: DataFrame, key: str, places: str, marker: str, disclosed: str) -> DataFrame:
    """Per place and year: papers, with a marker, with a disclosure, and percentages. A paper counts once for each of its places."""
    rows = papers.select(key, "year", marker, disclosed, F.explode(F.array_distinct(places)).alias("place"))
    n = lambda c: F.count(F.when(F.col(c), 1))
    out = rows.groupBy("place", "year").agg(F.count("*").alias("total"), n(marker).alias("marker"), n(disclosed).alias("disc"))
    return out.withColumns({f"{c}_pct": F.when(F.col("total") > 0, 100.0 * F.col(c) / F.col("total")).otherwise(0.0) for c in ("marker", "disc")})


def composition(papers: DataFrame, places: str, marker: str, native: Sequence[str] = lexicons.NATIVE, others: Sequence[str] = lexicons.NOT_NATIVE) -> DataFrame:
    """Per year the papers and marked papers of all, of those with a native place, and of those with no listed other place besides."""
    has = lambda ps: F.arrays_overlap(places, F.array(*map(F.lit, ps)))
    groups = {"all": F.lit(True), "native": has(native), "strict": has(native) & ~has(others)}
    return counts(papers, {f"{g}_{n}": c & m for g, c in groups.items() for n, m in (("total", F.lit(True)), ("marker", F.col(marker)))}, "year")


def smear(sample: DataFrame, versions: DataFrame, key: str, hit: str, since: int = 2023) -> DataFrame:
    """Of sampled records joined to their latest versions (key, updated_year, ``hit``): those revised since a year and the others, with the share
    that hits and the difference in points."""
    rows = versions.join(sample.select(key), key, "left_semi")
    of = lambda revised: (F.col("updated_year") >= since) if revised else (F.col("updated_year") < since)
    n = lambda c: F.count(F.when(c, 1))
    pct = lambda name: F.when(F.col(f"{name}_n") > 0, 100.0 * F.col(f"{name}_hit") / F.col(f"{name}_n")).otherwise(0.0)
    out = rows.agg(*[a for name, r in (("revised", True), ("other", False)) for a in (n(of(r)).alias(f"{name}_n"), n(of(r) & F.col(hit)).alias(f"{name}_hit"))])
    return out.withColumns({"revised_pct": pct("revised"), "other_pct": pct("other")}).withColumn("smear_pp", F.col("revised_pct") - F.col("other_pct"))
