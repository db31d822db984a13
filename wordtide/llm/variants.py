"""Spelling variants: near words by forward and backward minimal acyclic automata with perfect-hash word numbers.

Words that differ by one insertion, deletion or replacement agree on the first half of the one, or else on its last half. So each
word is looked up twice: forward, its first half is matched exactly and the rest with one error; backward, words are reversed and
the same is done with the longer half. A pair that both find is kept once: backward takes only pairs whose first halves differ.

The automata hold the words of a block as arrays: states by height, equal right languages merged, edges sorted by
(state, letter), and with each edge how many words sort before those behind it, so that a path adds up to the word's number
in the block, which is the place of its count. They are built and searched in numpy, all of a block's words together.

Counting is done in DataFrame functions. Words are dealt into blocks by direction and half, small groups of a half several to a
block. Groups above ``BLOCK`` words are cut into pieces, and each piece of words to look up meets each piece of words to find, so
that a task holds a bounded number of words whatever the group.

Defined results: null texts have no words; the text of a null doc_id is ``null``; repeated rows count as often as they occur;
ties of count go to the smallest word by code points; words without a near one, or without one of twice the count, have no form; an empty
table gives no rows; extra columns are ignored. Very long runs of letters are words like others; the automata take time and memory in
proportion to a block's letters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import give_back, materialise

LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words that one automaton holds, and words looked up in it at a time.
BLOCK = 20_000
LONG = 64
SPOILT = 97


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the runs of letters, some spoilt by a hash of document and run, that are long and frequent enough."""
    run = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("id", run.alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    spoilt = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % SPOILT == 0, spoilt).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """A minimal acyclic automaton of sorted, distinct words, given as rows of code points (0 after a word's end)."""

    def __init__(self, letters: np.ndarray):
        n, width = letters.shape
        lengths = (letters > 0).sum(1)
        # The trie: a node is the first word with its prefix, and the prefix's length.
        fresh = np.ones((n, width), bool)
        if n > 1:
            fresh[1:] = np.cumsum(letters[1:] != letters[:-1], 1) > 0
        fresh &= letters > 0
        number = np.zeros((n, width + 1), np.int64)
        number[:, 1:] = np.where(fresh, np.cumsum(fresh).reshape(n, width), 0)
        rows = np.arange(n)
        for k in range(1, width + 1):  # nodes that a word shares with the one before it
            first = np.maximum.accumulate(np.where(fresh[:, k - 1], rows, 0))
            number[:, k] = np.where(letters[:, k - 1] > 0, number[first, k], 0)
        row, depth = np.nonzero(fresh)
        parent, child, letter = number[row, depth], number[row, depth + 1], letters[row, depth]
        nodes = int(number.max()) + 1
        final = np.zeros(nodes, bool)
        final[number[rows, lengths]] = True
        height = np.zeros(nodes, np.int64)
        for k in range(width, 0, -1):
            at = depth == k - 1
            np.maximum.at(height, parent[at], height[child[at]] + 1)
        # States: nodes of equal right language, found from the leaves up; a node's edges are folded in one by one, each step
        # renaming (what was folded so far, letter, state behind), so that equal names mean equal edges.
        state = np.full(nodes, -1, np.int64)
        order = np.lexsort((letter, parent))
        parent, child, letter = parent[order], child[order], letter[order]
        start = np.searchsorted(parent, np.arange(nodes + 1))
        symbol = np.unique(letter, return_inverse=True)[1]
        found, levels, chosen = 0, [0], []
        for level in range(int(height.max()) + 1):
            at = np.nonzero(height == level)[0]
            name, degree = final[at].astype(np.int64), start[at + 1] - start[at]
            for k in range(int(degree.max(initial=0))):
                has = np.nonzero(degree > k)[0]
                e = start[at[has]] + k
                keys = (name[has] * (symbol.max() + 1) + symbol[e]) * (found + 1) + state[child[e]]
                name[has] = np.unique(keys, return_inverse=True)[1] + 2 + (k + 1) * (len(at) + 2)
            _, one, name = np.unique(name, return_index=True, return_inverse=True)
            state[at] = found + name
            found += len(one)
            levels.append(found)
            chosen.append(at[one])
        node = np.concatenate(chosen)  # one for each state
        self.root, self.final = int(state[0]), final[node]
        degree = start[node + 1] - start[node]
        self.first = np.concatenate([[0], np.cumsum(degree)])
        source = np.repeat(np.arange(found), degree)
        edge = np.repeat(start[node] - self.first[:-1], degree) + np.arange(len(source))
        self.letter, self.target = letter[edge], state[child[edge]]
        self.key = source * 0x110000 + self.letter  # sorted: states come in order, letters within them too
        # Words behind each state, and before each edge: the states of a level lead to lower ones only.
        words, self.before = np.zeros(found, np.int64), np.zeros(len(edge), np.int64)
        for low, high in zip(levels, levels[1:], strict=False):
            first = self.first[low : high + 1]
            total = np.concatenate([[0], np.cumsum(words[self.target[first[0] : first[-1]]])])
            at = first - first[0]
            words[low:high] = self.final[low:high] + total[at[1:]] - total[at[:-1]]
            self.before[first[0] : first[-1]] = total[:-1] - np.repeat(total[at[:-1]] - self.final[low:high], np.diff(first))

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge that each state has by a letter, and whether it has one."""
        key = state * 0x110000 + letter
        e = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return e, self.key[e] == key

    def near(self, letters: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word number) of the words that agree with a row up to ``half`` and then differ by one insertion, deletion or replacement."""
        lengths = (letters > 0).sum(1)
        padded = np.concatenate([letters, np.zeros((len(letters), 1), letters.dtype)], 1)
        q = np.arange(len(letters))
        state, number = np.full(len(q), self.root), np.zeros(len(q), np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[tuple[np.ndarray, ...]] = []  # (row, state, number) after the error, to go on at a place

        def go_on(at: int) -> None:
            """Exact steps of what has had its error, from place ``at``."""
            nonlocal waiting
            row, s, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
            ended = lengths[row] == at
            done = ended & self.final[s]
            out.append((row[done], n[done]))
            row, s, n = row[~ended], s[~ended], n[~ended]
            e, there = self.step(s, padded[row, at])
            e = e[there]
            waiting = [(row[there], self.target[e], n[there] + self.before[e])]

        for at in range(letters.shape[1] + 1):
            # Errors at this place, of rows whose exact half has passed. Inserted and replaced letters are those of the edges.
            may = half[q] <= at
            row, s, n = q[may], state[may], number[may]
            more: list[tuple[np.ndarray, ...]] = []
            if len(row):
                left = lengths[row] > at
                more.append((row[left], s[left], n[left]))  # the row's letter is left out: go on at the next place
                k = self.first[s + 1] - self.first[s]
                edge = np.repeat(self.first[s] - np.cumsum(k) + k, k) + np.arange(k.sum())
                row, n = np.repeat(row, k), np.repeat(n, k) + self.before[edge]
                waiting.append((row, self.target[edge], n))  # a letter of the word more: go on at this place
                other = (lengths[row] > at) & (self.letter[edge] != padded[row, at])
                more.append((row[other], self.target[edge][other], n[other]))
            if waiting:
                go_on(at)
            waiting += more
            on = lengths[q] > at
            q, state, number = q[on], state[on], number[on]
            e, there = self.step(state, padded[q, at])
            q, e = q[there], e[there]
            state, number = self.target[e], number[there] + self.before[e]
            if not len(q) and not any(len(w[0]) for w in waiting):
                break
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)], 1), axis=0)  # a letter of a run may be any of it
        return pairs[:, 0], pairs[:, 1]


def _letters(words: list[str]) -> np.ndarray:
    width = max(map(len, words))
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64)


def _reverse(letters: np.ndarray) -> np.ndarray:
    n, width = letters.shape
    back = (letters > 0).sum(1)[:, None] - 1 - np.arange(width)
    return np.where(back >= 0, np.take_along_axis(letters, np.maximum(back, 0), 1), 0)


def _half_differs(a: np.ndarray, b: np.ndarray, half: np.ndarray) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])
    places = np.arange(width)[None, :] < half[:, None]
    return ((a[:, :width] != b[:, :width]) & places).any(1)


def _near(back: bool, words: list[str], counts: np.ndarray, asked: list[str]) -> pd.DataFrame:
    letters, queries = _letters(words), _letters(asked)
    lengths = (queries > 0).sum(1)
    half = lengths // 2
    turned = _reverse(letters) if back else letters
    order = np.lexsort(turned.T[::-1])
    automaton = Automaton(turned[order])
    r, number = automaton.near(_reverse(queries), lengths - half) if back else automaton.near(queries, half)
    at = order[number]
    if back:
        differ = _half_differs(queries[r], letters[at], half[r])
        r, at = r[differ], at[differ]
    pairs = pd.DataFrame({"word": [asked[x] for x in r], "best_n": counts[at], "best": [words[x] for x in at]}).sort_values(["word", "best_n", "best"], ascending=[True, False, True])
    return pairs.groupby("word", sort=False).agg(n_near=("best", "size"), best_n=("best_n", "first"), best=("best", "first")).reset_index()


def near_in_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each word looked up: how many near words the block has, and the most frequent of them (the smallest, if several are).

    Words above ``LONG`` letters have automata by length, so that a block's arrays stay in proportion to its letters."""
    size, held = rows["word"].str.len(), rows["held"]
    classes = [(~held & (size <= LONG), held & (size <= LONG + 1))]
    classes += [(~held & (size == n), held & size.between(n - 1, n + 1)) for n in sorted(set(size[~held & (size > LONG)]))]
    found = [_near(bool(key[0]), rows.loc[h, "word"].tolist(), rows.loc[h, "n"].to_numpy(), rows.loc[a, "word"].tolist()) for a, h in classes if a.any() and h.any()]
    give_back()
    return pd.concat(found, ignore_index=True).astype({"word": object, "best": object}) if found else pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("word", str), ("n_near", "int64"), ("best_n", "int64"), ("best", str))})


def _halves(back: bool) -> tuple[Column, Column]:
    """The half of a word that is matched exactly, if it is looked up; and those by which words of its length and one more or less find it."""
    size = F.length("word")

    def half(length: Column) -> Column:
        kept = F.floor(length / 2).cast("int")
        return F.right(F.col("word"), length - kept) if back else F.substring(F.col("word"), F.lit(1), kept)

    return half(size), F.array_distinct(F.array(*[half(size + k) for k in (-1, 0, 1)]))


def dealt(words: DataFrame, block: int) -> DataFrame:
    """A row for each block that a word stands in (``held``) or is looked up in. A word and one that it is near to meet in one block."""

    def place(back: bool, half: Column, held: bool) -> Column:
        return F.struct(F.lit(back).alias("back"), half.alias("half"), F.lit(held).alias("held"))

    def ways(back: bool) -> Column:
        asked, held = _halves(back)
        return F.concat(F.array(place(back, asked, False)), F.transform(held, lambda half: place(back, half, True)))

    rows = words.select("word", "n", F.inline(F.concat(ways(False), ways(True))))
    large = rows.where("held").groupBy("back", "half").agg(F.count("*").alias("size")).where(F.col("size") > block)
    rows = rows.join(large, ["back", "half"], "left")
    # A large group is a grid of pieces: each piece of words that stand there meets each piece of words that are looked up.
    pieces = F.ceil(F.col("size") / block).cast("int")
    own, every = F.pmod(F.xxhash64("word"), pieces).cast("int"), F.sequence(F.lit(0), pieces - 1)
    grid = F.transform(every, lambda k: F.struct(F.when(F.col("held"), own).otherwise(k).alias("x"), F.when(F.col("held"), k).otherwise(own).alias("y")))
    n_blocks = max(1, -(-words.count() * 3 // block))
    small = F.array(F.struct(F.pmod(F.xxhash64("half"), F.lit(n_blocks)).cast("int").alias("x"), F.lit(0).alias("y")))
    whole = F.when(F.col("size").isNull(), F.lit("")).otherwise(F.col("half"))
    return rows.select("word", "n", "back", "held", whole.alias("cut"), F.inline(F.when(F.col("size").isNull(), small).otherwise(grid))).distinct()


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word."""
    words = materialise(word_counts(docs, least_length, least_count), "words")
    found = dealt(words, block).groupBy("back", "cut", "x", "y").applyInPandas(near_in_block, "word string, n_near bigint, best_n bigint, best string")
    best = F.max_by(F.struct("best_n", "best"), F.col("best_n"))
    # Of equal counts the smallest word: the greatest count is found first, then the least word that has it.
    tops = found.groupBy("word", "best_n").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    formed = words.join(tops, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("top.best_n") >= 2 * F.col("n"), F.col("top")).alias("top"))
    formed = materialise(formed.select("word", "n", "n_near", F.col("top.best").alias("form"), F.col("top.best_n").alias("form_n")), "forms")
    roots = roots_of(formed)
    return formed.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")


def roots_of(formed: DataFrame) -> DataFrame:
    """word, root: each word's form's form and so on, by doubling; counts double with each form, so few rounds do."""
    roots = materialise(formed.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        of = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = materialise(roots.join(of, "root").select("word", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "roots")
        roots = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return roots
