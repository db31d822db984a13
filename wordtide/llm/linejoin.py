"""Line dedup by an exact set-similarity join.

A line is the set of its distinct words. Lines with equal sets are one class. Two classes match at a Jaccard
similarity of at least 0.75. Words are put in one global order by rarity: counts over all texts, kept in a table of
fixed size indexed by a hash of the word, as levels of 16 bits, ties by the hash (any order gives the same matches; rarity makes few
candidates). Classes that share a word of their prefixes are candidates if sizes, the positions of the shared
word and a parity bitmap of the sets leave the required overlap possible. Every candidate is verified on full sets, so the join is exact.

A line is removed if it equals or matches a line that comes earlier by (doc_id, line). Pairs are made between
classes only; equal lines are never paired.

No pair ever becomes a row. Steps (``matches``):

1. one pass over the texts stores the lines' digests and counts the words;
2. a second pass sends the prefixes, dealt by word to parts of about ``PART_ROWS`` rows and packed, as a row for each would cost more than
   the work; each task sends the prefix of a class once. A part is sorted by word and size. Within a word the
   candidates are found by comparing every row with those that follow it while sizes allow. They leave as a forest: an
   edge for each class that hangs on another. A word of very many lines is dealt to pairs of blocks;
3. the edges are contracted to groups: classes of different groups never match;
4. the sets of each group's classes are read again from the documents that hold them and meet in one place, large groups in pairs of
   blocks of bounded size. All overlaps within are counted; the numbers of matches and the earliest match of each class leave.

What the driver holds: the table of levels and the slots of what to read again, all of fixed size. Shuffle files of finished steps are given up
in between.

Defined results: null text has no lines; every line with at least ``min_tokens`` (1) distinct words is a unit; rows
that repeat a doc_id and a text are one document; a null doc_id ranks last; an empty table gives no
rows; extra columns are ignored. Classes are told apart by 128-bit digests of their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import clear, drop, give_back, save, trimmed

MIN_TOKENS = 1
#: Distinct words from which a set can match one that does not equal it (2 of 3 words are under 0.75, 3 of 4 are not).
LEAST_SIMILAR = 3
#: Occurrences from which a class is joined to its lines by broadcast.
HOT = 4096
NUMERATOR, DENOMINATOR = 75, 100
#: Entries of the count table.
TABLE = 1 << 22
#: Bits of a count that its level keeps.
EXACT_BITS = 11
#: Sizes and positions from here on are not told apart by the filters.
MOST = (1 << 15) - 1
#: Occurrences of a word in one block, and words of the sets in one block of a group.
BLOCK_ROWS, BLOCK_WORDS = 50_000, 200_000
#: Prefix rows of a part, and those that a task packs at a time.
PART_ROWS, PACKED_ROWS = 2_000_000, 1_000_000
#: Slots of the filters before the joins.
SLOTS = 1 << 20
_SLICE = 2_000_000
_BLOCK = 1 << 16
_LONG_WORD = 512
_SEEN = 400_000
_FEW = 24
LAST = 2**63 - 1


class Lines(NamedTuple):
    """Words of some texts: their hashes and lines; of each line its text, number, start and stop (in bytes)."""

    word: np.ndarray
    line: np.ndarray
    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at starts to ends; 8 bytes must follow the last. Eight bytes are taken at a time."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = ends - starts
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    out = _mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (eight[starts] & masks[np.minimum(size, 8)]))
    at = np.flatnonzero(size > 8)
    for k in range(8, _LONG_WORD, 8):
        if k > 8:
            at = at[size[at] > k]
        if not len(at):
            break
        part = eight[starts[at] + k] & masks[np.minimum(size[at] - k, 8)]
        out[at] = _mixed(out[at] ^ part)
    for k in np.flatnonzero(size > _LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return _mixed(out)


def lines_of(texts: list[bytes]) -> Lines:
    """The lines that hold a word. A-Z are lower-cased, words parted by ASCII white space."""
    body = b"\n" + b"\n".join(texts) + b"\n"
    data = np.frombuffer(body.lower() + bytes(8), np.uint8)
    inside = data[: len(body)] > 32
    inside |= (data[: len(body)] < 9) | ((data[: len(body)] > 13) & (data[: len(body)] < 32))
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    breaks = np.flatnonzero(data[: len(body)] == 10)
    line = np.repeat(np.arange(-1, len(breaks)), np.diff(np.searchsorted(starts, breaks), prepend=0, append=len(starts)))
    new = np.concatenate([[True], line[1:] != line[:-1]])[: len(line)]
    used, line = line[new], np.cumsum(new) - 1
    begins, stops = breaks[:-1] + 1, breaks[1:]
    text_at = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(begins, text_at[:-1])
    text = np.searchsorted(text_at, begins[used], side="right") - 1
    return Lines(word_hashes(data, starts, ends), line, text, used - first[text], begins[used] - text_at[text], stops[used] - text_at[text])


def _sorted_words(line: np.ndarray, word: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """Where the distinct words of each line stand, by line, rank (if given) and hash. ``line`` ascends.

    Line, rank, as many bits of the hash as there is room for, and the place go into one number, as plain numbers sort fastest. Where two words
    of a line agree in all of these but the place, they are sorted again by all bits."""
    if not len(line):
        return np.empty(0, np.int64)
    places = len(line).bit_length()
    room = 64 - places - int(line[-1]).bit_length() - (0 if rank is None else 8 * rank.itemsize)
    if room >= 0:
        key = word >> np.uint64(64 - room) if room else np.zeros(len(word), np.uint64)
        if rank is not None:
            key |= rank.astype(np.uint64) << np.uint64(room)
            room += 8 * rank.itemsize
        if room < 64:
            key |= line.astype(np.uint64) << np.uint64(room)
        key = np.sort(key << np.uint64(places) | np.arange(len(line), dtype=np.uint64))
        order = (key & np.uint64((1 << places) - 1)).astype(np.int64)
        key >>= np.uint64(places)
        same = key[1:] == key[:-1]
        equal = same & (word[order[1:]] == word[order[:-1]])
        if (same != equal).any():
            run = np.concatenate([[0], np.cumsum(~same)])
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[1:][same != equal]] = True
            at = np.flatnonzero(mixed[run])
            order[at] = order[at][np.lexsort((word[order[at]], run[at]))]
            equal = same & (word[order[1:]] == word[order[:-1]])
    else:
        order = np.lexsort((word, line) if rank is None else (word, rank, line))
        equal = (line[order[1:]] == line[order[:-1]]) & (word[order[1:]] == word[order[:-1]])
    return order[np.concatenate([[True], ~equal])]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of about ``_SLICE`` bytes."""
    part: list[bytes] = []
    first, size = 0, 0
    for k, text in enumerate(pc.fill_null(texts.cast(pa.large_binary()), b"")):
        part.append(text.as_py())
        size += len(part[-1])
        if size >= _SLICE:
            yield first, part
            part, first, size = [], k + 1, 0
    if part:
        yield first, part


class Sets(NamedTuple):
    """The lines of at least ``min_tokens`` words: which they are, their digests and sizes."""

    kept: np.ndarray
    i1: np.ndarray
    i2: np.ndarray
    size: np.ndarray


def sets_of(lines: Lines, order: np.ndarray, min_tokens: int) -> tuple[Sets, np.ndarray]:
    """The sets, and per word of ``order`` its line."""
    line, word = lines.line[order], lines.word[order]
    n = len(lines.text)
    size = np.bincount(line, minlength=n)
    starts = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
    if not n:
        none = np.empty(0, np.int64)
        return Sets(none, none, none, none), line
    i1 = _mixed(np.add.reduceat(_mixed(word ^ np.uint64(0x243F6A8885A308D3)), starts) + size.astype(np.uint64))
    i2 = _mixed(np.add.reduceat(_mixed(word ^ np.uint64(0xA4093822299F31D0)), starts) ^ size.astype(np.uint64))
    return Sets(np.flatnonzero(size >= min_tokens), i1.view(np.int64), i2.view(np.int64), size), line


def widths(size: np.ndarray) -> np.ndarray:
    """Longs of the parity bitmaps of sets of these sizes. Sets that may match differ by a factor of two at most."""
    return np.where(size <= 96, 2, np.where(size <= 192, 4, 8))


def parities(word: np.ndarray, line: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The bitmaps of all lines, one after the other: which hash values, modulo their bits, occur an odd number of times. Half the bits of a
    bitmap are its two halves, xored."""
    first = 64 * np.concatenate([[0], np.cumsum(width)])
    at = first[line] + ((word >> np.uint64(55)).astype(np.int64) & (64 * width[line] - 1))
    return np.packbits((np.bincount(at, minlength=int(first[-1])) & 1).astype(np.uint8), bitorder="little").view(np.int64)


LINE = "struct<line:int,start:int,stop:int,i1:bigint,i2:bigint>"
_LINE = pa.struct([("line", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("i1", pa.int64()), ("i2", pa.int64())])
DESCRIBED = f"doc_id bigint, mark bigint, lines array<{LINE}>, block int, counts binary"


def _char_offsets(texts: list[bytes], text: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
    """Byte offsets in texts as offsets in characters."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data) or data.max() < 0x80:
        return list(at)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[text]
    return [heads[begins + x] - heads[begins] for x in at]


def _describe(min_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, mark, lines) of documents, then rows (block, counts) of the words that the task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ("doc_id bigint", "mark bigint", "lines", "block int", "counts binary")]
        total = np.zeros(TABLE, np.int32)
        for batch in batches:
            for first, texts in _slices(batch.column(2)):
                n = len(texts)
                lines = lines_of(texts)
                np.add.at(total, (lines.word & np.uint64(TABLE - 1)).astype(np.int64), np.int32(1))
                sets, _ = sets_of(lines, _sorted_words(lines.line, lines.word), min_tokens)
                k = sets.kept
                text = lines.text[k]
                fields = [lines.number[k], *_char_offsets(texts, text, lines.start[k], lines.stop[k])]
                rows = pa.StructArray.from_arrays([*(pa.array(f.astype(np.int32)) for f in fields), pa.array(sets.i1[k]), pa.array(sets.i2[k])], fields=list(_LINE))
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
                own = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.ListArray.from_arrays(pa.array(ends), rows), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        for block in range(TABLE // _BLOCK):
            part = total[block * _BLOCK : (block + 1) * _BLOCK]
            used = np.flatnonzero(part)
            if len(used):
                packed = used.astype("<u2").tobytes() + part[used].astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(_LINE)), pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=names)

    return run


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits and in their order: themselves below 2 ** EXACT_BITS, above that their exponent and first EXACT_BITS bits."""
    more = np.maximum(np.frexp(counts.astype(np.float64))[1] - EXACT_BITS, 0)
    return ((more << (EXACT_BITS - 1)) + (counts >> more)).astype(np.uint16)


SUMMED = "block int, levels binary, hot binary, words bigint"


def _sum_blocks(block_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each block, all rows of which are in this task: its levels, the entries of very many occurrences with their counts, and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = packed.as_buffer()
                n = data.size // 6
                at, counts = np.frombuffer(data, "<u2", n), np.frombuffer(data, "<i4", n, 2 * n)
                if block not in total:
                    total[block] = np.zeros(_BLOCK, np.int64)
                total[block][at] += counts
        for block, counts in total.items():
            hot = np.flatnonzero(counts > block_rows)
            packed = np.stack([hot + block * _BLOCK, counts[hot]]).astype("<i8").tobytes()
            columns = [pa.array([block], pa.int32()), pa.array([levels(counts).astype("<u2").tobytes()]), pa.array([packed]), pa.array([int(counts.sum())])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "levels", "hot", "words"])

    return run


class Order(NamedTuple):
    """The level of every entry of the count table; the entries of very many occurrences, ascending, and the number of blocks of each; all words."""

    level: np.ndarray
    hot: np.ndarray
    blocks: np.ndarray
    words: int


def rarity(described: DataFrame, block_rows: int = BLOCK_ROWS) -> Order:
    level = np.zeros(TABLE, np.uint16)
    summed = described.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(trimmed(_sum_blocks(block_rows)), SUMMED)
    rows = summed.collect()  # TABLE / _BLOCK rows, 2 * TABLE bytes
    for row in rows:
        level[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["levels"], "<u2")
    hot, counts = np.concatenate([np.empty((2, 0), np.int64), *(np.frombuffer(row["hot"], "<i8").reshape(2, -1) for row in rows)], axis=1)
    order = np.argsort(hot)
    return Order(level, hot[order], -(-counts[order] // block_rows), sum(row["words"] for row in rows))


def needed_prefix(sizes: np.ndarray) -> np.ndarray:
    """Words of a set's rare end of which it shares one with any match of its size or less."""
    return sizes - (NUMERATOR * sizes + DENOMINATOR - 1) // DENOMINATOR + 1


class Prefix(NamedTuple):
    """Rows of the words of prefixes. key: 40 bits of the word, 15 of the size, 8 of i1, so that one sort of longs serves; p0, p1: the bitmap,
    folded to 128 bits; at: the word's position; n_wide, wide: the longs of the whole bitmap where it is larger, one row's after the other's."""

    key: np.ndarray
    i1: np.ndarray
    p0: np.ndarray
    p1: np.ndarray
    at: np.ndarray
    n_wide: np.ndarray
    wide: np.ndarray


_KINDS = ("<i8", "<i8", "<i8", "<i8", "<i2", "<i1", "<i8")


def _joined_prefixes(parts: list[Prefix]) -> Prefix:
    return Prefix(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _taken(rows: Prefix, order: np.ndarray) -> Prefix:
    n = rows.n_wide.astype(np.int64)
    begins, own = (np.cumsum(n) - n)[order], n[order]
    at = np.repeat(begins - (np.cumsum(own) - own), own) + np.arange(own.sum())
    return Prefix(*(x[order] for x in rows[:6]), rows.wide[at])


def packed_prefixes(rows: Prefix) -> bytes:
    return b"".join([len(rows.key).to_bytes(8, "little"), *(x.astype(k).tobytes() for x, k in zip(rows, _KINDS, strict=True))])


def unpacked_prefixes(data: bytes) -> Prefix:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in _KINDS[:6]:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return Prefix(*out, np.frombuffer(data, _KINDS[6], (len(data) - at) // 8, at))


PACKED = "part int, rows binary"


def _packed(rows: Prefix, n_parts: int) -> Iterator[pa.RecordBatch]:
    """The rows of each part, packed; a few parts a batch."""
    part = (_mixed((rows.key >> 23).astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
    rows = _taken(rows, np.argsort(part, kind="stable"))
    ends = np.cumsum(np.bincount(part, minlength=n_parts))
    longs = np.concatenate([[0], np.cumsum(rows.n_wide, dtype=np.int64)])
    used = np.flatnonzero(np.diff(np.concatenate([[0], ends]))).tolist()
    for first in range(0, len(used), 64):
        few = used[first : first + 64]
        slices = [slice(int(ends[k - 1]) if k else 0, int(ends[k])) for k in few]
        data = [packed_prefixes(Prefix(*(x[w] for x in rows[:6]), rows.wide[longs[w.start] : longs[w.stop]])) for w in slices]
        yield pa.RecordBatch.from_arrays([pa.array(few, pa.int32()), pa.array(data, pa.binary())], names=["part", "rows"])


def _prefixes(order, min_tokens: int, n_parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``PACKED`` of the words of the prefixes that another line can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, hot, blocks, _ = Order(*order.value)
        seen: set[int] = set()
        found: list[Prefix] = []
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                lines = lines_of(texts)
                level = level_of[(lines.word & np.uint64(TABLE - 1)).astype(np.int64)]
                chosen = _sorted_words(lines.line, lines.word, level)
                sets, line = sets_of(lines, chosen, min_tokens)
                if not len(sets.size):
                    continue
                _, earliest = np.unique(sets.i1, return_index=True)
                new = np.zeros(len(sets.size), bool)
                if len(seen) > _SEEN:
                    seen.clear()
                fresh = [k for k, name in zip(earliest.tolist(), sets.i1[earliest].tolist(), strict=True) if name not in seen]
                new[fresh] = True
                seen.update(sets.i1[fresh].tolist())
                new &= (sets.size >= LEAST_SIMILAR) & (sets.size >= min_tokens)
                place = np.arange(len(line)) - np.concatenate([[0], np.cumsum(sets.size)])[:-1][line]
                # A word that stands in one line only matches nothing; sets of one or two words match equal sets only, which are one class.
                keep = new[line] & (place < needed_prefix(sets.size)[line]) & (level[chosen] > 1)
                of, at = line[keep], np.minimum(place[keep], MOST).astype(np.int32)
                word, i1 = lines.word[chosen][keep], sets.i1[of]
                slot = np.searchsorted(hot, (word & np.uint64(TABLE - 1)).astype(np.int64))
                is_hot = np.zeros(len(word), bool)
                is_hot[slot < len(hot)] = hot[slot[slot < len(hot)]] == (word[slot < len(hot)] & np.uint64(TABLE - 1)).astype(np.int64)
                key = word ^ _mixed(np.zeros(1, np.uint64))
                if is_hot.any():  # a row of a hot word goes to the pairs of its block with every block
                    n = np.ones(len(word), np.int64)
                    n[is_hot] = blocks[slot[is_hot]]
                    row = np.repeat(np.arange(len(word)), n)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    own = ((i1.view(np.uint64) >> np.uint64(20)) % n.astype(np.uint64)).astype(np.int64)[row]
                    pair = (np.minimum(own, other) << 20 | np.maximum(own, other)).astype(np.uint64)
                    key, i1, at, of = word[row] ^ _mixed(pair), i1[row], at[row], of[row]
                size = np.minimum(sets.size, MOST).astype(np.uint64)[of]
                key = (key >> np.uint64(24)) << np.uint64(23) | size << np.uint64(8) | i1.view(np.uint64) & np.uint64(255)
                width = widths(sets.size)
                bitmaps, begins = parities(lines.word[chosen], line, width), np.concatenate([[0], np.cumsum(width)])
                p0, p1 = (np.bitwise_xor.reduceat(bitmaps[k::2], begins[:-1] >> 1)[of] for k in (0, 1))
                n_wide = np.where(width > 2, width, 0)[of]
                wide = bitmaps[np.repeat(begins[:-1][of] - (np.cumsum(n_wide) - n_wide), n_wide) + np.arange(n_wide.sum())]
                found.append(Prefix(key.view(np.int64), i1, p0, p1, at.astype(np.int16), n_wide.astype(np.int8), wide))
                if sum(len(x.key) for x in found) >= PACKED_ROWS:
                    yield from _packed(_joined_prefixes(found), n_parts)
                    found = []
        if found:
            yield from _packed(_joined_prefixes(found), n_parts)

    return run


def _least_overlap(both: np.ndarray) -> np.ndarray:
    """overlap >= t / (1 + t) * (|x| + |y|), in whole numbers"""
    return (NUMERATOR * both + NUMERATOR + DENOMINATOR - 1) // (NUMERATOR + DENOMINATOR)


def _top(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The roots of the trees that hold x. A root points to itself."""
    a = root[x]
    while not np.array_equal(a, above := root[a]):
        a = above
    root[x] = a
    return a


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the trees of x and y, pair by pair; of several trees that would hang below one root, the rest come again."""
    while len(x):
        a, b = _top(root, x), _top(root, y)
        apart = a != b
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def forest(word: np.ndarray, size: np.ndarray, at: np.ndarray, bits: np.ndarray, wide: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, y) of a spanning forest of the candidates among rows in the order of word and size. ``bits``: the bitmaps, folded to two
    longs; ``wide``: rows of four and of eight longs, zeros for the rows whose bitmap has fewer."""
    root = np.arange(len(word))
    widest = np.where(wide[8].any(axis=1), 8, np.where(wide[4].any(axis=1), 4, 2))
    act, k = root.copy(), 0
    while True:
        k += 1
        act = act[act < len(word) - k]
        # Sizes ascend within a word, so a row that has met one too large has met all that it can match.
        act = act[(word[act + k] == word[act]) & (DENOMINATOR * size[act] >= NUMERATOR * size[act + k])]
        if not len(act):
            break
        x, y = act, act + k
        both = size[x] + size[y]
        needed = _least_overlap(both)
        most = both - 2 * needed  # words in which they may differ
        ok = (np.minimum(size[x] - at[x], size[y] - at[y]) >= needed) & (np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= most)
        ok |= size[y] >= MOST
        x, y, most = x[ok], y[ok], most[ok]
        common = np.minimum(widest[x], widest[y])
        for w in (4, 8):
            of = common >= w
            if of.any():
                ok = ~of
                ok[of] = (np.bitwise_count(wide[w][x[of]] ^ wide[w][y[of]]).sum(axis=1, dtype=np.int64) <= most[of]) | (size[y[of]] >= MOST)
                x, y, most, common = x[ok], y[ok], most[ok], common[ok]
        _merge(root, x, y)
    _top(root, np.arange(len(word)))
    hung = np.flatnonzero(root != np.arange(len(word)))
    return hung, root[hung]


def _wide(n_wide: np.ndarray, longs: np.ndarray) -> dict[int, np.ndarray]:
    """The bitmaps of more than two longs, in eight and in four longs; zeros where there are fewer."""
    n = n_wide.astype(np.int64)
    begins = np.cumsum(n) - n
    out = {8: np.zeros((len(n), 8), np.uint64), 4: np.zeros((len(n), 4), np.uint64)}
    for w in (4, 8):
        own = np.flatnonzero(n == w)
        out[w][own] = longs.view(np.uint64)[begins[own][:, None] + np.arange(w)]
    eight = n == 8
    out[4][eight] = out[8][eight, :4] ^ out[8][eight, 4:]
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from packed rows that are sorted by part; a part is kept until the next comes."""

    def edges(parts: list[Prefix]) -> pa.RecordBatch:
        rows = _joined_prefixes(parts)
        order = np.argsort(rows.key)
        key, i1 = rows.key[order], rows.i1[order]
        new = np.ones(len(key), bool)  # several tasks may have sent a class
        new[1:] = (key[1:] != key[:-1]) | (i1[1:] != i1[:-1])
        rows = _taken(rows, order[new])
        x, y = forest(rows.key >> 23, (rows.key >> 8) & MOST, rows.at.astype(np.int64), np.stack([rows.p0, rows.p1], axis=1).view(np.uint64), _wide(rows.n_wide, rows.wide))
        a, b = rows.i1[x], rows.i1[y]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    kept: list[Prefix] = []
    of = None
    for batch in batches:
        for part, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != of and kept:
                yield edges(kept)
                kept = []
            of = part
            kept.append(unpacked_prefixes(rows.as_py()))
    if kept:
        yield edges(kept)


def _may_be_in(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The rows whose long in the column agrees in its low bits with one of the longs in the one column of ``names``: SLOTS values are broadcast at most."""
    slot = lambda c: F.col(c).bitwiseAND(F.lit(SLOTS - 1))
    slots = names.select(slot(names.columns[0]).alias("__slot")).distinct()
    return rows.join(F.broadcast(slots), slot(column) == F.col("__slot"), "left_semi")


SETS = "grp bigint, i1 bigint, i2 bigint, doc_id bigint, line int, mark bigint, words array<bigint>"


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each document, with their words."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in SETS.split(", ")]
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        for first, texts in _slices(batch.column(0)):
            lines = lines_of(texts)
            order = _sorted_words(lines.line, lines.word)
            words = np.split(lines.word[order].view(np.int64), np.cumsum(np.bincount(lines.line[order], minlength=len(lines.text)))[:-1]) if len(order) else []
            at = {(t, n): k for k, (t, n) in enumerate(zip(lines.text.tolist(), lines.number.tolist(), strict=True))}
            found = [(w["grp"], w["i1"], w["i2"], w["doc_id"], w["line"], w["mark"], words[at[t, w["line"]]]) for t in range(len(texts)) for w in wanted[first + t]]
            columns = list(zip(*found, strict=True)) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def overlaps_of_few(owner: np.ndarray, row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, overlap), x < y, of rows of one owner that share words: counted word by word, for owners of few rows."""
    order = np.lexsort((row, word, owner))
    owner, row, word = owner[order], row[order], word[order]
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    act, k = np.arange(len(word)), 0
    while True:
        k += 1
        act = act[act < len(word) - k]
        act = act[(word[act + k] == word[act]) & (owner[act + k] == owner[act])]
        if not len(act):
            break
        xs.append(row[act])
        ys.append(row[act + k])
    x, y = np.concatenate(xs), np.concatenate(ys)
    n = int(row.max()) + 1 if len(row) else 1
    pair, count = np.unique(x * n + y, return_counts=True)
    return pair // n, pair % n, count


#: Rows of one block of a group, whatever their words.
MOST_ROWS = 20_000
#: Counts and postings that are held at a time for a block of many rows.
_TILE = 2_000_000


def matches_of_many(row: np.ndarray, word: np.ndarray, size: np.ndarray, apart: Callable[[slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, how many rows it matches, the first of them) of rows that match any. ``row`` is sorted; ``apart`` says which rows may match those of a
    slice. Words have inverted lists; some rows at a time are counted against all, and only counts and first matches are kept, so
    memory follows the tile and the lists, not the square of the rows."""
    n = len(size)
    lists = np.argsort(word, kind="stable")
    holder, sorted_words = row[lists], word[lists]
    low, high = np.searchsorted(sorted_words, word), np.searchsorted(sorted_words, word, "right")
    offsets = np.concatenate([[0], np.cumsum(size)])
    work = np.concatenate([[0], np.cumsum(high - low)])[offsets]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a = 0
    while a < n:
        b = min(n, a + max(1, _TILE // n), max(a + 1, int(np.searchsorted(work, work[a] + _TILE, "right")) - 1))
        e = slice(int(offsets[a]), int(offsets[b]))
        k = high[e] - low[e]
        at = np.repeat(low[e] - np.cumsum(k) + k, k) + np.arange(k.sum())
        counts = np.bincount(np.repeat(row[e] - a, k) * n + holder[at], minlength=(b - a) * n).reshape(b - a, n)
        ok = (DENOMINATOR * counts >= NUMERATOR * (size[a:b, None] + size[None, :] - counts)) & apart(slice(a, b))
        x = np.flatnonzero(ok.any(1))
        found.append((x + a, ok[x].sum(1), ok[x].argmax(1)))
        a = b
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


REACH = "i1 bigint, i2 bigint, n_links bigint, doc_id bigint, line int, mark bigint"


class Block(NamedTuple):
    """Rows of pairs of blocks of groups, in the order of (grp, x, y)."""

    key: np.ndarray
    cross: np.ndarray
    own: np.ndarray
    rows: list[np.ndarray]
    words: np.ndarray
    ends: np.ndarray


def _reach(block: Block) -> pa.RecordBatch:
    """Of each row that matches another: how many it matches, and the earliest."""
    i1, i2, doc, line, mark = block.rows
    size = np.diff(np.concatenate([[0], block.ends]))
    owner = np.repeat(np.arange(len(size)), size)
    starts = np.flatnonzero(np.concatenate([[True], block.key[1:] != block.key[:-1]]))
    n_rows = np.diff(np.concatenate([starts, [len(block.key)]]))
    group = np.repeat(np.arange(len(starts)), n_rows)
    few = (n_rows <= _FEW)[group[owner]]
    xs, ys, overlap = (list(p) for p in zip(overlaps_of_few(group[owner][few], owner[few], block.words[few]), strict=True))
    x, y, overlap = (np.concatenate(p) for p in (xs, ys, overlap))
    same = (i1[x] == i1[y]) & (i2[x] == i2[y])
    ok = ~same & (DENOMINATOR * overlap >= NUMERATOR * (size[x] + size[y] - overlap)) & (~block.cross[x] | (block.own[x] != block.own[y]))
    x, y = np.concatenate([x[ok], y[ok]]), np.concatenate([y[ok], x[ok]])
    order = np.lexsort((mark[y], line[y], doc[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
    n = np.diff(np.concatenate([first, [len(x)]]))
    found = [(x[first], n, y[first])]
    offsets = np.concatenate([[0], block.ends])
    for g in np.flatnonzero(n_rows > _FEW).tolist():
        a, b = int(starts[g]), int(starts[g] + n_rows[g])
        # In the order of places, so that the first match is the earliest.
        rows = a + np.lexsort((mark[a:b], line[a:b], doc[a:b]))
        words = np.concatenate([block.words[offsets[r] : offsets[r + 1]] for r in rows])
        one, two, own, cross = i1[rows], i2[rows], block.own[rows], bool(block.cross[a])

        def apart(part: slice, one=one, two=two, own=own, cross=cross) -> np.ndarray:
            differ = (one[part, None] != one) | (two[part, None] != two)
            return differ & (own[part, None] != own) if cross else differ

        x, n, y = matches_of_many(np.repeat(np.arange(b - a), size[rows]), words, size[rows], apart)
        found.append((rows[x], n, rows[y]))
    x, n, y = (np.concatenate(p) for p in zip(*found, strict=True))
    columns = [i1[x], i2[x], n, doc[y], line[y].astype(np.int32), mark[y]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in REACH.split(", ")])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_reach`` of rows (grp, x, y, own, i1, i2, doc_id, line, mark, words) sorted by (grp, x, y); a block's rows are kept until the next begins."""
    kept: list[pa.RecordBatch] = []

    def key_of(batch: pa.RecordBatch) -> np.ndarray:
        return _mixed(_mixed(batch.column(0).to_numpy().view(np.uint64)) ^ (batch.column(1).to_numpy().astype(np.uint64) << np.uint64(32) | batch.column(2).to_numpy().astype(np.uint64)))

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        whole = table.to_batches()[0] if table.num_rows else parts[0]
        words = whole.column(9)
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)) if whole.num_rows else np.empty(0, np.int64)
        numbers = [whole.column(k).to_numpy() for k in range(9)]
        return _reach(Block(key_of(whole), numbers[1] != numbers[2], numbers[3], numbers[4:9], words.flatten().to_numpy(), ends))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = key_of(batch)
        other = np.flatnonzero(key != key[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if kept and not last and key[0] != key_of(kept[-1])[-1]:
            yield done(kept)
            kept = []
        if last:
            yield done([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    if kept:
        yield done(kept)


def _place() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.col("line"), F.col("mark"))


def matches(docs: DataFrame, min_tokens: int = MIN_TOKENS, block_rows: int = BLOCK_ROWS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, mark, lines); classes (i1, i2, n: their occurrences, first: the earliest one) that occur again or may match another;
    and of those that match: i1, i2, n_links (classes) and earliest (of their first occurrences)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    described, _ = save(texts.mapInArrow(trimmed(_describe(min_tokens)), DESCRIBED), "described")
    order = rarity(described, block_rows)
    # Of 47 words, 12 are in the prefix.
    n_parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), order.words * 3 // 10 // PART_ROWS)
    order = context.broadcast(tuple(order))
    give_back()
    prefixes = texts.select("text").mapInArrow(trimmed(_prefixes(order, min_tokens, n_parts)), PACKED)
    edges = prefixes.repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(_forests), "a bigint, b bigint")
    edges, of_edges = save(edges, "edges")
    order.destroy()
    clear(spark)
    groups, of_groups = save(connected_components(edges), "groups")
    drop(spark, of_edges)
    clear(spark)

    of_docs = described.where("block IS NULL").select("doc_id", "mark", "lines")
    classes = of_docs.select("doc_id", "mark", F.explode("lines").alias("l")).select("doc_id", "mark", "l.*").groupBy("i1", "i2").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    named = groups.select(F.col("id").alias("g1"), F.col("component").alias("grp"))
    classes = classes.join(named, classes["i1"] == named["g1"], "left").where("n > 1 OR grp IS NOT NULL")
    classes, _ = save(classes.select("i1", "i2", "n", "first", "grp"), "classes")
    drop(spark, of_groups)
    clear(spark)

    wanted = classes.where("grp IS NOT NULL").select("grp", "i1", "i2", "first.*")
    again = _may_be_in(texts, "mark", wanted.select("mark")).dropDuplicates(["doc_id", "mark"])
    of_doc = wanted.groupBy(F.col("doc_id").alias("w_doc"), F.col("mark").alias("w_mark")).agg(F.collect_list(F.struct("grp", "i1", "i2", "doc_id", "line", "mark")).alias("wanted"))
    again = again.join(of_doc, (F.coalesce(again["doc_id"], F.lit(LAST)) == of_doc["w_doc"]) & (again["mark"] == of_doc["w_mark"])).select("text", "wanted")
    sets, of_sets = save(again.mapInArrow(trimmed(_full_sets), SETS), "sets")
    clear(spark)

    blocks = sets.groupBy("grp").agg(F.ceil(F.greatest(F.sum(F.size("words").cast("bigint")) / F.lit(block_words), F.count("*") / F.lit(MOST_ROWS))).cast("int").alias("nb"), F.count("*").alias("members")).where("members > 1")
    rows = sets.join(blocks.select("grp", "nb"), "grp").withColumn("own", F.pmod(F.xxhash64("i1", "i2"), F.col("nb")).cast("int"))
    # A row of a large group goes to the pairs of its block with every block.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("grp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "i1", "i2", "doc_id", "line", "mark", "words")
    met = rows.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y").mapInArrow(trimmed(_matched), REACH)
    reach = met.groupBy("i1", "i2").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("doc_id", "line", "mark")).alias("earliest"))
    reach, _ = save(reach, "reach")
    drop(spark, of_sets)
    clear(spark)
    return of_docs, classes, reach


def decisions(docs: DataFrame, hot: int = HOT, min_tokens: int = MIN_TOKENS, **blocks: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, mark, lines), and the lines that occur again or match another: doc_id, mark, line, start, stop, i1, i2,
    n_links (matching classes) and removed."""
    spark = docs.sparkSession
    of_docs, classes, reach = matches(docs, min_tokens, **blocks)
    of_class = classes.join(reach, ["i1", "i2"], "left").where("n > 1 OR n_links IS NOT NULL")
    of_class = of_class.select("i1", "i2", "n", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("earliest") < F.col("first"), F.lit(False)).alias("later"))
    of_class, _ = save(of_class, "decided")
    clear(spark)
    rows = of_docs.select("doc_id", "mark", F.explode("lines").alias("l")).select("doc_id", "mark", "l.*")
    rows = _may_be_in(rows, "i1", of_class.select("i1"))
    often = of_class.where(F.col("n") >= hot)
    cold = rows.join(F.broadcast(often.select("i1", "i2")), ["i1", "i2"], "left_anti").join(of_class.where(F.col("n") < hot), ["i1", "i2"])
    # At most one class in ``hot`` lines is broadcast.
    rows = rows.join(F.broadcast(often), ["i1", "i2"]).unionByName(cold)
    return of_docs, rows.select("doc_id", "mark", "line", "start", "stop", "i1", "i2", "n_links", (F.col("later") | (_place() != F.col("first"))).alias("removed"))


def line_dedup(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row per document row: doc_id, n_lines (units), n_links, n_removed and ``removed``: line, start and stop of each."""
    of_docs, found = decisions(docs, min_tokens=min_tokens)
    found = found.distinct().groupBy("doc_id", "mark").agg(
        F.sum("n_links").alias("n_links"),
        F.count(F.when(F.col("removed"), 1)).alias("n_removed"),
        F.array_sort(F.collect_list(F.when(F.col("removed"), F.struct("line", "start", "stop")))).alias("removed"),
    )
    found = found.select(F.col("doc_id").alias("f_doc"), F.col("mark").alias("f_mark"), "n_links", "n_removed", "removed")
    rows = of_docs.select("doc_id", "mark", F.size("lines").cast("bigint").alias("n_lines"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(F.col("f_doc")) & (rows["mark"] == F.col("f_mark")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return joined.select("doc_id", "n_lines", zero("n_links"), zero("n_removed"), F.coalesce("removed", F.array().cast("array<struct<line:int,start:int,stop:int>>")).alias("removed"))
