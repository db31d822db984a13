"""Cross-tokenizer alignment: id-striped dense count matrices over the places where two tokenizations end together.

Every text is encoded twice. Byte offsets at which tokens of both sides end cut them into groups; the two tokens that end there are
linked, one pair to a group, as no token is empty. Counts of linked id pairs over the corpus, and each B id's largest, score the links.

1. Texts are encoded in chunks of bounded size. A chunk gives a row for each document, and its links to each stripe of B ids
   (id modulo ``STRIPES``), packed as arrays: cells (b, a), and for each the documents that have it and how often. A task also
   adds up its cells, so that what is counted comes to a row for each task and stripe. All this is written once.
2. Cells go to their stripe, and a dense matrix of the stripe's ids by all A ids adds them up (``np.add.at``). Row maxima mark the best.
3. Links go to the same stripes as the counts and are scored there; a stripe with many links is dealt out over several tasks,
   each with the stripe's counts. Scores go back to the chunks, again packed, and are added up for each document.

No matrix and no row grows with the corpus: a stripe's counts are bounded by the two vocabularies, chunks by ``CHUNK_BYTES`` and
``CHUNK_DOCS`` (one very long text is a chunk of its own).

Defined results: null and empty texts, and texts that one side changes (their bytes do not come back), have no tokens and zeros; equal texts
have equal groups; ties for the best all count; repeated rows count as often as they occur; an empty table gives no rows; extra columns
are ignored. A very long text stays in one task, with a few tens of bytes for each of its tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import clear, materialise, trimmed

TOKENIZERS = "/opt/tokenizers"
STRIPES = 512
CHUNK_BYTES, CHUNK_DOCS = 1 << 20, 4096
#: Distinct cells that a task holds before it gives them out.
HELD_CELLS = 1 << 21
#: Packed bytes of a stripe's links for one task.
SHARE_BYTES = 64 << 20
#: How the byte-level tokenizer splits a text before merging: the pattern of its published file's pre-tokenizer.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_DOC, _LINKS, _CELLS = 0, 1, 2
PACKED = "kind int, doc_id {id}, chunk bigint, place int, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, stripe int, b binary, a binary, size binary, docs binary, times binary"


def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, the bytes' number of each id."""

    def __init__(self, encode: Callable[[str], np.ndarray], pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)


@cache
def byte_level(path: str) -> Side:
    """The byte-level side. Its merges stand in the order of their ids, so the ids are ranks and the faster library gives the same
    tokens; texts that it refuses (long runs of white space) go to the file's own."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, letters = model["vocab"], byte_alphabet()
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranks = [vocab[m] for m in merges]
    if ranks != sorted(ranks) or len(set(ranks)) != len(ranks):
        raise ValueError("merges do not stand in the order of their ids")
    pieces = [b""] * (max(vocab.values()) + 1)
    ordinary = {c for c in vocab if len(c) == 1} | set(merges)
    for piece, i in vocab.items():
        pieces[i] = bytes(letters[c] for c in piece) if piece in ordinary else piece.encode()
    fast = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks={pieces[vocab[p]]: vocab[p] for p in ordinary}, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.int64)

    return Side(encode, pieces)


@cache
def sentence_pieces(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
    return Side(lambda text: np.array(model.encode(text), np.int64), pieces)


class Grouper:
    """Groups of two tokenizations and the text that names them."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        # An id, then a comma or what ends its side of the group.
        self.names = [f"{i}{end}".encode() for n, last in ((len(a.pieces), "|"), (len(b.pieces), ";")) for i in range(n) for end in (",", last)]
        self.at_b = 2 * len(a.pieces)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of both sides, and which tokens of each end a group; None for a text without tokens."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text), self.b.encode(text)
        for side, ids in ((self.a, a), (self.b, b)):
            if b"".join(map(side.pieces.__getitem__, ids.tolist())) != whole:
                return None
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(b) - 1)
        last_a = ends_b[at] == ends_a
        last_b = np.zeros(len(b), bool)
        last_b[at[last_a]] = True
        return a, b, last_a, last_b

    def digest(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        stop_a, stop_b = np.nonzero(last_a)[0] + 1, np.nonzero(last_b)[0] + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + np.concatenate([[0], stop_b])[group_a]] = 2 * a + last_a
        names[np.arange(len(b)) + stop_a[group_b]] = self.at_b + 2 * b + last_b
        return hashlib.sha256(b"".join(map(self.names.__getitem__, names.tolist()))[:-1]).hexdigest()


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the narrowest width that holds them; ``_read`` finds it from the number of bytes."""
    most = int(x.max(initial=0))
    return x.astype(next(t for t in ("u1", "u2", "u4", "i8") if most <= np.iinfo(t).max)).tobytes()


def _read(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: "u1", 2: "u2", 4: "u4", 8: "i8"}[len(data) // n if n else 1]).astype(np.int64)


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.concatenate([[0], np.nonzero(x[1:] != x[:-1])[0] + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """stripe, b and a in one number."""
    return ((b % STRIPES) << 48) | (b << 24) | a


def _sides(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return key >> 48, key & 0xFFFFFF, (key >> 24) & 0xFFFFFF


def _encoder(path_a: str, path_b: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = schema.names

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], schema.field(c).type) for c in names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Grouper(byte_level(path_a), sentence_pieces(path_b))
        chunk = TaskContext.get().partitionId() << 32
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def cells() -> Iterator[pa.RecordBatch]:
            stripe, a, b = _sides(keys)
            cuts = _cuts(stripe)
            rows = [{"kind": _CELLS, "stripe": int(stripe[i]), "b": _small(b[i:j]), "a": _small(a[i:j]), "times": _small(counts[i:j]), "place": int(j - i)} for i, j in zip(cuts, cuts[1:], strict=False)]
            if rows:
                yield batch(rows)

        def finish(rows: list[dict], docs: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts
            if docs:
                key = np.concatenate([_key(a, b) for _, a, b in docs])
                doc = np.concatenate([np.full(len(a), place) for place, a, _ in docs])
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
                at = np.nonzero(new)[0]
                times = np.diff(np.append(at, len(key)))
                key, doc = key[at], doc[at]
                first = _cuts(key)
                cell, size = key[first[:-1]], np.diff(first)
                stripe, a, b = _sides(cell)
                cuts = _cuts(stripe)
                for i, j in zip(cuts, cuts[1:], strict=False):
                    x, y = first[i], first[j]
                    rows.append({"kind": _LINKS, "chunk": chunk, "stripe": int(stripe[i]), "place": int(j - i), "b": _small(b[i:j]), "a": _small(a[i:j]), "size": _small(size[i:j]), "docs": _small(doc[x:y]), "times": _small(times[x:y])})
                keys, inverse = np.unique(np.concatenate([keys, cell]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, np.add.reduceat(times, first[:-1])]), len(keys)).astype(np.int64)
            yield batch(rows)
            if len(keys) > HELD_CELLS:
                yield from cells()
                keys, counts = keys[:0], counts[:0]

        rows, docs, size = [], [], 0
        for table in batches:
            for doc_id, text in zip(table.column(0), table.column(1), strict=True):
                found = group(text.as_py() or "")
                row = {"kind": _DOC, "doc_id": doc_id.as_py(), "chunk": chunk, "place": len(rows), "n_a": 0, "n_b": 0, "n_groups": 0, "groups_sha256": ""}
                if found:
                    a, b, last_a, last_b = found
                    row |= {"n_a": len(a), "n_b": len(b), "n_groups": int(last_a.sum()), "groups_sha256": group.digest(*found)}
                    docs.append((len(rows), a[last_a], b[last_b]))
                    size += 4 * len(a)
                rows.append(row)
                if size >= CHUNK_BYTES or len(rows) >= CHUNK_DOCS:
                    yield from finish(rows, docs)
                    rows, docs, size, chunk = [], [], 0, chunk + 1
        if rows:
            yield from finish(rows, docs)
        yield from cells()

    return trimmed(run)


def _block(ids: tuple[int, int], kind: type = np.int64) -> np.ndarray:
    """Zeros for a stripe of B ids by all A ids."""
    return np.zeros((-(-ids[1] // STRIPES), ids[0]), kind)


def _by(column: str, batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[object, tuple]]:
    """(key, row) of batches; the key is the value of the first column."""
    for b in batches:
        for row in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in (column, *columns)], strict=True):
            yield row[0], row[1:]


def _count_stripes(ids: tuple[int, int], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the cells of each stripe, which come one stripe after another, in a dense matrix of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, _block(ids)
        touched = np.zeros(0, np.int64)  # the cells of ``block`` that are not 0

        def result() -> pa.RecordBatch:
            row, a = touched // ids[0], touched % ids[0]
            n = block[row, a]
            block[row, a] = 0
            first = _cuts(row)
            best = n == np.repeat(np.maximum.reduceat(n, first[:-1]), np.diff(first))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, len(n), _small(row * STRIPES + now), _small(a), _small(n), _small(best)), schema, strict=True)], schema=schema)

        for stripe, (n, b, a, times) in _by("stripe", batches, ["place", "b", "a", "times"]):
            if stripe != now:
                if now is not None:
                    yield result()
                now, touched = stripe, touched[:0]
            row, a = _read(b, n) // STRIPES, _read(a, n)
            np.add.at(block, (row, a), _read(times, n))
            touched = np.union1d(touched, row * ids[0] + a)
        if now is not None:
            yield result()

    return trimmed(run)


def _score_links(ids: tuple[int, int], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each packed row of links: how many of each document's are best, and the sum of their counts. A stripe's counts come before its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best, known = _block(ids), _block(ids, bool), (np.zeros(0, np.int64),) * 2
        for batch in batches:
            out = []
            for _, (chunk, n, b, a, size, docs, times) in _by("stripe", iter([batch]), ["chunk", "place", "b", "a", "size", "docs", "times"]):
                at = (_read(b, n) // STRIPES, _read(a, n))
                if chunk is None:
                    counts[known], best[known] = 0, False
                    counts[at], best[at], known = _read(times, n), _read(size, n), at
                    continue
                size = _read(size, n)
                total = int(size.sum())
                doc, times = _read(docs, total), _read(times, total)
                cell = np.repeat(np.arange(n), size)
                place, inverse = np.unique(doc, return_inverse=True)
                sums, tops = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                np.add.at(sums, inverse, counts[at][cell] * times)
                np.add.at(tops, inverse, best[at][cell] * times)
                out.append((chunk, len(place), _small(place), _small(tops), _small(sums)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return trimmed(run)


def _gather(columns: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A chunk's scores come before its documents; they are added up by place and handed out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, tops = None, None, None
        for batch in batches:
            out = []
            for chunk, (kind, n, docs, best, total, *rest) in _by("chunk", batches=iter([batch]), columns=["kind", "place", "docs", "tops", "sums", *columns]):
                if chunk != now:
                    now, sums, tops = chunk, np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
                if kind == _DOC:
                    out.append((*rest, int(tops[n]), int(sums[n])))
                else:
                    at = _read(docs, n)
                    tops[at] += _read(best, n)
                    sums[at] += _read(total, n)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return trimmed(run)


def _schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def _empty(df: DataFrame, ddl: str) -> tuple[str, pa.Schema]:
    return ddl, _schema(df.sparkSession.createDataFrame([], ddl))


def align(docs: DataFrame, path_a: str = f"{TOKENIZERS}/byte_bpe_50k.json", path_b: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row. The tokenizers' files are read by all executors."""
    spark, id_type = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    ids = len(byte_level(path_a).pieces), len(sentence_pieces(path_b).pieces)
    ddl, schema = _empty(docs, PACKED.format(id=id_type))
    rows = materialise(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_encoder(path_a, path_b, schema), ddl), "encoded")

    cells = rows.where(F.col("kind") == _CELLS).select("stripe", "place", "b", "a", "times")
    ddl, schema = _empty(docs, "stripe int, place int, b binary, a binary, times binary, size binary")
    counts = materialise(cells.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_count_stripes(ids, schema), ddl), "counts")

    links = rows.where(F.col("kind") == _LINKS)
    # At most ``STRIPES`` rows: how many tasks share a stripe's links.
    shares = links.groupBy("stripe").agg(F.ceil(F.sum(F.length("docs") + F.length("times") + 5 * F.col("place")) / SHARE_BYTES).cast("int").alias("shares"))
    shares = F.broadcast(materialise(shares, "shares"))
    links = links.join(shares, "stripe").select("stripe", F.pmod(F.xxhash64("chunk"), F.col("shares")).cast("int").alias("share"), "chunk", "place", "b", "a", "size", "docs", "times")
    known = counts.join(shares, "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("bigint").alias("chunk"), "place", "b", "a", "size", F.lit(None).cast("binary").alias("docs"), "times")
    dealt = links.unionByName(known).repartition("stripe", "share").sortWithinPartitions("stripe", "share", F.asc_nulls_first("chunk"))
    ddl, schema = _empty(docs, "chunk bigint, place int, docs binary, tops binary, sums binary")
    scores = dealt.mapInArrow(_score_links(ids, schema), ddl)

    kept = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    there = rows.where(F.col("kind") == _DOC).select("chunk", "kind", "place", *[F.lit(None).cast("binary").alias(c) for c in ("docs", "tops", "sums")], *kept)
    there = there.unionByName(scores.withColumn("kind", F.lit(-1)), allowMissingColumns=True)
    ddl, schema = _empty(docs, f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    clear(spark)
    out = there.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_gather(kept, schema), ddl)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
