"""Motion-JPEG in AVI as a media column: store bytes, read them back, find shots.

``encode`` writes a payload as grey frames of 24 x 24 samples of 8 bits, each a lossless JPEG image (process 14: SOF3, one Huffman
table, the left neighbour as prediction), into a RIFF AVI file with its index. ``decode`` walks the
RIFF chunks, follows ``idx1``, parses each frame's JPEG markers and decodes the entropy-coded data. All
frames of a batch are decoded in step, sample by sample, so the work is done by numpy.

Shots: the difference between neighbouring frames is the L1 distance of their grey histograms. A frame starts a
shot where that exceeds the mean of the preceding ``LOOK_BACK`` differences by ``DEVIATIONS`` standard deviations and
a floor. Clips carry their times at ``RATE`` frames a second.

Defined results: null text is the empty payload, one frame of filling; a text's features depend on the text alone, so
repeated rows get equal values; a damaged file stops the query; an empty table gives no rows; extra columns are ignored.
Memory is bounded by the longest text and a slice of ``SLICE`` frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import trimmed

SIDE = 24
SAMPLES = SIDE * SIDE
FILL = 255
RATE = 24
SLICE = 4096
BINS = 16
LOOK_BACK = 12
DEVIATIONS = 2.5
FLOOR = 64

#: Code lengths of the difference categories 0 to 8, fitted to prose; at most 7 + 8 bits a sample.
CODE_LENGTHS = (6, 4, 4, 2, 2, 4, 5, 2, 7)


class Damaged(ValueError):
    """The stored bytes are no file of this kind."""


def canonical_codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length), shortest codes first and by symbol within a length."""
    out, code, last = {}, 0, 0
    for symbol in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[symbol] - last
        last = lengths[symbol]
        out[symbol] = (code, last)
        code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    ordered = sorted(range(9), key=lambda s: (CODE_LENGTHS[s], s))
    counts = bytes(CODE_LENGTHS.count(n) for n in range(1, 17))
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xC4, b"\x00" + counts + bytes(ordered)),
            _segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
            _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0])),
        ]
    )


def _encode_tables() -> tuple[np.ndarray, np.ndarray]:
    """For a difference + 255: its bits (code, then the category's own) and their number."""
    codes = canonical_codes(dict(enumerate(CODE_LENGTHS)))
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = codes[category]
        bits[d + 255] = code << category | ((d if d > 0 else d + (1 << category) - 1) if category else 0)
        sizes[d + 255] = length + category
    return bits, sizes


def _entropy_code(frames: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """The stuffed entropy-coded data of each (n, SIDE, SIDE) frame."""
    wide = frames.astype(np.int16)
    diff = np.empty_like(wide)
    diff[:, :, 1:] = wide[:, :, 1:] - wide[:, :, :-1]
    diff[:, 1:, 0] = wide[:, 1:, 0] - wide[:, :-1, 0]
    diff[:, 0, 0] = wide[:, 0, 0] - 128
    index = diff.reshape(len(frames), SAMPLES).astype(np.int64) + 255
    bits, sizes = tables[0][index], tables[1][index]
    ends = np.cumsum(sizes, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(n_bytes)])
    at = ends - sizes + 8 * starts[:-1, None]
    shifted = (bits << (24 - (at & 7) - sizes)).ravel()
    byte = (at >> 3).ravel()
    total = int(starts[-1])
    packed = sum(np.bincount(byte + k, weights=(shifted >> (16 - 8 * k)) & 255, minlength=total + 2)[:total] for k in range(3)).astype(np.uint8)
    packed[starts[1:] - 1] |= ((1 << (-ends[:, -1] & 7)) - 1).astype(np.uint8)  # the last byte is filled with ones
    full = packed == 255
    shift = np.concatenate([[0], np.cumsum(full)])
    stuffed = np.zeros(total + int(shift[-1]), np.uint8)
    stuffed[np.arange(total) + shift[:-1]] = packed
    data, edges = stuffed.tobytes(), (starts + shift[starts]).tolist()
    return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def _avi(images: list[bytes]) -> bytes:
    n, largest = len(images), max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SAMPLES, 0, 0, 256, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    sizes = np.array([len(x) for x in images], np.int64)
    offsets = 4 + np.concatenate([[0], np.cumsum(8 + sizes + (sizes & 1))])[:-1]
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, offsets, sizes
    movi = b"movi" + b"".join([x for image in images for x in (b"00dc", len(image).to_bytes(4, "little"), image, b"\x00" * (len(image) & 1))])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes()))


class Encoder:
    def __init__(self) -> None:
        self.head, self.tables = _jpeg_head(), _encode_tables()

    def encode(self, payloads: list[bytes]) -> list[bytes]:
        """One AVI file a payload; payload sizes are positive multiples of SAMPLES."""
        frames = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE)
        images = [self.head + x + b"\xff\xd9" for k in range(0, len(frames), SLICE) for x in _entropy_code(frames[k : k + SLICE], self.tables)]
        out, at = [], 0
        for payload in payloads:
            n = len(payload) // SAMPLES
            out.append(_avi(images[at : at + n]))
            at += n
        return out


def chunks(data: bytes, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, stop) of the bodies of the RIFF chunks from start to stop."""
    while start + 8 <= stop:
        size = int.from_bytes(data[start + 4 : start + 8], "little")
        if start + 8 + size > stop:
            raise Damaged("a chunk ends beyond its list")
        yield data[start : start + 4], start + 8, start + 8 + size
        start += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[int, int, float, list[bytes]]:
    """Width, height, frames a second and the images that the index points to."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise Damaged("no RIFF AVI file")
    shape, rate, movi, index = None, None, None, None
    todo = [(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))]
    while todo:
        for name, start, stop in chunks(data, *todo.pop()):
            if name == b"LIST" and data[start : start + 4] == b"movi":
                movi = start
            elif name == b"LIST":
                todo.append((start + 4, stop))
            elif name == b"strh" and data[start : start + 4] == b"vids":
                scale, per = struct.unpack_from("<II", data, start + 20)
                rate = per / scale
            elif name == b"strf":
                shape = struct.unpack_from("<ii", data, start + 4)
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", (stop - start) // 4, start).reshape(-1, 4)
    if shape is None or rate is None or movi is None or index is None:
        raise Damaged("a header, the frames or the index are missing")
    images = []
    for name, _, offset, size in index.tolist():
        at = movi + offset
        if data[at : at + 8] != struct.pack("<II", name, size):
            raise Damaged("the index does not point to a frame")
        images.append(data[at + 8 : at + 8 + size])
    return *shape, rate, images


def parse_jpeg(image: bytes) -> tuple[int, int, int, tuple[tuple[int, int, int], ...]]:
    """Where the entropy-coded data starts, height, width and the Huffman table as (symbol, code, length)."""
    if image[:2] != b"\xff\xd8":
        raise Damaged("no JPEG image")
    at, table, shape = 2, None, None
    while True:
        if at + 4 > len(image) or image[at] != 0xFF:
            raise Damaged("a JPEG marker is missing")
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            symbols = body[17:]
            lengths, k = {}, 0
            for n, count in enumerate(body[1:17], 1):
                lengths |= dict.fromkeys(symbols[k : k + count], n)
                k += count
            table = tuple((s, *code) for s, code in canonical_codes(lengths).items())
        elif marker == 0xC3:
            precision, height, width, components = struct.unpack(">BHHB", body[:6])
            shape = (height, width)
            if (precision, components) != (8, 1):
                raise Damaged("only grey images of 8 bits are read")
        elif marker == 0xDA:
            if body[3:] != b"\x01\x00\x00" or table is None or shape is None:
                raise Damaged("only lossless images predicted from the left are read")
            return at, *shape, table
        elif 0xC0 <= marker <= 0xCF:
            raise Damaged("only lossless images are read")


def _peek_table(table: tuple[tuple[int, int, int], ...]) -> np.ndarray:
    """For the next 16 bits: the difference * 32 + the bits it takes; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for category, code, length in table:
        if length + category > 16:
            raise Damaged("codes of more than 16 bits with their differences are not read")
        for own in range(1 << category):
            d = own if category and own >> (category - 1) else own - (1 << category) + 1
            first = (code << category | own) << (16 - length - category)
            out[first : first + (1 << (16 - length - category))] = d * 32 + length + category
    return out


class Decoder:
    def __init__(self) -> None:
        self.heads: dict[bytes, tuple[int, int, tuple]] = {}
        self.tables: dict[tuple, np.ndarray] = {}

    def _head(self, image: bytes) -> tuple[bytes, int, int, tuple]:
        for head, known in self.heads.items():
            if image.startswith(head):
                return head, *known
        at, height, width, table = parse_jpeg(image)
        if len(self.heads) < 16:
            self.heads[image[:at]] = (height, width, table)
        return image[:at], height, width, table

    def images(self, images: list[bytes]) -> np.ndarray:
        """(n, height * width) samples of images of one shape and table."""
        out = []
        for k in range(0, len(images), SLICE):
            part = [(x, *self._head(x)) for x in images[k : k + SLICE]]
            if len({p[2:] for p in part}) > 1:
                raise Damaged("the images of a batch differ in shape or table")
            _, _, height, width, table = part[0]
            if table not in self.tables:
                self.tables[table] = _peek_table(table)
            if any(not p[0].endswith(b"\xff\xd9") for p in part):
                raise Damaged("an image has no end")
            out.append(_entropy_decode([p[0][len(p[1]) : -2] for p in part], height, width, self.tables[table]))
        return np.concatenate(out)


def _entropy_decode(coded: list[bytes], height: int, width: int, table: np.ndarray) -> np.ndarray:
    data = np.frombuffer(b"".join(coded), np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = ~((data[:-1] == 255) & (data[1:] == 0))
    edges = np.concatenate([[0], np.cumsum([len(x) for x in coded])])
    kept = np.concatenate([[0], np.cumsum(keep)])[edges]
    data = np.concatenate([data[keep], np.zeros(4, np.uint8)]).astype(np.uint32)
    three = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    at, stop = kept[:-1] * 8, kept[1:] * 8
    last = len(three) - 1
    read = np.empty((height * width, len(coded)), np.int32)
    for k in range(height * width):
        entry = table[(three[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF]
        read[k] = entry
        at = at + (entry & 31)
    if (at > stop).any() or (stop - at > 7).any() or not (read & 31).all():
        raise Damaged("entropy-coded data and image size differ")
    diff = (read >> 5).T.reshape(len(coded), height, width)
    first = 128 + np.cumsum(diff[:, :, 0], axis=1)
    diff = np.cumsum(diff, axis=2) - diff[:, :, :1] + first[:, :, None]
    return diff.astype(np.uint8).reshape(len(coded), height * width)


def shot_starts(samples: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which frames start a shot, and the histogram difference to the frame before (0 for an owner's first)."""
    n = len(samples)
    histogram = np.bincount((np.arange(n)[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    difference = np.zeros(n, np.int64)
    difference[1:] = np.abs(np.diff(histogram, axis=0)).sum(axis=1)
    first = np.ones(n, bool)
    first[1:] = owner[1:] != owner[:-1]
    difference[first] = 0
    began = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    low = np.maximum(began + 1, np.arange(n) - LOOK_BACK)
    low = np.minimum(low, np.arange(n))
    one, two = (np.concatenate([[0], np.cumsum(x)]) for x in (difference, difference * difference))
    count = np.maximum(1, np.arange(n) - low)
    mean = (one[:-1] - one[low]) / count
    deviation = np.sqrt(np.maximum(0.0, (two[:-1] - two[low]) / count - mean * mean))
    return first | (difference > mean + DEVIATIONS * deviation + FLOOR), difference


def _parts(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, values) of runs of rows that hold about ``limit`` bytes."""
    values = batch.column(column).cast(pa.binary())
    start, size, found = 0, 0, []
    for k in range(batch.num_rows):
        found.append(values[k].as_py() or b"")
        size += len(found[-1])
        if size >= limit or k == batch.num_rows - 1:
            yield batch.column(0)[start : k + 1], found
            start, size, found = k + 1, 0, []


PART_BYTES = 4_000_000


def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder()
    for batch in batches:
        for ids, texts in _parts(batch, 1, PART_BYTES):
            media = encoder.encode([t + bytes([FILL]) * (-len(t) % SAMPLES or (0 if t else SAMPLES)) for t in texts])
            yield pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary())], names=["doc_id", "media"])


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips array<struct<clip:int,first_frame:int,n_frames:int,start_s:double,stop_s:double>>"
_CLIP = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("stop_s", pa.float64())]))


def _features(ids: pa.Array, media: list[bytes], decoder: Decoder) -> pa.RecordBatch:
    files = [parse_avi(m) for m in media]
    owner = np.repeat(np.arange(len(files)), [len(f[3]) for f in files])
    samples = decoder.images([x for f in files for x in f[3]])
    starts, difference = shot_starts(samples, owner)
    columns: list[list] = [[] for _ in range(8)]
    at = 0
    for data, (_, _, rate, images) in zip(media, files, strict=True):
        n = len(images)
        payload = samples[at : at + n].tobytes()
        cuts = np.flatnonzero(starts[at : at + n]).tolist()
        clips = [{"clip": k, "first_frame": a, "n_frames": b - a, "start_s": a / rate, "stop_s": b / rate} for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], n], strict=True))]
        feature = f"frames={n};shots={len(cuts)};moved={int(difference[at : at + n].sum())};cuts={','.join(map(str, cuts[1:]))}"
        row = (len(payload.rstrip(bytes([FILL]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, clips)
        for column, value in zip(columns, row, strict=True):
            column.append(value)
        at += n
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _CLIP)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in FEATURES.split(", ")])


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = Decoder()
    for batch in batches:
        for ids, media in _parts(batch, 1, PART_BYTES):
            yield _features(ids, media, decoder)


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the text of every row as an AVI file."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(trimmed(store), "doc_id bigint, media binary")


def features(media: DataFrame) -> DataFrame:
    """What ``read`` finds in the stored bytes of (doc_id, media)."""
    return media.mapInArrow(trimmed(read), FEATURES)


def clip_rows(found: DataFrame) -> DataFrame:
    """One row per clip, timed."""
    return found.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
