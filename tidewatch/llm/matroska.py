"""Matroska (EBML) media columns: payloads stored as Matroska files, files read into packet tables.

The reader parses variable-length ids and sizes (unknown sizes too), clusters, simple blocks and
block groups, all four kinds of lacing and the cues, and gives a table of packets: timestamp,
track and byte range. The writer makes files of 8-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts_of, walk

# Element ids of the format, fixed values.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, FLAG_LACING = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
_TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

#: A frame's samples (and so bytes), samples a second, frames in a block, blocks in a cluster.
FRAME, RATE, LACED, BLOCKS = 576, 48_000, 8, 64
PACKETS = "track int, timestamp_ns long, offset long, size long, keyframe boolean, cluster int, block int"


# -- reading

def vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int, int]:
    """(value, next position, length) of a variable-length number; with ``marker`` the marker bit stays, as in ids."""
    first = data[at]
    if first == 0:
        raise ValueError(f"no number of up to 8 bytes at {at}")
    length = 9 - first.bit_length()
    if at + length > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + length], "big")
    return (value if marker else value & ((1 << 7 * length) - 1)), at + length, length


def element(data: bytes, at: int, end: int) -> tuple[int, int, int, bool]:
    """(id, start of its data, end of its data, whether its size is known)."""
    number, at, _ = vint(data, at, marker=True)
    size, at, length = vint(data, at)
    if size == (1 << 7 * length) - 1:
        return number, at, end, False
    if at + size > end:
        raise ValueError(f"element {number:#x} at {at} goes on past its parent")
    return number, at, at + size, True


def children(data: bytes, at: int, end: int):
    while at < end:
        number, begin, stop, known = element(data, at, end)
        yield number, begin, stop, known, at
        at = stop


def _uint(data: bytes, begin: int, stop: int) -> int:
    return int.from_bytes(data[begin:stop], "big")


def _float(data: bytes, begin: int, stop: int) -> float:
    return struct.unpack(">f" if stop - begin == 4 else ">d", data[begin:stop])[0] if stop > begin else 0.0


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    doc_type: str = ""
    tracks: dict = field(default_factory=dict)
    cues: list = field(default_factory=list)  # (time, track, cluster position)
    clusters: list = field(default_factory=list)  # (position in the segment, time)
    packets: list = field(default_factory=list)  # as PACKETS


def laces(data: bytes, at: int, stop: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes and where the first frame starts."""
    if kind == NO_LACING:
        return [stop - at], at
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED_LACING:
        if (stop - at) % count:
            raise ValueError("frames of a fixed lace differ in size")
        return [(stop - at) // count] * count, at
    for k in range(count - 1):
        if kind == XIPH_LACING:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, at, length = vint(data, at)
            size = value if k == 0 else sizes[-1] + value - ((1 << (7 * length - 1)) - 1)
        sizes.append(size)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    return sizes, at


def _block(data: bytes, begin: int, stop: int, media: Media, time: int, key: bool | None, length: int | None) -> None:
    track, at, _ = vint(data, begin)
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    sizes, at = laces(data, at + 3, stop, flags >> 1 & 3)
    each = media.tracks.get(track, {}).get("default_duration") or (length * media.scale // len(sizes) if length else 0)
    number = media.packets[-1][6] + 1 if media.packets else 0
    for k, size in enumerate(sizes):
        media.packets.append((track, (time + relative) * media.scale + k * each, at, size, bool(flags & 0x80) if key is None else key, len(media.clusters) - 1, number))
        at += size


def _cluster(data: bytes, begin: int, stop: int, known: bool, media: Media) -> int:
    """Parses a cluster; returns where it ends, which a cluster of unknown size shows only by what follows."""
    time = 0
    for number, a, b, _, at in children(data, begin, stop):
        if not known and number in _TOP:
            return at
        if number == TIMESTAMP:
            time = _uint(data, a, b)
            media.clusters[-1] = (media.clusters[-1][0], time)
        elif number == SIMPLE_BLOCK:
            _block(data, a, b, media, time, None, None)
        elif number == BLOCK_GROUP:
            inner = {n: (x, y) for n, x, y, _, _ in children(data, a, b)}
            length = _uint(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None
            if BLOCK in inner:
                _block(data, *inner[BLOCK], media, time, REFERENCE_BLOCK not in inner, length)
    return stop


def _tracks(data: bytes, begin: int, stop: int, media: Media) -> None:
    for number, a, b, _, _ in children(data, begin, stop):
        if number != TRACK_ENTRY:
            continue
        own = {n: (x, y) for n, x, y, _, _ in children(data, a, b)}
        audio = {n: (x, y) for n, x, y, _, _ in children(data, *own[AUDIO])} if AUDIO in own else {}
        media.tracks[_uint(data, *own[TRACK_NUMBER])] = {
            "type": _uint(data, *own[TRACK_TYPE]) if TRACK_TYPE in own else 0,
            "codec": data[slice(*own[CODEC_ID])].decode() if CODEC_ID in own else "",
            "default_duration": _uint(data, *own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0,
            "rate": _float(data, *audio[SAMPLING_FREQUENCY]) if SAMPLING_FREQUENCY in audio else 0.0,
            "channels": _uint(data, *audio[CHANNELS]) if CHANNELS in audio else 1,
            "depth": _uint(data, *audio[BIT_DEPTH]) if BIT_DEPTH in audio else 0,
        }


def _cues(data: bytes, begin: int, stop: int, media: Media) -> None:
    for number, a, b, _, _ in children(data, begin, stop):
        if number != CUE_POINT:
            continue
        time = 0
        for n, x, y, _, _ in children(data, a, b):
            if n == CUE_TIME:
                time = _uint(data, x, y)
            elif n == CUE_TRACK_POSITIONS:
                own = {k: _uint(data, p, q) for k, p, q, _, _ in children(data, x, y)}
                media.cues.append((time, own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER_POSITION, 0)))


def parse(data: bytes) -> Media:
    """Everything of the file but the frames' bytes; raises ValueError if it isn't Matroska."""
    media, at = Media(), 0
    while at < len(data):
        number, begin, stop, known = element(data, at, len(data))
        if at == 0 and number != EBML:
            raise ValueError("not an EBML file")
        if number == EBML:
            for n, a, b, _, _ in children(data, begin, stop):
                if n == DOC_TYPE:
                    media.doc_type = data[a:b].decode()
        elif number == SEGMENT:
            inner = begin
            while inner < stop:
                n, a, b, sized = element(data, inner, stop)
                if n == INFO:
                    for m, x, y, _, _ in children(data, a, b):
                        if m == TIMESTAMP_SCALE:
                            media.scale = _uint(data, x, y)
                        elif m == DURATION:
                            media.duration = _float(data, x, y)
                elif n == TRACKS:
                    _tracks(data, a, b, media)
                elif n == CLUSTER:
                    media.clusters.append((inner - begin, 0))
                    b = _cluster(data, a, b, sized, media)
                elif n == CUES:
                    _cues(data, a, b, media)
                inner = b
        at = stop
    return media


# -- writing

def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def size_vint(value: int, length: int = 0) -> bytes:
    need = max(1, -(-(value + 1).bit_length() // 7))  # all ones is kept for the unknown size
    length = max(length, need)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def make(number: int, data: bytes) -> bytes:
    return _id(number) + size_vint(len(data)) + data


def make_uint(number: int, value: int) -> bytes:
    return make(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Lace header and frames."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == XIPH_LACING:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == EBML_LACING:
        for k, f in enumerate(frames[:-1]):
            if k == 0:
                head += size_vint(len(f))
            else:
                delta, length = len(f) - len(frames[k - 1]), 1
                while not -(1 << 7 * length - 1) < delta < 1 << 7 * length - 1:
                    length += 1
                head += (delta + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return head + b"".join(frames)


def mux(payload: bytes, kind: int = FIXED_LACING, frame: int = FRAME, rate: int = RATE) -> bytes:
    """A file with one track of unsigned 8-bit PCM whose samples are the payload's bytes."""
    step_ns = frame * 1_000_000_000 // rate
    step = step_ns // 1_000_000
    frames = [payload[k : k + frame] for k in range(0, len(payload), frame)]
    per_block = 1 if kind == NO_LACING else LACED
    head = make(EBML, make_uint(0x4286, 1) + make_uint(0x42F7, 1) + make_uint(0x42F2, 4) + make_uint(0x42F3, 8) + make(DOC_TYPE, b"matroska") + make_uint(0x4287, 4) + make_uint(0x4285, 2))
    info = make(INFO, make_uint(TIMESTAMP_SCALE, 1_000_000) + make(DURATION, struct.pack(">d", float(step * len(frames)))) + make(0x4D80, b"tidewatch") + make(0x5741, b"tidewatch"))
    audio = make(AUDIO, make(SAMPLING_FREQUENCY, struct.pack(">d", float(rate))) + make_uint(CHANNELS, 1) + make_uint(BIT_DEPTH, 8))
    entry = make_uint(TRACK_NUMBER, 1) + make_uint(TRACK_UID, 1) + make_uint(TRACK_TYPE, 2) + make_uint(FLAG_LACING, int(kind != NO_LACING)) + make_uint(DEFAULT_DURATION, step_ns) + make(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts, at, cues = [info, make(TRACKS, make(TRACK_ENTRY, entry))], 0, b""
    at = sum(map(len, parts))
    per_cluster = per_block * BLOCKS
    for c in range(0, len(frames), per_cluster):
        blocks = [make_uint(TIMESTAMP, c * step)]
        for b in range(c, min(c + per_cluster, len(frames)), per_block):
            some = frames[b : min(b + per_block, c + per_cluster)]
            laced = kind if len(some) > 1 else NO_LACING
            block = size_vint(1) + struct.pack(">h", (b - c) * step)
            if len(some) == per_block:
                blocks.append(make(SIMPLE_BLOCK, block + bytes([0x80 | laced << 1]) + lace(some, laced)))
            else:
                blocks.append(make(BLOCK_GROUP, make(BLOCK, block + bytes([laced << 1]) + lace(some, laced)) + make_uint(BLOCK_DURATION, len(some) * step)))
        cues += make(CUE_POINT, make_uint(CUE_TIME, c * step) + make(CUE_TRACK_POSITIONS, make_uint(CUE_TRACK, 1) + make_uint(CUE_CLUSTER_POSITION, at)))
        parts.append(make(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    body = b"".join([*parts, make(CUES, cues)])
    return head + make(SEGMENT, body)


# -- operators

def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table: one row per frame with its id, track, timestamp and byte range in the file.

    A null or empty file has no packets. A file that can't be read gives one row with the reason in
    ``fault`` and nulls elsewhere; ``fault`` is null in all other rows. Repeated rows give repeated packets.
    """
    cols = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    fields = T.StructType.fromDDL(PACKETS).fields
    schema = T.StructType([cols.schema["id"], *fields, T.StructField("fault", T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, out = [], []
        for k, data in enumerate(batch.column(1).to_pylist()):
            try:
                got = [(*p, None) for p in parse(data).packets] if data else []
            except (ValueError, IndexError, KeyError, struct.error) as fault:  # what broken bytes make of sizes, offsets and tracks
                got = [(*[None] * len(fields), f"{type(fault).__name__}: {fault}")]
            rows += [k] * len(got)
            out += got
        if not out:
            return None
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], schema.names)

    return walk(cols, run, schema, "media").withColumnRenamed("id", id_col)


def padded(text: str | None, unit: int = FRAME) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b"\xff" * (max(unit, -(-len(data) // unit) * unit) - len(data)), len(data)


def read_back(data: bytes) -> tuple[bytes, Media]:
    """The payload by the packet table's byte ranges; the cues must lead to the clusters."""
    media = parse(data)
    if [(c[0], c[2]) for c in media.cues] != [(t, p) for p, t in media.clusters]:
        raise ValueError("cues and clusters differ")
    return b"".join(data[p[2] : p[2] + p[3]] for p in media.packets), media


def feature_of(payload: bytes, media: Media) -> str:
    samples = np.frombuffer(payload, np.uint8)
    track = media.tracks[1]
    return f"{track['codec']}@{track['rate']:.0f}:packets={len(media.packets)},blocks={media.packets[-1][6] + 1},clusters={len(media.clusters)},cues={len(media.cues)},last_ns={media.packets[-1][1]},sum={int(samples.sum(dtype=np.int64))},peak={int(samples.max())}"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", store: bool = False) -> DataFrame:
    """Each text as a Matroska file, read back: sizes, digests and features; with ``store`` the file itself in ``media``.

    Null is the empty text; a payload is never empty, as it is padded to one frame at least. Equal
    texts give equal values. Row for row; null ids stay; an empty table gives no rows.
    """
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    fields += [("media", T.BinaryType())] if store else []
    schema = T.StructType([cols.schema["id"], *(T.StructField(n, t) for n, t in fields)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts_of(batch.column(1)):
            payload, n = padded(text)
            data = mux(payload)
            got, media = read_back(data)
            if got != payload:
                raise ValueError("the payload read back differs")
            row = (n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(got, media))
            rows.append((*row, data) if store else row)
        kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True))], schema.names)

    return walk(cols, run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_matroska": query}
SQL: dict[str, str] = {}
