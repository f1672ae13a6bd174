"""Media columns: bytes as 8-bit sound in Matroska, and Matroska as packet tables.

Writing. ``store`` makes a file of an EBML header and one Segment: a seek head's place kept by a Void
element, Info, one track of unsigned 8-bit PCM, Clusters of laced SimpleBlocks, and Cues. Packets of
4,096 samples are laced eight to a block (EBML lacing where the last differs in size, fixed-size
lacing else), 16 blocks to a cluster.

Reading. ``packets`` parses any such file: variable-length ids and sizes, elements of unknown size
(Segment and Cluster end where an element of their own or a higher level begins), Void and unknown
elements (skipped), SimpleBlocks and BlockGroups, all four lacings (none, Xiph, fixed, EBML), and Cues. It
gives a row for each packet: track, timestamp in ns, byte range in the file, key frame; and the cue points.
A damaged element ends its parent there; whole packets before it are kept.

Defined results: null text is empty; an empty text is 64 zero bytes; repeated rows have a row each; an
empty table gives no row. A row's result depends on its text alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import derived

#: Element ids of the Matroska specification (RFC 9559).
EBML, VOID, CRC32, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS = 0x1A45DFA3, 0xEC, 0xBF, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1254C367, 0x1043A770, 0x1941A469
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {SEGMENT, EBML, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

SAMPLE_RATE = 8_000
PACKET, LACED, BLOCKS = 4_096, 8, 16
UNIT = 64


def number(value: int, width: int = 0) -> bytes:
    """A size as EBML writes it, in as few bytes as it takes (all ones are kept for an unknown size) or in ``width``."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(id: int, body: bytes) -> bytes:
    return id.to_bytes((id.bit_length() + 7) // 8, "big") + number(len(body)) + body


def unsigned(id: int, value: int) -> bytes:
    return element(id, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(id: int, value: float) -> bytes:
    return element(id, struct.pack(">d", value))


def lace(frames: list[memoryview | bytes], kind: int) -> bytes:
    """The lacing head of a block: the number of frames but one, and sizes as ``kind`` tells them."""
    sizes = [len(f) for f in frames]
    if kind == NO_LACE:
        return b""
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == FIXED:
        return head
    steps = [b - a for a, b in zip(sizes[:-1], sizes[1:-1], strict=False)]
    return head + (number(sizes[0]) if len(sizes) > 1 else b"") + b"".join(signed_number(d) for d in steps)


def signed_number(value: int) -> bytes:
    width = next(w for w in range(1, 9) if abs(value) < 1 << 7 * w - 1)
    return number(value + (1 << 7 * width - 1) - 1, width)


def block(track: int, relative: int, frames: list, kind: int, key: bool = True, simple: bool = True) -> bytes:
    flags = kind << 1 | (0x80 if key and simple else 0)
    return element(SIMPLE_BLOCK if simple else BLOCK, number(track) + relative.to_bytes(2, "big", signed=True) + bytes([flags]) + lace(frames, kind) + b"".join(frames))


def store(payload: bytes) -> bytes:
    """A Matroska file that holds ``payload`` as sound samples."""
    view = memoryview(payload)
    frames = [view[i : i + PACKET] for i in range(0, len(view), PACKET)]
    # One tick is a sample: 10**9 / 8000 ns. Block times are relative to the cluster's and fit 16 bits by scale.
    tick = 10**9 // SAMPLE_RATE * PACKET
    clusters, cues, at = [], [], 0
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(MAX_ID, 4) + unsigned(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ_VERSION, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, tick) + real(DURATION, len(payload) / PACKET) + element(MUXING_APP, b"gneiss") + element(WRITING_APP, b"gneiss"))
    sound = element(AUDIO, real(RATE, SAMPLE_RATE) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + unsigned(DEFAULT_DURATION, tick) + sound))
    front = element(VOID, bytes(32)) + info + tracks
    at = len(front)
    for c in range(0, len(frames), LACED * BLOCKS):
        body = [unsigned(TIMESTAMP, c)]
        for i in range(c, min(c + LACED * BLOCKS, len(frames)), LACED):
            laced = frames[i : i + LACED]
            kind = NO_LACE if len(laced) == 1 else FIXED if len(laced[-1]) == PACKET else EBML_LACE
            body.append(block(1, i - c, laced, kind))
        clusters.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, c) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    segment = b"".join([front, *clusters, element(CUES, b"".join(cues))])
    return head + element(SEGMENT, segment)


class Damaged(ValueError):
    pass


def read_id(data: memoryview, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise Damaged("id")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise Damaged("id")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_number(data: memoryview, at: int, end: int) -> tuple[int, int, int]:
    """A variable-length number, its width, and the place after it; -1 for an unknown size."""
    if at >= end or not data[at]:
        raise Damaged("size")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged("size")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), width, at + width


def children(data: memoryview, at: int, end: int, level: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, begin, body, end) of the elements of a parent. One of unknown size runs to the parent's end or its next peer."""
    while at < end:
        try:
            id, body = read_id(data, at, end)
            size, _, body = read_number(data, body, end)
        except Damaged:
            return
        if level == 1 and id == SEGMENT:
            return
        if size >= 0:
            stop = body + size
        else:
            stop = end
            if id == CLUSTER:
                for peer, begin, _, _ in children(data, body, end, 2):
                    if peer in TOP:
                        stop = begin
                        break
        if level == 2 and id in TOP:
            yield id, at, body, min(stop, end)
            return
        yield id, at, body, min(stop, end)
        at = stop


def integer(data: memoryview, body: int, end: int) -> int:
    return int.from_bytes(data[body:end], "big")


def frames_of(data: memoryview, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the frames' byte ranges of a block."""
    track, _, at = read_number(data, at, end)
    if at + 3 > end:
        raise Damaged("block")
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    kind = flags >> 1 & 3
    if kind == NO_LACE:
        return track, relative, flags, [(at, end)]
    if at >= end:
        raise Damaged("lacing")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise Damaged("lacing")
            sizes.append(size + data[at])
            at += 1
    elif kind == EBML_LACE and n > 1:
        size, _, at = read_number(data, at, end)
        sizes.append(size)
        for _ in range(n - 2):
            step, width, at = read_number(data, at, end)
            step = (1 << 7 * width) - 1 if step < 0 else step
            sizes.append(sizes[-1] + step - ((1 << 7 * width - 1) - 1))
    elif kind == FIXED:
        if (end - at) % n:
            raise Damaged("lacing")
        sizes = [(end - at) // n] * (n - 1)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise Damaged("lacing")
    out = []
    for size in [*sizes, rest]:
        out.append((at, at + size))
        at += size
    return track, relative, flags, out


def packets(media: bytes) -> tuple[list[tuple[int, int, int, int, bool]], list[tuple[int, int, int]], dict]:
    """Packets (track, timestamp ns, begin, end, key), cue points (ns, track, the cluster's place in the file), and the tracks by number."""
    data = memoryview(media)
    table: list[tuple[int, int, int, int, bool]] = []
    cues: list[tuple[int, int, int]] = []
    tracks: dict[int, dict] = {}
    for id, _, segment, segment_end in children(data, 0, len(data), 0):
        if id != SEGMENT:
            continue
        scale = 1_000_000
        for id, _, body, end in children(data, segment, segment_end, 1):
            if id == INFO:
                scale = next((integer(data, b, e) for i, _, b, e in children(data, body, end, 3) if i == TIMESTAMP_SCALE), scale)
            elif id == TRACKS:
                for i, _, b, e in children(data, body, end, 3):
                    if i == TRACK_ENTRY:
                        track = _track(data, b, e)
                        tracks[track["number"]] = track
            elif id == CLUSTER:
                _cluster(data, body, end, scale, tracks, table)
            elif id == CUES:
                for i, _, b, e in children(data, body, end, 3):
                    if i == CUE_POINT:
                        time, places = 0, []
                        for j, _, b2, e2 in children(data, b, e, 3):
                            if j == CUE_TIME:
                                time = integer(data, b2, e2)
                            elif j == CUE_POSITIONS:
                                places.append({k: integer(data, b3, e3) for k, _, b3, e3 in children(data, b2, e2, 3)})
                        cues += [(time * scale, p.get(CUE_TRACK, 0), segment + p.get(CUE_CLUSTER, 0)) for p in places]
    return table, cues, tracks


def _track(data: memoryview, body: int, end: int) -> dict:
    track = {"number": 0, "codec": "", "duration": 0, "rate": 0.0, "channels": 1, "bits": 0}
    for i, _, b, e in children(data, body, end, 3):
        if i == TRACK_NUMBER:
            track["number"] = integer(data, b, e)
        elif i == CODEC:
            track["codec"] = bytes(data[b:e]).decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            track["duration"] = integer(data, b, e)
        elif i == AUDIO:
            for j, _, b2, e2 in children(data, b, e, 3):
                if j == RATE:
                    track["rate"] = float(np.frombuffer(data[b2:e2], f">f{e2 - b2}")[0]) if e2 - b2 in (4, 8) else 0.0
                elif j in (CHANNELS, BIT_DEPTH):
                    track["channels" if j == CHANNELS else "bits"] = integer(data, b2, e2)
    return track


def _cluster(data: memoryview, body: int, end: int, scale: int, tracks: dict, table: list) -> None:
    time = 0
    for i, _, b, e in children(data, body, end, 3):
        if i == TIMESTAMP:
            time = integer(data, b, e)
        elif i in (SIMPLE_BLOCK, BLOCK_GROUP):
            key, found = None, (b, e) if i == SIMPLE_BLOCK else None
            if i == BLOCK_GROUP:
                key = True
                for j, _, b2, e2 in children(data, b, e, 3):
                    if j == BLOCK:
                        found = (b2, e2)
                    elif j == REFERENCE:
                        key = False
            if not found:
                continue
            try:
                track, relative, flags, frames = frames_of(data, *found)
            except Damaged:
                continue
            step = tracks.get(track, {}).get("duration", 0)
            key = bool(flags & 0x80) if key is None else key
            table.extend((track, (time + relative) * scale + k * step, lo, hi, key) for k, (lo, hi) in enumerate(frames))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def feature(payload: bytes, table: list, cues: list, tracks: dict) -> str:
    """What the stored sound is like: codec, rate, packets, cues, length, mean level, loudness, zero crossings."""
    x = np.frombuffer(payload, np.uint8)
    level = x.astype(np.float32) - np.float32(128)
    rms = float(np.sqrt(np.dot(level.astype(np.float64), level) / len(x)))
    crossings = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    t = tracks[1]
    return f"{t['codec']} {t['rate']:.0f} Hz {t['bits']} bit; packets {len(table)}; cues {len(cues)}; seconds {len(x) / t['rate']:.6f}; mean {int(x.sum(dtype=np.int64)) / len(x):.6f}; rms {rms:.6f}; crossings {crossings}"


def sound_columns(docs: DataFrame, id_column: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and the file, ``media``)."""
    added = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}

    def stored(texts: list) -> list[list]:
        rows = []
        for raw in texts:
            raw = raw or b""
            media = store(padded(raw))
            table, cues, tracks = packets(media)
            view = memoryview(media)
            payload = b"".join([view[lo:hi] for _, _, lo, hi, _ in table])
            rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, table, cues, tracks), *[media] * with_media))
        return [*map(list, zip(*rows, strict=True))]

    return derived(docs, [id_column], F.col(text).cast("binary"), added | ({"media": "binary"} if with_media else {}), lambda: stored)


def packet_tables(media: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """Files in a binary column -> a row a packet: id, packet, track, timestamp_ns, begin, end, key."""
    kind = "array<struct<track: long, timestamp_ns: long, begin: long, end: long, key: boolean>>"
    fields = ("track", "timestamp_ns", "begin", "end", "key")

    def parsed(files: list) -> list[list]:
        return [[[dict(zip(fields, x, strict=True)) for x in packets(file or b"")[0]] for file in files]]

    tables = derived(media, [id_column], F.col(column), {"packets": kind}, lambda: parsed, 50)
    return tables.toDF("id", "packets").select(F.col("id").alias(id_column), F.posexplode("packets").alias("packet", "p")).select(id_column, F.col("packet").cast("long").alias("packet"), "p.*")
