"""Media columns: Matroska files written to and parsed from binary columns.

A text's payload (UTF-8, padded with spaces to a positive multiple of 192 bytes) is stored as 8-bit mono PCM: one track,
blocks of ``FRAME`` = 192 samples, several frames laced in each block, blocks in clusters, clusters indexed by cues. The
reader knows nothing of the writer: it walks EBML elements with variable-length ids and sizes, SimpleBlocks and
BlockGroups, all four lacing kinds, elements of unknown size and unknown ids, and returns packets with track, timestamp,
byte range and key flag, plus the cue table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import per_text

#: Samples of a frame, and what payloads are padded to.
FRAME = 192
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 16
RATE = 8000
#: Nanoseconds of one tick of a timestamp.
TICK = 1_000_000
#: Levels of elements that the reader goes down; the format has fewer.
DEEPEST = 32

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x2AD7B1, 0x4489, 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
DOC_TYPE, REFERENCE = 0x4282, 0xFB
_PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS, AUDIO}
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


# Writing


def _size(n: int) -> bytes:
    """A size in as few bytes as hold it; all ones is kept for unknown."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(code: int, data: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + _size(len(data)) + data


def _uint(code: int, n: int) -> bytes:
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(code: int, x: float) -> bytes:
    import struct

    return element(code, struct.pack(">d", x))


def block(track: int, ticks: int, frames: list[bytes], lacing: int = 2, key: bool = True) -> bytes:
    """A SimpleBlock's data. lacing: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if len(frames) == 1:
        lacing = 0
    head = _size(track) + ticks.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | lacing << 1])
    if lacing:
        head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = 1
            while not -(1 << 7 * width - 1) < b - a < (1 << 7 * width - 1):
                width += 1
            head += ((1 << 7 * width) | (b - a + (1 << 7 * width - 1) - 1)).to_bytes(width, "big")
    return head + b"".join(frames)


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(FRAME, -(-len(text) // FRAME) * FRAME), b" ")


def write(payload: bytes) -> bytes:
    """A Matroska file whose one audio track holds the payload as unsigned 8-bit samples."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    per_frame = FRAME * 1000 // RATE  # 24 ticks of a millisecond
    head = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, TICK) + _float(DURATION, float(len(frames) * per_frame)) + element(0x4D80, b"trellisgraph") + element(0x5741, b"trellisgraph"))
    audio = element(AUDIO, _float(SAMPLING, float(RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, per_frame * TICK) + audio))
    clusters, cues, at = [], [], len(info) + len(tracks)
    per_cluster = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, len(frames), per_cluster):
        part = [_uint(TIMESTAMP, first * per_frame)]
        for i in range(first, min(first + per_cluster, len(frames)), FRAMES_PER_BLOCK):
            part.append(element(SIMPLE_BLOCK, block(1, (i - first) * per_frame, frames[i : min(i + FRAMES_PER_BLOCK, first + per_cluster)])))
        clusters.append(element(CLUSTER, b"".join(part)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, first * per_frame) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return head + element(SEGMENT, info + tracks + b"".join(clusters) + element(CUES, b"".join(cues)))


# Reading


@dataclass
class Media:
    doc_type: str = ""
    scale: int = TICK
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, offset, size, key flag, cluster, lacing)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    #: (time in ns, track, offset of the cluster in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    #: Offset of every cluster in the file.
    clusters: list[int] = field(default_factory=list)


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """(value, width, next offset) of a variable-length number; ``keep`` leaves the length marker in (ids)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("cut off in a variable-length number")
    value = int.from_bytes(data[at : at + width], "big")
    return value if keep else value - (1 << 7 * width), width, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, its offset, start and end of its data) of each child. A child of unknown size ends where its level does."""
    while at < end:
        begin = at
        code, _, at = vint(data, at, keep=True)
        size, width, at = vint(data, at)
        stop = at + size
        if size == (1 << 7 * width) - 1:
            stop = end if code != CLUSTER else _open_end(data, at, end)
        if stop > end:
            raise ValueError(f"element {code:x} at byte {begin} is cut off")
        yield code, begin, at, stop
        at = stop


def _open_end(data: bytes, at: int, end: int) -> int:
    """End of a cluster of unknown size: the next element of the segment's level."""
    while at < end:
        code, _, body = vint(data, at, keep=True)
        if code in _TOP:
            return at
        size, _, body = vint(data, body)
        at = body + size
    return end


def laces(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if not lacing:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("fixed-size lacing does not divide the block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, width, at = vint(data, at)
            size = value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing exceeds the block")
    return sizes, at


def parse(data: bytes) -> Media:
    """Tables of a Matroska file: tracks, packets and cues."""
    out, base = Media(), 0

    def number(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def real(a: int, b: int) -> float:
        import struct

        if b - a not in (0, 4, 8):
            raise ValueError(f"a float of {b - a} bytes")
        return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0

    def packets(a: int, b: int, cluster_time: int, key: bool | None) -> None:
        track, _, at = vint(data, a)
        ticks, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
        sizes, at = laces(data, at + 3, b, flags >> 1 & 3)
        step = out.tracks.get(track, {}).get("default_duration", 0)
        for i, size in enumerate(sizes):
            out.packets.append((track, (cluster_time + ticks) * out.scale + i * step, at, size, bool(flags & 0x80) if key is None else key, len(out.clusters) - 1, flags >> 1 & 3))
            at += size

    def walk(at: int, end: int, state: dict, depth: int = 0) -> None:
        nonlocal base
        if depth > DEEPEST:
            raise ValueError(f"elements nested more than {DEEPEST} deep")
        for code, begin, a, b in elements(data, at, end):
            if code == SEGMENT:
                base = a
            if code == CLUSTER:
                out.clusters.append(begin)
                state["time"] = 0
            inner = {} if code in (TRACK, CUE_POINT, BLOCK_GROUP) else state
            if code in (SIMPLE_BLOCK, BLOCK, BLOCK_GROUP) and "time" not in state:
                raise ValueError(f"a block outside a cluster at byte {begin}")
            if code == BLOCK_GROUP:
                inner = {"time": state["time"], "key": not any(c[0] == REFERENCE for c in elements(data, a, b))}
            if code in _PARENTS:
                walk(a, b, inner, depth + 1)
            if code == TRACK:
                out.tracks[inner.get("number", 0)] = inner
            elif code == CUE_POINT:
                out.cues.append((inner.get("cue", 0) * out.scale, inner.get("cue_track", 0), base + inner.get("cue_at", 0)))
            elif code == DOC_TYPE:
                out.doc_type = data[a:b].decode()
            elif code == TIMESTAMP_SCALE:
                out.scale = number(a, b)
            elif code == DURATION:
                out.duration = real(a, b)
            elif code == TIMESTAMP:
                state["time"] = number(a, b)
            elif code == SIMPLE_BLOCK:
                packets(a, b, state["time"], None)
            elif code == BLOCK:
                packets(a, b, state["time"], state.get("key", False))
            elif code == CODEC:
                state["codec"] = data[a:b].decode()
            elif code == SAMPLING:
                state["rate"] = real(a, b)
            else:
                name = {TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "default_duration", CUE_TIME: "cue", CUE_TRACK: "cue_track", CUE_CLUSTER: "cue_at"}.get(code)
                if name:
                    state[name] = number(a, b)

    walk(0, len(data), {})
    return out


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's packets, joined in the order of their timestamps."""
    own = sorted((p for p in media.packets if p[0] == track), key=lambda p: p[1])
    return b"".join(data[p[2] : p[2] + p[3]] for p in own)


def feature(data: bytes, media: Media, stored: bytes) -> str:
    """A summary of the tables and the signal: shape of the file, then mean and energy of the samples."""
    import numpy as np

    track = media.tracks[1]
    signal = np.frombuffer(stored, np.uint8).astype(np.int64)
    indexed = len({c[2] for c in media.cues} & set(media.clusters))
    crossings = int(np.count_nonzero((signal[1:] >= 128) != (signal[:-1] >= 128)))
    return (
        f"{media.doc_type};{track['codec']};{track['rate']:.0f}Hz;{track['channels']}ch;{track['bits']}bit;packets={len(media.packets)};laced={sum(p[6] > 0 for p in media.packets)};"
        f"clusters={len(media.clusters)};cues={indexed};ms={media.packets[-1][1] // TICK + FRAME * 1000 // RATE};sum={int(signal.sum())};energy={int((signal * signal).sum())};crossings={crossings}"
    )


def packet_table(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, packets): for each row the packets of a binary Matroska column; null and unreadable files give null."""
    schema = "packets array<struct<track: bigint, timestamp_ns: bigint, offset: bigint, size: bigint, key: boolean, cluster: bigint, lacing: bigint>>"
    names = ("track", "timestamp_ns", "offset", "size", "key", "cluster", "lacing")

    def make():
        def one(data: bytes):
            try:
                media = parse(data)
            except (ValueError, IndexError):
                return None
            return [dict(zip(names, p, strict=True)) for p in media.packets] if data else None

        return lambda rows: {"packets": [one(r) for r in rows]}

    return per_text(files, schema, make, [id_col], data_col, binary=True)


def media_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text stored as a Matroska file in a binary column."""

    def make():
        return lambda texts: {"n_bytes": [len(t) for t in texts], "media": [write(payload_of(t)) for t in texts]}

    return per_text(docs, "n_bytes bigint, media binary", make, [id_col], text_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row.

    Each text is stored and the stored bytes are parsed again; the payload columns come from the packets read back. Null
    and empty texts are stored as one frame of spaces. Equal texts give equal values.
    """
    schema = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def make():
        def one(text: bytes) -> tuple:
            stored = write(payload_of(text))
            media = parse(stored)
            back = samples(stored, media)
            return (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(stored, media, back))

        names = [c.split()[0] for c in schema.split(", ")]
        return lambda texts: dict(zip(names, map(list, zip(*map(one, texts), strict=True)), strict=True))

    return per_text(docs, schema, make, [id_col], text_col)
