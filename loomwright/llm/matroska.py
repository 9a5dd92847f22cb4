"""Matroska media columns: EBML elements, clusters, lacing and cues read into packet tables.

``packets`` turns a binary column of Matroska files into one row for each packet (track, timestamp, byte range), and
``write`` makes such files from 8-bit samples.  The query stores every text as samples, reads the stored bytes back
through the same parser and reports digests of what came out.

Defined cases: null media have no packets; a damaged or truncated file gives the packets before the damage and its
``damage`` text; elements within elements deeper than ``DEPTH``, integers of over 8 bytes and times beyond 64 bits are
damage; a null text is stored as an empty one (192 spaces); equal texts give equal files; there is no length
limit beyond that of a value; only the key and the payload are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import table

#: Element ids of the Matroska specification (RFC 9559) and of EBML (RFC 8794).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, VOID, CRC32 = 0x114D9B74, 0xEC, 0xBF
#: Elements that hold others; at the top level they also end a cluster or segment of unknown size.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD}
INTEGERS = {TIMESTAMP, TIMESTAMP_SCALE, CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION, TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION}

#: Bytes (samples at 8 kHz) of a packet, packets of a laced block, blocks of a cluster.
FRAME, LACED, BLOCKS = 192, 64, 8
RATE = 8000
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: Elements that a block lies within at most (a segment, a cluster and a group, with room for masters in masters).
DEPTH = 16


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], how: int) -> bytes:
    """The part of a block after its flags."""
    if how == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if how == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif how == EBML_LACING:
        head += vint(len(frames[0]))
        for before, f in zip(frames, frames[1:-1], strict=False):
            step = len(f) - len(before)
            width = next(w for w in range(1, 9) if abs(step) < 1 << 7 * w - 1)
            head += vint(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], how: int, number: int = SIMPLE_BLOCK) -> bytes:
    flags = how << 1 | (0x80 if number == SIMPLE_BLOCK else 0)
    return element(number, vint(track) + struct.pack(">hB", relative, flags) + lace(frames, how))


def write(payload: bytes, how: int | None = None) -> bytes:
    """Samples (a positive multiple of FRAME bytes) as a Matroska file with one PCM track, laced blocks and cues; by
    default the three kinds of lacing take turns."""
    ms = FRAME * 1000 // RATE
    frames = [payload[at : at + FRAME] for at in range(0, len(payload), FRAME)]
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"loomwright") + element(WRITING_APP, b"loomwright") + element(DURATION, struct.pack(">d", len(frames) * ms)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, ms * 1_000_000) + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    for first in range(0, len(frames), LACED * BLOCKS):
        start, inside = first * ms, []
        for k in range(first, min(first + LACED * BLOCKS, len(frames)), LACED):
            part = frames[k : min(k + LACED, first + LACED * BLOCKS)]
            turn = (XIPH, FIXED, EBML_LACING)[k // LACED % 3] if how is None else how
            inside.append(block(1, k * ms - start, part, turn if len(part) > 1 else NO_LACING))
        cluster = element(CLUSTER, uint(TIMESTAMP, start) + b"".join(inside))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


class Damage(ValueError):
    pass


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise Damage(f"no element at {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise Damage(f"no element at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_vint(data: bytes, at: int, end: int) -> tuple[int | None, int, int]:
    """Value (None: unknown), where it ends, its width."""
    if at >= end or not data[at]:
        raise Damage(f"no size at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damage(f"no size at {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width, width


@dataclass
class Media:
    """What a file holds; a packet is (track, timestamp in ns, offset, size, keyframe, cluster, place in its block)."""

    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    duration: float = 0.0
    doc_type: str = ""
    damage: str = ""


def sizes_of(data: bytes, at: int, end: int, how: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if how == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Damage(f"no lace at {at}")
    n, at = data[at] + 1, at + 1
    if how == FIXED:
        if (end - at) % n:
            raise Damage(f"uneven lace at {at}")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if how == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise Damage(f"no lace at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            value, at, width = read_vint(data, at, end)
            value = (1 << 7 * width) - 1 if value is None else value
            size = value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Damage(f"lace beyond its block at {at}")
    return [*sizes, last], at


def parse(data: bytes | None) -> Media:
    """All packets of a file, in the order in which they are stored."""
    found = Media()
    if data is None:
        return found
    try:
        walk(data, 0, len(data), found, {"segment": 0, "time": 0, "track": {}, "cue": {}, "key": None})
    except Damage as e:
        found.damage = str(e)
    return found


def walk(data: bytes, at: int, end: int, found: Media, state: dict, within: int = 0, depth: int = 0) -> int:
    if depth > DEPTH:
        raise Damage(f"elements too deep at {at}")
    while at < end:
        began = at
        number, at = read_id(data, at, end)
        if within == CLUSTER and number in TOP:  # ends a cluster of unknown size
            return began
        size, at, _ = read_vint(data, at, end)
        stop = end if size is None else at + size
        if stop > end:
            if number in (SEGMENT, CLUSTER):
                walk(data, at, end, found, state | {"segment": at} if number == SEGMENT else opened(found, state, began), number, depth + 1)
            raise Damage(f"element at {began} is cut off")
        if number == SEGMENT:
            state["segment"] = at
        if number == CLUSTER:
            opened(found, state, began)
        if number in MASTERS:
            if number == TRACK_ENTRY:
                state["track"] = {}
            if number == CUE_POINT:
                state["cue"] = {}
            if number == BLOCK_GROUP:
                state["key"], state["at"] = True, len(found.packets)
            at = walk(data, at, stop, found, state, number if size is None and number == CLUSTER else 0, depth + 1)
            if number == TRACK_ENTRY:
                found.tracks[state["track"].get("number", 0)] = state["track"]
            if number == CUE_POINT:
                found.cues.append((state["cue"].get("time", 0), state["cue"].get("track", 0), state["cue"].get("cluster", 0)))
            if number == BLOCK_GROUP:
                found.packets[state["at"] :] = [(*p[:4], state["key"], *p[5:]) for p in found.packets[state["at"] :]]
            continue
        if number in (SIMPLE_BLOCK, BLOCK):
            read_block(data, at, stop, found, state, number == SIMPLE_BLOCK)
        else:
            if number in INTEGERS and stop - at > 8:
                raise Damage(f"integer of {stop - at} bytes at {began}")
            leaf(number, data[at:stop] if stop - at <= 4096 else b"", found, state)
        at = stop
    return at


def opened(found: Media, state: dict, began: int) -> dict:
    found.clusters.append(began - state["segment"])
    state["time"] = 0
    return state


def leaf(number: int, body: bytes, found: Media, state: dict) -> None:
    whole = int.from_bytes(body, "big")
    real = (lambda: struct.unpack(">d" if len(body) == 8 else ">f", body)[0] if len(body) in (4, 8) else 0.0)
    if number == TIMESTAMP:
        state["time"] = whole
    elif number == TIMESTAMP_SCALE:
        found.scale = whole
    elif number == DURATION:
        found.duration = real()
    elif number == DOC_TYPE:
        found.doc_type = body.rstrip(b"\0").decode("ascii", "replace")
    elif number == REFERENCE:
        state["key"] = False
    elif number in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
        state["cue"][{CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER_POSITION: "cluster"}[number]] = whole
    elif number in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION):
        state["track"][{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "frame_ns"}[number]] = whole
    elif number == CODEC_ID:
        state["track"]["codec"] = body.decode("ascii", "replace")
    elif number == SAMPLING_FREQUENCY:
        state["track"]["rate"] = real()


def read_block(data: bytes, at: int, end: int, found: Media, state: dict, simple: bool) -> None:
    track, at, _ = read_vint(data, at, end)
    if at + 3 > end or track is None:
        raise Damage(f"block cut off at {at}")
    relative, flags = struct.unpack_from(">hB", data, at)
    sizes, at = sizes_of(data, at + 3, end, flags >> 1 & 3)
    time = (state["time"] + relative) * found.scale
    step, cluster = found.tracks.get(track, {}).get("frame_ns", 0), len(found.clusters) - 1
    if max(abs(time), abs(time + len(sizes) * step)) >> 63:
        raise Damage(f"time beyond 64 bits at {at}")
    for k, size in enumerate(sizes):
        found.packets.append((track, time + k * step, at, size, bool(flags & 0x80) if simple else True, cluster, k))
        at += size
    found.blocks += 1


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """A track's samples, from the packets' byte ranges."""
    return b"".join(data[p[2] : p[2] + p[3]] for p in media.packets if p[0] == track)


PACKETS = "media_id long, packet long, track long, timestamp_ns long, byte_start long, byte_length long, keyframe boolean, cluster int, laced_at int, codec string, cued boolean, damage string"


def packets(media: DataFrame, key: str = "media_id", content: str = "content") -> DataFrame:
    """The packet table of a binary column; a file that holds no packet gives no row, unless it is damaged: then one
    row with null packet columns and the damage."""

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PACKETS.split(", ")]
        for batch in batches:
            for one, data in zip(batch["media_id"], batch["content"], strict=True):
                found = parse(data)
                cued = {position for _, _, position in found.cues}
                rows = [(one, i, *p, found.tracks.get(p[0], {}).get("codec"), p[5] >= 0 and found.clusters[p[5]] in cued, found.damage or None) for i, p in enumerate(found.packets)]
                if not rows and found.damage:
                    rows = [(one, *[None] * 10, found.damage)]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({c: "Int64" for c in ("media_id", "packet", "track", "timestamp_ns", "byte_start", "byte_length")} | {"cluster": "Int32", "laced_at": "Int32", "keyframe": "boolean", "cued": "boolean"})

    return media.select(F.col(key).cast("long").alias("media_id"), F.col(content).alias("content")).mapInPandas(tables, PACKETS)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * ((-len(raw)) % FRAME if raw else FRAME)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_cued long, last_timestamp_ns long, packets_sha256 string"


def table_digest(media: Media) -> str:
    """SHA-256 of the packet table's numbers: track, timestamp, start, length, keyframe, cluster and place in its block of
    each packet, little-endian 64-bit."""
    return hashlib.sha256(np.array(media.packets, "<i8").tobytes()).hexdigest()


def digest(text: str | None) -> tuple:
    n, payload = padded(text)
    stored = write(payload)
    media = parse(stored)
    back = payload_of(stored, media)
    samples = np.frombuffer(back, "u1")
    track, cued = media.tracks.get(1, {}), {position for _, _, position in media.cues}
    feature = f"codec={track.get('codec')};rate={track.get('rate', 0):.0f};bits={track.get('bits')};clusters={len(media.clusters)};blocks={media.blocks};packets={len(media.packets)};cues={len(media.cues)};ms={media.duration:.0f};mean={int(samples.sum(dtype='u8')) * 1000 // max(1, len(samples))};peak={int(samples.max(initial=0))}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(media.packets), sum(p[5] >= 0 and media.clusters[p[5]] in cued for p in media.packets), media.packets[-1][1], table_digest(media)


def store_texts(docs: DataFrame) -> DataFrame:
    """Digests of each text's stored form and of what its packets give back."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        for batch in batches:
            out = pd.DataFrame([(d, *digest(t)) for d, t in zip(batch["doc_id"], batch["text"], strict=True)], columns=names)
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(rows, DIGESTS)


def op3_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
