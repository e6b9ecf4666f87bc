"""Matroska media columns: EBML elements, clusters, lacing and cues read into packet tables, and a writer of PCM audio.

A packet is a frame of a block: track, timestamp in milliseconds, byte range in the stored form, and its cluster.
Elements of unknown size end where a parent's next element begins. Frame sizes come from fixed, Xiph or EBML lacing.

Rows: a null text or media is an empty one; an empty payload is stored as one frame of filling; equal payloads have
equal stored forms (no dates, no random ids), so repeated rows and ties give repeated results; a null id stays null; payloads are
stored whole, whatever their size, one in memory at a time; a damaged file raises ValueError with the byte offset; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import arrow_stage

# Element ids of the Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Elements that stand directly in a segment; one of them ends a cluster of unknown size.
TOP = {0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367}

FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER, SAMPLE_RATE = 576, 8, 64, 48_000
FRAME_MS = FRAME * 1000 // SAMPLE_RATE


class Packet(NamedTuple):
    track: int
    ms: int
    start: int
    size: int
    cluster: int
    key: bool


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, dict]
    cues: list[tuple[int, int, int]]
    clusters: int
    duration_ms: float | None


def _element_id(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    n = 9 - first.bit_length()
    if not 1 <= n <= 4 or at + n > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def _number(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length number and the place behind it; None if all its bits are set (unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no number at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"the number at byte {at} is cut off")
    value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, start: int, end: int, stop_at: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its content) of the elements in a byte range.

    stop_at: ids that end a parent of unknown size. An element of unknown size reaches to the range's end; its reader
    stops at the elements that can't be inside it and says so by sending that place.
    """
    at = start
    while at < end:
        kind, p = _element_id(data, at)
        if kind in stop_at:
            return
        size, p = _number(data, p)
        stop = end if size is None else p + size
        if stop > end:
            raise ValueError(f"the element at byte {at} is cut off")
        if size is None and kind == CLUSTER:
            stop = p
            for _, _, _, stop in elements(data, p, end, TOP):
                pass
        yield kind, at, p, stop
        at = stop


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins. lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return [end - at], at
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError(f"the frames at byte {at} aren't of one size")
        return [size] * count, at
    if lacing == 1:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(count - 1):
            n = 9 - data[at].bit_length()
            value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * n - 1) - 1))
            at += n
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError(f"the lace at byte {at} is longer than its block")
    return [*sizes, last], at


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def parse(data: bytes) -> Media:
    packets: list[Packet] = []
    tracks: dict[int, dict] = {}
    cues: list[tuple[int, int, int]] = []
    clusters, scale, duration = 0, 1_000_000, None

    def block(at: int, end: int, base: int, cluster: int, simple: bool) -> None:
        number, at = _number(data, at)
        ticks, flags = struct.unpack_from(">hB", data, at)
        sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
        step = tracks.get(number, {}).get("frame_ms", 0)
        for k, size in enumerate(sizes):
            packets.append(Packet(number, (base + ticks) * scale // 1_000_000 + k * step, at, size, cluster, bool(flags & 0x80) if simple else True))
            at += size

    for kind, _, a, b in elements(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        origin = a
        for kind, at, a, b in elements(data, a, b):
            if kind == INFO:
                for k, _, c, d in elements(data, a, b):
                    if k == SCALE:
                        scale = _uint(data, c, d)
                    elif k == DURATION:
                        duration = _float(data, c, d)
            elif kind == TRACKS:
                for _, _, c, d in (e for e in elements(data, a, b) if e[0] == TRACK):
                    got: dict = {}
                    for k, _, e, f in elements(data, c, d):
                        if k in (TRACK_NUMBER, TRACK_TYPE):
                            got["number" if k == TRACK_NUMBER else "type"] = _uint(data, e, f)
                        elif k == CODEC:
                            got["codec"] = data[e:f].decode("ascii", "replace")
                        elif k == 0x23E383:  # default duration of a frame, in nanoseconds
                            got["frame_ms"] = _uint(data, e, f) // 1_000_000
                        elif k == AUDIO:
                            for q, _, g, h in elements(data, e, f):
                                if q == RATE:
                                    got["rate"] = _float(data, g, h)
                                elif q in (CHANNELS, BIT_DEPTH):
                                    got["channels" if q == CHANNELS else "bits"] = _uint(data, g, h)
                    tracks[got.get("number", 0)] = got
            elif kind == CLUSTER:
                base = 0
                for k, _, c, d in elements(data, a, b):
                    if k == TIMESTAMP:
                        base = _uint(data, c, d)
                    elif k == SIMPLE_BLOCK:
                        block(c, d, base, clusters, True)
                    elif k == BLOCK_GROUP:
                        for q, _, e, f in elements(data, c, d):
                            if q == BLOCK:
                                block(e, f, base, clusters, False)
                clusters += 1
            elif kind == CUES:
                for _, _, c, d in (e for e in elements(data, a, b) if e[0] == CUE_POINT):
                    time = 0
                    for k, _, e, f in elements(data, c, d):
                        if k == CUE_TIME:
                            time = _uint(data, e, f)
                        elif k == CUE_POSITIONS:
                            got = {q: _uint(data, g, h) for q, _, g, h in elements(data, e, f)}
                            cues.append((time * scale // 1_000_000, got.get(CUE_TRACK, 0), origin + got.get(CUE_CLUSTER, 0)))
    return Media(packets, tracks, cues, clusters, None if duration is None else duration * scale / 1e6)


def _size(n: int) -> bytes:
    length = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _el(kind: int, content: bytes | int | float | str) -> bytes:
    if isinstance(content, int):
        content = content.to_bytes(max(1, (content.bit_length() + 7) // 8), "big")
    elif isinstance(content, float):
        content = struct.pack(">d", content)
    elif isinstance(content, str):
        content = content.encode()
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(content)) + content


_HEAD = _el(EBML, b"".join([_el(EBML_VERSION, 1), _el(EBML_READ_VERSION, 1), _el(EBML_MAX_ID, 4), _el(EBML_MAX_SIZE, 8), _el(DOC_TYPE, "matroska"), _el(DOC_VERSION, 4), _el(DOC_READ_VERSION, 2)]))
_AUDIO = _el(AUDIO, _el(RATE, float(SAMPLE_RATE)) + _el(CHANNELS, 1) + _el(BIT_DEPTH, 8))
_TRACKS = _el(TRACKS, _el(TRACK, b"".join([_el(TRACK_NUMBER, 1), _el(TRACK_UID, 1), _el(TRACK_TYPE, 2), _el(FLAG_LACING, 1), _el(0x23E383, FRAME_MS * 1_000_000), _el(CODEC, "A_PCM/INT/LIT"), _AUDIO])))


def mux(payload: bytes) -> bytes:
    """A file of one track of 8-bit mono samples; the payload's length must be a positive multiple of FRAME."""
    frames = len(payload) // FRAME
    info = _el(INFO, b"".join([_el(SCALE, 1_000_000), _el(DURATION, float(frames * FRAME_MS)), _el(MUXING_APP, "evigraph"), _el(WRITING_APP, "evigraph")]))
    at = len(info) + len(_TRACKS)
    parts, cues = [info, _TRACKS], []
    per_cluster = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, frames, per_cluster):
        blocks = [_el(TIMESTAMP, first * FRAME_MS)]
        for f in range(first, min(frames, first + per_cluster), FRAMES_PER_BLOCK):
            n = min(FRAMES_PER_BLOCK, frames - f)
            blocks.append(_el(SIMPLE_BLOCK, b"\x81" + struct.pack(">hBB", (f - first) * FRAME_MS, 0x84, n - 1) + payload[f * FRAME : (f + n) * FRAME]))
        cues.append(_el(CUE_POINT, _el(CUE_TIME, first * FRAME_MS) + _el(CUE_POSITIONS, _el(CUE_TRACK, 1) + _el(CUE_CLUSTER, at))))
        parts.append(_el(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(_el(CUES, b"".join(cues)))
    return _HEAD + _el(SEGMENT, b"".join(parts))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text in UTF-8) and media: the text's bytes, filled up with 255 to whole frames, as a file."""

    def rows(batches):
        for b in batches:
            for key, text in zip(b["k"], b["t"], strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                yield key, len(data), mux(data + b"\xff" * (-len(data) % FRAME if data else FRAME))

    return arrow_stage(df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")), f"`{id_col}` long, n_bytes long, media binary", rows)


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, packet, track, ms, start, size, cluster, key."""

    def rows(batches):
        for b in batches:
            for key, media in zip(b["k"], b["m"], strict=True):
                for n, p in enumerate(parse(media or b"").packets):
                    yield key, n, *p

    return arrow_stage(df.select(F.col(id_col).cast("long").alias("k"), F.col(media_col).alias("m")), f"`{id_col}` long, packet long, track long, ms long, start long, size long, cluster long, key boolean", rows)


def read_back(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per file, from its packet table: sizes, digests and features of the payload that its packets hold."""

    def rows(batches):
        for b in batches:
            for key, n_bytes, media in zip(b["k"], b["n"], b["m"], strict=True):
                got = parse(media or b"")
                payload = b"".join(media[p.start : p.start + p.size] for p in got.packets)
                samples = np.frombuffer(payload, np.uint8)
                level = 0 if not len(samples) else int(samples.astype(np.int64).sum()) * 1000 // len(samples)
                feature = f"tracks={len(got.tracks)};clusters={got.clusters};cues={len(got.cues)};packets={len(got.packets)};last_ms={got.packets[-1].ms if got.packets else 0};mean_milli={level}"
                yield key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    source = df.select(F.col(id_col).cast("long").alias("k"), F.col("n_bytes").alias("n"), F.col(media_col).alias("m"))
    return arrow_stage(source, f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", rows)


def query(spark, sf_dir: str) -> DataFrame:
    return read_back(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
