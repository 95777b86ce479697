"""MPEG audio columns: a resynchronising frame parser, and a lossless carrier that stores bytes in valid frames.

The parser reads any MPEG 1, 2 or 2.5 stream of layers I to III: it skips ID3 tags, finds frame headers, resumes after
damage at the next header whose successor is a header too, reads the variable-bitrate table of the first frame, checks
frame checksums and gives exact durations and seek offsets. The carrier writes a silent layer III stream whose frames
hold the payload where ancillary data stands, as players skip it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, table

# Fixed values of the MPEG audio format: kbit/s by (version 1 or not, layer) and header index; samples a second by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}

OWNER = b"payload\0"
RATE, SAMPLES = 44100, 1152
#: Header bytes of the carrier's frames: version 1, layer III, checksum present; the third byte takes the bitrate index.
CARRIER = (0xFF, 0xFA, 0xC0)
SIDE = 17  # side information of a mono frame, all zero: no audio data
HEAD = 4 + 2 + SIDE
SIZES = tuple(144 * k * 1000 // RATE for k in BITRATES[True, 3])
TOP = len(SIZES) - 1
TABLE_INDEX = 7  # the frame of the variable-bitrate table


def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return tuple(out)


CRC_TABLE = _crc_table()
_known: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF. Short inputs recur in each frame and are kept."""
    if (c := _known.get(data)) is None:
        c = 0xFFFF
        for b in data:
            c = (c << 8 ^ CRC_TABLE[c >> 8 ^ b]) & 0xFFFF
        if len(_known) < 4096:
            _known[data] = c
    return c


def _frame(index: int, body: bytes) -> bytes:
    head = bytes((CARRIER[0], CARRIER[1], index << 4, CARRIER[2]))
    side = bytes(SIDE)
    return b"".join((head, crc16(head[2:] + side).to_bytes(2, "big"), side, body, bytes(SIZES[index] - HEAD - len(body))))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """Payload as a tagged variable-bitrate stream: full frames at the top bitrate, the last at the least that fits."""
    room = SIZES[TOP] - HEAD
    sizes, frames = [], []
    for at in range(0, len(payload), room):
        body = payload[at : at + room]
        index = TOP if len(body) == room else next(i for i in range(1, TOP + 1) if SIZES[i] - HEAD >= len(body))
        frames.append(_frame(index, body))
        sizes.append(SIZES[index])
    total = SIZES[TABLE_INDEX] + sum(sizes)
    if frames:  # all but the last frame are equal in size
        seek = bytes(min(255, 256 * (SIZES[TABLE_INDEX] + (i * len(sizes) // 100) * sizes[0]) // total) for i in range(100))
    else:
        seek = bytes(100)
    info = b"Xing" + struct.pack(">III", 7, len(sizes), total) + seek
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag_frame = b"PRIV" + struct.pack(">IH", len(private), 0) + private
    return b"".join((b"ID3\x03\0\0", _syncsafe(len(tag_frame)), tag_frame, _frame(TABLE_INDEX, info), *frames))


def header(data: bytes, at: int) -> tuple[int, int, int, int, int, int] | None:
    """(version bits, layer, kbit/s, samples a second, frame bytes, header bytes before data) of a header at a place."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer, index, rate = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbit, hz, pad = BITRATES[version == 3, layer][index], RATES[version][rate], b2 >> 1 & 1
    if layer == 1:
        size = (12 * kbit * 1000 // hz + pad) * 4
    else:
        size = (144 if layer == 2 or version == 3 else 72) * kbit * 1000 // hz + pad
    mono = b3 >> 6 == 3
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    before = 4 + (0 if b1 & 1 else 2) + (side if layer == 3 else 0)
    return (version, layer, kbit, hz, size, before) if size > before else None


def protected(data: bytes, at: int, layer: int, before: int) -> bytes | None:
    """What a frame's checksum covers besides the header's last two bytes: side information in layer III, the bit allocation in
    layer I; null for layer II, whose extent depends on tables of allocations that aren't kept here."""
    if layer == 3:
        return data[at + 6 : at + before]
    if layer == 1:
        mode, bound = data[at + 3] >> 6, 4 * ((data[at + 3] >> 4 & 3) + 1)
        return data[at + 6 : at + 6 + (16 if mode == 3 else (32 + bound) // 2 if mode == 1 else 32)]
    return None


def table_of(data: bytes, at: int, before: int, size: int) -> dict | None:
    """The table of a variable-bitrate stream's first frame, if it holds one: its kind, the frames and bytes that it tells, null
    where it doesn't, and the bytes after the frame's begin at which its seek points stand."""
    if (kind := data[at + before : at + before + 4]) in (b"Xing", b"Info"):
        flags, place, told = int.from_bytes(data[at + before + 4 : at + before + 8], "big"), at + before + 8, []
        for flag in (1, 2):
            told.append(int.from_bytes(data[place : place + 4], "big") if flags & flag else None)
            place += 4 if flags & flag else 0
        marks = data[place : place + 100] if flags & 4 and place + 100 <= at + size else b""
        return {"kind": kind.decode().lower(), "frames": told[0], "bytes": told[1], "seek": [m * told[1] // 256 for m in marks] if told[1] is not None else []}
    if data[at + 36 : at + 40] == b"VBRI" and size >= 62:
        n_bytes, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        seek, upto = [], 0
        for k in range(entries if 62 + entries * width <= size and width else 0):
            seek.append(upto)
            upto += scale * int.from_bytes(data[at + 62 + k * width : at + 62 + (k + 1) * width], "big")
        return {"kind": "vbri", "frames": frames, "bytes": n_bytes, "seek": seek}
    return None


def _samples(version: int, layer: int) -> int:
    return 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576


def tags(data: bytes) -> tuple[int, int, list[tuple[bytes, bytes]]]:
    """(start of audio, end of audio, frames of the leading tag). A tag whose size is damaged ends with the data."""
    start, found = 0, []
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
        start, at = min(len(data), 10 + size), 10
        while at + 10 <= start and data[at : at + 4].strip(b"\0"):
            n = struct.unpack(">I", data[at + 4 : at + 8])[0]
            found.append((data[at : at + 4], data[at + 10 : min(start, at + 10 + n)]))
            at += 10 + n
    end = len(data) - 128 if len(data) >= start + 128 and data[-128:-125] == b"TAG" else len(data)
    return start, end, found


def parse(data: bytes | None) -> dict:
    """Everything the columns hold of one stream; a null or empty stream has no frames."""
    data = bytes(data or b"")
    start, end, found = tags(data)
    at, offsets, bad, checked, skipped, samples, kbits, first = start, [], 0, 0, 0, 0, {}, None
    bodies, told, synced = [], None, False
    while at + 4 <= end:
        h = header(data, at)
        # A header counts if the frame is whole and either follows a frame or has a header, or the end, right after it.
        if h and at + h[4] <= end and (first is None or h[:2] == first[:2] and h[3] == first[3]) and (synced or at + h[4] == end or header(data, at + h[4])):
            version, layer, kbit, hz, size, before = h
            first = first or h
            if not data[at + 1] & 1 and (covered := protected(data, at, layer, before)) is not None:
                checked += 1
                bad += crc16(data[at + 2 : at + 4] + covered) != int.from_bytes(data[at + 4 : at + 6], "big")
            table = table_of(data, at, before, size) if not offsets and told is None else None
            if table:
                told = table
            else:
                offsets.append(at)
                samples += _samples(version, layer)
                kbits[kbit] = kbits.get(kbit, 0) + 1
                bodies.append((at + before, at + size))
            at, synced = at + size, True
        else:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at
            at, synced = nxt, False
    private = next((v for k, v in found if k == b"PRIV" and v.startswith(OWNER)), None)
    payload, intact = None, None
    if private is not None and len(private) == len(OWNER) + 12:
        n, crc = struct.unpack(">QI", private[len(OWNER) :])
        payload = b"".join(data[a:b] for a, b in bodies)[:n]
        intact = len(payload) == n and zlib.crc32(payload) == crc
    return {
        "version": VERSIONS[first[0]] if first else None,
        "layer": first[1] if first else None,
        "sample_rate": first[3] if first else None,
        "frames": len(offsets),
        "samples": samples,
        "seconds": samples / first[3] if first else 0.0,
        "bitrates": ",".join(f"{k}x{n}" for k, n in sorted(kbits.items())),
        "table_kind": told and told["kind"],
        "table_frames": told and (-1 if told["frames"] is None else told["frames"]),
        "table_bytes": told and told["bytes"],
        "table_seek": told["seek"] if told else [],
        "checked_frames": checked,
        "bad_checksums": bad,
        "skipped_bytes": skipped,
        "tag_frames": len(found),
        "offsets": offsets,
        "payload": payload,
        "payload_intact": intact,
    }


PARSED = "version string, layer int, sample_rate int, frames long, samples long, seconds double, bitrates string, table_kind string, table_frames long, table_bytes long, table_seek array<long>, checked_frames long, bad_checksums long, skipped_bytes long, tag_frames int, offsets array<long>, payload binary, payload_intact boolean"


def store_payload(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Adds a column of streams that carry the binary payload column; a null payload is stored as an empty one."""
    ship(df.sparkSession)

    @F.pandas_udf(T.BinaryType())
    def carried(p: pd.Series) -> pd.Series:
        return pd.Series([encode(bytes(x) if x is not None else b"") for x in p], dtype=object)

    return df.withColumn(media, carried(F.col(payload)))


def probe_media(df: DataFrame, media: str = "media", parsed: str = "parsed") -> DataFrame:
    """Adds a struct column of what parse() finds in each stream."""

    @F.pandas_udf(PARSED)
    def probed(m: pd.Series) -> pd.DataFrame:
        rows = [parse(x) for x in m]
        return pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in (c.split()[0] for c in PARSED.split(", "))})

    return df.withColumn(parsed, probed(F.col(media)))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's padded text stored in MPEG frames, read back, with digests, stream features, the exact duration and the
    byte at which each frame begins. An empty table gives an empty result; only doc_id and text are read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_b"))
    n = F.octet_length("_b")
    padded = docs.select(
        "doc_id",
        n.cast("long").alias("n_bytes"),
        F.concat("_b", F.expr("cast(repeat(char(0), cast(if(length(_b) = 0, 64, pmod(-length(_b), 64)) as int)) as binary)")).alias("payload"),
    )
    parsed = probe_media(store_payload(padded, "payload").drop("payload"))
    p = F.col("parsed")
    return parsed.select(
        "doc_id",
        "n_bytes",
        F.octet_length(p.payload).cast("long").alias("payload_bytes"),
        F.sha2(p.payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(p.payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.format_string(
            "mpeg%s/layer%s %sHz frames=%s samples=%s kbit=%s table=%s checksums=%s/%s skipped=%s intact=%s last=%s",
            p.version, p.layer, p.sample_rate, p.frames, p.samples, p.bitrates, p.table_frames, p.checked_frames - p.bad_checksums, p.checked_frames, p.skipped_bytes, p.payload_intact, F.coalesce(F.try_element_at(p.offsets, F.lit(-1)), F.lit(-1)),
        ).alias("feature"),
        p.seconds.alias("seconds"),
        p.offsets.alias("offsets"),
    )
