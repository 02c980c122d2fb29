"""Media columns as MPEG transport streams (ISO/IEC 13818-1): writing, parsing and features.

A payload is cut into access units; each becomes a PES packet with a time stamp, carried in 188-byte packets of one
elementary stream behind a program association and a program map table. The parser needs nothing but the stored
bytes: it reads the tables, checks each packet's continuity counter, puts the PES packets together and gives the
elementary stream with its time stamps and random-access points.

Defined cases: a null or empty payload is stored as its padding; bytes that are no transport stream give an error
text instead of fields; packets that are lost or repeated are counted and the elementary bytes that are there are
returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID = 0x1000, 0x0100
PRIVATE_DATA = 0x06  # stream type: PES packets with private data
STREAM_ID = 0xBD
#: Payload bytes are padded to a multiple of this; an access unit is this many of them; every n-th is a random-access point.
PAD, UNIT, RANDOM_ACCESS = 576, 576 * 16, 4
#: Ticks of the 90 kHz clock from one access unit to the next.
TICKS = 3600


def _crc_table() -> np.ndarray:
    """CRC-32 of the tables: polynomial 0x04C11DB7, most significant bit first."""
    x = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        x = np.where(x >> np.uint32(31), (x << np.uint32(1)) ^ np.uint32(0x04C11DB7), x << np.uint32(1)).astype(np.uint32)
    return x


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    x = 0xFFFFFFFF
    for b in data:
        x = ((x << 8) & 0xFFFFFFFF) ^ int(_CRC[(x >> 24) ^ b])
    return x


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    """33 bits of a presentation time stamp with their marker bits."""
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _clock(pts: int) -> bytes:
    """Program clock reference: 33 bits of base, 6 reserved, 9 of extension."""
    return ((pts & 0x1FFFFFFFF) << 15 | 0x3F << 9).to_bytes(6, "big")


def write_stream(payload: bytes, unit: int = UNIT, every: int = RANDOM_ACCESS, ticks: int = TICKS) -> bytes:
    """The payload as a transport stream."""
    out, count = [_TABLES], 0
    for k, lo in enumerate(range(0, len(payload), unit)):
        part, pts = payload[lo : lo + unit], (k * ticks) & 0x1FFFFFFFF
        n = len(part) + 8
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (n if n <= 0xFFFF else 0).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + part
        # the first packet has an adaptation field with the clock and, at some units, the random-access flag
        field = bytes([0x10 | (0x40 if k % every == 0 else 0)]) + _clock(pts)
        room = PACKET - 4 - 1 - len(field)
        if len(pes) < room:
            field += b"\xff" * (room - len(pes))
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | count, len(field)]) + field + pes[: PACKET - 5 - len(field)])
        count, rest = (count + 1) & 15, pes[PACKET - 5 - len(field) :]
        whole = len(rest) // (PACKET - 4)
        if whole:
            packets = np.empty((whole, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            packets[:, 3] = 0x10 | (count + np.arange(whole)) & 15
            packets[:, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, -1)
            out.append(packets.tobytes())
            count = (count + whole) & 15
        if tail := rest[whole * (PACKET - 4) :]:  # stuffing fills the last packet
            fill = PACKET - 5 - len(tail)
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | count, fill]) + (b"\x00" + b"\xff" * (fill - 1) if fill else b"") + tail)
            count = (count + 1) & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds of its first elementary stream."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)  # PID to stream type
    lost: int = 0  # breaks of the continuity counter
    repeated: int = 0
    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)  # of each PES packet, -1 without one
    random_access: list[int] = field(default_factory=list)  # numbers of the PES packets that begin at one
    error: str = ""


def _sections(rows: np.ndarray, start: np.ndarray) -> bytes:
    """The bytes of the first section that the packets carry, put together."""
    got = b""
    for row, at in zip(rows, start):
        if row[1] & 0x40:
            if got:
                break
            at += 1 + int(row[at])
        elif not got:
            continue
        got += row[at:].tobytes()
        if len(got) >= 3 and len(got) >= 3 + (int.from_bytes(got[1:3], "big") & 0xFFF):
            break
    size = 3 + (int.from_bytes(got[1:3], "big") & 0xFFF) if len(got) >= 3 else 0
    got = got[:size] if len(got) >= size else b""
    return got if len(got) >= 12 and crc32_mpeg(got) == 0 else b""


def read_stream(data: bytes | None) -> Stream:
    """Parses a transport stream; .error says why it cannot be parsed."""
    out = Stream()
    if not data or len(data) % PACKET:
        out.error = "empty" if not data else "not whole packets"
        return out
    rows = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    out.packets = len(rows)
    if (rows[:, 0] != SYNC).any():
        out.error = "sync byte missing"
        return out
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    has_field, has_payload = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    start = np.where(has_field, 5 + rows[:, 4].astype(np.int32), 4)
    at = lambda p: np.flatnonzero((pid == p) & has_payload & (start < PACKET))
    pat = _sections(rows[at(0)], start[at(0)])
    if not pat or pat[0] != 0:
        out.error = "no program association table"
        return out
    for i in range(8, len(pat) - 4, 4):
        number, to = int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF
        if number:
            out.programs[number] = to
    for to in out.programs.values():
        pmt = _sections(rows[at(to)], start[at(to)])
        if not pmt or pmt[0] != 2:
            out.error = "no program map table"
            return out
        i = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
        while i + 5 <= len(pmt) - 4:
            out.streams[int.from_bytes(pmt[i + 1 : i + 3], "big") & 0x1FFF] = pmt[i]
            i += 5 + (int.from_bytes(pmt[i + 3 : i + 5], "big") & 0xFFF)
    if not out.streams:
        out.error = "no elementary stream"
        return out
    own = at(next(iter(out.streams)))
    counter = (rows[own, 3] & 15).astype(np.int32)
    step = (counter[1:] - counter[:-1]) & 15
    again = np.zeros(len(own), bool)
    again[1:] = (step == 0) & (rows[own[1:], 1:] == rows[own[:-1], 1:]).all(1)
    out.repeated, out.lost = int(again.sum()), int(((step != 1) & ~again[1:]).sum())
    own = own[~again]
    begins = rows[own, 1] & 0x40 > 0
    random_access = begins & has_field[own] & (rows[own, 4] > 0) & (rows[own, 5] & 0x40 > 0)
    heads = np.flatnonzero(begins)
    parts = []
    for n, (lo, hi) in enumerate(zip(heads, [*heads[1:], len(own)])):
        first = own[lo]
        head = rows[first, start[first] :].tobytes()
        if hi - lo > 1:
            some = own[lo + 1 : hi]
            if (start[some[:-1]] == 4).all():  # only the last can have stuffing
                head += rows[some[:-1], 4:].tobytes() + rows[some[-1], start[some[-1]] :].tobytes()
            else:
                head += b"".join(rows[j, start[j] :].tobytes() for j in some)
        if head[:3] != b"\x00\x00\x01" or len(head) < 9:
            out.error = "no PES header"
            return out
        size = int.from_bytes(head[4:6], "big")
        body = head[9 + head[8] : 6 + size if size else None]
        p = head[9:14]
        out.stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1 if head[7] & 0x80 and len(p) == 5 else -1)
        if random_access[lo]:
            out.random_access.append(n)
        parts.append(body)
    out.payload = b"".join(parts)
    return out


def padded(data: bytes, pad: int = PAD) -> bytes:
    """The bytes, then 255s up to a positive multiple of pad."""
    return data + b"\xff" * ((-len(data)) % pad or (0 if data else pad))


def feature_text(s: Stream) -> str:
    if s.error:
        return f"error={s.error}"
    return f"packets={s.packets};programs={len(s.programs)};streams={','.join(f'{p}:{t}' for p, t in s.streams.items())};lost={s.lost};repeated={s.repeated};units={len(s.stamps)};pts={s.stamps[0]}-{s.stamps[-1]};random_access={len(s.random_access)}"


def store_media(df: DataFrame, column: str, out: str = "media", pad: int = PAD) -> DataFrame:
    """Adds the column's bytes (text as UTF-8), padded, as a transport stream in `out`."""
    rest = [c for c in df.columns if c != out]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(column).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([write_stream(padded(x or b"", pad)) for x in raw], pa.binary())], [*rest, out])

    return df.mapInArrow(run, df.select(rest).schema.add(out, "binary"))


MEDIA = {"packets": T.LongType(), "lost": T.LongType(), "repeated": T.LongType(), "payload": T.BinaryType(), "stamps": T.ArrayType(T.LongType()), "random_access": T.ArrayType(T.IntegerType()), "error": T.StringType()}


def parse_media(df: DataFrame, column: str = "media", prefix: str = "ts_") -> DataFrame:
    """Adds the parsed fields (prefix + names of MEDIA) of a column of transport streams."""
    names = list(MEDIA)
    rest = [c for c in df.columns if c not in {prefix + n for n in names}]
    schema = df.select(rest).schema
    for name, kind in MEDIA.items():
        schema = schema.add(prefix + name, kind)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_stream(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array([getattr(s, n) for s in got], k) for n, k in zip(names, kinds))], [*rest, *(prefix + n for n in names)])

    return df.mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back and gives their digest columns."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                raw = raw or b""
                media = write_stream(padded(raw))
                s = read_stream(media)
                back = s.payload
                rows.append((i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(s)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DIGEST)
