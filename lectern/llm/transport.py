"""MPEG transport streams as a media column: written from payload bytes, and parsed again.

The parser reads any stream of 188-byte packets: it follows the program tables, checks continuity counters, puts the
elementary packets together, and keeps their timestamps and random-access points. Packets are handled as one numpy array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, slices

#: Fixed values of the format (ISO/IEC 13818-1): packet size and sync byte, the table's packet identifier, stream types.
PACKET, SYNC, PAT_PID, PRIVATE_TYPE, PRIVATE_STREAM = 188, 0x47, 0, 0x06, 0xBD
#: What the writer uses: identifiers, bytes of an elementary packet, 90 kHz ticks between them, and how many of them lie
#: between random-access points.
PMT_PID, DATA_PID, UNIT_BYTES, UNIT_TICKS, ACCESS_EVERY = 0x1000, 0x0100, 16_128, 3_600, 8


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables; 0 over a section with its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


#: The writer's two program tables never change.
_TABLES = _table_packet(PAT_PID, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _table_packet(
    PMT_PID, _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
)


def _stamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def _clock(ticks: int) -> bytes:
    return ((ticks & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")


def write_stream(payload: bytes) -> bytes:
    """payload as private elementary packets of one program; an empty payload gives the program tables alone."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data, ticks = payload[at : at + UNIT_BYTES], k * UNIT_TICKS
        unit = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\5" + _stamp(ticks) + data
        # the first packet of a random-access unit says so, and has the clock
        lead = b"\7\x50" + _clock(ticks) if k % ACCESS_EVERY == 0 else b""
        room = PACKET - 4 - len(lead)
        n = 1 + max(0, -(-(len(unit) - room) // (PACKET - 4)))
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        body = [b""] * 3  # the first packet, whole ones, and the last, which is filled up
        if n > 1:
            body = [unit[:room], unit[room : room + (n - 2) * (PACKET - 4)], unit[room + (n - 2) * (PACKET - 4) :]]
            if lead:
                packets[0, 3] |= 0x20
            packets[0, 4:] = np.frombuffer(lead + body[0], np.uint8)
            packets[1 : n - 1, 4:] = np.frombuffer(body[1], np.uint8).reshape(n - 2, PACKET - 4)
            lead = b""
        last = body[2] if n > 1 else unit
        if fill := PACKET - 4 - len(lead) - len(last):
            lead = bytes([len(lead) + fill - 1]) + (lead[1:] or b"\0"[: fill - 1]) + b"\xff" * (fill if lead else fill - 2)
        if lead:
            packets[n - 1, 3] |= 0x20
        packets[n - 1, 4:] = np.frombuffer(lead + last, np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Elementary:
    """An elementary stream: its units as (presentation ticks, decoding ticks, random access, data)."""

    pid: int
    kind: int
    program: int
    units: list[tuple[int | None, int | None, bool, bytes]] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        return b"".join(u[3] for u in self.units)


@dataclass
class Stream:
    """What parse_stream finds. errors: continuity errors by packet identifier; bad: packets or tables that are damaged."""

    packets: int = 0
    bad: int = 0
    errors: dict[int, int] = field(default_factory=dict)
    clocks: list[int] = field(default_factory=list)
    programs: dict[int, int] = field(default_factory=dict)
    streams: list[Elementary] = field(default_factory=list)


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _continuity_errors(headers: np.ndarray, has_payload: np.ndarray, jumps: np.ndarray) -> int:
    """Packets of one identifier whose counter is not the next one; a repeated packet may occur once."""
    counter = headers[:, 3] & 15
    step = (counter[1:].astype(int) - counter[:-1]) & 15
    fine = np.where(has_payload[1:], (step == 1) | (step == 0), step == 0)
    return int((~fine & ~jumps[1:]).sum())


def parse_stream(media: bytes) -> Stream:
    found = Stream(packets=len(media) // PACKET)
    packets = np.frombuffer(media, np.uint8, found.packets * PACKET).reshape(-1, PACKET)
    good = (packets[:, 0] == SYNC) & (packets[:, 1] < 0x80)
    found.bad = int((~good).sum()) + bool(len(media) % PACKET)
    packets = packets[good]
    pid = (packets[:, 1].astype(int) & 31) << 8 | packets[:, 2]
    control = packets[:, 3] >> 4 & 3
    adapted, has_payload = (control & 2) > 0, (control & 1) > 0
    begin = 4 + np.where(adapted, 1 + packets[:, 4].astype(int), 0)
    flags = np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)
    starts, access, jumps = (packets[:, 1] & 0x40) > 0, (flags & 0x40) > 0, (flags & 0x80) > 0
    for p in packets[(flags & 0x10) > 0]:
        found.clocks.append(int.from_bytes(p[6:12].tobytes(), "big") >> 15)

    def rows_of(which: int) -> np.ndarray:
        rows = np.flatnonzero(pid == which)
        if len(rows) > 1:
            found.errors[which] = _continuity_errors(packets[rows], has_payload[rows], jumps[rows])
            same = np.append(False, ((packets[rows[1:], 3] ^ packets[rows[:-1], 3]) & 15 == 0) & has_payload[rows[1:]] & has_payload[rows[:-1]])
            rows = rows[~same]  # a packet that is sent twice counts once
        else:
            found.errors[which] = 0
        return rows[has_payload[rows]]

    def joined(rows: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The payloads, and where each packet's begins."""
        at = np.minimum(begin[rows], PACKET)
        return packets[rows][np.arange(PACKET) >= at[:, None]].tobytes(), np.append(0, np.cumsum(PACKET - at))

    def sections(which: int, table: int) -> Iterator[bytes]:
        rows = rows_of(which)
        data, cuts = joined(rows)
        for at in cuts[:-1][starts[rows]].tolist():
            at += 1 + data[at] if at < len(data) else 1
            while at + 3 <= len(data) and data[at] == table:
                section = data[at : at + 3 + ((data[at + 1] & 15) << 8 | data[at + 2])]
                if section_crc(section) == 0:
                    yield section
                else:
                    found.bad += 1
                at += len(section)

    for section in sections(PAT_PID, 0):
        for i in range(8, len(section) - 4, 4):
            if program := section[i] << 8 | section[i + 1]:
                found.programs[program] = (section[i + 2] & 31) << 8 | section[i + 3]
    for program, table_pid in found.programs.items():
        for section in sections(table_pid, 2):
            i = 12 + ((section[10] & 15) << 8 | section[11])
            while i + 5 <= len(section) - 4:
                stream = Elementary((section[i + 1] & 31) << 8 | section[i + 2], section[i], program)
                if all(s.pid != stream.pid for s in found.streams):
                    found.streams.append(stream)
                i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])
    for stream in found.streams:
        rows = rows_of(stream.pid)
        data, cuts = joined(rows)
        first = np.flatnonzero(starts[rows])
        ends = np.append(cuts[first], len(data))[1:]
        for row, b, e in zip(rows[first].tolist(), cuts[first].tolist(), ends.tolist(), strict=True):
            head = data[b : b + 19]
            if len(head) < 9 or head[:3] != b"\0\0\1":
                found.bad += 1
                continue
            size = head[4] << 8 | head[5]
            shown = _read_stamp(head[9:14]) if head[7] & 0x80 else None
            decoded = _read_stamp(head[14:19]) if head[7] & 0xC0 == 0xC0 else shown
            stream.units.append((shown, decoded, bool(access[row]), data[b + 9 + head[8] : min(e, b + 6 + size) if size else e]))
    return found


def features(stream: Stream) -> str:
    """Counts, tables, continuity, timestamps and random-access points in one line of text."""
    units = [u for s in stream.streams for u in s.units]
    stamps = [u[0] for u in units if u[0] is not None]
    parts = {
        "packets": stream.packets, "bad": stream.bad, "programs": len(stream.programs), "streams": len(stream.streams), "units": len(units),
        "continuity_errors": sum(stream.errors.values()), "clocks": len(stream.clocks), "random_access": ",".join(str(u[0]) for u in units if u[2]),
        "first_pts": min(stamps, default=""), "last_pts": max(stamps, default=""),
    }
    return ";".join(f"{k}={v}" for k, v in parts.items())


def to_media(rows: DataFrame, *, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """doc_id and media: each row's payload (binary; null counts as empty) as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload"):
            media = [write_stream(p or b"") for p in part.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(payload_col).alias("payload")).mapInArrow(run, "doc_id long, media binary")


def from_media(rows: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, media, payload (of the first elementary stream, as read back), feature, and the stored timestamps:
    random_access (array of ticks) and continuity_errors. Null media counts as empty; broken packets are counted in the
    feature and left out. Each row is handled by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            read = [parse_stream(m or b"") for m in part.column("media").to_pylist()]
            columns = [
                pa.array([s.streams[0].payload if s.streams else b"" for s in read], pa.binary()),
                pa.array([features(s) for s in read], pa.string()),
                pa.array([[u[0] for x in s.streams for u in x.units if u[2]] for s in read], pa.list_(pa.int64())),
                pa.array([sum(s.errors.values()) for s in read], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("media"), *columns], names=["doc_id", "media", "payload", "feature", "random_access", "continuity_errors"])

    schema = "doc_id long, media binary, payload binary, feature string, random_access array<long>, continuity_errors long"
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def padded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 192) -> DataFrame:
    """doc_id and payload: the text as UTF-8 (null counts as empty), filled up with spaces to a positive multiple of unit."""
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.greatest(F.ceil(F.octet_length(bytes_) / unit), F.lit(1)).cast("int") * unit
    return id_and_text(docs, id_col, text_col).select("doc_id", F.octet_length(bytes_).cast("long").alias("n_bytes"), F.rpad(bytes_, size, F.lit(b" ")).alias("payload"))


def op8_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = padded(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload"):
            media = [write_stream(p) for p in part.column("payload").to_pylist()]
            read = [parse_stream(m) for m in media]
            columns = [pa.array(media, pa.binary()), pa.array([s.streams[0].payload for s in read], pa.binary()), pa.array([features(s) for s in read], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    rows = payloads.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(length(payload) - 15, 1), 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


QUERIES = {"op8_transport": op8_transport}
