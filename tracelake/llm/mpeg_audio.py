"""MPEG audio columns: parse streams of frames, and store bytes in such a stream.

`parsed` walks any byte string: it reads ID3 tags, finds frame headers (again after damage), reads Xing, Info and VBRI
tables, verifies the 16-bit checksum of protected frames (layers I and III) and yields exact duration and the byte
offset of every frame. `written` stores a payload losslessly: silent protected layer III frames carry it in the
bytes that follow their side information, where a decoder ignores them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from tracelake.llm.tables import slices, text_bytes

# Fixed values of the format: kbit/s by (MPEG-1 or not, layer) and sample rates by version bits.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
SAMPLE_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
CRC_POLYNOMIAL = 0x8005
SEEK_POINTS = 100  # of a Xing table


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    length: int
    samples: int
    mode: int
    extension: int

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def checked(self) -> int | None:
        """Bytes after the checksum that it covers; None where this depends on the coded data."""
        if self.layer == 3:
            return self.side
        if self.layer == 1:
            bound = 4 * (self.extension + 1) if self.mode == 1 else 32
            return (32 if self.mono else 2 * bound + 32 - bound) * 4 // 8
        return None


@lru_cache(1 << 14)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, None if they are none. Free-format streams are not read."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate_at, kbit_at = four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate_at == 3 or kbit_at in (0, 15):
        return None
    kbits, rate, padding = BITRATES[version == 3, layer][kbit_at], SAMPLE_RATES[version][rate_at], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12_000 * kbits // rate + padding) * 4 if layer == 1 else samples * 125 * kbits // rate + padding
    return Header(version, layer, not four[1] & 1, kbits, rate, four[3] >> 6 == 3, length, samples, four[3] >> 6,
                  four[3] >> 4 & 3)


@lru_cache(1 << 14)
def checksum(data: bytes) -> int:
    """The format's 16-bit checksum of the last two header bytes and what follows the checksum."""
    out = 0xFFFF
    for byte in data:
        out ^= byte << 8
        for _ in range(8):
            out = (out << 1 ^ CRC_POLYNOMIAL if out & 0x8000 else out << 1) & 0xFFFF
    return out


def syncsafe(four: bytes) -> int:
    return sum((b & 127) << 7 * (3 - i) for i, b in enumerate(four))


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)  # kind, frames, bytes, seek
    first: Header | None = None
    offsets: list[int] = field(default_factory=list)  # of audio frames
    lengths: list[int] = field(default_factory=list)
    kbits: set[int] = field(default_factory=set)
    samples: int = 0
    bad_checksums: int = 0
    unchecked: int = 0
    skipped: int = 0  # bytes that are neither frames nor tags
    resyncs: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.first.rate if self.first else 0.0


def id3_frames(body: bytes, version: int) -> dict[str, str]:
    """Text frames of an ID3v2.3 or 2.4 tag; the name of a TXXX frame is its description."""
    out, at = {}, 0
    while at + 10 <= len(body) and body[at]:
        name = body[at: at + 4].decode("latin-1")
        size = syncsafe(body[at + 4: at + 8]) if version == 4 else int.from_bytes(body[at + 4: at + 8], "big")
        data = body[at + 10: at + 10 + size]
        at += 10 + size
        if name[0] == "T" and data:
            text = data[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(data[0], 3)], "replace")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            out[name] = text.rstrip("\0")
    return out


def vbr_table(frame: bytes, head: Header) -> dict:
    """What a Xing, Info or VBRI frame says, {} if the frame is none."""
    at = 4 + 2 * head.protected + head.side
    for at in dict.fromkeys((at, 4 + head.side)):
        if (kind := frame[at: at + 4]) in (b"Xing", b"Info") and len(frame) >= at + 8:
            out, flags, at = {"kind": kind.decode()}, int.from_bytes(frame[at + 4: at + 8], "big"), at + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at = int.from_bytes(frame[at: at + 4], "big"), at + 4
            if flags & 4:
                out["seek"] = list(frame[at: at + SEEK_POINTS])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        table = frame[62: 62 + entries * width]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "frames_per_entry": per,
                "seek": [scale * int.from_bytes(table[i: i + width], "big") for i in range(0, len(table), max(width, 1))]}
    return {}


def parsed(data: bytes) -> Stream:
    """Everything `Stream` tells about a byte string; damaged parts are skipped up to the next two headers in step."""
    out, at, end, lost = Stream(), 0, len(data), False
    while data[at: at + 3] == b"ID3" and at + 10 <= end:
        size = syncsafe(data[at + 6: at + 10])
        out.tags |= id3_frames(data[at + 10: at + 10 + size], data[at + 3])
        at = min(end, at + 10 + size + 10 * bool(data[at + 5] & 16))
    if end - at >= 128 and data[end - 128: end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if text := data[end + a: end + b].split(b"\0")[0].decode("latin-1").strip():
                out.tags.setdefault(name, text)
    while at < end:
        head = header(data[at: at + 4])
        if head and at + head.length <= end and (at + head.length == end or not (lost or out.first is None)
                                                 or header(data[at + head.length: at + head.length + 4])):
            if out.first is None:
                out.first = head
                if head.layer == 3 and (table := vbr_table(data[at: at + head.length], head)):
                    out.table = table
                    at += head.length
                    continue
            if head.protected:
                size = head.checked
                if size is None:
                    out.unchecked += 1
                elif checksum(data[at + 2: at + 4] + data[at + 6: at + 6 + size]) != int.from_bytes(data[at + 4: at + 6], "big"):
                    out.bad_checksums += 1
            out.offsets.append(at)
            out.lengths.append(head.length)
            out.kbits.add(head.kbits)
            out.samples += head.samples
            at += head.length
            lost = False
        else:
            out.resyncs += not lost
            lost = True
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out.skipped += to - at
            at = to
    return out


MONO_32K = 0xC0  # mode byte; 32 kHz is rate index 2
ROOM = {k: (index, 144 * 1000 * k // 32000 - 4 - 2 - 17) for index, k in enumerate(BITRATES[True, 3]) if k}


@lru_cache(64)
def frame_start(index: int) -> bytes:
    """Header, checksum and side information of a silent mono frame of the bitrate with this index."""
    head = bytes([0xFF, 0xFA, index << 4 | 2 << 2, MONO_32K])
    return head + checksum(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


def text_frame(name: str, text: str) -> bytes:
    body = b"\3" + name.encode() + b"\0" + text.encode()
    return b"TXXX" + bytes(len(body) >> 7 * i & 127 for i in (3, 2, 1, 0)) + b"\0\0" + body


def written(payload: bytes) -> bytes:
    """A variable-bitrate stream that carries `payload`: tag, Xing table, full frames, the smallest frame for the rest."""
    full, room = ROOM[320]
    start = frame_start(full)
    parts = [start + payload[i: i + room] for i in range(0, len(payload) - room + 1, room)]
    if rest := payload[len(parts) * room:]:
        index, space = next(x for x in ROOM.values() if x[1] >= len(rest))
        parts.append(frame_start(index) + rest + bytes(space - len(rest)))
    body = text_frame("payload_bytes", str(len(payload))) + text_frame("payload_crc32", str(zlib.crc32(payload)))
    tag = b"ID3\4\0\0" + bytes(len(body) >> 7 * i & 127 for i in (3, 2, 1, 0)) + body
    index, space = ROOM[64]
    size = sum(map(len, parts))
    total = len(frame_start(index)) + space + size
    ends = [total - size]
    for part in parts:
        ends.append(ends[-1] + len(part))
    seek = bytes(min(255, 256 * ends[i * len(parts) // SEEK_POINTS] // total) for i in range(SEEK_POINTS))
    table = b"Xing" + (7).to_bytes(4, "big") + len(parts).to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    return b"".join([tag, frame_start(index), table, bytes(space - len(table)), *parts])


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that `written` stored; an error if a frame or the whole is damaged."""
    if stream.bad_checksums or stream.skipped or stream.table.get("frames") != len(stream.offsets):
        raise ValueError("damaged stream")
    out = b"".join(data[a + 23: a + n] for a, n in zip(stream.offsets, stream.lengths))[: int(stream.tags["payload_bytes"])]
    if zlib.crc32(out) != int(stream.tags["payload_crc32"]):
        raise ValueError("damaged payload")
    return out


def feature(stream: Stream) -> str:
    seek = hashlib.sha256(b"".join(x.to_bytes(8, "big") for x in stream.offsets)).hexdigest()[:16]
    return (f"frames={len(stream.offsets)} samples={stream.samples} rate={stream.first.rate if stream.first else 0} "
            f"kbits={min(stream.kbits, default=0)}-{max(stream.kbits, default=0)} table={stream.table.get('kind', '')} "
            f"bad={stream.bad_checksums} skipped={stream.skipped} seek={seek}")


def with_audio(files: DataFrame, content: str = "content") -> DataFrame:
    """files with a struct column `audio`: duration, frames, their byte offsets, tags, table kind and damage.

    Null or empty content, and content without frames, has no frames and a duration of 0; nothing fails on damage.
    A column named audio is replaced; other columns are kept.
    """
    kept = [f for f in files.schema.fields if f.name not in ("audio",)]
    kind = ("struct<seconds: double, samples: long, sample_rate: int, frames: long, offsets: array<long>, "
            "tags: map<string, string>, table: string, variable: boolean, bad_checksums: long, unchecked: long, "
            "skipped: long, resyncs: long>")
    struct_type = StructType.fromDDL(f"audio {kind}")["audio"].dataType

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column(content):
                s = parsed(x.as_py() or b"")
                rows.append({"seconds": s.seconds, "samples": s.samples, "sample_rate": s.first.rate if s.first else 0,
                             "frames": len(s.offsets), "offsets": s.offsets, "tags": list(s.tags.items()),
                             "table": s.table.get("kind"), "variable": len(s.kbits) > 1, "bad_checksums": s.bad_checksums,
                             "unchecked": s.unchecked, "skipped": s.skipped, "resyncs": s.resyncs})
            audio = pa.array(rows, pa.struct([
                ("seconds", pa.float64()), ("samples", pa.int64()), ("sample_rate", pa.int32()), ("frames", pa.int64()),
                ("offsets", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string())), ("table", pa.string()),
                ("variable", pa.bool_()), ("bad_checksums", pa.int64()), ("unchecked", pa.int64()),
                ("skipped", pa.int64()), ("resyncs", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), audio], [*(f.name for f in kept), "audio"])

    return files.select(*(f.name for f in kept)).mapInArrow(run, StructType([*kept, StructField("audio", struct_type)]))


def stored_texts(docs: DataFrame) -> DataFrame:
    """Store every text in an audio stream, read it back from there and describe the stream.

    docs: doc_id long, text string; other columns are ignored; one row per input row, so repeated rows give equal
    rows. A null text counts as empty: its payload is 64 zero bytes. Returns doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, seconds. Texts are stored whole, one stream each,
    however long. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rows = []
            for a, b in slices(offsets):
                for i in range(a, b):
                    text = data[offsets[i]: offsets[i + 1]].tobytes()
                    media = written(text + bytes(-len(text) % 64 if text else 64))
                    stream = parsed(media)
                    payload = payload_of(media, stream)
                    rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                                 len(media), hashlib.sha256(media).hexdigest(), feature(stream), stream.seconds))
            if rows:
                columns = [pa.array(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
             "feature", "seconds"]
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
             "media_sha256 string, feature string, seconds double")
