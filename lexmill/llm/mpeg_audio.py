"""Media columns: bytes carried in MPEG audio, and a reader that indexes such streams.

The writer makes MPEG-1 layer III frames (mono, 32 kHz, with checksums) of silence, whose ancillary bytes hold the
payload: full frames at the highest bitrate and a last one at the least that suffices, so the stream has a variable
bitrate; an ID3v2 tag with the payload's length, a table of frames, bytes and 100 seek points in the first frame, and
an ID3v1 tag at the end. The reader resynchronises: a frame header counts if its fields are allowed and another header,
a tag or the end follows at its length; else it goes on by a byte. It parses the tags and the table, verifies every
checksum, and gives exact durations (samples, not bitrates) and the offset of every frame.

Cases: null reads as empty bytes, whose payload is 64 zero bytes; junk before and between frames is skipped and
counted; frames with a wrong checksum are counted and left out of the payload; a stream without frames has none; texts
of any length are stored whole; repeated rows give equal streams; an empty table gives no rows; columns of a result's
name are replaced and others left alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrays import text_buffers
from lexmill.session import save, ship_package, table

#: Fixed values of the format, in kbit/s and Hz: bitrates by layer (MPEG-1 I, II, III; MPEG-2 I, II and III), rates by version.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
RATE = 32000
SAMPLES = 1152
HEAD = 4 + 2 + 17
PAD = 64


class Header:
    """The fields of a 4-byte frame header that are needed; raises ValueError if they aren't allowed."""

    def __init__(self, word: bytes) -> None:
        a, b, c, d = word
        version, layer = (b >> 3) & 3, 4 - ((b >> 1) & 3)
        if a != 0xFF or b & 0xE0 != 0xE0 or version == 1 or layer == 4 or c >> 4 in (0, 15) or (c >> 2) & 3 == 3 or d & 3 == 2:
            raise ValueError("no frame header")
        first = version == 3
        self.protected = not b & 1
        self.kbits = BITRATES[1 if first else 2, layer][(c >> 4) - 1]
        self.rate = RATES[version][(c >> 2) & 3]
        self.layer, self.mono = layer, d >> 6 == 3
        pad = (c >> 1) & 1
        if layer == 1:
            self.samples, self.length = 384, (12000 * self.kbits // self.rate + pad) * 4
        else:
            self.samples = 1152 if first or layer == 2 else 576
            self.length = self.samples // 8 * 1000 * self.kbits // self.rate + pad
        self.side = (17 if self.mono else 32) if first else (9 if self.mono else 17)


def crc16(data: bytes) -> int:
    """The checksum of frames: polynomial x^16 + x^15 + x^2 + 1 from all ones."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _head(kbits: int, protected: bool = True) -> bytes:
    word = bytes([0xFF, 0xFA if protected else 0xFB, (BITRATES[1, 3].index(kbits) + 1) << 4 | 2 << 2, 0xC0])
    return word + (crc16(word[2:] + bytes(17)).to_bytes(2, "big") if protected else b"") + bytes(17)


def _room(kbits: int) -> int:
    return 144 * kbits * 1000 // RATE - HEAD


_TOP = BITRATES[1, 3][-1]


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % PAD or (0 if data else PAD))


def encode(payload: bytes) -> bytes:
    room = _room(_TOP)
    full, rest = divmod(len(payload), room)
    frames = np.zeros((full, room + HEAD), np.uint8)
    frames[:, :HEAD] = np.frombuffer(_head(_TOP), np.uint8)
    frames[:, HEAD:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    body, sizes = frames.tobytes(), [room + HEAD] * full
    if rest:
        kbits = next(k for k in BITRATES[1, 3] if _room(k) >= rest)
        body += _head(kbits) + payload[full * room :] + bytes(_room(kbits) - rest)
        sizes.append(_room(kbits) + HEAD)
    table_frame = 144 * 32 * 1000 // RATE
    at = np.concatenate([[0], np.cumsum(sizes)]) + table_frame
    seek = bytes(int(255 * at[k * len(sizes) // 100] // at[-1]) for k in range(100))
    info = _head(32, protected=False) + b"Xing" + struct.pack(">III", 15, len(sizes), int(at[-1])) + seek + struct.pack(">I", 0)
    info += bytes(table_frame - len(info))
    texts = [(b"TXXX", b"\0payload_bytes\0%d" % len(payload)), (b"TLEN", b"\0%d" % (len(sizes) * SAMPLES * 1000 // RATE))]
    tag = b"".join(k + struct.pack(">IH", len(v), 0) + v for k, v in texts)
    size = bytes((len(tag) >> s) & 0x7F for s in (21, 14, 7, 0))
    return b"ID3\3\0\0" + size + tag + info + body + b"TAG" + bytes(125)


def read_id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """The tag's length and its texts; (0, {}) if there is none."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0, {}
    end = 10 + sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    at, out = 10, {}
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        n = struct.unpack(">I", data[at + 4 : at + 8])[0]
        if data[4 - 1] == 4:  # version 2.4 counts seven bits a byte
            n = sum(b << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
        kind, body = data[at : at + 4].decode("latin-1"), data[at + 11 : at + 10 + n]
        name, _, value = body.partition(b"\0") if kind == "TXXX" else (b"", b"", body)
        if kind[0] == "T":
            out[f"{kind}:{name.decode('latin-1')}" if name else kind] = value.decode("latin-1")
        at += 10 + n
    return end, out


class Stream:
    """Frames, tags, table and payload of a stream."""

    def __init__(self, data: bytes) -> None:
        at, self.tags = read_id3v2(data)
        end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
        self.skipped = self.bad = self.samples = 0
        self.rate, self.seek, self.table, parts = 0, [], None, []
        known: dict[bytes, Header | None] = {}

        def header(i: int) -> Header | None:
            word = data[i : i + 4]
            if word not in known:
                try:
                    known[word] = Header(word) if len(word) == 4 else None
                except ValueError:
                    known[word] = None
            return known[word]

        checks: dict[bytes, bool] = {}
        synced = False
        while at < end:
            h = header(at)
            after = at + h.length if h else 0
            if not h or after > end or not (after == end or header(after) or (synced and not self.seek)):
                # within a damaged stream the next header isn't there: a frame that is alone is still taken if it checks
                if not (h and after <= end and h.protected and self._check(data, at, h, checks)):
                    nxt = data.find(b"\xff", at + 1, end)
                    self.skipped += (nxt if nxt >= 0 else end) - at
                    at = nxt if nxt >= 0 else end
                    continue
            synced = True
            if self.table is None and not self.seek and (info := self._info(data, at, h)):
                self.table = info
            else:
                self.rate = self.rate or h.rate
                self.samples += h.samples
                self.seek.append(at)
                if not h.protected or self._check(data, at, h, checks):
                    parts.append(data[at + 4 + 2 * h.protected + h.side : after])
                else:
                    self.bad += 1
            at = after
        n = self.tags.get("TXXX:payload_bytes", "")
        self.payload = b"".join(parts)[: int(n) if re.fullmatch(r"\d{1,15}", n) else None]

    @staticmethod
    def _check(data: bytes, at: int, h: Header, checks: dict[bytes, bool]) -> bool:
        """Layer III's checksum: the header's last two bytes and the side information. Others' isn't verified."""
        if h.layer != 3:
            return True
        covered = data[at + 2 : at + 6 + h.side]
        if covered not in checks:
            checks[covered] = crc16(covered[:2] + covered[4:]) == int.from_bytes(covered[2:4], "big")
            if len(checks) > 4096:
                checks.clear()
                return Stream._check(data, at, h, checks)
        return checks[covered]

    @staticmethod
    def _info(data: bytes, at: int, h: Header) -> dict | None:
        """The variable-bitrate table, in either of its two forms."""
        x = at + 4 + h.side
        if data[x : x + 4] in (b"Xing", b"Info"):
            flags, x, out = struct.unpack(">I", data[x + 4 : x + 8])[0], x + 8, {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = struct.unpack(">I", data[x : x + 4])[0]
                    x += 4
            out["seek"] = list(data[x : x + 100]) if flags & 4 else []
            return out
        if data[at + 36 : at + 40] == b"VBRI":
            size, frames, n, scale, width = struct.unpack(">IIHHH", data[at + 46 : at + 60])
            points = [scale * int.from_bytes(data[at + 62 + k * width : at + 62 + (k + 1) * width], "big") for k in range(n)]
            return {"frames": frames, "bytes": size, "seek": points}
        return None

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0

    def feature(self) -> str:
        crc = zlib.crc32(np.array(self.seek, "<i8").tobytes())
        return f"frames={len(self.seek)};samples={self.samples};rate={self.rate};duration_us={self.duration_us};table_frames={(self.table or {}).get('frames', -1)};bad={self.bad};skipped={self.skipped};seek_crc32={crc}"


def _store(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        data, at = text_buffers(batch)
        whole = data.tobytes()
        yield pa.array([encode(padded(whole[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


_FIELDS = [
    ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()),
    ("feature", pa.string()),
    ("duration_us", pa.int64()),
    ("seek_offsets", pa.list_(pa.int64())),
]
_MEDIA = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string,duration_us:bigint,seek_offsets:array<bigint>>"


def _describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = []
        for value in batch:
            data = value.as_py() or b""
            s = Stream(data)
            rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), s.feature(), s.duration_us, s.seek))
        columns = list(zip(*rows, strict=True)) or [[] for _ in _FIELDS]
        yield pa.StructArray.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def store_audio(docs: DataFrame, text_col: str = "text", name: str = "media") -> DataFrame:
    """``docs`` with each text's bytes as an MPEG audio stream (binary)."""
    ship_package(docs.sparkSession)
    return docs.withColumn(name, F.arrow_udf(_store, "binary")(F.col(text_col)))


def describe_audio(media: DataFrame, media_col: str = "media", name: str = "audio") -> DataFrame:
    """``media`` with what the reader finds in each stream: payload digests, durations, seek offsets and a feature line."""
    ship_package(media.sparkSession)
    return media.withColumn(name, F.arrow_udf(_describe, _MEDIA)(F.col(media_col)))


def op8_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """Every document stored as MPEG audio in the shared folder, read back and described."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = save(store_audio(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media"), "media", compression="zstd")
    return describe_audio(stored).select("doc_id", "n_bytes", *[f"audio.{n}" for n, _ in _FIELDS])
