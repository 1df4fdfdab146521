"""MPEG audio media columns: frames, tags, variable-bitrate tables, checksums, seek offsets.

``parse`` reads any MPEG-1/2/2.5 Layer I to III stream: it skips ID3v2 and APE tags and ID3v1,
finds the first frame, walks from header to header, resynchronises after damage, reads Xing/Info
and VBRI tables, verifies the CRC-16 of protected frames of each layer (over what that layer
protects) and gives the exact duration as samples over rate and the byte offset of every frame.
Free-format frames, whose headers do not tell their length, count as skipped bytes. ``encode`` wraps bytes in a legal Layer III stream: silent
frames whose ancillary bytes carry them, behind an ID3v2 tag and an Info table, so any player
accepts the file and ``payload`` gives the bytes back.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table[i] = c & 0xFFFF
    return table


_CRC = _crc_table()


def crc16(columns: np.ndarray) -> np.ndarray:
    """CRC-16 (0x8005, from 0xFFFF) of each row of a byte matrix."""
    crc = np.full(columns.shape[0], 0xFFFF, np.uint16)
    for i in range(columns.shape[1]):
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)) ^ columns[:, i]]
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """CRC-16 (0x8005, from 0xFFFF) of the first ``bits`` bits."""
    crc = 0xFFFF
    for byte in data[: bits // 8]:
        crc = (crc << 8 & 0xFFFF) ^ int(_CRC[crc >> 8 ^ byte])
    for k in range(bits % 8):
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15 ^ data[bits // 8] >> 7 - k) & 1 else 0)
    return crc


#: Layer II: bits of a band's allocation, by table; a table has as many as it has bands.
_ALLOCATION = (
    [4] * 11 + [3] * 12 + [2] * 4, [4] * 11 + [3] * 12 + [2] * 7, [4] * 2 + [3] * 6, [4] * 2 + [3] * 10, [4] * 4 + [3] * 7 + [2] * 19,
)


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    length: int
    samples: int
    mono: bool
    bound: int = 32  # bands from here on share their allocation between channels

    @property
    def bands(self) -> list[int]:
        """Bits of the allocation of each band of Layer I or II."""
        if self.layer == 1:
            return [4] * 32
        each = self.kbps if self.mono else self.kbps // 2
        if self.version != 3:
            return _ALLOCATION[4]
        if each >= 56 and (self.rate == 48000 or each <= 80):
            return _ALLOCATION[0]
        if each >= 96:
            return _ALLOCATION[1]
        return _ALLOCATION[2 if self.rate != 32000 else 3]

    def protected_bits(self, frame: bytes) -> int:
        """Bits after the CRC that it covers: side information in Layer III; bit allocation in Layer
        I; bit allocation and, for each band that has bits, scale factor selection in Layer II."""
        if self.layer == 3:
            return 8 * self.side
        channels, at, used = 2 - self.mono, 48, 0
        word = int.from_bytes(frame, "big")
        for band, bits in enumerate(self.bands):
            fields = channels if band < self.bound else 1
            for _ in range(fields):
                used += (word >> len(frame) * 8 - at - bits & (1 << bits) - 1 > 0) * (channels if fields < channels else 1)
                at += bits
        return at - 48 + (2 * used if self.layer == 2 else 0)

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_HEADERS: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The frame header in a big-endian 32-bit word, or None if it is none (free format included)."""
    if word in _HEADERS:
        return _HEADERS[word]
    version, layer_bits = word >> 19 & 3, word >> 17 & 3
    rate, kind, pad = word >> 10 & 3, word >> 12 & 15, word >> 9 & 1
    found = None
    if word >> 21 == 0x7FF and version != 1 and layer_bits and rate != 3 and 0 < kind < 15 and word & 3 != 2:
        layer, hz = 4 - layer_bits, _RATES[version][rate]
        kbps = _KBPS[1 if version == 3 else 2, layer][kind - 1]
        if layer == 1:
            length, samples = (12000 * kbps // hz + pad) * 4, 384
        else:
            samples = 576 if layer == 3 and version != 3 else 1152
            length = samples // 8 * 1000 * kbps // hz + pad
        bound = ((word >> 4 & 3) + 1) * 4 if word >> 6 & 3 == 1 else 32
        found = Header(version, layer, not word >> 16 & 1, kbps, hz, length, samples, word >> 6 & 3 == 3, bound)
    if len(_HEADERS) < 1 << 16:
        _HEADERS[word] = found
    return found


@dataclass
class Stream:
    """What ``parse`` found. ``offsets`` and ``lengths`` are of the audio frames, without the
    table's own frame; ``crc_ok`` and ``crc_bad`` count protected frames; ``skipped`` are bytes that
    belong to no frame or tag; ``tags`` names the tags with their sizes."""

    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    samples: int = 0
    rate: int = 0
    layer: int = 0
    kbps: tuple[int, ...] = ()
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: tuple[tuple[str, int], ...] = ()
    table: dict = field(default_factory=dict)

    @property
    def duration(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _word(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "big")


def _tag_at(data: bytes, at: int, end: int) -> tuple[str, int] | None:
    """A tag that starts here: name and size, header and footer included."""
    head = data[at : at + 32]
    if head[:3] == b"ID3" and len(head) >= 10 and max(head[6:10]) < 128:
        size = head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]
        return "id3v2", min(end - at, size + (20 if head[5] & 16 else 10))
    if head[:8] == b"APETAGEX" and len(head) == 32:
        size = int.from_bytes(head[12:16], "little") + (32 if head[23] & 128 else 0)
        return "ape", min(end - at, max(32, size))
    return None


def _table(data: bytes, at: int, h: Header) -> dict:
    """Xing, Info or VBRI table in a frame."""
    x = at + 4 + 2 * h.protected + h.side
    for x in (x, at + 4 + h.side):
        if data[x : x + 4] in (b"Xing", b"Info"):
            flags, spot, out = _word(data, x + 4), x + 8, {"kind": data[x : x + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = _word(data, spot)
                    spot += 4
            if flags & 4:
                out["toc"] = bytes(data[spot : spot + 100])
            return out
    if data[at + 36 : at + 40] == b"VBRI":
        return {"kind": "VBRI", "bytes": _word(data, at + 46), "frames": _word(data, at + 50)}
    return {}


def _chains(data: bytes, at: int, end: int, like: Header | None) -> bool:
    """Whether a frame starts here: its header is sound, fits the stream and is followed by another
    header, by a tag or by the end."""
    h = header(_word(data, at)) if at + 4 <= end else None
    if h is None or at + h.length > end or (like and (h.version, h.layer, h.rate) != (like.version, like.layer, like.rate)):
        return False
    after = at + h.length
    if after == end or _tag_at(data, after, end):
        return True
    g = header(_word(data, after)) if after + 4 <= end else None
    return g is not None and (g.version, g.layer, g.rate) == (h.version, h.layer, h.rate)


def parse(data: bytes) -> Stream:
    """All there is in a stream; damage costs the damaged frames only. Never raises on any bytes.
    An ID3v1 tag is one only if no sound frame that starts before it holds its bytes."""
    end, spot = len(data), len(data) - 128
    if spot < 0 or data[spot : spot + 3] != b"TAG":
        return _parse(data, end, [])
    whole = _parse(data, end, [])
    k = int(np.searchsorted(whole.offsets, spot)) - 1
    if k >= 0 and whole.offsets[k] + whole.lengths[k] > spot and _chains(data, int(whole.offsets[k]), end, None):
        return whole
    return _parse(data, spot, [("id3v1", 128)])


def _parse(data: bytes, end: int, tags: list[tuple[str, int]]) -> Stream:
    """All there is before ``end``; ``tags`` are known already."""
    out, at = Stream(), 0
    first: Header | None = None
    words, spots = [], []
    sure = False  # the last frame's length led here
    while at + 4 <= end:
        word = _word(data, at)
        h = header(word)
        if h is not None and at + h.length <= end and (
            (sure and (h.version, h.layer, h.rate) == (first.version, first.layer, first.rate)) or _chains(data, at, end, first)
        ):
            if first is None:
                first = h
                out.table = _table(data, at, h)
                if out.table:
                    at += h.length
                    sure = True
                    continue
            words.append(word)
            spots.append(at)
            at += h.length
            sure = True
            continue
        tag = _tag_at(data, at, end)
        if tag:
            tags.append(tag)
            at += tag[1]
            sure = sure and first is not None
            continue
        sure = False
        sync = data.find(b"\xff", at + 1, end)
        tag_at = min((x for x in (data.find(b"ID3", at + 1, end), data.find(b"APETAGEX", at + 1, end)) if x >= 0), default=end) if first is None else end
        step = min(end if sync < 0 else sync, tag_at)
        out.skipped += step - at
        at = step
    out.skipped += max(0, end - at)
    out.tags = tuple(tags)
    if first is None:
        return out
    out.rate, out.layer = first.rate, first.layer
    if not words:
        return out
    every = [header(w) for w in words]
    out.offsets, out.lengths = np.array(spots, np.int64), np.array([h.length for h in every], np.int64)
    out.samples = sum(h.samples for h in every)
    out.kbps = tuple(sorted({h.kbps for h in every}))
    raw = np.frombuffer(data, np.uint8)
    for side in {h.side for h in every if h.protected and h.layer == 3}:
        at_ = np.array([s for s, h in zip(spots, every) if h.protected and h.layer == 3 and h.side == side])
        fits = at_ + 6 + side <= end
        cover = np.concatenate([at_[fits, None] + [2, 3], at_[fits, None] + 6 + np.arange(side)], 1)
        stored = raw[at_[fits] + 4].astype(np.uint16) << np.uint16(8) | raw[at_[fits] + 5]
        good = int((crc16(raw[cover]) == stored).sum())
        out.crc_ok += good
        out.crc_bad += len(at_) - good
    for spot, h in zip(spots, every):
        if h.protected and h.layer != 3:
            frame = bytes(data[spot : spot + h.length])
            bits = h.protected_bits(frame)
            good = 48 + bits <= 8 * h.length and crc16_bits(frame[2:4] + frame[6:], 16 + bits) == int.from_bytes(frame[4:6], "big")
            out.crc_ok += good
            out.crc_bad += not good
    return out


#: The carrier: MPEG-1 Layer III, protected, 80 kbit/s, 48 kHz, mono: 240 bytes a frame, of which
#: 4 header, 2 CRC and 17 side information (all zero: silence, no main data).
CARRIER, UNIT, FRAME, BODY = 0xFFFA64C0, 192, 240, 23


def _frame() -> np.ndarray:
    frame = np.zeros(FRAME, np.uint8)
    frame[:4] = np.frombuffer(CARRIER.to_bytes(4, "big"), np.uint8)
    crc = int(crc16(np.concatenate([frame[2:4], frame[6:BODY]])[None, :])[0])
    frame[4:6] = crc >> 8, crc & 255
    return frame


_FRAME = _frame()


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """``raw`` with spaces up to a positive multiple of ``unit``."""
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b" ")


def encode(payload: bytes) -> bytes:
    """A stream that carries ``payload``, whose length is a positive multiple of UNIT."""
    if not payload or len(payload) % UNIT:
        raise ValueError("payload length must be a positive multiple of 192")
    n = len(payload) // UNIT
    frames = np.broadcast_to(_FRAME, (n + 1, FRAME)).copy()
    frames[1:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes(min(255, (256 * (1 + i * n // 100)) // (n + 1)) for i in range(100))
    table = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * FRAME).to_bytes(4, "big") + toc
    frames[0, BODY : BODY + len(table)] = np.frombuffer(table, np.uint8)
    note = b"TLEN" + (10).to_bytes(4, "big") + b"\0\0\0" + str(n * 24).encode().rjust(9, b"0")[:9]
    size = len(note)
    tag = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + note
    return tag + frames.tobytes()


def payload(data: bytes, stream: Stream) -> bytes:
    """The bytes that a stream made by ``encode`` carries, in the order of its frames."""
    raw = np.frombuffer(data, np.uint8)
    whole = stream.offsets[stream.lengths == FRAME]
    return raw[whole[:, None] + BODY + np.arange(UNIT)].tobytes() if len(whole) else b""


def feature(stream: Stream) -> str:
    """Frames, samples, rate, exact duration, bitrates, checksums, skipped bytes, tags, table, and
    the seek offsets as a digest with the first and last of them."""
    seek = hashlib.md5(stream.offsets.astype("<i8").tobytes()).hexdigest()[:16]
    ends = f"{stream.offsets[0]}-{stream.offsets[-1]}" if len(stream.offsets) else ""
    tags = "+".join(f"{name}:{size}" for name, size in stream.tags)
    return (
        f"layer={stream.layer};frames={len(stream.offsets)};samples={stream.samples};rate={stream.rate};duration={stream.duration:.6f};"
        f"kbps={'/'.join(map(str, stream.kbps))};crc={stream.crc_ok}/{stream.crc_ok + stream.crc_bad};skipped={stream.skipped};"
        f"tags={tags};table={stream.table.get('kind', '')}:{stream.table.get('frames', '')};seek={ends}:{seek}"
    )


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with ``duration`` (seconds), ``samples, rate, frames, crc_bad, skipped``, ``seek``
    (byte offset of every frame) and ``feature`` of the binary column. Null and empty values, and
    bytes without any frame, give zeros and an empty ``seek``. Columns of these names are replaced;
    repeated rows stay and are read alike; an empty table stays empty."""
    bounded_batches(media.sparkSession)
    made = ["duration", "samples", "rate", "frames", "crc_bad", "skipped", "seek", "feature"]
    kept = [c for c in media.columns if c.lower() not in made]
    media = media.select(*kept)
    at = kept.index(column)

    def run(batches):
        kinds = [pa.float64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        for batch in batches:
            rows = []
            for value in batch.column(at):
                s = parse(value.as_py() or b"")
                rows.append((s.duration, s.samples, s.rate, len(s.offsets), s.crc_bad, s.skipped, s.offsets, feature(s)))
            columns = zip(*rows) if rows else [[]] * len(made)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(columns, kinds))], [*kept, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(run, f"{schema}, duration double, samples long, rate int, frames long, crc_bad long, skipped long, seek array<long>, feature string")


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of every row: the whole text (null: empty) as a stream. Repeated rows
    stay; an empty table stays empty; other columns are not read."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            raw = [(t.as_py() or "").encode() for t in batch.column(1)]
            media = pa.array([encode(pad(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Digests, features, exact durations and seek offsets from the stored bytes alone (``doc_id,
    n_bytes, media``): ``duration`` in seconds, ``samples``, and in ``seek`` the byte offset of every
    frame. Repeated rows are read alike; an empty table stays empty."""
    media = media.select("doc_id", "n_bytes", "media")
    names = {
        "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string",
        "feature": "string", "duration": "double", "samples": "long", "seek": "array<long>",
    }

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for value in batch.column(2):
                data = value.as_py()
                stream = parse(data)
                body = payload(data, stream)
                rows.append((
                    len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                    feature(stream), stream.duration, stream.samples, stream.offsets,
                ))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, " + ", ".join(f"{name} {kind}" for name, kind in names.items()))


def op8(spark, sf_dir: str) -> DataFrame:
    """Every document stored as a stream, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text"))
    return read_back(stored(docs))
