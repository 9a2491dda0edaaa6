"""Media columns: baseline JPEG written and read in numpy.

Documents become pictures without loss: each payload byte is one 8x8 block whose
only coefficient is the DC term. With a quantiser step of 8 the quantised DC is
``byte - 128``, so the DC-only luminance thumbnail of the picture is the payload.
One row of 64 blocks is one restart interval; intervals decode independently, so
the reader decodes all intervals of a batch side by side, one Huffman symbol of
each per numpy step. The reader takes any baseline JPEG with one or three
components; a media value may hold several frames one after another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm import textnum
from skyloom.llm.common import slim

ROW = 64  # blocks, and so payload bytes, in a row
FRAME_ROWS = 8191  # 8-pixel block rows that a 16-bit height can hold
# Fixed values of the format: code counts by length and the symbols of the DC
# luminance table that the standard gives as typical.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
AC_COUNTS = bytes([1] + [0] * 15)  # one code of one bit: end of block
AC_SYMBOLS = bytes([0])
# Zig-zag is not needed: only DC terms are used.

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, width long, height long, thumbnail_hash string"
)


def huffman_codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length)."""
    code, at, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def huffman_lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit prefix: length * 256 + symbol, or 0 where no code begins."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in huffman_codes(counts, symbols).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + symbol
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, b"\0" + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS),
        _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit count for each DC difference from -255 to 255, end of block included."""
    codes, eob = huffman_codes(DC_COUNTS, DC_SYMBOLS), huffman_codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, length = codes[s]
        extra = d if d >= 0 else d + (1 << s) - 1
        bits[d + 255] = ((code << s | extra) << eob[1]) | eob[0]
        size[d + 255] = length + s + eob[1]
    return bits, size


def encode_payloads(payload: np.ndarray, rows: np.ndarray) -> tuple[bytearray, np.ndarray]:
    """JPEG bytes of consecutive documents of so many 64-byte rows, and their end offsets."""
    bits, size = _difference_codes()
    v = payload.reshape(-1, ROW).astype(np.int16) - 128
    d = v.copy()
    d[:, 1:] -= v[:, :-1]
    key = d.astype(np.int64) + 255
    length = size[key]
    ends = np.cumsum(length, 1)
    n_bytes = (ends[:, -1] + 7) >> 3
    first = np.concatenate([[0], np.cumsum(n_bytes)])
    at = (ends - length) + (first[:-1] * 8)[:, None]
    value = (bits[key] << (24 - length - (at & 7))).ravel()
    byte = (at >> 3).ravel()
    total = int(first[-1])
    packed = np.bincount(byte, (value >> 16).astype(np.float64), total + 2)
    packed += np.bincount(byte + 1, ((value >> 8) & 255).astype(np.float64), total + 2)[: total + 2]
    packed += np.bincount(byte + 2, (value & 255).astype(np.float64), total + 3)[: total + 2]
    scan = packed[:total].astype(np.uint8)
    spare = (-ends[:, -1]) & 7
    scan[first[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)
    # Frames: documents of more than FRAME_ROWS rows get several.
    frame_rows, last_of_doc = [], []
    for r in rows.tolist():
        n = -(-r // FRAME_ROWS)
        frame_rows += [FRAME_ROWS] * (n - 1) + [r - FRAME_ROWS * (n - 1)]
        last_of_doc += [False] * (n - 1) + [True]
    frame_rows = np.asarray(frame_rows, np.int64)
    frame_end = np.cumsum(frame_rows)
    head = len(frame_header(1))
    opens = np.zeros(len(n_bytes), np.int64)
    opens[frame_end - frame_rows] = head
    stuffed = scan == 255
    ff = np.concatenate([[0], np.cumsum(stuffed)])
    interval_out = n_bytes + (ff[first[1:]] - ff[first[:-1]]) + 2
    out_end = np.cumsum(interval_out + opens)
    out_start = out_end - interval_out
    out = np.zeros(int(out_end[-1]), np.uint8)
    inner = np.arange(total) - np.repeat(first[:-1], n_bytes)
    place = inner + np.repeat(out_start - ff[first[:-1]], n_bytes) + ff[:-1]
    out[place] = scan
    in_frame = np.arange(len(n_bytes)) - np.repeat(frame_end - frame_rows, frame_rows)
    out[out_end - 2] = 255
    out[out_end - 1] = 0xD0 + (in_frame & 7)
    out[out_end[frame_end - 1] - 1] = 0xD9
    data = bytearray(out.tobytes())
    for begin, r in zip((out_start[frame_end - frame_rows] - head).tolist(), frame_rows.tolist(), strict=True):
        data[begin : begin + head] = frame_header(r)
    return data, out_end[frame_end[np.asarray(last_of_doc)] - 1]


@dataclass
class Frame:
    """One picture: size, components and where its entropy-coded data lies."""

    doc: int
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # DC step by table
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    selectors: dict[int, tuple[int, int]] = field(default_factory=dict)
    interval: int = 0
    scan: tuple[int, int] = (0, 0)

    def layout(self) -> tuple:
        """What must agree for two frames to be decoded side by side."""
        blocks = [] if len(self.components) > 1 else [(0, *self.selectors[self.components[0][0]])]
        if len(self.components) > 1:
            for k, (c, h, v, _) in enumerate(self.components):
                blocks += [(k, *self.selectors[c])] * (h * v)
        return tuple(blocks), tuple(sorted(self.tables.items()))

    def mcus(self) -> tuple[int, int]:
        many = len(self.components) > 1
        hmax = max(c[1] for c in self.components) if many else 1
        vmax = max(c[2] for c in self.components) if many else 1
        return -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))


def parse_frames(data: bytes, start: int, stop: int, doc: int) -> list[Frame]:
    """Reads the markers of all frames in data[start:stop]."""
    frames, at = [], start
    while at + 1 < stop:
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no start of image at byte {at - start} of document {doc}")
        f, at = Frame(doc), at + 2
        while True:
            if at + 3 >= stop or data[at] != 0xFF:
                raise ValueError(f"broken marker in document {doc}")
            marker, n = data[at + 1], data[at + 2] << 8 | data[at + 3]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xC0:
                _, f.height, f.width, k = struct.unpack(">BHHB", body[:6])
                f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError(f"frame type {marker:#x} is not baseline, in document {doc}")
            elif marker == 0xDB:
                i = 0
                while i < len(body):
                    wide, t = body[i] >> 4, body[i] & 15
                    f.quantisers[t] = body[i + 1] << 8 | body[i + 2] if wide else body[i + 1]
                    i += 129 if wide else 65
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    k = sum(body[i + 1 : i + 17])
                    f.tables[body[i]] = (bytes(body[i + 1 : i + 17]), bytes(body[i + 17 : i + 17 + k]))
                    i += 17 + k
            elif marker == 0xDD:
                f.interval = body[0] << 8 | body[1]
            elif marker == 0xDA:
                f.selectors = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                if len(f.selectors) != len(f.components):
                    raise ValueError(f"scans of single components are not baseline interleaved, in document {doc}")
                end = at
                while True:  # the next marker that is neither stuffing nor a restart
                    end = data.find(b"\xff", end, stop)
                    if end < 0 or end + 1 >= stop:
                        raise ValueError(f"no end of image in document {doc}")
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                f.scan, at = (at, end), end
                while data[at + 1] != 0xD9:
                    at += 2 + (data[at + 2] << 8 | data[at + 3])
                at += 2
                frames.append(f)
                break
    return frames


def decode_dc(data: bytes, frames: list[Frame]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each frame, as rows of 8-bit samples."""
    raw = np.frombuffer(data, np.uint8)
    out: list[np.ndarray | None] = [None] * len(frames)
    groups: dict[tuple, list[int]] = {}
    for k, f in enumerate(frames):
        groups.setdefault(f.layout(), []).append(k)
    for (blocks, tables), members in groups.items():
        lookups = {t: huffman_lookup(*x) for t, x in tables}
        own = [frames[k] for k in members]
        keep = np.zeros(len(raw) + 1, np.int8)
        for f in own:
            keep[f.scan[0]] += 1
            keep[f.scan[1]] -= 1
        inside = np.cumsum(keep[:-1]).astype(bool)
        ff = np.flatnonzero((raw == 255) & inside)
        nxt = raw[np.minimum(ff + 1, len(raw) - 1)]
        drop = inside.copy()
        drop[ff[nxt == 0] + 1] = False
        restart = ff[(nxt >= 0xD0) & (nxt <= 0xD7)]
        drop[restart] = drop[restart + 1] = False
        clean_at = np.cumsum(drop) - drop
        clean = np.concatenate([raw[drop], np.zeros(16, np.uint8)])
        scans = np.asarray([f.scan[0] for f in own])
        lane_start = np.sort(np.concatenate([scans, restart + 2]))
        lane_frame = np.searchsorted(scans, lane_start, side="right") - 1
        per = [f.mcus() for f in own]
        n_mcu = np.asarray([a * b for a, b in per])
        step = np.asarray([f.interval or a * b for f, (a, b) in zip(own, per, strict=True)])
        nth = np.arange(len(lane_start)) - np.searchsorted(lane_frame, lane_frame)
        first_mcu = nth * step[lane_frame]
        lane_mcus = np.clip(n_mcu[lane_frame] - first_mcu, 0, step[lane_frame])
        pos = np.append(clean_at, len(clean) - 16)[lane_start].astype(np.int64) * 8
        window = np.ndarray((len(clean) - 8,), ">u8", clean.tobytes(), strides=(1,))
        n_luma = sum(b[0] == 0 for b in blocks)
        base = np.concatenate([[0], np.cumsum(n_mcu)])[:-1][lane_frame] + first_mcu
        samples = np.zeros((int(n_mcu.sum()), n_luma), np.int32)
        predicted = np.zeros((max(b[0] for b in blocks) + 1, len(pos)), np.int64)
        for m in range(int(lane_mcus.max(initial=0))):
            lanes = None if (lane_mcus > m).all() else np.flatnonzero(lane_mcus > m)
            p = pos if lanes is None else pos[lanes]
            luma = 0
            for component, dc, ac in blocks:
                w = window[np.minimum(p >> 3, len(window) - 1)].astype(np.uint64) << (p & 7).astype(np.uint64)
                found = lookups[dc][(w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                length, s = found >> 8, found & 255
                if not length.all():
                    raise ValueError("a code that is in no table")
                bits = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (63 - s).astype(np.uint64)).astype(np.int64)
                d = np.where((s > 0) & (bits < (np.int64(1) << np.maximum(s - 1, 0))), bits - (np.int64(1) << s) + 1, bits)
                now = predicted[component] if lanes is None else predicted[component][lanes]
                now = now + d
                if lanes is None:
                    predicted[component] = now
                else:
                    predicted[component][lanes] = now
                p = p + length + s
                k, left = np.zeros(len(p), np.int64), None  # AC terms are skipped, symbol by symbol
                while True:
                    q = p if left is None else p[left]
                    w = window[np.minimum(q >> 3, len(window) - 1)].astype(np.uint64) << (q & 7).astype(np.uint64)
                    found = lookups[16 + ac][(w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                    length, s = found >> 8, found & 255
                    if not length.all():
                        raise ValueError("a code that is in no table")
                    q = q + length + (s & 15)
                    if left is None:
                        p = q
                    else:
                        p[left] = q
                    if not s.any():
                        break
                    more = np.where(s == 0, 64, (s >> 4) + 1)
                    if left is None:
                        k, left = k + more, np.arange(len(p))
                    else:
                        k[left] += more
                    left = left[k[left] < 63]
                    if not len(left):
                        break
                if component == 0:
                    samples[base + m if lanes is None else base[lanes] + m, luma] = now
                    luma += 1
            if lanes is None:
                pos = p
            else:
                pos[lanes] = p
        begin = 0
        for k, f, (across, down) in zip(members, own, per, strict=True):
            part = samples[begin : begin + across * down]
            begin += across * down
            h, v = (f.components[0][1], f.components[0][2]) if len(f.components) > 1 else (1, 1)
            grid = part.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            q = f.quantisers[f.components[0][3]]
            level = np.floor(grid * q / 8 + 0.5).astype(np.int64) + 128
            hmax, vmax = (max(c[1] for c in f.components), max(c[2] for c in f.components)) if len(f.components) > 1 else (1, 1)
            tall, wide = -(-(-(-f.height * v // vmax)) // 8), -(-(-(-f.width * h // hmax)) // 8)
            out[k] = np.clip(level[:tall, :wide], 0, 255).astype(np.uint8)
    return out


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64-bit average hash in hexadecimal: an 8x8 grid of mean levels against their mean."""
    tall, wide = thumbnail.shape
    r, c = np.arange(8) * tall // 8, np.arange(8) * wide // 8
    t = thumbnail.astype(np.int64)
    sums = np.add.reduceat(np.add.reduceat(t, r, 0), c, 1)
    rows, cols = np.maximum(np.diff(np.append(r, tall)), 1), np.maximum(np.diff(np.append(c, wide)), 1)
    mean = sums / np.outer(rows, cols)
    return np.packbits((mean > mean.mean()).ravel()).tobytes().hex()


def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textnum.slices(batches, "text", 1 << 19):
        raw, offsets = textnum.string_buffer(batch.column(1))
        sizes = np.diff(offsets)
        rows = np.maximum(-(-sizes // ROW), 1)
        starts = np.cumsum(rows * ROW) - rows * ROW
        payload = np.zeros(int(rows.sum()) * ROW, np.uint8)
        payload[np.arange(len(raw)) + np.repeat(starts - offsets[:-1], sizes)] = raw
        data, ends = encode_payloads(payload, rows)
        media = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(bytes(data))])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), media.cast(pa.binary())], ["doc_id", "n_bytes", "media"])


def inspect_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumbnail_hash"]
    for batch in textnum.slices(batches, "media", 1 << 19):
        values, offsets = textnum.string_buffer(batch.column(2), pa.large_binary())
        data, media = values.tobytes(), batch.column(2)
        frames = [f for k in range(len(media)) for f in parse_frames(data, int(offsets[k]), int(offsets[k + 1]), k)]
        thumbnails = decode_dc(data, frames)
        rows: list[list] = [[] for _ in range(8)]
        at = 0
        for k in range(len(media)):
            own = []
            while at < len(frames) and frames[at].doc == k:
                own.append(at)
                at += 1
            thumb = thumbnails[own[0]] if len(own) == 1 else np.concatenate([thumbnails[i] for i in own])
            payload = thumb.tobytes()
            stored = data[offsets[k] : offsets[k + 1]]
            width, height = frames[own[0]].width, sum(frames[i].height for i in own)
            ahash = thumbnail_hash(thumb)
            for column, x in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{width}x{height}:{ahash}", width, height), strict=True):
                column.append(x)
        hashes = [x.rpartition(":")[2] for x in rows[5]]
        arrays = [batch.column(0), batch.column(1), *[pa.array(x) for x in rows], pa.array(hashes)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def store_as_jpeg(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored picture of every document.

    Null and empty texts are one row of zero bytes. Texts longer than a picture
    can hold (524,224 bytes) become several frames in one value. Repeated rows stay
    repeated; an empty table gives an empty table; a null doc_id stays null; other
    columns are not read.
    """
    return slim(docs, "doc_id", "text").mapInArrow(encode_batches, MEDIA_SCHEMA)


def read_jpeg(media: DataFrame) -> DataFrame:
    """Sizes, digests and thumbnail hashes read back from stored pictures (doc_id, n_bytes, media)."""
    return slim(media, "doc_id", "n_bytes", "media").mapInArrow(inspect_batches, FEATURE_SCHEMA)


def op3_media(spark, sf_dir: str) -> DataFrame:
    from skyloom.llm.common import documents

    return read_jpeg(store_as_jpeg(documents(spark, sf_dir)))
