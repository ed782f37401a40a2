"""FLAC media columns: encoding of bytes as 8-bit samples, and decoding to PCM blocks.

The encoder stores a payload as one channel of 8-bit samples in frames of
``BLOCK`` samples, choosing per frame among constant, verbatim, fixed predictors
of order 0 to 2 and a quantised linear predictor of order 2, with Rice-coded
residuals in partitions.  Every frame has a seek point, so a reader can start at
any of them.

The decoder verifies the header CRC-8 and frame CRC-16 of every frame and the
stream's MD5, and yields PCM blocks with their sample offsets.  Frames of a batch
are decoded side by side in numpy: the n-th residual of all frames at once.
Streams of other encoders (several channels, other sample sizes, escaped
partitions, no seek table) go through a plain frame decoder.

A payload is encoded and decoded in windows of frames, so memory follows its size by
a small factor only.

Defined results for columns: null and empty texts are an empty payload, padded to
64 zero bytes; null media raise no error and have no blocks; damaged media raise
``ValueError``; repeated rows give equal results; other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, ensure_checkpoint_dir

BLOCK = 1024
PAD = 64
RATE = 8000
PARTITION_ORDER = 2
#: Payload bytes handled at once; a multiple of ``BLOCK``.
SLICE = 1 << 20
#: Fixed by the format: the largest block.
MAX_BLOCK = 1 << 16

#: Fixed by the format: generator polynomials, and block sizes by code.
CRC8_POLY, CRC16_POLY = 0x07, 0x8005
BLOCK_SIZES = {1: 192, **{2 + i: 576 << i for i in range(4)}, **{8 + i: 256 << i for i in range(8)}}
SAMPLE_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED_COEFFICIENTS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    """Effect of ``bits`` zero bits after each value of a register of that width."""
    c = np.arange(1 << bits, dtype=np.uint32)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for _ in range(bits):
        c = np.where(c & top, (c << 1) ^ poly, c << 1) & mask
    return c.astype(np.uint16)


@functools.cache
def _tables():
    return _crc_table(CRC8_POLY, 8).tolist(), _crc_table(CRC16_POLY, 16)


def crc8(data: bytes) -> int:
    table, c = _tables()[0], 0
    for b in data:
        c = table[c ^ b]
    return c


def crc16_many(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each ``data[start:end]``: all ranges at once, two bytes a step."""
    table = _tables()[1]
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, steps = start[order], size[order] // 2
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    pairs = padded[:-1].astype(np.uint16) << 8 | padded[1:]
    c = np.zeros(len(start), np.uint16)
    active = len(c)
    for i in range(int(steps.max(initial=0))):
        active = int(np.searchsorted(-steps[:active], -i, side="left"))
        c[:active] = table[c[:active] ^ pairs[at[:active] + 2 * i]]
    odd = size[order] % 2 == 1
    if odd.any():
        # One more byte: its zero-bit effect on the register's high byte.
        last = padded[at[odd] + 2 * steps[odd]].astype(np.uint16)
        high = (c[odd] >> 8) ^ last
        c[odd] = ((c[odd] & 0xFF) << 8) ^ table[high]
    out = np.empty_like(c)
    out[order] = c
    return out


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    head = (0xFF << (8 - size)) & 0xFF | n >> (6 * (size - 1))
    return bytes([head, *(0x80 | n >> (6 * i) & 0x3F for i in range(size - 2, -1, -1))])


@functools.lru_cache(1 << 16)
def frame_header(number: int, size: int) -> bytes:
    """Header of frame ``number`` of one 8-bit channel, with its CRC-8."""
    code = next((c for c, s in BLOCK_SIZES.items() if s == size), 7)
    head = bytes([0xFF, 0xF8, code << 4, 1 << 1]) + _utf8_number(number) + (struct.pack(">H", size - 1) if code == 7 else b"")
    return head + bytes([crc8(head)])


def stream_head(samples: int, md5: bytes, seek: list[tuple[int, int, int]]) -> bytes:
    """Marker, STREAMINFO and SEEKTABLE; ``seek`` has (sample, byte offset, frame samples)."""
    packed = RATE << 44 | 0 << 41 | 7 << 36 | samples
    info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + packed.to_bytes(8, "big") + md5
    table = b"".join(struct.pack(">QQH", *p) for p in seek)
    last = 0x80 if not seek else 0
    out = b"fLaC" + bytes([last]) + len(info).to_bytes(3, "big") + info
    return out + (bytes([0x83]) + len(table).to_bytes(3, "big") + table if seek else b"")


@dataclass
class _Frames:
    """Frames of a batch of payloads, samples one after another."""

    payload: np.ndarray  # of each frame: its payload
    number: np.ndarray  # in its payload
    start: np.ndarray  # first sample in the batch
    size: np.ndarray


def _cut(lengths: np.ndarray) -> _Frames:
    count = -(-lengths // BLOCK)
    payload = np.repeat(np.arange(len(lengths)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    number = np.arange(first[-1]) - np.repeat(first[:-1], count)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    start = np.repeat(begin[:-1], count) + number * BLOCK
    return _Frames(payload, number, start, np.minimum(np.repeat(begin[1:], count) - start, BLOCK))


def _log2_floor(x: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)


_LPC_PRECISION, _LPC_SHIFT = 7, 5
CONSTANT, VERBATIM, FIXED, LINEAR = 0, 1, 8, 32


def encode_frames(samples: np.ndarray, frames: _Frames) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all frames one after another, where each starts and the last ends)."""
    n_frames, total = len(frames.size), len(samples)
    s = samples.astype(np.int32)
    frame = np.repeat(np.arange(n_frames), frames.size)
    at = np.arange(total) - frames.start[frame]
    lag1 = np.concatenate([[0], s[:-1]])
    lag2 = np.concatenate([[0, 0], s[:-2]])[:total]
    # Quantised order-2 predictor from the frame's autocorrelation.
    sums = lambda x: np.add.reduceat(x, frames.start)
    f = s.astype(np.float64)
    inner1, inner2 = at >= 1, at >= 2
    r0, r1, r2 = sums(f * f), sums(f * lag1 * inner1), sums(f * lag2 * inner2)
    det = r0 * r0 - r1 * r1
    safe = np.where(np.abs(det) > 1e-9, det, 1.0)
    top = (1 << (_LPC_PRECISION - 1)) - 1
    quant = lambda c: np.clip(np.round(np.where(det > 1e-9, c / safe, 0) * (1 << _LPC_SHIFT)), -top - 1, top).astype(np.int32)
    c1, c2 = quant(r0 * r1 - r1 * r2), quant(r0 * r2 - r1 * r1)
    candidates = [(FIXED, 0, s), (FIXED, 1, s - lag1), (FIXED, 2, s - 2 * lag1 + lag2), (LINEAR, 2, s - ((c1[frame] * lag1 + c2[frame] * lag2) >> _LPC_SHIFT))]
    parts_log = np.where(frames.size == BLOCK, PARTITION_ORDER, 0)
    part_size = frames.size >> parts_log
    part_count = 1 << parts_log
    part_first = np.concatenate([[0], np.cumsum(part_count)])[:-1]
    n_parts = int(part_count.sum())
    part_of = part_first[frame] + at // part_size[frame]
    part_frame = np.repeat(np.arange(n_frames), part_count)
    part_begin = np.searchsorted(part_of, np.arange(n_parts))
    best_bits, kind, order, rice = frames.size * 8, np.full(n_frames, VERBATIM), np.zeros(n_frames, np.int64), np.zeros(n_parts, np.int64)
    code = np.zeros(total, np.int64)
    for what, p, residual in candidates:
        u = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
        u[at < p] = 0
        counted = np.maximum(part_size[part_frame] - np.where(np.arange(n_parts) == part_first[part_frame], p, 0), 1)
        k = _log2_floor(np.add.reduceat(u, part_begin) * 0.7 / counted + 1)
        bits = np.add.reduceat(u >> k[part_of], part_begin) + counted * (k + 1) + 4
        own = np.add.reduceat(bits, part_first) + 6 + 8 * p + (9 + 2 * _LPC_PRECISION if what == LINEAR else 0)
        own[frames.size <= p] = 1 << 40
        better = own < best_bits
        best_bits = np.where(better, own, best_bits)
        kind, order = np.where(better, what, kind), np.where(better, p, order)
        rice = np.where(better[part_frame], k, rice)
        code = np.where(better[frame], u, code)
    flat = sums((s != s[frames.start][frame]).astype(np.int64)) == 0
    kind = np.where(flat, CONSTANT, kind)
    order = np.where(flat, 0, order)
    # Layout in bits: header, subframe type, warm-up, coefficients, partitions, CRC-16.
    heads = [frame_header(int(a), int(b)) for a, b in zip(frames.number, frames.size, strict=True)]
    head_bits = np.fromiter(map(len, heads), np.int64, n_frames) * 8
    ricey = (kind == FIXED) | (kind == LINEAR)
    raw = (at < order[frame]) | (kind == VERBATIM)[frame] | ((kind == CONSTANT)[frame] & (at == 0))
    k = rice[part_of]
    q = code >> k
    length = np.where(raw, 8, np.where(ricey[frame], q + 1 + k, 0))
    ends = np.cumsum(length)
    before = ends - length
    rel = before - before[frames.start][frame]  # of the sample's code among the frame's codes
    extra_lpc = np.where(kind == LINEAR, 9 + 2 * _LPC_PRECISION, 0)
    residual_head = np.where(ricey, 6, 0)
    code_bits = np.add.reduceat(length, frames.start)
    body_bits = head_bits + 8 + extra_lpc + residual_head + np.where(ricey, 4 * part_count, 0) + code_bits
    frame_bytes = -(-body_bits // 8) + 2
    byte_at = np.concatenate([[0], np.cumsum(frame_bytes)])
    bit_at = byte_at[:-1] * 8
    bits = np.zeros(byte_at[-1] * 8, np.uint8)
    codes_at = bit_at + head_bits + 8

    def put(position, value, width):
        for j in range(width):
            bits[position + j] = (value >> (width - 1 - j)) & 1

    sub = np.where(kind == FIXED, FIXED + order, np.where(kind == LINEAR, LINEAR + order - 1, kind))
    put(bit_at + head_bits, sub << 1, 8)
    linear = np.flatnonzero(kind == LINEAR)
    if len(linear):
        p = codes_at[linear] + 8 * order[linear]
        put(p, np.full(len(linear), _LPC_PRECISION - 1), 4)
        put(p + 4, np.full(len(linear), _LPC_SHIFT), 5)
        put(p + 9, c1[linear] & ((1 << _LPC_PRECISION) - 1), _LPC_PRECISION)
        put(p + 9 + _LPC_PRECISION, c2[linear] & ((1 << _LPC_PRECISION) - 1), _LPC_PRECISION)
    some = np.flatnonzero(ricey)
    put(codes_at[some] + 8 * order[some] + extra_lpc[some] + 2, parts_log[some], 4)
    # A sample's code comes after the heads of its partition and of those before it.
    part_index = part_of - part_first[frame]
    shift = np.where(raw, 0, extra_lpc[frame] + residual_head[frame] + 4 * (part_index + 1))
    end_bit = codes_at[frame] + rel + length + np.where(ricey[frame], shift, 0)
    first_coded = np.maximum(part_begin, frames.start[part_frame] + np.where(np.arange(n_parts) == part_first[part_frame], order[part_frame], 0))
    coded = np.flatnonzero(ricey[part_frame])
    put(end_bit[first_coded[coded]] - length[first_coded[coded]] - 4, rice[coded], 4)
    width = np.where(raw, 8, k + 1)
    value = np.where(raw, s & 0xFF, (np.int64(1) << k) | (code & ((np.int64(1) << k) - 1)))
    rows = np.flatnonzero(length > 0)
    end_rows, value_rows, width_rows = end_bit[rows], value[rows], width[rows]
    for j in range(int(width_rows.max(initial=0))):
        if j >= 1:
            on = width_rows > j
            if not on.all():
                end_rows, value_rows, width_rows = end_rows[on], value_rows[on], width_rows[on]
        bits[end_rows - 1 - j] = (value_rows >> j) & 1
    data = np.packbits(bits)
    head_len = head_bits // 8
    head_all = np.frombuffer(b"".join(heads), np.uint8)
    head_first = np.concatenate([[0], np.cumsum(head_len)])
    data[np.arange(head_first[-1]) - np.repeat(head_first[:-1], head_len) + np.repeat(byte_at[:-1], head_len)] = head_all
    crc = crc16_many(data, byte_at[:-1], byte_at[1:] - 2)
    data[byte_at[1:] - 2], data[byte_at[1:] - 1] = crc >> 8, crc & 0xFF
    return data, byte_at


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % PAD or (PAD if not payload else 0))


def _windows(sizes: list[int], limit: int) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of (number, start, stop) stretches that hold at most ``limit`` in all."""
    group: list[tuple[int, int, int]] = []
    room = limit
    for i, n in enumerate(sizes):
        for a in range(0, n, limit):
            b = min(a + limit, n)
            if group and b - a > room:
                yield group
                group, room = [], limit
            group.append((i, a, b))
            room -= b - a
    if group:
        yield group


def encode_many(payloads: list[bytes], limit: int = SLICE) -> list[bytes]:
    """A FLAC stream for each (padded, non-empty) payload of unsigned bytes.

    Frames are made over ``limit`` bytes at a time (a multiple of ``BLOCK``), so a
    long payload needs little more memory than itself.
    """
    parts: list[list[bytes]] = [[] for _ in payloads]
    seek: list[list[tuple[int, int, int]]] = [[] for _ in payloads]
    written, md5 = [0] * len(payloads), [hashlib.md5() for _ in payloads]
    for group in _windows([*map(len, payloads)], limit):
        samples = (np.frombuffer(b"".join(payloads[i][a:b] for i, a, b in group), np.uint8) ^ 0x80).view(np.int8)
        frames = _cut(np.array([b - a for _, a, b in group]))
        frames.number += np.array([a // BLOCK for _, a, _ in group])[frames.payload]
        data, byte_at = encode_frames(samples, frames)
        first = np.searchsorted(frames.payload, np.arange(len(group) + 1)).tolist()
        raw, at, sizes, pcm, begin = data.tobytes(), byte_at.tolist(), frames.size.tolist(), samples.tobytes(), 0
        for (i, a, b), x, y in zip(group, first, first[1:], strict=False):
            seek[i] += [(a + k * BLOCK, written[i] + at[x + k] - at[x], sizes[x + k]) for k in range(y - x)]
            parts[i].append(raw[at[x] : at[y]])
            written[i] += at[y] - at[x]
            md5[i].update(pcm[begin : begin + b - a])
            begin += b - a
    return [b"".join([stream_head(len(payloads[i]), md5[i].digest(), seek[i]), *parts[i]]) for i in range(len(payloads))]


@dataclass
class Stream:
    """Parsed metadata of a FLAC stream."""

    data: bytes
    channels: int
    bits: int
    rate: int
    samples: int
    md5: bytes
    audio: int  # where the first frame starts
    seek: list[tuple[int, int, int]]


def parse_stream(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise ValueError("metadata ends early")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            seek = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
        at += 4 + size
    if info is None or len(info) != 34:
        raise ValueError("no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    return Stream(data, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed >> 44, packed & ((1 << 36) - 1), info[18:34], at, seek)


class _Bits:
    def __init__(self, data: bytes, byte: int):
        self.data, self.at = data, byte * 8

    def take(self, n: int) -> int:
        end = self.at + n
        a, b = self.at // 8, -(-end // 8)
        if b > len(self.data):
            raise ValueError("frame ends early")
        self.at = end
        return int.from_bytes(self.data[a:b], "big") >> (8 * b - end) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n) if n else 0
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _plain_subframe(bits: _Bits, size: int, width: int) -> list[int]:
    if bits.take(1):
        raise ValueError("bad subframe")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        out = [bits.signed(width)] * size
    elif kind == 1:
        out = [bits.signed(width) for _ in range(size)]
    else:
        if kind >= 32:
            order = kind - 31
        elif 8 <= kind <= 12:
            order = kind - 8
        else:
            raise ValueError("reserved subframe type")
        out = [bits.signed(width) for _ in range(order)]
        shift, weights = 0, FIXED_COEFFICIENTS[order] if kind < 32 else ()
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        method, parts = bits.take(2), bits.take(4)
        param_bits = 4 if method == 0 else 5
        for p in range(1 << parts):
            k = bits.take(param_bits)
            count = (size >> parts) - (order if p == 0 else 0)
            raw = bits.take(5) if k == (1 << param_bits) - 1 else None
            for _ in range(count):
                if raw is None:
                    u = bits.unary() << k | (bits.take(k) if k else 0)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = bits.signed(raw)
                out.append(r + (sum(w * x for w, x in zip(weights, reversed(out[-order:] if order else []), strict=True)) >> shift))
    return [x << wasted for x in out]


def _parse_header(data: bytes, at: int, info: Stream) -> tuple[int, int, int, int]:
    """(bytes, block size, channel code, bits) of the frame header at ``at``; its CRC-8 is checked."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where one should start")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    first = data[at + 4]
    p = at + 4 + (1 if first < 0x80 else 8 - (first ^ 0xFF).bit_length())
    if code == 6:
        size, p = data[p] + 1, p + 1
    elif code == 7:
        size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        size = BLOCK_SIZES[code]
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:p]) != data[p]:
        raise ValueError("frame header CRC-8 does not match")
    return p + 1 - at, size, data[at + 3] >> 4, SAMPLE_SIZES.get(data[at + 3] >> 1 & 7, info.bits)


def plain_frame(info: Stream, at: int) -> tuple[np.ndarray, int]:
    """(samples by channel, where the next frame starts) of any frame."""
    data = info.data
    head, size, channels, width = _parse_header(data, at, info)
    bits = _Bits(data, at + head)
    side = {8: 1, 9: 0, 10: 1}.get(channels)
    count = 2 if channels >= 8 else channels + 1
    out = np.array([_plain_subframe(bits, size, width + (side == c)) for c in range(count)], np.int64)
    if channels == 8:
        out[1] = out[0] - out[1]
    elif channels == 9:
        out[0] = out[0] + out[1]
    elif channels == 10:
        mid = out[0] << 1 | out[1] & 1
        out = np.stack([(mid + out[1]) >> 1, (mid - out[1]) >> 1])
    end = -(-bits.at // 8)
    body = np.frombuffer(data, np.uint8)
    if len(data) < end + 2 or crc16_many(body, np.array([at]), np.array([end]))[0] != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("frame CRC-16 does not match")
    return out, end + 2


_header_of = functools.lru_cache(1 << 16)(lambda head: crc8(head))


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray | None]:
    """Samples of each frame ``data[start:end]`` of one 8-bit channel, decoded side by side.

    None for a frame that needs the plain decoder.  Damaged frames raise.
    """
    n = len(start)
    crc = crc16_many(data, start, end - 2)
    if (crc != (data[end - 2].astype(np.uint16) << 8 | data[end - 1])).any():
        raise ValueError("frame CRC-16 does not match")
    raw = data.tobytes()
    size, head = np.zeros(n, np.int64), np.zeros(n, np.int64)
    simple = np.ones(n, bool)
    for i, a in enumerate(start.tolist()):
        code, first = raw[a + 2] >> 4, raw[a + 4]
        p = a + 4 + (1 if first < 0x80 else 8 - (first ^ 0xFF).bit_length())
        if raw[a] != 0xFF or raw[a + 1] != 0xF8 or raw[a + 2] & 15 or raw[a + 3] != 2 or code in (0, 6):
            simple[i] = False
            continue
        if code == 7:
            size[i], p = int.from_bytes(raw[p : p + 2], "big") + 1, p + 2
        else:
            size[i] = BLOCK_SIZES[code]
        if _header_of(raw[a:p]) != raw[p]:
            raise ValueError("frame header CRC-8 does not match")
        head[i] = p + 1 - a
    out: list[np.ndarray | None] = [None] * n
    bits = np.unpackbits(np.concatenate([data, np.zeros(8, np.uint8)]))
    words = data.astype(np.uint32)
    words = np.concatenate([words, np.zeros(4, np.uint32)])
    words = words[:-3] << 24 | words[1:-2] << 16 | words[2:-1] << 8 | words[3:]

    def take(position, width):
        """Unsigned numbers of up to 24 bits."""
        return (words[position >> 3] >> (32 - width - (position & 7)).astype(np.uint32) & ((1 << width) - 1)).astype(np.int64)

    def signed(position, width):
        x = take(position, width)
        return x - ((x >> (width - 1)) << width)

    position = (start + head) * 8
    sub = take(np.where(simple, position, 0), 8)
    simple &= (sub & 0x81) == 0
    kind = sub >> 1
    for i in np.flatnonzero(simple & (kind == CONSTANT)):
        out[i] = np.full(size[i], signed(position[i : i + 1] + 8, 8)[0], np.int8)
    for i in np.flatnonzero(simple & (kind == VERBATIM)):
        a = start[i] + head[i] + 1
        out[i] = data[a : a + size[i]].view(np.int8).copy()
    fixed = simple & (kind >= 8) & (kind <= 12)
    linear = simple & (kind >= 32)
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    lanes = np.flatnonzero((fixed | linear) & (order <= 4))
    if not len(lanes):
        return out
    lanes = lanes[np.argsort(order[lanes] - size[lanes], kind="stable")]  # most residuals first
    o, m = order[lanes], size[lanes]
    pos = position[lanes] + 8
    warm = [signed(np.where(o > j, pos + 8 * j, pos), 8) for j in range(4)]
    pos = pos + 8 * o
    is_linear = linear[lanes]
    precision = np.where(is_linear, take(pos, 4) + 1, 1)
    shift = np.where(is_linear, take(pos + 4, 5), 0)
    weights = np.zeros((4, len(lanes)), np.int64)
    for j in range(4):
        x = take(np.where(is_linear & (o > j), pos + 9 + j * precision, pos), 15) >> (15 - precision)
        weights[j] = np.where(is_linear & (o > j), x - ((x >> (precision - 1)) << precision), 0)
    pos = pos + np.where(is_linear, 9 + o * precision, 0)
    method, parts = take(pos, 2), take(pos + 2, 4)
    odd = (method != 0) | (is_linear & (shift > 15))
    pos = pos + 6
    part = m >> parts
    ones = np.flatnonzero(bits)
    following = np.empty(len(bits), np.int32)
    edges = np.concatenate([[0], ones + 1])
    following[: edges[-1]] = np.repeat(ones.astype(np.int32), np.diff(edges))
    following[edges[-1] :] = len(bits) - 1
    count = m - o
    steps = int(count.max())
    stop = np.zeros((steps, len(lanes)), np.int32)
    begin = np.zeros((steps, len(lanes)), np.int32)
    rice = np.zeros((steps, len(lanes)), np.int8)
    k, turn = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    limit = len(bits) - 64
    active = len(lanes)
    due = 0
    for r in range(steps):
        while active and count[active - 1] <= r:
            active -= 1
        if r == due:
            hit = np.flatnonzero(turn[:active] == r)
            k[hit] = take(np.minimum(pos[hit], limit), 4)
            odd[hit] |= k[hit] == 15
            pos[hit] += 4
            turn[hit] += np.where(turn[hit] == 0, part[hit] - o[hit], part[hit])
            due = int(turn[:active].min())
        here = np.minimum(pos[:active], limit)
        begin[r, :active] = here
        stop[r, :active] = np.take(following, here)
        rice[r, :active] = k[:active]
        pos[:active] = stop[r, :active] + 1 + k[:active]
    past = stop.astype(np.int64) + 1
    low = words[past >> 3] >> np.uint32(1) >> (31 - rice - (past & 7)).astype(np.uint32) & ((1 << rice.astype(np.uint32)) - 1).astype(np.uint32)
    u = (stop - begin).astype(np.int64) << rice | low
    residual = (u >> 1) ^ -(u & 1)
    del past, low, u, stop, begin, rice
    samples = np.zeros((int(m.max()), len(lanes)), np.int64)
    for n_warm in range(5):
        for use_linear in (False, True):
            own = np.flatnonzero((o == n_warm) & (is_linear == use_linear))
            if not len(own):
                continue
            width = int(count[own].max())
            res = residual[:width, own]
            first = np.array([warm[j][own] for j in range(n_warm)]).reshape(n_warm, len(own))
            if use_linear:
                y = np.concatenate([first, res])
                w, sh = weights[:n_warm, own], shift[own]
                for t in range(n_warm, n_warm + width):
                    y[t] += (w * y[t - n_warm : t][::-1]).sum(0) >> sh
            else:
                # Undo n differences: each running sum starts from the warm-up's difference of that order.
                starts = []
                d = first
                for _ in range(n_warm):
                    starts.append(d)
                    d = np.diff(d, axis=0)
                y = res
                for d in reversed(starts):
                    y = np.concatenate([d[:1], d[:1] + np.cumsum(np.concatenate([np.diff(d, axis=0), y]), axis=0)]) if len(d) == 1 else np.concatenate([d[:1], d[:1] + np.cumsum(y, axis=0)])
            samples[: len(y), own] = y
    table = samples.T.astype(np.int8)
    for c, i in enumerate(lanes.tolist()):
        if not odd[c]:
            out[i] = table[c, : m[c]]
    return out


def _pcm_bytes(frame: np.ndarray, width: int) -> bytes:
    """Interleaved samples of a frame, little-endian, in ``width`` bytes each."""
    inter = frame.T.reshape(-1)
    return inter.astype(np.int8).tobytes() if width == 1 else np.ascontiguousarray(inter.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width]).tobytes()


def decode_many(streams: list[bytes], limit: int = SLICE) -> list[list[np.ndarray]]:
    """PCM frames, (channel, sample) arrays, of each stream; checksums and MD5 are verified.

    Frames are decoded over about ``limit`` samples at a time, those of a long stream
    in several turns.
    """
    infos = [parse_stream(s) for s in streams]
    quick = []
    for i, info in enumerate(infos):
        covered = info.channels == 1 and info.bits == 8 and info.seek and info.seek[0][:2] == (0, 0)
        covered = covered and all(a[0] + a[2] == b[0] for a, b in zip(info.seek, info.seek[1:], strict=False)) and info.seek[-1][0] + info.seek[-1][2] == info.samples
        if covered:
            quick.append(i)
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for group in _windows([len(infos[i].seek) for i in quick], max(limit // BLOCK, 1)):
        # Seek points a..b of a stream: the bytes from frame a to where frame b begins.
        body, starts, ends, base = [], [], [], 0
        for q, a, b in group:
            info = infos[quick[q]]
            own = [p[1] for p in info.seek[a : b + 1]] + ([len(info.data) - info.audio] if b == len(info.seek) else [])
            starts += [base + x - own[0] for x in own[:-1]]
            ends += [base + x - own[0] for x in own[1:]]
            body.append(info.data[info.audio + own[0] : info.audio + own[-1]])
            base += len(body[-1])
        if any(y - x < 3 for x, y in zip(starts, ends, strict=True)) or (ends and ends[-1] != base) or sum(map(len, body)) != base:
            raise ValueError("seek points out of order")
        decoded = iter(decode_frames(np.frombuffer(b"".join(body), np.uint8), np.array(starts), np.array(ends)))
        for q, a, b in group:
            i = quick[q]
            for point in infos[i].seek[a:b]:
                frame = next(decoded)
                out[i].append(plain_frame(infos[i], infos[i].audio + point[1])[0] if frame is None else frame.reshape(1, -1))
    for i, info in enumerate(infos):
        if not out[i]:
            p = info.audio
            while p < len(info.data):
                frame, p = plain_frame(info, p)
                out[i].append(frame)
        # MD5 of interleaved samples in whole bytes; zero: not known.
        if any(info.md5):
            md5 = hashlib.md5()
            for f in out[i]:
                md5.update(_pcm_bytes(f, -(-info.bits // 8)))
            if md5.digest() != info.md5:
                raise ValueError("samples do not match the stream's MD5")
    return out


def payload_of(frames: list[np.ndarray]) -> bytes:
    """The unsigned bytes stored as 8-bit samples of one channel."""
    return b"".join((f[0].astype(np.int8).view(np.uint8) ^ 0x80).tobytes() for f in frames)


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, zero-padded to a multiple of 64, as FLAC."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "t", SLICE):
                texts = batch.column("t").cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
                media = encode_many([padded(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"{key} {key_type}, n_bytes bigint, media binary")


def _decoded(batches, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[np.ndarray]]]]:
    for whole in batches:
        for batch in byte_slices(whole, column, SLICE):
            media = batch.column(column).to_numpy(zero_copy_only=False).tolist()
            yield batch, media, decode_many(media)


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, block, sample_offset, n_samples, channels, pcm): little-endian 32-bit samples, interleaved."""
    key_type = media.schema[key].dataType.simpleString()

    def run(batches):
        for batch, _, decoded in _decoded(batches, "media"):
            owner, rows = [], []
            for i, frames in enumerate(decoded):
                at = 0
                for b, f in enumerate(frames):
                    owner.append(i)
                    rows.append((b, at, f.shape[1], f.shape[0], f.T.astype("<i4").tobytes()))
                    at += f.shape[1]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "block", "sample_offset", "n_samples", "channels", "pcm"])

    rows = media.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("media"))
    return rows.mapInArrow(run, f"{key} {key_type}, block bigint, sample_offset bigint, n_samples bigint, channels int, pcm binary")


def stored_media(media: DataFrame, folder: str | None = None) -> DataFrame:
    """Write media to ``folder`` (the shared checkpoint folder unless given) and read them back."""
    spark = media.sparkSession
    at = folder or f"{ensure_checkpoint_dir(spark)}/media-{uuid.uuid4().hex}"
    media.write.parquet(at)
    return spark.read.parquet(at)


def write_pcm(media: DataFrame, folder: str, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Write the PCM blocks of media to ``folder``, each task's in order of key and sample, and read them."""
    pcm_blocks(media, key, column).sortWithinPartitions(key, "sample_offset").write.parquet(folder)
    return media.sparkSession.read.parquet(folder)


def seek_samples(blocks: DataFrame, start: int, stop: int) -> DataFrame:
    """The blocks that hold samples ``start`` to ``stop``: the file reader skips others by their offset."""
    return blocks.where((F.col("sample_offset") < stop) & (F.col("sample_offset") > start - MAX_BLOCK) & (F.col("sample_offset") + F.col("n_samples") > start))


def media_features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from the decoded samples."""
    key_type = media.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch, media_bytes, decoded in _decoded(batches, "media"):
            rows = []
            for stored, frames in zip(media_bytes, decoded, strict=True):
                payload = payload_of(frames)
                peak = energy = total = changes = 0
                for a in range(0, len(payload), SLICE):  # each stretch with the sample before it
                    s = np.frombuffer(payload, np.uint8)[max(a - 1, 0) : a + SLICE].astype(np.int64) - 128
                    changes += int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
                    s = s[a > 0 :]
                    peak, energy, total = max(peak, int(np.abs(s).max())), energy + int((s * s).sum()), total + int(s.sum())
                feature = f"flac 8 bit {RATE} Hz frames={len(frames)} peak={peak} energy={energy} sum={total} crossings={changes}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    rows = media.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), "n_bytes", F.col(column).alias("media"))
    return rows.mapInArrow(run, f"{key} {key_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
