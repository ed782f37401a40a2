"""FLAC: exact round trips, checksums, and the plain decoder as a second opinion."""

import hashlib
import zlib

import numpy as np
import pytest

from glyphmill.llm import flac

SF = "/root/testdata/sf0.001"


def payloads():
    rng = np.random.default_rng(1)
    byte = lambda x: np.asarray(x).astype(np.uint8).tobytes()
    raw = [b"", b"a" * 64, bytes(range(256)) * 9, byte(rng.integers(0, 256, 5000)), b"Hello world, this is text. " * 64, byte(128 + 100 * np.sin(np.arange(6400) / 20)), byte(np.cumsum(rng.integers(-2, 3, 4096))), byte(np.cumsum(np.cumsum(rng.integers(-1, 2, 640))) // 4), bytes(300_000), "é".encode() * 40_000]
    return [flac.padded(p) for p in raw]


def plain(stream):
    info = flac.parse_stream(stream)
    at, out = info.audio, []
    while at < len(stream):
        frame, at = flac.plain_frame(info, at)
        out.append(frame)
    return out


def test_round_trip_by_both_decoders():
    all_ = payloads()
    streams = flac.encode_many(all_)
    assert [flac.payload_of(f) for f in flac.decode_many(streams)] == all_
    assert [flac.payload_of(plain(s)) for s in streams] == all_
    kinds = set()
    for s in streams:
        info = flac.parse_stream(s)
        for _, offset, _ in info.seek:
            head = flac._parse_header(s, info.audio + offset, info)[0]
            kinds.add(s[info.audio + offset + head] >> 1)
    assert {0, 1, 9, 10, 33} <= kinds


def test_seek_points_give_single_frames():
    payload = payloads()[5]
    stream = flac.encode_many([payload])[0]
    info = flac.parse_stream(stream)
    for sample, offset, size in info.seek:
        frame, _ = flac.plain_frame(info, info.audio + offset)
        assert flac.payload_of([frame]) == payload[sample : sample + size]


def test_streams_without_seek_table():
    payload = payloads()[4]
    stream = flac.encode_many([payload])[0]
    info = flac.parse_stream(stream)
    bare = flac.stream_head(info.samples, info.md5, []) + stream[info.audio :]
    assert flac.payload_of(flac.decode_many([bare])[0]) == payload


def test_stereo_sixteen_bits_with_escaped_partition():
    """A hand-made frame: mid-side stereo, fixed order 1, one escaped partition, wasted bits."""
    left, right = [100, 104, 96, 92], [98, 100, 100, 90]
    mid, side = [(a + b) >> 1 for a, b in zip(left, right, strict=True)], [a - b for a, b in zip(left, right, strict=True)]
    bits = ""
    put = lambda v, n: format(v & ((1 << n) - 1), f"0{n}b")
    bits += "0" + put(9, 6) + "0" + put(mid[0], 16) + "00" + "0000" + "1111" + put(6, 5)
    bits += "".join(put(b - a, 6) for a, b in zip(mid, mid[1:], strict=False))
    bits += "0" + put(1, 6) + "1" + "01" + "".join(put(s >> 2, 17 - 2) for s in side) if all(s % 4 == 0 for s in side) else "0" + put(1, 6) + "1" + "1" + "".join(put(s >> 1, 16) for s in side)
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x60, 0xA8, 0, 3])
    head += bytes([flac.crc8(head)])
    body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = int(flac.crc16_many(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
    pcm = np.array([left, right]).T.astype("<i2").tobytes()
    packed = 44100 << 44 | 1 << 41 | 15 << 36 | 4
    info = bytes([0x80, 0, 0, 34]) + (4).to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(pcm).digest()
    frames = flac.decode_many([b"fLaC" + info + body + crc.to_bytes(2, "big")])[0]
    assert frames[0].tolist() == [left, right]


def test_damage_is_noticed():
    stream = bytearray(flac.encode_many([payloads()[4]])[0])
    stream[-10] ^= 4
    with pytest.raises(ValueError):
        flac.decode_many([bytes(stream)])
    with pytest.raises(ValueError):
        flac.decode_many([b"RIFF"])


def test_crc16_bit_by_bit():
    data = np.random.default_rng(2).integers(0, 256, 300).astype(np.uint8)
    for a, b in ((0, 300), (3, 8), (10, 11), (5, 5)):
        c = 0
        for x in data[a:b].tolist():
            c ^= x << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        assert flac.crc16_many(data, np.array([a]), np.array([b]))[0] == c


def test_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "'clash' AS media", "1 AS n_bytes")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "x", 0), (-2, "", "x", 0), (-2, "", "x", 0)], docs.schema))
    media = flac.encode_media(docs)
    rows = flac.media_features(media).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        data = texts[r.doc_id].encode()
        whole = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    blocks = flac.pcm_blocks(media.where("doc_id >= 0"))
    rebuilt = {}
    for b in sorted(blocks.collect(), key=lambda b: (b.doc_id, b.block)):
        own = rebuilt.setdefault(b.doc_id, bytearray())
        assert b.sample_offset == len(own)
        own += (np.frombuffer(b.pcm, "<i4") + 128).astype(np.uint8).tobytes()
    assert all(bytes(v).rstrip(b"\0") == texts[k].encode().rstrip(b"\0") for k, v in rebuilt.items())
    assert flac.encode_media(docs.limit(0)).count() == 0
