import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import matroska as m


@settings(deadline=None, max_examples=60)
@given(st.binary(min_size=0, max_size=60_000), st.sampled_from([m.FIXED, m.XIPH, m.EBML_LACING]))
def test_round_trip(raw, how):
    payload = raw + b" " * (-len(raw) % m.FRAME or (0 if raw else m.FRAME))
    data = m.write(payload, how)
    found = m.parse(data)
    assert not found.damage and m.payload_of(data, found) == payload
    assert [p[1] for p in found.packets] == [k * 24_000_000 for k in range(len(payload) // m.FRAME)]
    assert [c[2] for c in found.cues] == found.clusters and found.doc_type == "matroska"


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(min_size=0, max_size=700), min_size=2, max_size=9), st.sampled_from([m.XIPH, m.EBML_LACING]))
def test_uneven_laces(frames, how):
    body = m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 5) + m.block(2, -3, frames, how))
    data = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm")) + m.element(m.SEGMENT, body)
    found = m.parse(data)
    assert not found.damage and [data[p[2] : p[2] + p[3]] for p in found.packets] == frames
    assert {p[0] for p in found.packets} == {2} and {p[1] for p in found.packets} == {2_000_000}


def test_unknown_sizes_and_block_groups():
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.uint(m.TIMESTAMP, 7)
    group = m.element(m.BLOCK_GROUP, m.block(1, 1, [b"abc"], m.NO_LACING, m.BLOCK) + m.uint(m.REFERENCE, 1))
    data = m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + group + cluster + m.block(1, 0, [b"d"], m.NO_LACING)
    found = m.parse(data)
    assert [(data[p[2] : p[2] + p[3]], p[1], p[4], p[5]) for p in found.packets] == [(b"abc", 8_000_000, False, 0), (b"d", 7_000_000, True, 1)]


@pytest.mark.parametrize("cut", [1, 30, 400, 1000])
def test_damage_keeps_what_came_before(cut):
    whole = m.write(b"x" * 192 * 2000)
    found = m.parse(whole[:-cut])
    assert found.damage
    kept = m.parse(whole).packets
    assert found.packets == kept[: len(found.packets)] and len(found.packets) >= len(kept) - 512


def test_packet_table(spark):
    rows = [(1, m.write(b"a" * 192 * 3)), (2, None), (3, b"\0junk"), (None, m.write(b"b" * 192)), (5, b"")]
    out = m.packets(spark.createDataFrame(rows, "media_id long, content binary")).collect()
    assert sorted((r.media_id or 0, r.packet, r.byte_length) for r in out if r.packet is not None) == [(0, 0, 192), (1, 0, 192), (1, 1, 192), (1, 2, 192)]
    assert [(r.media_id, bool(r.damage)) for r in out if r.packet is None] == [(3, True)] and all(r.cued for r in out if r.packet is not None)


#: A file put together by hand from the specification: EBML head, a segment of known size with one track (number 1, 1.25 ms a
#: frame), a cluster at 10 ms, a block with Xiph lacing (frames of 1 and 2 bytes), one with EBML lacing (frames of 3, 1 and 2
#: bytes: sizes 0x83, then -2 as 0xBD, the last from what is left), one with a single frame, one with fixed lacing (two of 2 bytes).
GOLDEN = bytes.fromhex(
    "1A45DFA3 87 4282 84 7765626D"
    "18538067 C9"
    "1654AE6B 90 AE 8E D7 81 01 86 82 4131 23E383 83 1312D0"
    "1F43B675 AF E7 81 0A"
    "A3 89 81 0001 82 01 01 61 6262"
    "A3 8D 81 FFFF 06 02 83 BD 636363 64 6565"
    "A3 85 81 0004 00 6A"
    "A3 89 81 0006 04 01 6B6B 6C6C"
)


def test_golden_bytes():
    found = m.parse(GOLDEN)
    assert (found.damage, found.doc_type, found.scale) == ("", "webm", 1_000_000)
    assert found.tracks == {1: {"number": 1, "codec": "A1", "frame_ns": 1_250_000}}
    got = [(GOLDEN[p[2] : p[2] + p[3]], p[1], p[4], p[6]) for p in found.packets]
    assert got == [(b"a", 11_000_000, True, 0), (b"bb", 12_250_000, True, 1), (b"ccc", 9_000_000, False, 0), (b"d", 10_250_000, False, 1), (b"ee", 11_500_000, False, 2), (b"j", 14_000_000, False, 0), (b"kk", 16_000_000, False, 0), (b"ll", 17_250_000, False, 1)]


def test_writer_bytes():
    """What is written for one packet, byte by byte from the specification."""
    data = m.write(b"x" * 192)
    cluster = bytes.fromhex("1F43B675 40CA E78100 A3 40C4 81 0000 80") + b"x" * 192
    assert data.startswith(bytes.fromhex("1A45DFA3 A3 4286 81 01 42F7 81 01 42F2 81 04 42F3 81 08 4282 88") + b"matroska") and data.count(cluster) == 1


@pytest.mark.parametrize("data", [b"\xa0\xff" * 3000, b"\xa0\x01" + b"\xff" * 7 + b"\xa0\xff" * 50_000])
def test_nested_without_end(data):
    assert "too deep" in m.parse(data).damage


def test_long_integers_and_times():
    late = m.element(m.SEGMENT, m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 3) + m.block(1, 0, [b"a"], 0)) + m.element(m.CLUSTER, m.element(m.TIMESTAMP, b"\xff" * 9) + m.block(1, 0, [b"b"], 0)))
    assert "integer of 9 bytes" in m.parse(late).damage and len(m.parse(late).packets) == 1
    far = m.element(m.SEGMENT, m.element(m.CLUSTER, m.element(m.TIMESTAMP, b"\xff" * 8) + m.block(1, 0, [b"b"], 0)))
    assert "64 bits" in m.parse(far).damage


@settings(deadline=None, max_examples=400)
@given(st.integers(0, 2**31), st.integers(1, 6), st.booleans())
def test_any_bytes_are_parsed_or_damage(seed, n, cut):
    """Flipped, cut and nested input never raises, and all packets lie within the file and within 64 bits."""
    rng = random.Random(seed)
    data = bytearray(m.write(bytes(rng.randrange(256) for _ in range(192)) * 70) if n % 2 else GOLDEN)
    for _ in range(n):
        data[rng.randrange(len(data))] = rng.randrange(256)
    data = bytes(data[: rng.randrange(len(data))] if cut else data)
    for one in (data, m.element(m.SEGMENT, data), m.element(m.CLUSTER, data)):
        found = m.parse(one)
        assert all(0 <= p[2] <= p[2] + p[3] <= len(one) and abs(p[1]) < 2**63 and 0 <= p[0] < 2**63 for p in found.packets)


def test_hostile_media_in_spark(spark):
    rows = [(1, b"\xa0\xff" * 3000, "clash"), (2, m.element(m.CLUSTER, m.element(m.TIMESTAMP, b"\xff" * 9)), "clash"), (3, GOLDEN, "clash")]
    out = m.packets(spark.createDataFrame(rows, "media_id long, content binary, packet string")).collect()
    assert sorted((r.media_id, r.packet, bool(r.damage)) for r in out if r.packet is None) == [(1, None, True), (2, None, True)]
    assert len([r for r in out if r.media_id == 3]) == 8


def plain_packets(n):
    """The packet table that a text of ``n`` packets must have: start and length in its file, without the parser."""
    return [(1, k * 24_000_000, k // 512, k % 512 % 64) for k in range(n)]


def check(rows, docs):
    have = {}
    for r in rows:
        have.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, have.values())) == len(docs)
    for doc, text in docs:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        for r in have[doc]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            stored = m.write(payload)
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
            n = len(payload) // 192
            packets = m.parse(stored).packets
            assert [(p[0], p[1], p[5], p[6]) for p in packets] == plain_packets(n) and all(stored[p[2] : p[2] + p[3]] == payload[k * 192 : k * 192 + 192] for k, p in enumerate(packets))
            assert (r.n_packets, r.n_cued, r.last_timestamp_ns) == (n, n, (n - 1) * 24_000_000)
            table = b"".join(int(v).to_bytes(8, "little") for p in packets for v in p)
            assert r.packets_sha256 == hashlib.sha256(table).hexdigest()
            blocks = sum(-(-min(512, n - first) // 64) for first in range(0, n, 512))
            assert r.feature == f"codec=A_PCM/INT/LIT;rate=8000;bits=8;clusters={-(-n // 512)};blocks={blocks};packets={n};cues={-(-n // 512)};ms={n * 24};mean={sum(payload) * 1000 // len(payload)};peak={max(payload)}"


def test_hard_rows(spark):
    docs = [(1, ""), (2, None), (None, "é🙂"), (4, "y" * 192), (5, "z" * 1_000_000)]
    check(m.store_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    assert m.store_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    check(m.op3_matroska_packets(spark, tiny).collect(), docs)
