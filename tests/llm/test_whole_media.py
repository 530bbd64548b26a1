"""Movies of other writers: fragments, wide boxes, packed sizes; each against the ranges that the test itself laid out."""

import hashlib
import struct

import pytest

from lodestone.llm import media
from lodestone.llm.media import box, full_box


def track(k, sizes=b"", *tables):
    empty = (full_box(b"stts", 0, 0, bytes(4)), full_box(b"stsc", 0, 0, bytes(4)), full_box(b"stsz", 0, 0, bytes(8)), full_box(b"stco", 0, 0, bytes(4)))
    stbl = box(b"stbl", full_box(b"stsd", 0, 0, struct.pack(">I", 1), box(b"avc1", bytes(8))), *(tables or empty))
    return box(b"trak", full_box(b"tkhd", 0, 3, struct.pack(">IIIII", 0, 0, k, 0, 0)), box(b"mdia", full_box(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 10, 0)), box(b"minf", stbl)))


def wide(kind, body):
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def traf(k, flags, fields, *runs):
    return box(b"traf", full_box(b"tfhd", 0, flags, struct.pack(">I", k), fields), *runs)


def run(sizes, offset=None, marks=None):
    flags = 0x200 | (1 if offset is not None else 0) | (0x400 if marks else 0)
    rows = b"".join(struct.pack(">I", s) + (struct.pack(">I", marks[i]) if marks else b"") for i, s in enumerate(sizes))
    return full_box(b"trun", 0, flags, struct.pack(">I", len(sizes)), struct.pack(">i", offset) if offset is not None else b"", rows)


NOT_SYNC = 0x10000


@pytest.mark.parametrize("header", [lambda b: box(b"moof", b), lambda b: wide(b"moof", b)])
@pytest.mark.parametrize("from_moof", [False, True])
def test_fragments(header, from_moof):
    flags = 8 | (0x20000 if from_moof else 0)
    head = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", track(1), track(2), box(b"mvex", *[full_box(b"trex", 0, 0, struct.pack(">IIIII", k, 1, 2, 0, 0)) for k in (1, 2)]))

    def moof(length):
        first = traf(1, flags, struct.pack(">I", 3), run([5, 7], length + 8, [0, NOT_SYNC]), run([4]))
        second = traf(2, flags, struct.pack(">I", 1), run([6, 9], length + 8 + 16 if from_moof else None, [NOT_SYNC, 0]))
        return header(first + second)

    length = len(moof(0))
    blob = head + moof(length) + box(b"mdat", bytes(range(31)))
    at = len(head) + length + 8
    status, (one, two) = media.probe(blob)
    assert status == "ok"
    assert one["offsets"].tolist() == [at, at + 5, at + 12] and one["sizes"].tolist() == [5, 7, 4] and one["duration"] == 9
    assert one["keyframes"].tolist() == [[at, 5], [at + 12, 4]]
    assert two["offsets"].tolist() == [at + 16, at + 22] and two["keyframes"].tolist() == [[at + 22, 9]] and two["duration"] == 2
    assert media.payload_of(blob, one) == bytes(range(16)) and media.payload_of(blob, two) == bytes(range(16, 31))


def test_each_fragment_counts_from_its_own_place():
    head = box(b"moov", track(1), box(b"mvex", full_box(b"trex", 0, 0, struct.pack(">IIIII", 1, 1, 1, 0, 0))))
    part = box(b"moof", traf(1, 0, b"", run([8], len(box(b"moof", traf(1, 0, b"", run([8], 0)))) + 8)))
    data = [bytes([k] * 8) for k in (1, 2, 3)]
    blob = head + b"".join(part + box(b"mdat", d) for d in data)
    status, (one,) = media.probe(blob)
    assert status == "ok" and media.payload_of(blob, one) == b"".join(data)
    last = len(blob) - 8
    named = head + box(b"moof", traf(1, 1, struct.pack(">Q", 5), run([8], 3)))
    assert media.probe(named)[1][0]["offsets"].tolist() == [8] and one["offsets"][-1] == last


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_packed_sizes_and_wide_offsets(bits):
    sizes = [3, 15, 1, 9, 2]
    packed = {4: bytes([3 << 4 | 15, 1 << 4 | 9, 2 << 4]), 8: bytes(sizes), 16: struct.pack(">5H", *sizes)}[bits]

    def head(at):
        tables = (
            full_box(b"stts", 0, 0, struct.pack(">III", 1, 5, 2)),
            full_box(b"stsc", 0, 0, struct.pack(">I6I", 2, 1, 3, 1, 2, 2, 1)),
            full_box(b"stz2", 0, 0, bytes(3), bytes([bits]), struct.pack(">I", 5), packed),
            full_box(b"co64", 0, 0, struct.pack(">IQQ", 2, at, at + 100)),
            full_box(b"stss", 0, 0, struct.pack(">III", 2, 1, 5)),
        )
        return box(b"moov", track(1, b"", *tables))

    at = len(head(0)) + 8
    blob = head(at) + box(b"mdat", bytes(200))
    status, (one,) = media.probe(blob)
    assert status == "ok" and one["codec"] == "avc1"
    assert one["offsets"].tolist() == [at, at + 3, at + 18, at + 100, at + 109] and one["keyframes"].tolist() == [[at, 3], [at + 109, 2]]


def test_stored_digest_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a" * 100_000, "x"), (2, None, "x"), (None, "a" * 100_000, "x")], "doc_id bigint, text string, media_sha256 string")
    got = {r.doc_id: r for r in media.digest_texts(docs).collect()}
    for k, raw in ((1, b"a" * 100_000), (2, b"")):
        stored = media.wrap_payload(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
        assert (got[k].media_bytes, got[k].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert [x for x in got[1] if x != 1] == [x for x in got[None] if x is not None]
    assert media.digest_texts(docs.limit(0)).count() == 0
