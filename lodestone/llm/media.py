"""Media columns: ISO base media files, probed through their boxes and sample tables alone.

`probe_media` walks nested boxes, decodes the sample tables (stts, stsc, stsz / stz2, stco / co64, stss) and movie
fragments (moof / traf / trun) and stores each track's codec, duration and keyframe byte ranges; media data are
skipped, never decoded. `wrap_payload` is the writer: 8-bit grey 8 x 8 frames of 64 bytes, one sample each,
a sync sample every 16 frames.

Defined results: a null blob gives status `null` and no tracks; bytes without a movie give `no_movie`; boxes that
run over their parent, or tables that contradict each other, give `malformed`. No input raises. Repeated rows and
further columns pass through; a column of the result's name is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import ship

FRAME = 64
GROUP = 16
TIMESCALE = 25
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf")
MAX_DEPTH = 16
TRACKS = "array<struct<track_id:bigint,codec:string,timescale:bigint,duration:bigint,duration_s:double,samples:bigint,keyframes:array<struct<offset:bigint,length:bigint>>>>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap_payload(payload: bytes) -> bytes:
    """A movie whose samples are the payload's 64-byte frames. Its length must be a positive multiple of 64."""
    n = len(payload) // FRAME
    if n < 1 or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = struct.pack(">6xH", 1) + struct.pack(">16xHHIIIH32sHh", 8, 8, 0x480000, 0x480000, 0, 1, b"\4raw8", 8, -1)
    firsts = np.arange(0, n, GROUP)
    chunk_runs = [(1, GROUP, 1)] if n >= GROUP else []
    if n % GROUP:
        chunk_runs.append((n // GROUP + 1, n % GROUP, 1))

    def movie(at: int) -> bytes:
        offsets = firsts * FRAME + at
        wide = int(offsets[-1]) >= 1 << 32
        table = box(
            b"stbl",
            full_box(b"stsd", 0, 0, struct.pack(">I", 1), box(b"raw ", entry)),
            full_box(b"stts", 0, 0, struct.pack(">III", 1, n, 1)),
            full_box(b"stss", 0, 0, struct.pack(">I", len(firsts)), (firsts + 1).astype(">u4").tobytes()),
            full_box(b"stsc", 0, 0, struct.pack(">I", len(chunk_runs)), *[struct.pack(">III", *r) for r in chunk_runs]),
            full_box(b"stsz", 0, 0, struct.pack(">II", FRAME, n)),
            full_box(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        return box(
            b"moov",
            full_box(b"mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, n, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2)),
            box(
                b"trak",
                full_box(b"tkhd", 0, 3, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), matrix, struct.pack(">II", 8 << 16, 8 << 16)),
                box(
                    b"mdia",
                    full_box(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
                    full_box(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
                    box(b"minf", full_box(b"vmhd", 0, 1, bytes(8)), box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1))), table),
                ),
            ),
        )

    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    lead = 8 if len(payload) + 8 < 1 << 32 else 16
    head = kind + movie(len(kind) + len(movie(0)) + lead)
    if len(kind) + len(movie(0)) + lead != len(head) + lead:  # the offsets became wide
        head = kind + movie(len(head) + lead)
    data = struct.pack(">I4s", len(payload) + 8, b"mdat") if lead == 8 else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    return head + data + payload


def boxes(data: memoryview, start: int, end: int):
    """(type, start of the body, end) of the boxes side by side in data[start:end]."""
    while start < end:
        if end - start < 8:
            raise ValueError("box header cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("box header cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError("box runs over its parent")
        yield kind, body, start + size
        start += size


def children(data: memoryview, start: int, end: int, depth: int = 0) -> list:
    """The tree below: [(type, start, end, children)]; only known containers are entered."""
    if depth > MAX_DEPTH:
        raise ValueError("boxes nest too deeply")
    return [(k, b, e, children(data, b, e, depth + 1) if k in CONTAINERS else []) for k, b, e in boxes(data, start, end)]


def find(tree: list, *path: bytes):
    for kind, start, end, below in tree:
        if kind == path[0]:
            if len(path) == 1:
                return start, end, below
            if found := find(below, *path[1:]):
                return found
    return None


def table(data: memoryview, tree: list, kind: bytes, dtype: str, width: int = 1) -> np.ndarray | None:
    """The rows of a counted table."""
    if not (at := find(tree, kind)):
        return None
    (n,) = struct.unpack_from(">I", data, at[0] + 4)
    if at[0] + 8 + n * width * np.dtype(dtype).itemsize > at[1]:
        raise ValueError("table runs over its box")
    return np.frombuffer(data, dtype, n * width, at[0] + 8).astype(np.int64).reshape(n, width)


def sample_sizes(data: memoryview, tree: list) -> np.ndarray:
    if at := find(tree, b"stsz"):
        each, n = struct.unpack_from(">II", data, at[0] + 4)
        if each:
            if n * each > len(data):
                raise ValueError("more samples than bytes")
            return np.full(n, each, np.int64)
        if at[0] + 12 + 4 * n > at[1]:
            raise ValueError("table runs over its box")
        return np.frombuffer(data, ">u4", n, at[0] + 12).astype(np.int64)
    if at := find(tree, b"stz2"):
        bits, n = struct.unpack_from(">3xBI", data, at[0] + 4)
        if bits not in (4, 8, 16) or at[0] + 12 + (n * bits + 7) // 8 > at[1]:
            raise ValueError("table runs over its box")
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, (n + 1) // 2, at[0] + 12)
            return np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n].astype(np.int64)
        return np.frombuffer(data, ">u2" if bits == 16 else np.uint8, n, at[0] + 12).astype(np.int64)
    return np.zeros(0, np.int64)


def sample_offsets(data: memoryview, tree: list, sizes: np.ndarray) -> np.ndarray:
    """Each sample's place in the file, from chunk runs, chunk offsets and sizes."""
    runs = table(data, tree, b"stsc", ">u4", 3)
    chunks = table(data, tree, b"stco", ">u4")
    if chunks is None:
        chunks = table(data, tree, b"co64", ">u8")
    if not len(sizes):
        return np.zeros(0, np.int64)
    if runs is None or chunks is None or not len(runs) or not len(chunks):
        raise ValueError("samples without chunks")
    chunks = chunks[:, 0]
    length = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if runs[0, 0] != 1 or (length < 0).any():
        raise ValueError("chunk runs out of order")
    if (runs[:, 1] > len(sizes)).any():
        raise ValueError("chunks hold too many samples")
    per_chunk = np.repeat(runs[:, 1], length)
    if per_chunk.sum() != len(sizes):
        raise ValueError("chunks hold another number of samples")
    before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    first = np.concatenate(([0], np.cumsum(per_chunk)))[:-1]
    held = per_chunk > 0
    return np.repeat(chunks[held] - before[first[held]], per_chunk[held]) + before


def duration_of(data: memoryview, tree: list) -> tuple[int, int]:
    if not (at := find(tree, b"mdia", b"mdhd")):
        raise ValueError("a track without a media header")
    if data[at[0]] == 1:
        return struct.unpack_from(">IQ", data, at[0] + 20)
    return struct.unpack_from(">II", data, at[0] + 12)


def fragments(data: memoryview, tree: list) -> dict[int, list]:
    """Per track (offset, size, is sync, duration) of the samples in movie fragments.

    Offsets count from the place that a fragment's header names; else from its movie fragment, where it says so or where it is the first;
    else from the end of the data of the fragment before it.
    """
    defaults = {}
    if at := find(tree, b"moov", b"mvex"):
        for kind, start, _, _ in at[2]:
            if kind == b"trex":
                track, _, span, size, flags = struct.unpack_from(">IIIII", data, start + 4)
                defaults[track] = (span, size, flags)
    out: dict[int, list] = {}
    end = 0
    for kind, _, body_end, below in tree:
        moof, end = end, body_end  # top-level boxes touch
        if kind != b"moof":
            continue
        place = moof
        for kind2, _, _, parts in below:
            if kind2 != b"traf" or not (at := find(parts, b"tfhd")):
                continue
            flags, track = struct.unpack_from(">II", data, at[0])
            p, base = at[0] + 8, moof if flags & 0x20000 else place
            span, size, marks = defaults.get(track, (0, 0, 0))
            if flags & 1:
                (base,) = struct.unpack_from(">Q", data, p)
                p += 8
            p += 4 * bool(flags & 2)
            for bit in (8, 16, 32):
                if flags & bit:
                    (value,) = struct.unpack_from(">I", data, p)
                    span, size, marks = (value if bit == 8 else span), (value if bit == 16 else size), (value if bit == 32 else marks)
                    p += 4
            place = base
            for kind3, s, e, _ in parts:
                if kind3 != b"trun":
                    continue
                how, n = struct.unpack_from(">II", data, s)
                p = s + 8
                if how & 1:
                    place = base + struct.unpack_from(">i", data, p)[0]
                    p += 4
                first = marks
                if how & 4:
                    (first,) = struct.unpack_from(">I", data, p)
                    p += 4
                width = 4 * sum(bool(how & b) for b in (0x100, 0x200, 0x400, 0x800))
                if p + width * n > e or n > len(data):
                    raise ValueError("run of samples runs over its box")
                for i in range(n):
                    each, length, mark = span, size, first if i == 0 else marks
                    for b in (0x100, 0x200, 0x400):
                        if how & b:
                            (value,) = struct.unpack_from(">I", data, p)
                            each, length, mark = (value if b == 0x100 else each), (value if b == 0x200 else length), (value if b == 0x400 else mark)
                            p += 4
                    p += 4 * bool(how & 0x800)
                    out.setdefault(track, []).append((place, length, not mark & 0x10000, each))
                    place += length
    return out


def probe(blob: bytes | None) -> tuple[str, list[dict]]:
    """(status, tracks) of one file."""
    if blob is None:
        return "null", []
    data = memoryview(blob)
    try:
        tree = children(data, 0, len(data))
        moov = find(tree, b"moov")
        if not moov:
            return "no_movie", []
        later, tracks = fragments(data, tree), []
        for kind, _, _, below in moov[2]:
            if kind != b"trak":
                continue
            head, stbl = find(below, b"tkhd"), find(below, b"mdia", b"minf", b"stbl")
            if not head or not stbl:
                raise ValueError("a track without header or sample table")
            (track,) = struct.unpack_from(">I", data, head[0] + (20 if data[head[0]] == 1 else 12))
            scale, duration = duration_of(data, below)
            about = find(stbl[2], b"stsd")
            codec = bytes(data[about[0] + 12 : about[0] + 16]).decode("latin-1") if about and about[1] - about[0] >= 16 else None
            sizes = sample_sizes(data, stbl[2])
            offsets = sample_offsets(data, stbl[2], sizes)
            times = table(data, stbl[2], b"stts", ">u4", 2)
            if times is not None and times[:, 0].sum() != len(sizes):
                raise ValueError("times of another number of samples")
            sync = table(data, stbl[2], b"stss", ">u4")
            keys = np.arange(len(sizes)) if sync is None else sync[:, 0] - 1
            if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
                raise ValueError("a sync sample that isn't there")
            ranges = np.stack([offsets[keys], sizes[keys]], 1)
            if more := later.get(track):
                ranges = np.concatenate([ranges, np.array([x[:2] for x in more if x[2]], np.int64).reshape(-1, 2)])
                duration = max(duration, (int((times[:, 0] * times[:, 1]).sum()) if times is not None else 0) + sum(x[3] for x in more))
                sizes = np.append(sizes, [x[1] for x in more])
                offsets = np.append(offsets, [x[0] for x in more])
            if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
                raise ValueError("samples outside the file")
            tracks.append({"track_id": track, "codec": codec, "timescale": scale, "duration": duration, "duration_s": duration / scale if scale else None, "samples": len(sizes), "keyframes": ranges, "offsets": offsets, "sizes": sizes})
        return "ok", tracks
    except (ValueError, struct.error, IndexError, OverflowError):
        return "malformed", []


def payload_of(blob: bytes, track: dict) -> bytes:
    """The samples' bytes in order; samples that touch are read in one piece."""
    offsets, sizes = track["offsets"], track["sizes"]
    new = np.flatnonzero(np.concatenate(([True], offsets[1:] != offsets[:-1] + sizes[:-1])))
    ends = np.append(new[1:], len(sizes)) - 1
    return b"".join(blob[offsets[a] : offsets[b] + sizes[b]] for a, b in zip(new, ends, strict=True))


def track_rows(tracks: list[dict]) -> list[dict]:
    return [{k: v for k, v in t.items() if k not in ("offsets", "sizes", "keyframes")} | {"keyframes": [{"offset": int(o), "length": int(n)} for o, n in t["keyframes"]]} for t in tracks]


def probe_media(df: DataFrame, blob: str = "media") -> DataFrame:
    """df with `media_status` and `media_tracks`, from the binary column `blob`."""
    from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

    kept = [f for f in df.schema.fields if f.name not in ("media_status", "media_tracks")]
    schema = StructType([*kept, StructField("media_status", StringType()), StructField("media_tracks", _parse_datatype_string(TRACKS))])
    from pyspark.sql.pandas.types import to_arrow_type

    tracks_type = to_arrow_type(schema["media_tracks"].dataType)
    at = [f.name for f in kept].index(blob)

    def run(batches):
        for batch in batches:
            found = [probe(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s for s, _ in found], pa.string()), pa.array([track_rows(t) for _, t in found], tracks_type)],
                names=[*batch.schema.names, "media_status", "media_tracks"],
            )

    return df.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def digest_texts(docs: DataFrame) -> DataFrame:
    """Wrap every text as a movie, read its payload back through the sample tables, and digest both.

    Null texts count as empty. A row for every row of docs; equal texts have equal values in all but doc_id.
    """
    schema = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
        "codec string, duration_s double, keyframes array<struct<offset:bigint,length:bigint>>"
    )
    ranges_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows, counts, places, lengths = [], [0], [], []
            for text in batch.column(1):
                raw = text.as_buffer() if text.is_valid else b""
                raw = raw.to_pybytes() if raw else b""
                media = wrap_payload(raw + bytes(-len(raw) % FRAME or (0 if raw else FRAME)))
                status, tracks = probe(media)
                if status != "ok" or len(tracks) != 1:
                    raise AssertionError("a file of this module's own could not be read back")
                t = tracks[0]
                back, keys = payload_of(media, t), t["keyframes"]
                feature = f"codec={t['codec'].strip()};timescale={t['timescale']};duration={t['duration']};samples={t['samples']};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]};ranges={zlib.crc32(keys.astype('<i8').tobytes()):08x}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature, t["codec"].strip(), t["duration_s"]))
                counts.append(counts[-1] + len(keys))
                places.append(keys[:, 0])
                lengths.append(keys[:, 1])
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
            pair = pa.StructArray.from_arrays([pa.array(np.concatenate(places or [np.zeros(0, np.int64)])), pa.array(np.concatenate(lengths or [np.zeros(0, np.int64)]))], names=["offset", "length"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pair).cast(ranges_type)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


ship(__name__)
