"""ISO media containers in a binary column: what boxes and sample tables say, without decoding payloads."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import small_batches, stored, table, texts

#: Frames of 8 x 8 samples of 8 bits: 64 bytes.
SIDE = 8
FRAME = SIDE * SIDE
FRAMES_A_SECOND = 25
FRAMES_A_CHUNK = 32
KEYFRAME_EVERY = 16
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < (1 << 32) - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def build(payload: bytes) -> bytes:
    """A container with one video track of uncompressed 8-bit grey frames that hold the payload (a positive multiple of 64 bytes) as it is."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of a frame")
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_A_CHUNK)
    keys = np.arange(1, frames + 1, KEYFRAME_EVERY)
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")
    mvhd = full_box(b"mvhd", 1, 0, struct.pack(">QQIQIH10x", 0, 0, FRAMES_A_SECOND, frames, 0x10000, 0x100), _UNITY, bytes(24), struct.pack(">I", 2))
    tkhd = full_box(b"tkhd", 1, 3, struct.pack(">QQI4xQ8xhhH2x", 0, 0, 1, frames, 0, 0, 0), _UNITY, struct.pack(">II", SIDE << 16, SIDE << 16))
    mdhd = full_box(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, FRAMES_A_SECOND, frames, 0x55C4, 0))
    hdlr = full_box(b"hdlr", 0, 0, b"mhlr", b"vide", bytes(12), b"\0")
    entry = box(b"raw ", bytes(6), struct.pack(">HHH4sIIHHIIIH", 1, 0, 0, bytes(4), 0, 0, SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    last = frames - (chunks - 1) * FRAMES_A_CHUNK
    runs = [(1, FRAMES_A_CHUNK if chunks > 1 else last, 1)] + ([(chunks, last, 1)] if chunks > 1 and last != FRAMES_A_CHUNK else [])

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * FRAMES_A_CHUNK * FRAME
        stbl = box(
            b"stbl",
            full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, 0, struct.pack(">III", 1, frames, 1)),
            full_box(b"stss", 0, 0, struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            full_box(b"stsc", 0, 0, struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", 0, 0, struct.pack(">II", FRAME, frames)),
            full_box(b"co64", 0, 0, struct.pack(">I", chunks), offsets.astype(">u8").tobytes()),
        )
        dinf = box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1)))
        minf = box(b"minf", full_box(b"vmhd", 0, 1, bytes(8)), dinf, stbl)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    data = box(b"mdat", payload)
    start = len(head) + len(moov(0)) + len(data) - len(payload)
    return head + moov(start) + data


def boxes(data: memoryview, begin: int = 0, end: int | None = None):
    """(kind, begin of body, end) of the boxes of a range; a box that runs beyond its parent is an error."""
    end = len(data) if end is None else end
    while begin < end:
        if end - begin < 8:
            raise ValueError(f"{end - begin} stray bytes at {begin}")
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            if end - body < 8:
                raise ValueError(f"box at {begin} is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else begin + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {begin} has size {size}")
        yield kind, body, stop
        begin = stop


def _numbers(data: memoryview, begin: int, end: int, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if begin + n * size > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data[begin : begin + n * size], kind).astype(np.int64)


def _nested(data: memoryview, begin: int, end: int):
    """The boxes of a range and, in their order, those within containers, however deep."""
    walks = [boxes(data, begin, end)]
    while walks:
        found = next(walks[-1], None)
        if found is None:
            walks.pop()
        elif found[0] in CONTAINERS:
            walks.append(boxes(data, found[1], found[2]))
        else:
            yield found


def _tables(data: memoryview, begin: int, end: int, track: dict) -> None:
    """Read what a track's boxes say into track."""
    for kind, a, b in _nested(data, begin, end):
        if kind == b"mdhd":
            track["timescale"], track["duration"] = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
        elif kind == b"hdlr":
            track["kind"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"tkhd":
            (track["track"],) = struct.unpack_from(">I", data, a + (20 if data[a] else 12))
        elif kind == b"stsd":
            track["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
            (n,) = struct.unpack_from(">I", data, a + 4)
            width = {b"stts": 2, b"stsc": 3}.get(kind, 1)
            track[kind.decode()] = _numbers(data, a + 8, b, n * width, ">u8" if kind == b"co64" else ">u4").reshape(-1, width)
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, a + 4)
            if size * n > len(data):
                raise ValueError(f"{n} samples of {size} bytes in a container of {len(data)}")
            track["stsz"] = np.full(n, size, np.int64) if size else _numbers(data, a + 12, b, n, ">u4")


def sample_ranges(track: dict) -> tuple[np.ndarray, np.ndarray]:
    """(offset, size) of every sample, from the chunk and size tables."""
    sizes = track.get("stsz", np.zeros(0, np.int64))
    offsets = track.get("co64", track.get("stco", np.zeros((0, 1), np.int64)))[:, 0]
    runs = track.get("stsc", np.zeros((0, 3), np.int64))
    if not len(offsets) or not len(runs) or not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach = np.diff(np.concatenate((runs[:, 0], [len(offsets) + 1])))
    a_chunk = np.repeat(runs[:, 1], reach)
    if a_chunk.sum() != len(sizes):
        raise ValueError("chunk and size tables disagree")
    first = np.cumsum(a_chunk) - a_chunk
    before = np.cumsum(sizes) - sizes
    chunk = np.repeat(np.arange(len(offsets)), a_chunk)
    return offsets[chunk] + before - before[first[chunk]], sizes


def read_tracks(media) -> list[tuple[dict, np.ndarray, np.ndarray]]:
    """(tables, sample offsets, sample sizes) of each track of a container (bytes or a buffer); payloads are not touched."""
    data, tracks = memoryview(media), []
    for kind, a, b in boxes(data):
        for inner, c, d in boxes(data, a, b) if kind == b"moov" else ():
            if inner == b"trak":
                track: dict = {}
                _tables(data, c, d, track)
                tracks.append((track, *sample_ranges(track)))
    return tracks


def samples(media, offset: np.ndarray, size: np.ndarray) -> bytes:
    """The samples at these ranges, one after the other; ranges that follow each other are one slice."""
    if len(size) and (offset.min() < 0 or (offset + size).max() > len(media)):
        raise ValueError("a sample lies outside the container")
    new = np.flatnonzero(np.concatenate(([True], offset[1:] != offset[:-1] + size[:-1]))) if len(size) else np.zeros(0, np.int64)
    last = np.concatenate((new[1:], [len(size)]))[: len(new)] - 1
    data = memoryview(media)
    return b"".join(data[a:b] for a, b in zip(offset[new].tolist(), (offset[last] + size[last]).tolist()))


def describe(media) -> list[dict]:
    """Each track's kind, codec, seconds, number of samples and the byte ranges of its keyframes (all samples if no table names some)."""
    return [_described(*x) for x in read_tracks(media)]


def _described(track: dict, offset: np.ndarray, size: np.ndarray) -> dict:
    keys = track["stss"][:, 0] - 1 if "stss" in track else np.arange(len(size))
    if len(keys) and (keys.min() < 0 or keys.max() >= len(size)):
        raise ValueError("a keyframe is no sample")
    scale = track.get("timescale", 0)
    return {
        "track": track.get("track"),
        "kind": track.get("kind"),
        "codec": track.get("codec"),
        "seconds": track.get("duration", 0) / scale if scale else None,
        "n_samples": len(size),
        "keyframes": np.stack((offset[keys], size[keys]), axis=1).tolist(),
    }


_TRACKS = pa.list_(
    pa.struct(
        [("track", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.list_(pa.int64())))]
    )
)
TRACKS = "array<struct<track:long,kind:string,codec:string,seconds:double,n_samples:long,keyframes:array<array<long>>>>"


def media_tracks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, tracks, error) for every row of media (key, binary column): what describe() finds.

    A null or empty value has no tracks; a value that isn't a well-formed container has null tracks
    and says why in error, as do counts that a container of its size can't have; boxes may be nested
    to any depth. Rows come out as often as they went in; an empty table gives an empty one.
    """
    rows = media.select(media[key].cast("long").alias("key"), media[column].alias("media"))
    schema = pa.schema([("key", pa.int64()), ("tracks", _TRACKS), ("error", pa.string())])

    def run(batches):
        for whole in batches:
            for b in small_batches(whole, "media"):
                tracks, errors = [], []
                for value in b.column("media"):
                    try:
                        tracks.append(describe(value.as_buffer() if value.is_valid else b""))
                        errors.append(None)
                    except (ValueError, struct.error, IndexError, OverflowError) as e:
                        tracks.append(None)
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(tracks, _TRACKS), pa.array(errors, pa.string())], schema=schema)

    return rows.mapInArrow(run, f"key long, tracks {TRACKS}, error string").withColumnRenamed("key", key)


def media_of_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of every whole text, filled up with bytes 0 to whole frames, as a container.

    A null or empty text is one frame of bytes 0. Repeated rows and rows without a doc_id come out as
    they go in; an empty table gives an empty one; further columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for whole in batches:
            for b in small_batches(whole, "text", 8 << 20):
                made = []
                for t in b.column("text"):
                    raw = t.as_buffer().to_pybytes()
                    made.append(build(raw + bytes(max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))))
                size = pc.binary_length(b.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(made, pa.binary())], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64())]
    + [("media_sha256", pa.string()), ("feature", pa.string())]
)


def media_digest(media: DataFrame) -> DataFrame:
    """Digests of what stored containers (doc_id, n_bytes, media) hold, and a feature string of their first track.

    The payload is read through the sample tables. Containers are those of media_of_texts(); a null
    or malformed one is an error. Rows come out as they go in; an empty table gives an empty one.
    """

    def run(batches):
        for whole in batches:
            for b in small_batches(whole, "media"):
                rows = []
                for doc, n, value in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media")):
                    raw = memoryview(value.as_buffer())
                    track, offset, size = read_tracks(raw)[0]
                    payload = samples(raw, offset, size)
                    feature = json.dumps(_described(track, offset, size), separators=(",", ":"))
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGEST)], schema=_DIGEST)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op8_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers of the texts of the table documents hold, as read back from the stored column."""
    return media_digest(stored(media_of_texts(table(spark, sf_dir, "documents")), "media"))
