"""Media columns as ISO base media files: write samples into nested boxes, and read codec, duration and keyframe byte ranges back.

``write_movie`` stores a payload as uncompressed 8-bit grey frames: one track whose sample tables (stts, stss, stsz, stsc, stco or
co64) say when each frame is shown, which frames are keyframes and where they lie in the media data box. ``probe`` walks the boxes
of any such file and decodes its sample tables with array arithmetic; it reads box headers and tables only, never the payload.
``read_payload`` returns the bytes of a track's samples in order.

``media_column`` and ``media_features`` are the same over a DataFrame. Media values go through Arrow in slices of a few MB.

Defined cases: a null or empty payload is stored as one frame of padding; values are padded with byte 255 to whole frames; a file
that is cut short or is no ISO media file gets an empty list of tracks; a track without an stss box has only keyframes; an empty
table gives an empty table; samples of one stated size are kept as runs, one a chunk, so what a file takes in memory, and the length of its feature, is a few times the size
of its tables, whatever counts it states; samples beyond the file's length in sum are left out, and arrays of all samples (``sizes``, ``offsets``, ``times``) are
made only where they are asked for; columns beyond those named are kept out, so their names can't clash; equal payloads give equal files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm._shared import slices, small_batches, stage

WIDTH, HEIGHT = 24, 24
FRAME = WIDTH * HEIGHT
PAD = b"\xff"
FRAME_RATE, KEY_EVERY, CHUNK_FRAMES = 25, 16, 64

# Fixed values of the ISO base media format: boxes that hold boxes, and the unity matrix of a header.
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"mvex"}
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I", len(body) + 8) + kind + body
    return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(kind: bytes, rows: np.ndarray, form: str, *before: bytes) -> bytes:
    """A full box with a count and big-endian rows."""
    return full_box(kind, 0, 0, *before, struct.pack(">I", len(rows)), rows.astype(form).tobytes())


def pad(payload: bytes) -> bytes:
    frames = max(1, -(-len(payload) // FRAME))
    return payload.ljust(frames * FRAME, PAD)


def write_movie(payload: bytes) -> bytes:
    """The file of a payload; its length is padded to whole frames."""
    payload = pad(payload)
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def movie(first: int, wide: bool) -> bytes:
        starts = first + np.arange(chunks, dtype=np.int64) * (CHUNK_FRAMES * FRAME)
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
        runs = [(1, CHUNK_FRAMES, 1)] if frames % CHUNK_FRAMES == 0 else [(1, CHUNK_FRAMES, 1), (chunks, frames % CHUNK_FRAMES, 1)] if chunks > 1 else [(1, frames, 1)]
        tables = box(
            b"stbl",
            full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            table(b"stts", np.array([(frames, 1)]), ">u4"),
            table(b"stss", np.arange(0, frames, KEY_EVERY) + 1, ">u4"),
            full_box(b"stsz", 0, 0, struct.pack(">II", FRAME, frames)),
            table(b"stsc", np.array(runs), ">u4"),
            table(b"co64" if wide else b"stco", starts, ">u8" if wide else ">u4"),
        )
        info = box(b"minf", full_box(b"vmhd", 0, 1, bytes(8)), box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1))), tables)
        media = box(b"mdia", full_box(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, FRAME_RATE, frames, 0x55C4, 0)), full_box(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12), b"\0"), info)
        track = box(b"trak", full_box(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, 1, 0, frames), bytes(16), UNITY, struct.pack(">II", WIDTH << 16, HEIGHT << 16)), media)
        header = full_box(b"mvhd", 1, 0, struct.pack(">QQIQ", 0, 0, FRAME_RATE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", header, track)

    wide = len(payload) >= (1 << 32) - (1 << 20)
    lead = len(head) + len(movie(0, wide)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return head + movie(lead, wide) + box(b"mdat", payload)


@dataclass
class Track:
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    runs: np.ndarray = field(default_factory=lambda: np.empty((0, 3), np.int64))  # first byte, size of a sample, samples
    steps: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.int64))  # samples, time to the next
    sync: np.ndarray | None = None  # keyframes; None: all samples

    @property
    def samples(self) -> int:
        return int(self.runs[:, 2].sum())

    @property
    def sizes(self) -> np.ndarray:
        return np.repeat(self.runs[:, 1], self.runs[:, 2])

    @property
    def offsets(self) -> np.ndarray:
        place = np.arange(self.samples) - np.repeat(np.cumsum(self.runs[:, 2]) - self.runs[:, 2], self.runs[:, 2])
        return np.repeat(self.runs[:, 0], self.runs[:, 2]) + place * self.sizes

    @property
    def times(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(spread(self.steps[:, 1], self.steps[:, 0], self.samples))))[: self.samples]

    @property
    def keys(self) -> np.ndarray:
        return np.arange(self.samples) if self.sync is None else self.sync

    def key_runs(self) -> np.ndarray:
        """(first byte, length, keyframes one after the other) of all keyframes."""
        if self.sync is None:
            return self.runs
        ends = np.cumsum(self.runs[:, 2])
        at = np.searchsorted(ends, self.sync, "right")
        own = self.runs[at]
        return np.column_stack([own[:, 0] + (self.sync - ends[at] + own[:, 2]) * own[:, 1], own[:, 1], np.ones(len(at), np.int64)])

    def key_ranges(self) -> list[tuple[int, int]]:
        """(first byte, length) of every keyframe."""
        return [(a + k * n, n) for a, n, count in self.key_runs().tolist() for k in range(count)]


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first and last byte of the body) of the boxes in a range; stops at one that doesn't fit."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def leaves(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """All boxes below a range in order, containers before what they hold, however deep."""
    open_ranges = [boxes(data, start, end)]
    while open_ranges:
        found = next(open_ranges[-1], None)
        if found is None:
            open_ranges.pop()
            continue
        yield found
        if found[0] in CONTAINERS:
            open_ranges.append(boxes(data, *found[1:]))


def spread_counts(counts: np.ndarray, n: int) -> np.ndarray:
    """The counts, cut where their sum reaches n."""
    return np.diff(np.minimum(np.cumsum(np.minimum(counts, n)), n), prepend=0)


def spread(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The values, each repeated, but no more than n in all."""
    return np.repeat(values, spread_counts(counts, n))


def decode(data: memoryview, found: dict[bytes, tuple[int, int]], most: int) -> Track:
    """A track from the places of its boxes; of its samples those whose sizes, at least one byte each, are at most ``most`` in sum."""

    def rows(kind: bytes, form: str, width: int, skip: int = 4) -> np.ndarray:
        if kind not in found:
            return np.empty((0, width), np.int64)
        a, b = found[kind]
        (n,) = struct.unpack_from(">I", data, a + skip)
        each = np.dtype(form).itemsize * width
        return np.frombuffer(data, form, min(n, (b - a - skip - 4) // each) * width, a + skip + 4).reshape(-1, width).astype(np.int64)

    track = Track()
    if b"stsd" in found:
        a, b = found[b"stsd"]
        track.codec = next((kind.decode("latin-1").strip() for kind, _, _ in boxes(data, a + 8, b)), "")
    if b"mdhd" in found:
        a, _ = found[b"mdhd"]
        track.timescale, track.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    same, n, sizes = 0, 0, np.empty(0, np.int64)
    if b"stsz" in found:
        a, _ = found[b"stsz"]
        same, n = struct.unpack_from(">II", data, a + 4)
        if same:
            n = min(n, most // same)
        else:
            sizes = rows(b"stsz", ">u4", 1, 8)[:, 0]
            sizes = sizes[np.cumsum(np.maximum(sizes, 1)) <= most]
            n = len(sizes)
    chunk_at = np.clip(rows(b"co64", ">u8", 1)[:, 0] if b"co64" in found else rows(b"stco", ">u4", 1)[:, 0], 0, len(data))
    chunks = rows(b"stsc", ">u4", 3)
    if n and len(chunk_at) and len(chunks):
        each = spread(chunks[:, 1], np.diff(np.append(np.clip(chunks[:, 0], 1, len(chunk_at) + 1), len(chunk_at) + 1)), len(chunk_at))
        if same:
            held = spread_counts(each, n)
            track.runs = np.column_stack([chunk_at[: len(held)], np.full(len(held), same, np.int64), held])[held > 0]
        else:
            chunk = spread(np.arange(len(each)), each, n)
            ahead = np.concatenate(([0], np.cumsum(sizes)))[: len(chunk)]
            first = np.concatenate(([0], np.cumsum(np.minimum(each, n))))[chunk]
            track.runs = np.column_stack([chunk_at[chunk] + ahead - ahead[first], sizes[: len(chunk)], np.ones(len(chunk), np.int64)])
    track.steps = rows(b"stts", ">u4", 2)
    if b"stss" in found:
        k = rows(b"stss", ">u4", 1)[:, 0] - 1
        track.sync = k[(k >= 0) & (k < track.samples)]
    return track


def probe(data: bytes | None) -> list[Track]:
    """The tracks of a file, without reading its payload."""
    view, tracks = memoryview(data or b""), []
    left = len(view)
    for kind, a, b in boxes(view, 0, len(view)):
        if kind == b"moov":
            for inner, c, d in boxes(view, a, b):
                if inner == b"trak":
                    try:
                        track = decode(view, {k: (x, y) for k, x, y in leaves(view, c, d)}, left)
                    except (struct.error, ValueError, IndexError):
                        continue
                    tracks.append(track)
                    left -= int((np.maximum(track.runs[:, 1], 1) * track.runs[:, 2]).sum())
    return tracks


def read_payload(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples in order; runs of samples that lie together are read at once."""
    if not len(track.runs):
        return b""
    start, end = track.runs[:, 0], track.runs[:, 0] + track.runs[:, 1] * track.runs[:, 2]
    breaks = np.flatnonzero(start[1:] != end[:-1]) + 1
    first, last = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(start)])) - 1
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True))


def feature_text(tracks: list[Track]) -> str:
    """One line per track: codec, timescale, duration, samples and the keyframes' first bytes and lengths; of a run of keyframes one after the other
    the first, and how many."""
    keys = lambda t: ",".join(f"{a}+{n}" if c == 1 else f"{a}+{n}x{c}" for a, n, c in t.key_runs().tolist())
    return "\n".join(f"codec={t.codec};timescale={t.timescale};duration={t.duration};samples={t.samples};keyframes={keys(t)}" for t in tracks)


def media_column(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, n_bytes, media): every payload (text or binary) as a file."""
    rows = small_batches(df).select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"))

    def write(batches):
        for batch in slices(batches, "payload"):
            values = batch.column("payload").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, values), pa.int64()), pa.array(map(write_movie, values), pa.binary())], ["key", "n_bytes", "media"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(write, f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


def media_features(df: DataFrame, key: str, media: str, carry: list[str] = ()) -> DataFrame:
    """(key, *carry, digests of the payload as read back and of the file, feature)."""
    rows = small_batches(df).select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.coalesce(F.col(f"`{media}`"), F.lit(b"")).alias("media"))
    digests = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    names = [f.name for f in rows.schema.fields[:-1]]

    def read(batches):
        for batch in slices(batches, "media"):
            found = []
            for data in batch.column("media").to_pylist():
                tracks = probe(data)
                payload = b"".join(read_payload(data, t) for t in tracks)
                found.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), sha256(data).hexdigest(), feature_text(tracks)))
            columns = list(zip(*found, strict=True))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*names, *(x.split()[0] for x in digests.split(", "))])

    out = rows.mapInArrow(read, ", ".join([*kinds, digests]))
    return out.withColumnsRenamed({"key": key, **{f"c{i}": c for i, c in enumerate(carry)}})


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text stored as a media file in the shared folder, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = stage(media_column(docs, "doc_id", "text"), "media")
    out = media_features(stored, "doc_id", "media", ["n_bytes"])
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
