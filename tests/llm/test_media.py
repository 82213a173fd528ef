import os
import struct
import zlib
from hashlib import sha256

import numpy as np

from phylospark.llm import media as M


def test_round_trip_of_many_sizes():
    for n in (0, 1, 575, 576, 577, M.FRAME * 64, M.FRAME * 64 + 1, M.FRAME * 200 + 5, M.FRAME * 128):
        payload = os.urandom(n)
        data = M.write_movie(payload)
        (track,) = M.probe(data)
        assert M.read_payload(data, track) == M.pad(payload)
        frames = len(M.pad(payload)) // M.FRAME
        assert (track.codec, track.timescale, track.duration, len(track.sizes)) == ("raw", M.FRAME_RATE, frames, frames)
        assert track.keys.tolist() == list(range(0, frames, M.KEY_EVERY)) and track.times.tolist() == list(range(frames))
        for (at, size), k in zip(track.key_ranges(), track.keys.tolist(), strict=True):
            assert data[at : at + size] == M.pad(payload)[k * M.FRAME : (k + 1) * M.FRAME]


def other_movie(wide: bool) -> tuple[bytes, list[bytes]]:
    """Uneven samples in two chunks, the first chunk last in the file; no sync table, a 32-bit media header, a 64-bit data box."""
    samples = [b"aa", b"bbbb", b"c", b"ddd", b"eeeee"]
    first, second = b"".join(samples[:2]), b"".join(samples[2:])
    head = M.box(b"ftyp", b"isom")

    def moov(offsets):
        form = ">u8" if wide else ">u4"
        sizes = np.array([len(s) for s in samples]).astype(">u4").tobytes()
        tables = M.box(
            b"stbl",
            M.full_box(b"stsd", 0, 0, struct.pack(">I", 1), M.box(b"avc1", bytes(78))),
            M.table(b"stts", np.array([(2, 3), (3, 4)]), ">u4"),
            M.full_box(b"stsz", 0, 0, struct.pack(">II", 0, 5), sizes),
            M.table(b"stsc", np.array([(1, 2, 1), (2, 3, 1)]), ">u4"),
            M.full_box(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", 2), np.array(offsets).astype(form).tobytes()),
        )
        return M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.full_box(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, 10, 18, 0, 0)), M.box(b"minf", tables))))

    at = len(head) + len(moov([0, 0])) + 16
    data = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + len(first) + len(second)) + second + first
    return head + moov([at + len(second), at]) + data, samples


def test_tables_of_other_files():
    for wide in (False, True):
        data, samples = other_movie(wide)
        (track,) = M.probe(data)
        assert [data[a : a + n] for a, n in zip(track.offsets.tolist(), track.sizes.tolist(), strict=True)] == samples
        assert track.codec == "avc1" and track.times.tolist() == [0, 3, 6, 10, 14] and track.keys.tolist() == list(range(5)) and (track.timescale, track.duration) == (10, 18)
        assert M.read_payload(data, track) == b"".join(samples)


def test_damaged_files_never_fail():
    data = M.write_movie(b"x" * 5000)
    for cut in range(0, len(data), 7):
        for track in M.probe(data[:cut]):
            M.read_payload(data[:cut], track)
    assert M.probe(b"not a movie at all") == M.probe(None) == M.probe(b"") == []


def test_columns(spark):
    rows = [(1, "text é"), (2, None), (2, ""), (None, "x" * 3000)]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, media string")
    got = {(r["doc_id"], r["n_bytes"]): r for r in M.media_features(M.media_column(docs, "doc_id", "text"), "doc_id", "media", ["n_bytes"]).collect()}
    for i, t in rows:
        payload = M.pad((t or "").encode())
        r = got[i, len((t or "").encode())]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert M.media_column(docs.limit(0), "doc_id", "text").count() == 0


def test_stated_counts_are_bounded():
    """Counts of 2**32 - 1 in any table, and thousands of nested boxes, neither fail nor take memory."""
    import resource

    data = M.write_movie(b"payload " * 400)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for kind, skip in ((b"stsz", 12), (b"stts", 8), (b"stts", 12), (b"stsc", 8), (b"stsc", 12), (b"stsc", 16), (b"stss", 8), (b"stco", 8), (b"stco", 12), (b"stsz", 8)):
        at = data.index(kind) + 4
        for value in (b"\xff\xff\xff\xff", b"\x7f\xff\xff\xff", b"\0\0\0\0", b"\0\0\0\1"):
            broken = data[: at + skip - 4] + value + data[at + skip :]
            for track in M.probe(broken):
                assert len(track.sizes) <= len(broken) and len(M.read_payload(broken, track)) <= len(broken)
    deep = b""
    for _ in range(5000):
        deep = M.box(b"udta", deep)
    assert [t.codec for t in M.probe(M.box(b"moov", M.box(b"trak", deep)))] == [""]
    many = M.box(b"moov", *([M.box(b"trak", M.box(b"stbl", M.full_box(b"stsz", 0, 0, b"\0\0\0\1\xff\xff\xff\xff")))] * 3000))
    assert sum(len(t.sizes) for t in M.probe(many)) <= len(many)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_a_large_file_that_states_billions_of_samples():
    """20 MB, one chunk, samples of one byte, as many as a count can state, no table of keyframes."""
    import tracemalloc

    tables = M.box(b"stbl", M.full_box(b"stsz", 0, 0, struct.pack(">II", 1, 2**32 - 1)), M.table(b"stsc", np.array([(1, 2**32 - 1, 1)]), ">u4"), M.table(b"stco", np.array([0]), ">u4"), M.table(b"stts", np.array([(2**32 - 1, 1)]), ">u4"))
    data = M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.box(b"minf", tables)))) + M.box(b"mdat", bytes(20_000_000))
    tracemalloc.start()
    (track,) = M.probe(data)
    text, payload = M.feature_text([track]), M.read_payload(data, track)
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    assert track.samples == len(data) == len(payload) and text.endswith(f"keyframes=0+1x{len(data)}")


def test_query_equals_brute_force(spark, tmp_path):
    texts = ["text é", None, "", "x" * 575, "x" * 576, "long " * 100_000, "text é"]
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, media int").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in M.op2_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = M.write_movie(raw)
        assert tuple(rows[i])[1:7] == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), sha256(stored).hexdigest())
        frames = len(payload) // 576
        keys = ",".join(f"{len(stored) - len(payload) + 576 * k}+576" for k in range(0, frames, 16))
        assert rows[i]["feature"] == f"codec=raw;timescale=25;duration={frames};samples={frames};keyframes={keys}"
