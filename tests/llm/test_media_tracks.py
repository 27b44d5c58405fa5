"""Containers of several tracks, and fragmented ones."""

import struct

from strandmap.llm import media
from strandmap.llm.media import box, full


def u(*x: int) -> bytes:
    return struct.pack(f">{len(x)}I", *x)


def trak(of: int, kind: bytes, codec: bytes, *tables: bytes) -> bytes:
    stsd = full(b"stsd", u(1), box(codec, bytes(8)))
    mdia = box(b"mdia", full(b"mdhd", u(0, 0, 1000, 500), bytes(4)), full(b"hdlr", bytes(4), kind, bytes(13)), box(b"minf", box(b"stbl", stsd, *tables)))
    return box(b"trak", full(b"tkhd", u(0, 0, of, 0, 500)), mdia)


def tables(offset: int, sizes: list[int], sync: list[int] | None) -> list[bytes]:
    own = [full(b"stts", u(1, len(sizes), 10)), full(b"stsc", u(1, 1, len(sizes), 1)), full(b"stsz", u(0, len(sizes), *sizes)), full(b"stco", u(1, offset))]
    return own if sync is None else [*own, full(b"stss", u(len(sync), *sync))]


def test_every_track_is_told(spark):
    file = box(b"moov", trak(1, b"soun", b"mp4a", *tables(5000, [4, 6], None)), trak(2, b"vide", b"avc1", *tables(6000, [50, 7, 60], [1, 3])))
    df = spark.createDataFrame([(1, bytearray(file))], "id long, media binary")
    seen = media.probe(df).first()["info"]
    keys = [(t["kind"], t["codec"], [tuple(k) for k in t["keyframes"]]) for t in seen["tracks"]]
    assert keys == [("soun", "mp4a", [(5000, 4), (5004, 6)]), ("vide", "avc1", [(6000, 50), (6057, 60)])] and seen["codec"] == "mp4a"


def test_fragments_are_decoded():
    moov = box(b"moov", trak(1, b"soun", b"mp4a"), trak(2, b"vide", b"avc1"), box(b"mvex", full(b"trex", u(1, 1, 20, 5, 0)), full(b"trex", u(2, 1, 40, 0, 0x10000))))

    def moof(offset: int) -> bytes:
        sound = box(b"traf", full(b"tfhd", u(1), flags=0x20000), full(b"trun", u(3, offset), flags=1))
        video = box(b"traf", full(b"tfhd", u(2), flags=0x20000), full(b"trun", u(2, offset + 15, 0, 9, 8), flags=0x205))
        more = full(b"trun", u(1, 30, 6, 0x10000), flags=0x700)
        return box(b"moof", full(b"mfhd", u(1)), sound, box(b"traf", video[8:], more))

    head = moof(0)
    payload = bytes(range(15)) + b"v" * 17 + b"w" * 6
    file = moov + moof(len(head) + 8) + box(b"mdat", payload)
    at = len(moov) + len(head) + 8
    sound, video = media.info(file)["tracks"]
    assert (sound["n_samples"], sound["duration_s"], sound["keyframes"][2]) == (3, 0.06, {"offset": at + 10, "bytes": 5})
    assert (video["n_samples"], video["duration_s"], video["keyframes"]) == (3, 0.11, [{"offset": at + 15, "bytes": 9}])
    a, b = media.parse(file)
    assert media.samples(file, a) == payload[:15] and media.samples(file, b) == payload[15:]
    assert media.info(moov + box(b"moof", box(b"traf", full(b"tfhd", u(3))))) is None


def test_compact_sizes_are_decoded():
    for bits, raw, want in ((4, bytes([0x35, 0x70]), [3, 5, 7]), (8, bytes([3, 200, 7]), [3, 200, 7]), (16, struct.pack(">HHH", 3, 999, 7), [3, 999, 7])):
        own = [full(b"stts", u(1, 3, 10)), full(b"stsc", u(1, 1, 3, 1)), full(b"stz2", bytes(3), bytes([bits]), u(3), raw), full(b"stco", u(1, 70)), full(b"stss", u(1, 2))]
        seen = media.info(box(b"moov", trak(1, b"vide", b"avc1", *own)))
        assert seen["n_samples"] == 3 and seen["keyframes"] == [{"offset": 70 + want[0], "bytes": want[1]}]
        assert media.info(box(b"moov", trak(1, b"vide", b"avc1", *own[:2], full(b"stz2", bytes(3), bytes([bits]), u(99), raw), own[3]))) is None


def test_read_back_of_null_and_malformed_containers(spark):
    good = media.mux(b"x" * 192 * 70)
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    files = [good, None, b"", b"abc", good[:-1], box(b"moov", trak(1, b"soun", b"mp4a")), deep, good]
    df = spark.createDataFrame([(i, None if f is None else bytearray(f), "clash", "c") for i, f in enumerate(files)], "id long, media binary, feature string, info string")
    out = {r["id"]: r for r in media.read_back(df).collect()}
    assert out[0]["payload_bytes"] == 192 * 70 and out[0]["feature"] == out[7]["feature"] and out[0]["info"] == "c"
    assert [tuple(k) for k in out[0]["keyframes"]] == media.key_ranges(media.parse(good)[0]) and len(out[0]["keyframes"]) == 3
    assert all(out[i]["feature"] is None and out[i]["payload_bytes"] is None and out[i]["keyframes"] is None for i in range(1, 7))
    assert [r["info"] is not None for r in media.probe(df).orderBy("id").collect()] == [True, False, False, False, False, True, False, True]
