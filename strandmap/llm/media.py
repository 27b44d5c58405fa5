"""ISO base media containers (ISO/IEC 14496-12) as columns.

`mux` stores a payload of 8-bit samples in a container; `probe` walks the nested boxes of a container, decodes its sample
tables and gives codec, duration and key frame byte ranges without touching payload bytes; `samples` cuts the payload
out by those tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from strandmap.llm.shared import map_arrow, schema_with

#: Payload bytes in one sample of the container (an access unit of so many 8-bit samples).
UNIT = 192
#: Samples a second.
RATE = 8000
#: Units in one chunk, and from one key frame to the next.
CHUNK_UNITS = 64
KEY_EVERY = 32

#: Boxes that hold boxes, with the bytes before their first child.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"mfra": 0}


#: Deeper nesting than this is no container of the standard, whose deepest boxes lie seven deep.
DEEPEST = 32


class MediaError(ValueError):
    """The bytes aren't a well-formed container."""


# --- writing ----------------------------------------------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    if n > 0xFFFFFFFF:
        return b"".join((struct.pack(">I4sQ", 1, kind, n + 8), *parts))
    return b"".join((struct.pack(">I4s", n, kind), *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """A container of one audio track of 8-bit mono samples; the payload's length is a positive multiple of UNIT."""
    if not payload or len(payload) % UNIT:
        raise MediaError(f"the payload must be a positive multiple of {UNIT} bytes")
    units = len(payload) // UNIT
    ticks = units * UNIT
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")
    chunks = -(-units // CHUNK_UNITS)
    last = units - (chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS)] if last == CHUNK_UNITS else ([(1, CHUNK_UNITS), (chunks, last)] if chunks > 1 else [(1, last)])
    keys = range(1, units + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def moov(offsets: bytes, wide: bool) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, n, 1) for first, n in runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets),
            full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
            minf,
        )
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, ticks), struct.pack(">Ih", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    wide = len(payload) > 0xFFF00000
    head = len(ftyp) + len(moov(bytes((8 if wide else 4) * chunks), wide)) + (16 if wide else 8)
    step = CHUNK_UNITS * UNIT
    offsets = struct.pack(f">{chunks}{'Q' if wide else 'I'}", *range(head, head + chunks * step, step))
    return b"".join((ftyp, moov(offsets, wide), box(b"mdat", payload)))


# --- reading ----------------------------------------------------------------------------------------------------


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    stts: list[tuple[int, int]] = field(default_factory=list)
    stsc: list[tuple[int, int]] = field(default_factory=list)
    sizes: list[int] | tuple[int, int] = (0, 0)  # (size of all, number) or one each
    chunks: list[int] = field(default_factory=list)
    sync: list[int] | None = None
    id: int = 0
    defaults: tuple[int, int, int] = (0, 0, 0)  # duration, size and flags of fragment samples
    runs: list[tuple[int, int, int, bool]] = field(default_factory=list)  # offset, bytes, duration and key frame of each fragment sample

    def count(self) -> int:
        return self._listed() + len(self.runs)

    def ticks(self) -> int:
        """Duration in units of the time scale; that of fragments is in their runs."""
        return sum(n * d for n, d in self.stts) + sum(r[2] for r in self.runs) if self.runs else self.duration

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, bytes) of each sample."""
        return self._tabled() + [(at, n) for at, n, _, _ in self.runs]

    def _listed(self) -> int:
        return self.sizes[1] if isinstance(self.sizes, tuple) else len(self.sizes)

    def _tabled(self) -> list[tuple[int, int]]:
        out, n, run = [], self._listed(), 0
        for c, at in enumerate(self.chunks, 1):
            while run + 1 < len(self.stsc) and self.stsc[run + 1][0] <= c:
                run += 1
            for _ in range(self.stsc[run][1] if self.stsc else 0):
                if len(out) == n:
                    return out
                size = self.sizes[0] if isinstance(self.sizes, tuple) else self.sizes[len(out)]
                out.append((at, size))
                at += size
        if len(out) < n:
            raise MediaError("the sample tables name more samples than the chunks hold")
        return out


@dataclass
class Fragment:
    """A track's part of a fragment: where its offsets count from, where its next run begins, and what samples have by default."""

    track: Track
    base: int
    at: int
    defaults: tuple[int, int, int]


def walk(data: memoryview, lo: int, hi: int, path: tuple = ()):
    """(path, kind, start of body, end) of every box; a size of 0 reaches to the end, 1 means a 64-bit size follows."""
    open_ = [(lo, hi, path)]
    while open_:
        lo, hi, path = open_.pop()
        if lo >= hi:
            continue
        if hi - lo < 8:
            raise MediaError(f"{hi - lo} bytes left over at {lo}")
        n, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if n == 1:
            if hi - lo < 16:
                raise MediaError(f"a 64-bit size is cut off at {lo}")
            n, body = struct.unpack_from(">Q", data, body)[0], lo + 16
        elif n == 0:
            n = hi - lo
        if n < body - lo or lo + n > hi:
            raise MediaError(f"box {kind!r} at {lo} has {n} bytes")
        yield path, kind, body, lo + n
        open_.append((lo + n, hi, path))
        if kind in CONTAINERS:
            if len(path) >= DEEPEST:
                raise MediaError(f"boxes at {lo} are nested more than {DEEPEST} deep")
            open_.append((body + CONTAINERS[kind], lo + n, (*path, kind)))


def compact_sizes(data: memoryview, lo: int, hi: int) -> list[int]:
    """Sample sizes of a compact table: 4, 8 or 16 bits each, the high half of a byte first."""
    bits, n = struct.unpack_from(">xxxBI", data, lo + 4)
    if bits not in (4, 8, 16) or lo + 12 + -(-n * bits // 8) > hi:
        raise MediaError(f"a compact table of {n} sizes of {bits} bits")
    raw = data[lo + 12 : lo + 12 + -(-n * bits // 8)]
    if bits == 8:
        return list(raw)
    if bits == 16:
        return [x for (x,) in struct.iter_unpack(">H", raw)]
    return [x for byte in raw for x in (byte >> 4, byte & 15)][:n]


def parse(media: bytes) -> list[Track]:
    """The tracks of a container with their decoded sample tables."""
    data, tracks = memoryview(media), []

    def table(form: str, at: int, end: int, n: int) -> list:
        each = struct.calcsize(">" + form)
        if at + n * each > end:
            raise MediaError("a table is longer than its box")
        return list(struct.iter_unpack(">" + form, data[at : at + n * each]))

    def runs(t: Track, lo: int, hi: int, fragment: Fragment) -> None:
        flags, n = struct.unpack_from(">II", data, lo)
        flags, at = flags & 0xFFFFFF, lo + 8
        if flags & 1:
            fragment.at, at = fragment.base + struct.unpack_from(">i", data, at)[0], at + 4
        first = None
        if flags & 4:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        if n > len(data):
            raise MediaError(f"a run of {n} samples")
        own = [bool(flags & f) for f in (0x100, 0x200, 0x400, 0x800)]
        rows = table("I" * sum(own), at, hi, n) if any(own) else [()] * n
        for i, row in enumerate(rows):
            given = iter(row)
            duration, size, kind = (next(given) if has else default for has, default in zip(own, fragment.defaults, strict=False))
            kind = first if i == 0 and first is not None else kind
            t.runs.append((fragment.at, size, duration, not kind & 0x10000))
            fragment.at += size

    moof, fragment = 0, None
    for _, kind, lo, hi in walk(data, 0, len(data)):
        if kind == b"trak":
            tracks.append(Track())
        if kind == b"moof":
            moof, fragment = lo - (8 if data[lo - 4 : lo] == b"moof" else 16), None
        elif kind == b"trex":
            of, _, *defaults = struct.unpack_from(">5I", data, lo + 4)
            for t in tracks:
                if t.id == of:
                    t.defaults = tuple(defaults)
        elif kind == b"tfhd":
            flags, of = struct.unpack_from(">II", data, lo)
            t = next((t for t in tracks if t.id == of), None)
            if t is None:
                raise MediaError(f"a fragment of track {of}, which isn't there")
            base = moof if flags & 0x20000 or fragment is None else fragment.at
            at, defaults = lo + 8, list(t.defaults)
            if flags & 1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 if flags & 2 else 0
            for i, f in enumerate((8, 0x10, 0x20)):
                if flags & f:
                    defaults[i], at = struct.unpack_from(">I", data, at)[0], at + 4
            fragment = Fragment(t, base, base, tuple(defaults))
        elif kind == b"trun":
            if fragment is None:
                raise MediaError("a run without a header of its fragment")
            runs(fragment.track, lo, hi, fragment)
        if not tracks or hi - lo < 8:
            continue
        t = tracks[-1]
        if kind == b"tkhd":
            t.id = struct.unpack_from(">I", data, lo + (20 if data[lo] == 1 else 12))[0]
        elif kind == b"hdlr":
            t.kind = bytes(data[lo + 8 : lo + 12]).decode("latin-1")
        elif kind == b"mdhd":
            t.timescale, t.duration = struct.unpack_from(">IQ" if data[lo] == 1 else ">II", data, lo + (20 if data[lo] == 1 else 12))
        elif kind == b"stsd" and hi - lo >= 16:
            t.codec = bytes(data[lo + 12 : lo + 16]).decode("latin-1").strip()
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, lo + 4)
            t.sizes = (size, n) if size else [x for (x,) in table("I", lo + 12, hi, n)]
        elif kind == b"stz2":
            t.sizes = compact_sizes(data, lo, hi)
        elif kind in (b"stts", b"stsc", b"stco", b"co64", b"stss"):
            n = struct.unpack_from(">I", data, lo + 4)[0]
            rows = table({b"stts": "II", b"stsc": "III", b"stco": "I", b"co64": "Q", b"stss": "I"}[kind], lo + 8, hi, n)
            if kind == b"stts":
                t.stts = rows
            elif kind == b"stsc":
                t.stsc = [(a, b) for a, b, _ in rows]
            elif kind == b"stss":
                t.sync = [x for (x,) in rows]
            else:
                t.chunks = [x for (x,) in rows]
    return tracks


def key_ranges(track: Track) -> list[tuple[int, int]]:
    """(offset, bytes) of each key frame; every sample is one where the container has no list of them."""
    own = track._tabled()
    listed = own if track.sync is None else [own[i - 1] for i in track.sync if 1 <= i <= len(own)]
    return listed + [(at, n) for at, n, _, key in track.runs if key]


def samples(media: bytes, track: Track) -> bytes:
    """The track's payload, cut out by its sample tables."""
    data = memoryview(media)
    out: list[list[int]] = []
    for at, n in track.ranges():
        if at + n > len(data):
            raise MediaError("a sample lies beyond the end")
        if out and out[-1][1] == at:
            out[-1][1] = at + n
        else:
            out.append([at, at + n])
    return b"".join(data[a:b] for a, b in out)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with spaces up to a positive multiple of UNIT, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(-(-len(raw) // UNIT), 1) * UNIT, b" "), len(raw)


# --- columns ----------------------------------------------------------------------------------------------------

#: Rows of one Python batch are cut so that their containers stay within this many bytes.
BATCH_BYTES = 8 << 20


def _by_bytes(x: pa.RecordBatch, column: int):
    lo, total = 0, 0
    for i, v in enumerate(x.column(column)):
        total += v.as_buffer().size if v.is_valid else 0
        if total > BATCH_BYTES and i > lo:
            yield x.slice(lo, i - lo)
            lo, total = i, 0
    yield x.slice(lo)


def with_media(df: DataFrame, text: str = "text", to: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """df with the container of each whole text's bytes (null: empty) in the binary column ``to``, instead of the text, and its unpadded bytes.

    Existing columns of these names are replaced; equal texts give equal containers; an empty table stays empty.
    """
    df = df.drop(*{to, n_bytes} - {text})
    names = df.columns
    kept = [c for c in names if c != text]

    def work(batches):
        at = names.index(text)
        for whole in batches:
            for x in _by_bytes(whole, at):
                made = [padded(t) for t in x.column(at).to_pylist()]
                columns = [x.column(names.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in made], pa.int64()), pa.array([mux(p) for p, _ in made], pa.binary())], [*kept, n_bytes, to])

    out = schema_with(df.select(*kept), **{n_bytes: "long", to: "binary"})
    return map_arrow(df, work, out)


_TRACK = "codec: string, timescale: long, duration_s: double, n_samples: long, n_keyframes: long, keyframes: array<struct<offset: long, bytes: long>>"
#: What is told of the first track, and of every track in ``tracks``.
INFO = f"struct<{_TRACK}, tracks: array<struct<kind: string, {_TRACK}>>>"


def _told(t: Track) -> dict:
    keys = key_ranges(t)
    return {"kind": t.kind, "codec": t.codec, "timescale": t.timescale, "duration_s": t.ticks() / t.timescale if t.timescale else None, "n_samples": t.count(), "n_keyframes": len(keys), "keyframes": [{"offset": a, "bytes": n} for a, n in keys]}


def info(media: bytes | None) -> dict | None:
    """What `probe` stores of one container; null for null and malformed bytes, and where there is no track."""
    if media is None:
        return None
    try:
        tracks = parse(media)
        if not tracks:
            return None
        told = [_told(t) for t in tracks]
        return {**{k: v for k, v in told[0].items() if k != "kind"}, "tracks": told}
    except (MediaError, struct.error):
        return None


def probe(df: DataFrame, media: str = "media", to: str = "info") -> DataFrame:
    """df with codec, time scale, duration, samples and key frame byte ranges of each container, and of each of its tracks, in struct ``to``; payload bytes are not read."""
    df = df.drop(*{to} - {media})
    names = df.columns
    out = schema_with(df, **{to: INFO})

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(out[to].dataType)
        for x in batches:
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([info(v.as_py()) for v in x.column(names.index(media))], kind)], [*names, to])

    return map_arrow(df, work, out)


#: Columns of `read_back`.
READ = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "keyframes": "array<struct<offset: long, bytes: long>>"}


def features(stored: bytes | None) -> tuple | None:
    """What `read_back` tells of one container; null for null and malformed bytes, and where the first track has no samples."""
    if stored is None:
        return None
    try:
        t = parse(stored)[0]
        payload, keys = samples(stored, t), key_ranges(t)
        if not keys:
            return None
        feature = f"{t.codec}|{t.timescale}|{t.count()}|{t.ticks() / t.timescale:.6f}|{len(keys)}|{','.join(f'{a}+{n}' for a, n in keys)}"
    except (MediaError, struct.error, IndexError, ZeroDivisionError):
        return None
    told = [{"offset": a, "bytes": n} for a, n in keys]
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, told


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """df without the container but with the columns of READ, all from the stored bytes of its first track.

    feature is ``codec|time scale|samples|seconds|key frames|ranges``, with the offset and bytes of every key frame; ``keyframes``
    has these as an array.  Null and malformed containers, and those without samples or key frames, give nulls.  Existing columns of these names
    are replaced, repeated rows stay, an empty table stays empty.
    """
    df = df.drop(*READ.keys() - {media})
    names = df.columns
    kept = [c for c in names if c != media]
    out = schema_with(df.select(*kept), **READ)

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(out[c].dataType) for c in READ]
        none = (None,) * len(READ)
        for x in batches:
            rows = [features(v.as_py()) or none for v in x.column(names.index(media))]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(READ), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(x.column(names.index(c)) for c in kept), *columns], out.names)

    return map_arrow(df, work, out)
