"""Token ids in bit-plane files.

A file holds the ids of a range of documents.  Ids are cut into blocks of fixed size; a block's little-endian bytes
are transposed into four byte planes, each plane is compressed with zstandard, and a chunk index at the end gives every
block's place and plane lengths.  Document ids and lengths are stored beside it, so that single documents can be read.

    magic | plane ... plane | documents | chunk index | footer

Files are written through the file system of the shared folder's URI.  A task writes under a name of its own attempt and
only files that finished tasks report are read, so retries and lost executors leave no wrong data behind.
"""

from __future__ import annotations

import gc
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm.shared import map_arrow, own_folder, partitions

MAGIC = b"SMPLANE1"
#: Ids in a block.
BLOCK_IDS = 1 << 16
#: Bytes of pieces, words and their ids that one worker keeps in each of two generations of a table, and characters of the
#: longest piece that is kept: text without spaces is one piece for each paragraph and rarely met again.
KEPT_BYTES, KEPT_CHARS = 112 << 20, 64
#: About what an entry takes beside its characters and ids: two object headers and a place in the table.
ENTRY_BYTES = 190
FOOTER = struct.Struct("<QQQQ8s")  # place of the documents, of the index, blocks, ids, magic
ENTRY = struct.Struct("<QI4I")  # place, ids, plane lengths

_BLANK = re.compile(r" (?:\s|\Z)")
_SPLIT = re.compile(r" (?=\S)")


# --- encoding ---------------------------------------------------------------------------------------------------


class Known(dict):
    """Ids by piece, made when they are first asked for.  A full generation becomes the old one; what is asked again lives on."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        n = len(key)
        if n > KEPT_CHARS:
            return out
        if self.held >= KEPT_BYTES:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += ENTRY_BYTES + 4 * n + len(out)  # a character takes 4 bytes at most
        self[key] = out
        return out


class Encoder:
    """Ids of whole texts by a `tokenizers` file, with the library run once for each distinct piece.

    The byte-level pre-tokenizer always starts a new token at a space before a non-space, at a sign after a letter, and at
    a single line break between two words, so a text may be cut there, and the ids of the pieces joined are the ids of
    the text.  Pieces of letters alone are one word to the pre-tokenizer and go to the library's model directly.  Files with
    another pre-tokenizer are used without cuts.
    """

    def __init__(self, path: str, end_id: int = 0):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        pre = self.tokenizer.pre_tokenizer
        self.cuts = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.tokenizer.normalizer is None
        if self.cuts:
            # The pre-tokenizer's letter for each byte, learned from it: it gives the 256 letters in order of the bytes it writes them for.
            self.letters = _byte_letters(ByteLevel(add_prefix_space=False, use_regex=False))
            self.signs = Known(lambda s: self._encode([s])[0] if s else b"")
            self.pieces, self.bare = self._table(" "), self._table("")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _table(self, lead: str) -> Known:
        """Ids of pieces between two cuts, after a space or not."""
        tokenize, letters, signs = self.tokenizer.model.tokenize, self.letters, self.signs
        letter = letters[32] if lead else ""
        as_is = all(letters[b] == chr(b) for b in range(128) if chr(b).isalpha())

        def make(piece: str) -> bytes:
            word = piece.rstrip(SIGNS)
            if word.isalpha():
                if len(word) < len(piece):
                    return own[word] + signs[piece[len(word) :]]
                raw = letter + (word if as_is and word.isascii() else word.encode().decode("latin-1").translate(letters))
                return array("I", [t.id for t in tokenize(raw)]).tobytes()
            if "\n" in piece:
                a, _, b = piece.partition("\n")
                if a and b and "\n" not in b and not a[-1].isspace() and not b[0].isspace():
                    return own[a] + signs["\n"] + self.bare[b]
            return self._encode([lead + piece])[0]

        own = Known(make)
        return own

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: empty), each with the end id."""
        if not self.cuts:
            return [x + self.end for x in self._encode([t or "" for t in texts])]
        out, ids = [], self.pieces.__getitem__
        for t in texts:
            t = t or ""
            first, *rest = _SPLIT.split(t) if _BLANK.search(t) else t.split(" ")
            out.append(b"".join([self.bare[first] if first else b"", *map(ids, rest), self.end]))
        return out


#: Fixed value: ASCII signs, none of which is a letter, a digit or white space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters(byte_level) -> dict[int, str]:
    """Character code of a byte (latin-1) -> the letter that the byte-level pre-tokenizer writes for it."""
    out = {}
    for b in range(128):
        out[b] = byte_level.pre_tokenize_str(chr(b))[0][0]
    for code in range(128, 0x800, 1):  # two-byte characters show the letters of all lead and trail bytes in use below
        raw, seen = chr(code).encode(), byte_level.pre_tokenize_str(chr(code))[0][0]
        out.update(zip(raw, seen, strict=True))
    for code in (0x800, 0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000, 0xA000, 0xB000, 0xC000, 0xD000, 0xE000, 0xF000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000):
        raw, seen = chr(code).encode(), byte_level.pre_tokenize_str(chr(code))[0][0]
        out.update(zip(raw, seen, strict=True))
    return out


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this worker process; what it has seen serves later tasks too."""
    return Encoder(path, end_id)


# --- files ------------------------------------------------------------------------------------------------------


def planes(ids: np.ndarray) -> list[bytes]:
    """The four byte planes of little-endian ids, least significant first."""
    return [p.tobytes() for p in np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)]


def unplanes(parts: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in parts]).T).view("<u4").ravel()


class Writer:
    """Writes one file from documents in order, in memory of a few blocks."""

    def __init__(self, sink, block_ids: int = BLOCK_IDS, level: int = 3):
        self.sink, self.block, self.zstd = sink, block_ids, zstandard.ZstdCompressor(level=level)
        self.sink.write(MAGIC)
        self.at, self.entries, self.doc_ids, self.lengths = len(MAGIC), [], [], []
        self.open_: list[bytes] = []
        self.open_bytes, self.n_ids = 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.open_.append(ids)
        self.open_bytes += len(ids)
        if self.open_bytes >= 4 * self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.frombuffer(b"".join(self.open_), "<u4")
        at = 0
        while len(ids) - at >= self.block or (all_ and at < len(ids)):
            part = ids[at : at + self.block]
            packed = [self.zstd.compress(p) for p in planes(part)]
            self.entries.append((self.at, len(part), *map(len, packed)))
            self._write(b"".join(packed))
            at += len(part)
        self.open_ = [ids[at:].tobytes()]
        self.open_bytes = len(self.open_[0])

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def finish(self) -> None:
        self._flush(True)
        docs_at = self.at
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        self._write(struct.pack("<Q", len(ids)) + self.zstd.compress(known.tobytes() + ids.tobytes() + np.array(self.lengths, "<u8").tobytes()))
        index_at = self.at
        self._write(self.zstd.compress(b"".join(ENTRY.pack(*e) for e in self.entries)))
        self._write(FOOTER.pack(docs_at, index_at, len(self.entries), self.n_ids, MAGIC))


class Reader:
    """Random access to a file of `Writer`: the chunk index tells which blocks to read."""

    def __init__(self, source):
        self.source, self.unzstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        docs_at, index_at, blocks, self.n_ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a bit-plane file")
        self.entries = list(ENTRY.iter_unpack(self.unzstd.decompress(self._read(index_at, size - FOOTER.size - index_at)))) if blocks else []
        raw = self._read(docs_at, index_at - docs_at)
        n = struct.unpack_from("<Q", raw)[0]
        table = self.unzstd.decompress(raw[8:])
        known = np.frombuffer(table, np.uint8, n)
        self.doc_ids = [d if k else None for d, k in zip(np.frombuffer(table, "<i8", n, n).tolist(), known.tolist(), strict=True)]
        self.lengths = np.frombuffer(table, "<u8", n, 9 * n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.block_starts = np.concatenate([[0], np.cumsum([e[1] for e in self.entries])]).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, i: int) -> np.ndarray:
        at, n, *lengths = self.entries[i]
        raw, parts = self._read(at, sum(lengths)), []
        for k in lengths:
            parts.append(self.unzstd.decompress(raw[:k], max_output_size=n))
            raw = raw[k:]
        return unplanes(parts)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the file."""
        i = int(np.searchsorted(self.block_starts, lo, "right")) - 1
        out = []
        while lo < hi:
            b, start = self.block(i), int(self.block_starts[i])
            out.append(b[lo - start : hi - start])
            lo, i = start + len(b), i + 1
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc id, ids) in order; each block is read once."""
        buffer, first, i = np.zeros(0, "<u4"), 0, 0
        for d, lo, hi in zip(self.doc_ids, self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            parts = [buffer[lo - first :]]
            have = first + len(buffer)
            while have < hi:
                parts.append(self.block(i))
                have += len(parts[-1])
                i += 1
            if len(parts) > 1:
                buffer, first = np.concatenate(parts), lo
            yield d, buffer[lo - first : hi - first]


# --- Spark ------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id``, and write ids in ascending order of the ids, nulls first.

    Gives the manifest: ``path, start, n_docs, n_ids`` for each file, in order; start counts the ids before the file.
    Repeated ids keep a document each, in order of a hash of the text, and may go over several files, as may null ids.
    Long texts are encoded whole.  An empty table gives an empty manifest.  Columns of other names are left alone.

    ``folder`` must be of a scheme that `pyarrow.fs.FileSystem.from_uri` opens (file, s3, gs, hdfs where libhdfs is installed).
    """
    spark = docs.sparkSession
    folder = folder or own_folder(spark, "tokens")
    # The hash and the row's number split an id that many rows have; the rows of one id and text are alike.
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(partitions(docs), F.col("doc_id").asc_nulls_first(), "hash", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash").select("doc_id", "text")

    def work(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        writer, name = None, ""
        gc.disable()  # nothing here is cyclic, and the collector would walk all known pieces again and again
        for x in batches:
            if not len(x):
                continue
            if writer is None:
                encode = encoder(tokenizer, end_id)
                fs.create_dir(base, recursive=True)
                context = TaskContext.get()
                name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.planes"
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = Writer(sink)
            ids, texts = x["doc_id"].to_pylist(), x["text"]
            for lo in range(0, len(ids), 256):
                for d, i in zip(ids[lo : lo + 256], encode(texts.slice(lo, 256).to_pylist()), strict=True):
                    writer.add(d, i)
        gc.enable()
        if writer is not None:
            writer.finish()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "part": [context.partitionId()], "n_docs": [len(writer.lengths)], "n_ids": [writer.n_ids]}, pa.schema([("path", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    files = map_arrow(ordered, work, "path string, part long, n_docs long, n_ids long").collect()  # a row for each partition, which are ranges in order
    files.sort(key=lambda r: r["part"])
    rows, start = [], 0
    for r in files:
        rows.append((r["path"], start, r["n_docs"], r["n_ids"]))
        start += r["n_ids"]
    return spark.createDataFrame(rows, "path string, start long, n_docs long, n_ids long")


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document in the files of a manifest; ids is an array of long.  Column ``ids`` is left undecoded by `digest`."""
    return _read(manifest, True)


def digest(manifest: DataFrame) -> DataFrame:
    """`read` without the ids themselves: ``doc_id, start, n_tokens, ids_crc32``."""
    return _read(manifest, False)


def _read(manifest: DataFrame, with_ids: bool) -> DataFrame:
    n = max(manifest.count(), 1)

    def work(batches):
        for x in batches:
            for path, start in zip(x["path"].to_pylist(), x["start"].to_pylist(), strict=True):
                fs, place = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as f:
                    rows: list[tuple] = []
                    held = 0
                    for d, ids in Reader(f).documents():
                        rows.append((d, start, len(ids), zlib.crc32(ids.tobytes())) + ((ids.astype(np.int64),) if with_ids else ()))
                        start += len(ids)
                        held += len(ids)
                        if len(rows) >= 10_000 or (with_ids and held > 1_000_000):
                            yield batch(rows)
                            rows, held = [], 0
                    yield batch(rows)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def batch(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_arrow(manifest.select("path", "start").repartition(n, "path"), work, schema)
