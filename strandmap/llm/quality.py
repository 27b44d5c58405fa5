"""Document quality by nearest-neighbour voting on latent-semantic vectors.

Whole texts become TF-IDF vectors over hashed terms: lower-cased words, word shapes (runs of letter case, digits and
signs) and words that repeat the one before.  Document frequencies are counted over all documents.  A truncated
singular value decomposition of a bounded sample of labelled rows gives the latent space (Deerwester et al., "Indexing by
Latent Semantic Analysis", 1990); the labelled vectors are broadcast, every document is compared with all of them in
blocks, exactly, and its nearest ones vote with their cosines as weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm.shared import map_arrow, schema_with
from strandmap.llm.textscan import Words, slices, text_bytes, xxh64

#: Hashed dimensions: shapes take the first, words the others; the last one counts repeated words.
SHAPES, TERMS = 256, 1024
#: Latent dimensions, neighbours that vote, and the bound on labelled rows (and so on the broadcast: 4 bytes by LATENT each).
LATENT, NEIGHBOURS, SAMPLE = 64, 24, 8000
#: Documents compared at a time, and those whose term counts are held at a time (8 bytes by TERMS each).
BLOCK, HELD = 512, 2048

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97


def counts(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts of each row, (rows, TERMS)."""
    rows = len(offsets) - 1
    words = Words(values, offsets, lower=False)
    row = np.repeat(np.arange(rows), words.counts)
    total = np.zeros(rows * TERMS)
    if not len(row):
        return total.reshape(rows, TERMS)
    buf = words.buf
    low = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    h = xxh64(low, words.start, words.end)
    total += np.bincount(row * TERMS + (SHAPES + h % np.uint64(TERMS - SHAPES - 1)).astype(np.int64), minlength=len(total))
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    total += np.bincount(row[again] * TERMS + TERMS - 1, minlength=len(total))
    kind = _CLASS[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[words.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = np.concatenate([kind[keep], np.full(16, 32, np.uint8)])
    s = xxh64(shape, at[words.start], at[words.end])
    total += np.bincount(row * TERMS + (s % np.uint64(SHAPES)).astype(np.int64), minlength=len(total))
    return total.reshape(rows, TERMS)


def _blocks(texts):
    values, offsets = text_bytes(texts)
    for first, last in slices(offsets, 1 << 20):
        for lo in range(first, last, HELD):
            hi = min(lo + HELD, last)
            yield lo, hi, counts(values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def weigh(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (zero for wordless texts)."""
    share = np.sqrt(c / np.maximum(c[:, :SHAPES].sum(1, keepdims=True), 1)) * idf
    return (share / np.maximum(np.linalg.norm(share, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # (TERMS, latent)
    vectors: np.ndarray  # (labelled, latent), length 1
    labels: np.ndarray

    def score(self, c: np.ndarray) -> np.ndarray:
        """Weighted vote of the nearest labelled rows, 0 to 1; the share of label 1 for a text without words or neighbours."""
        out = np.empty(len(c))
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(c), BLOCK):
            x = unit(weigh(c[lo : lo + BLOCK], self.idf) @ self.basis)
            if not k:
                out[lo : lo + BLOCK] = prior
                continue
            cos = x @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0.0).astype(float) ** 8  # near ones outweigh the far ones of a sparse class
            total = w.sum(1)
            vote = (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[lo : lo + BLOCK] = np.where(total > 0, vote, prior)
        return np.clip(out, 0.0, 1.0)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents with each term, and documents, over all rows; added up on the executors."""

    def work(batches):
        total, n = np.zeros(TERMS + 1), 0
        for x in batches:
            for _, _, c in _blocks(x.column(0)):
                total[:TERMS] += (c > 0).sum(0)
                n += len(c)
        total[TERMS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], ["i", "n"])

    rows = map_arrow(docs.select(F.col(text).alias("text")), work, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 rows
    out = np.zeros(TERMS + 1)
    for r in rows:
        out[r["i"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from ``sample`` rows of ``labels`` at most, those that come first by a hash of the id.

    Null labels and ids, and labels of other ids, are left out; repeated rows count each, as do both labels of one id.
    Of several documents of one id the one with the least hash of its text is learned from.  Without any labelled document every score is 0.5.
    """
    df, n = document_frequencies(docs, text)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample).groupBy("_id", "_label").agg(F.count("*").alias("_times"))

    def work(batches):
        for x in batches:
            for lo, hi, c in _blocks(x.column(0)):
                rows = [v.astype(np.float16).tobytes() for v in weigh(c, idf)]
                yield pa.RecordBatch.from_arrays([*(x.column(i).slice(lo, hi - lo) for i in (1, 2, 3)), pa.array(rows, pa.binary())], ["id", "label", "times", "v"])

    own = docs.select(F.col(text).alias("text"), F.col(id_col).alias("_id")).join(F.broadcast(chosen), "_id")
    own = own.groupBy("_id", "_label", "_times").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("of")).select("of.text", F.xxhash64("_id").alias("id"), "_label", "_times")
    table = map_arrow(own, work, "id long, label int, times long, v binary").orderBy("id", "label", "v").toArrow()  # sample rows at most
    x = np.frombuffer(b"".join(table["v"].to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    times = table["times"].to_numpy() if len(table) else np.zeros(0, np.int64)
    x, y = np.repeat(x, times, axis=0), np.repeat(table["label"].to_numpy().astype(float), times) if len(table) else np.zeros(0)
    if not len(x):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = vectors[:, ::-1][:, : min(LATENT, len(x))].astype(np.float32)
    return Model(idf, np.ascontiguousarray(basis), unit(x @ basis).astype(np.float32), y)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the quality score of each whole text in column ``to`` (0 to 1, higher: label 1 is likelier); an existing one is replaced.

    Null and wordless texts get the share of label 1 among the labelled rows.  Long texts count whole, repeated rows each; of
    labelled rows as near as the last voter some vote, the same ones for the same vectors.  An empty table stays empty.
    """
    docs = docs.drop(to)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for x in batches:
            out = [shared.value.score(c) for _, _, c in _blocks(x.column(names.index(text)))]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*names, to])

    return map_arrow(docs, work, schema_with(docs, **{to: "double"}))


def training_rows(labels: DataFrame, id_col: str = "doc_id"):
    """Rows that may be learned from: all whose ``crc32(id as text) mod 5`` isn't 0."""
    return labels.where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)
