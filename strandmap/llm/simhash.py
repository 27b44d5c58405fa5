"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit SimHashes of word shingles.  Distinct fingerprints are linked within a Hamming radius:
correlated bits are grouped into parts, each part gets its own threshold by dynamic programming over estimated
candidate counts (thresholds sum to radius - parts + 1, -1 leaves a part out; Qin et al., "GPH: Similarity
Search in Hamming Space", ICDE 2018), every fingerprint probes the ball of its part values, and candidates are
verified on all 64 bits.  Links are contracted to components on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmap.llm.components import Forest, components
from strandmap.llm.shared import cut, map_arrow, masked, partitions, quoted, schema_with, written
from strandmap.llm.textscan import majority, minima, shingle_sets, simhash, text_bytes

#: A bucket of more rows than this is not compared pairwise; its fingerprints go the exact way of `_hot_links`.
BUCKET = 4096
#: Weaker correlations of two bits than this don't bring them together.
CORRELATED = 0.2
#: Numbers of parts among which the plan chooses.
PARTS = (2, 3, 4)


def fingerprints(docs: DataFrame, text: str = "text", k: int = 3, to: str = "fp") -> DataFrame:
    """docs with the SimHash of each whole text (a signed long) in column ``to``; null and wordless texts get 0.

    An existing column ``to`` is replaced.  Only the text passes through Python when docs is pruned to few columns.
    """
    docs = docs.drop(to)
    names = docs.columns

    def work(batches):
        for x in batches:
            fp = simhash(*text_bytes(x.column(names.index(text))), k)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(fp.view(np.int64))], [*names, to])

    return map_arrow(docs, work, schema_with(docs, **{to: "long"}))


# --- the plan ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int


def _bit_stats(fps: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each column the 64 x 64 counts of bits set together, added up on the executors."""
    size = len(columns) * 4096

    def work(batches):
        total, n = np.zeros((len(columns), 64, 64)), 0
        for x in batches:
            for w, c in enumerate(columns):
                v = x[c].to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(v, axis=1, bitorder="little").astype(np.float32)
                total[w] += bits.T @ bits
            n += len(x)
        if n:
            flat = np.append(total.ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "c"])

    rows = map_arrow(fps.select(*columns), work, "i long, c double").groupBy("i").agg(F.sum("c").alias("c")).toArrow()  # 4096 rows a column
    flat = np.zeros(size + 1)
    flat[rows["i"].to_numpy()] = rows["c"].to_numpy()
    return int(flat[-1]), flat[:-1].reshape(len(columns), 64, 64)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """The 64 bits in ``parts`` groups of near equal size, correlated bits together; where none are, neighbours."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    corr[corr < CORRELATED] = 0
    left, out = list(range(64)), []
    for g in range(parts):
        width = 64 // parts + (g < 64 % parts)
        group = [left[int(np.argmax(corr[np.ix_(left, left)].sum(1)))]]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(1)))])
        out.append(tuple(sorted(group)))
        left = [b for b in left if b not in group]
    return out


def part_value(fp, bits: tuple[int, ...]):
    """The chosen bits of a fingerprint column as a number."""
    v = F.lit(0).cast("long")
    runs: list[list[int]] = []
    for to, b in enumerate(bits):  # neighbouring bits are moved together
        if runs and runs[-1][1] + runs[-1][2] == b:
            runs[-1][2] += 1
        else:
            runs.append([to, b, 1])
    for to, b, width in runs:
        v = v.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit((1 << width) - 1).cast("long")), to))
    return v


def allocate(costs: list[list[float]], radius: int) -> list[int]:
    """Thresholds t (each >= -1, summing to radius - parts + 1) of least total cost; costs[i][t] is that of part i at t >= 0."""
    units = radius + 1  # threshold t takes t + 1 of them
    best = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, radius + 1):
                u, c = used + t + 1, cost + (own[t] if t >= 0 else 0.0)
                if u <= units and (u not in after or c < after[u][0]):
                    after[u] = (c, [*chosen, t])
        best = after
    return best[units][1]


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``width`` bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def plan(fps: DataFrame, columns: list[str], radius: int, numbers: tuple[int, ...] = PARTS) -> list[list[Part]]:
    """For each fingerprint column, parts and thresholds of the least estimated work over the distinct fingerprints ``fps``."""
    n, together = _bit_stats(fps, columns)
    named = [(w, m, bits) for w in range(len(columns)) for m in numbers for bits in group_bits(n, together[w], m)]
    structs = [F.struct(F.lit(k).alias("k"), part_value(F.col(columns[w]), bits).alias("v")) for k, (w, _, bits) in enumerate(named)]
    values = fps.select(F.explode(F.array(*structs)).alias("x")).select("x.k", "x.v")
    same = values.groupBy("k", "v").count().groupBy("k").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
    pairs = {r["k"]: r["pairs"] for r in same.collect()}  # a row for each part
    out = []
    for w in range(len(columns)):
        p = np.diag(together[w]) / max(n, 1)
        d = 2 * p * (1 - p)
        ratio = d / np.maximum(1 - d, 1e-9)  # pairs that differ in this bit for each pair that agrees
        chosen: tuple[float, list[Part]] | None = None
        for m in numbers:
            own = [(k, bits) for k, (w_, m_, bits) in enumerate(named) if (w_, m_) == (w, m)]
            costs = [_costs(pairs.get(k, 0.0), ratio[list(bits)], max(n, 1), radius) for k, bits in own]
            thresholds = allocate(costs, radius)
            total = sum(c[t] for c, t in zip(costs, thresholds, strict=True) if t >= 0)
            if chosen is None or total < chosen[0]:
                chosen = (total, [Part(bits, t) for (_, bits), t in zip(own, thresholds, strict=True)])
        out.append(chosen[1])
    return out


def _costs(pairs: float, ratio: np.ndarray, n: int, radius: int) -> list[float]:
    """Estimated candidates and probes of a part at thresholds 0 to radius, from its pairs of equal values and its bits' ratios."""
    e = [1.0] + [0.0] * radius  # elementary symmetric sums of the ratios: candidates at each distance
    for x in ratio:
        for j in range(radius, 0, -1):
            e[j] += e[j - 1] * x
    return [pairs * sum(e[: t + 1]) + 4.0 * n * len(ball(len(ratio), t)) for t in range(radius + 1)]


# --- probing ----------------------------------------------------------------------------------------------------


def _bucket_links(radius: int):
    """Rows (key, fp, own) sorted by key -> forest of the links within each key, verified on all bits."""

    def work(batches):
        held, carry = Forest(), None
        for x in batches:
            part = [x[c].to_numpy(zero_copy_only=False) for c in ("k", "v", "fp", "own")]
            if carry is not None:
                part = [np.concatenate(z) for z in zip(carry, part, strict=True)]
            k, v, fp, own = part
            cut_at = len(k)
            while cut_at and k[cut_at - 1] == k[-1] and v[cut_at - 1] == v[-1]:  # the last key may go on; it has BUCKET rows at most
                cut_at -= 1
            carry = [z[cut_at:] for z in part]
            yield from _within(k[:cut_at], v[:cut_at], fp[:cut_at], own[:cut_at], radius, held)
        if carry is not None:
            yield from _within(*carry, radius, held)
        yield from held.rest()

    return work


def _within(k, v, fp, own, radius, held):
    at, step = np.arange(len(k)), 1
    while len(at):
        at = at[at + step < len(k)]
        at = at[(k[at] == k[at + step]) & (v[at] == v[at + step])]
        a, b = fp[at], fp[at + step]
        ok = (own[at] | own[at + step]) & (np.bitwise_count((a ^ b).view(np.uint64)) <= radius) & (a != b)
        yield from held.add(a[ok], b[ok])
        step += 1


def _hot_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links within 1 or 2 bits for fingerprints of overfull buckets, without comparing them pairwise.

    Two fingerprints differ in at most 2 bits exactly when some word is within 1 bit of both, and in at most 1 bit when one
    of them is that word.  Each fingerprint names its 65 such words; those that name the same word are linked with the
    first of them, for 1 bit with the word itself if it is one of them.  A word has at most 65.
    """
    words = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in ball(64, 1)])).alias("w"))
    words = words.repartition(partitions(fps), "w").sortWithinPartitions("w", "fp")

    def star(w, fp):
        """Edges of whole groups."""
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
        hub = fp[first][group] if radius == 2 else w
        there = np.ones(len(w), bool) if radius == 2 else np.logical_or.reduceat(fp == w, first)[group]
        ok = there & (fp != hub)
        return fp[ok], hub[ok]

    def work(batches):
        held, w0, fp0 = Forest(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in batches:
            w, fp = (np.concatenate([z, x[c].to_numpy(zero_copy_only=False)]) for z, c in ((w0, "w"), (fp0, "fp")))
            if len(w):
                last = int(np.searchsorted(w, w[-1]))  # the last word may go on
                if last:
                    yield from held.add(*star(w[:last], fp[:last]))
                w0, fp0 = w[last:], fp[last:]
        if len(w0):
            yield from held.add(*star(w0, fp0))
        yield from held.rest()

    return map_arrow(words, work, "a long, b long")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps(fp)`` that connect all pairs within ``radius`` bits."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2: overfull buckets have an exact way only for these")
    parts = [(i, p) for i, p in enumerate(plan(fps, ["fp"], radius)[0]) if p.threshold >= 0]
    probes = [F.struct(F.lit(i).alias("k"), F.lit(m).cast("long").alias("m")) for i, p in parts for m in ball(len(p.bits), p.threshold)]
    value = F.coalesce(*[F.when(F.col("x.k") == i, part_value(F.col("fp"), p.bits)) for i, p in parts])
    rows = fps.select("fp", F.explode(F.array(*probes)).alias("x"))
    rows = rows.select("x.k", value.bitwiseXOR(F.col("x.m")).alias("v"), "fp", (F.col("x.m") == 0).alias("own"))
    hot = cut(rows.groupBy("k", "v").count().where(F.col("count") > BUCKET).select("k", "v"))
    if hot.isEmpty():
        cold, more = rows, None
    else:
        cold = rows.join(hot, ["k", "v"], "left_anti")
        hot_fps = rows.join(hot, ["k", "v"], "left_semi").select("fp").distinct()
        more = _hot_links(hot_fps, radius)
    cold = cold.repartition(partitions(fps), "k", "v").sortWithinPartitions("k", "v")
    edges = map_arrow(cold, _bucket_links(radius), "a long, b long")
    return edges if more is None else edges.union(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: id, ``fp`` (long), ``component`` (smallest id among all documents reachable by links).

    Documents whose fingerprints differ in at most ``radius`` bits are linked; equal fingerprints always are, wordless
    and null texts (fingerprint 0) included.  Repeated ids keep a row each; a null id belongs to a component but never
    names it unless all ids in it are null.  An empty table gives no rows.  Other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = cut(fingerprints(rows).select("id", "fp"))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    found = components(links(fps.select("fp"), radius)).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    rooted = cut(fps.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = rooted.join(named, "root").select("fp", "component")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component")


#: Shape of a sketch of SimHash words: a pair of this similarity is met with this probability.  `text_classes` has no use for it.
MEETS_AT, MEETS = 0.85, 0.95


def differing(similarity: float) -> float:
    """Expected share of differing SimHash bits of two texts whose shingle sets have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sketch_shape(n: int) -> tuple[int, int]:
    """(bits in a part, 64-bit words in a sketch) for n distinct sketches.

    Parts grow with the table so that buckets stay small; words follow so that similar pairs still meet.
    """
    parts = 4 if n < 1 << 24 else 3 if n < 1 << 32 else 2
    bits = 64 // parts
    needed = math.log(1 - MEETS) / math.log(1 - (1 - differing(MEETS_AT)) ** bits)
    return parts, max(math.ceil(needed / parts), 8)


# --- similarity of texts ----------------------------------------------------------------------------------------

#: Minima of a band; a pair of similarity s agrees in a band with probability s ** ROWS.
ROWS = 4
#: A pair of just the wanted similarity is to be met in one of the bands with this probability, whatever the table's size.
MET = 0.999
#: Pairs whose minima tell a similarity this many standard errors below the wanted one are not compared exactly.
ERRORS = 4
#: Keys of rows up to this many, of some 50 bytes each, are broadcast; more are joined by a shuffle, with the same result.
SHIPPED_ROWS = 500_000
#: Nodes in a slice of a bucket, and shingles in a slice of a group; a task compares two slices.
TILE, SLICE = 1024, 1 << 20


def bands(similarity: float) -> int:
    """Bands that meet a pair of this similarity with probability MET."""
    each = similarity**ROWS
    return 1 if each >= MET else math.ceil(math.log(1 - MET) / math.log(1 - each))


def least_matches(minima: int, similarity: float) -> int:
    """Equal minima below which a pair is not compared exactly."""
    return max(math.floor(minima * similarity - ERRORS * math.sqrt(minima * similarity * (1 - similarity))), 0)


def _keys_of(sets: np.ndarray, sizes: np.ndarray, n_bands: int) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty shingle sets laid end to end: (rows, bands) keys, and a byte of each minimum, (rows, bands * ROWS)."""
    starts = np.cumsum(sizes) - sizes
    low = minima(sets, starts, n_bands * ROWS)
    keys = low[:, ::ROWS].copy()
    with np.errstate(over="ignore"):
        for r in range(1, ROWS):
            keys = ((keys << np.uint64(29)) | (keys >> np.uint64(35))) * np.uint64(0x9E3779B185EBCA87) ^ low[:, r::ROWS]
    return keys.view(np.int64), (low >> np.uint64(20)).astype(np.uint8)


def _similar_links(similarity: float, least: int, width: int):
    """Rows (v, tile, node, n, sketch) sorted by key -> forest of the pairs within each key that may be this similar."""

    def work(batches):
        held, carry = Forest(), None
        for x in batches:
            key = [x[c].to_numpy(zero_copy_only=False) for c in ("v", "tile", "node", "n")]
            sketch = np.frombuffer(b"".join(x["sketch"].to_pylist()), np.uint8).reshape(-1, width)
            part = [*key, sketch]
            if carry is not None:
                part = [np.concatenate(z) for z in zip(carry, part, strict=True)]
            if not len(part[0]):
                continue
            last = np.ones(len(part[0]), bool)
            for z in part[:2]:
                last &= z == z[-1]
            cut_at = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            carry = [z[cut_at:] for z in part]
            yield from within([z[:cut_at] for z in part], held)
        if carry is not None:
            yield from within(carry, held)
        yield from held.rest()

    def within(part, held):
        *key, nodes, n, sketch = part
        group = np.zeros(len(nodes), np.int64)
        for z in key:
            group[1:] |= z[1:] != z[:-1]
        group = np.cumsum(group)
        at, step = np.arange(len(nodes)), 1
        while len(at):
            at = at[at + step < len(nodes)]
            at = at[group[at] == group[at + step]]
            for lo in range(0, len(at), 1 << 16):
                i = at[lo : lo + (1 << 16)]
                i = i[np.minimum(n[i], n[i + step]) / np.maximum(n[i], n[i + step]) >= similarity]  # sets of other sizes can't be so similar
                i = i[(sketch[i] == sketch[i + step]).sum(1, dtype=np.int64) >= least]
                yield from held.add(nodes[i], nodes[i + step])
            step += 1

    return work


def exact_links(nodes: np.ndarray, sizes: np.ndarray, sets: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what all pairs of at least this Jaccard similarity connect; non-empty sets, end to end.

    A search from set to set: each is compared with those not reached yet, so that a group of copies takes one pass.
    """
    items, number = np.unique(sets, return_inverse=True)
    first = np.cumsum(sizes) - sizes
    mark = np.zeros(len(items), bool)
    left, flat = np.arange(len(nodes)), number
    a: list[int] = []
    b: list[int] = []
    while len(left):
        todo = [left[0]]
        flat, left = flat[sizes[left[0]] :], left[1:]
        while todo and len(left):
            i = todo.pop()
            own = number[first[i] : first[i] + sizes[i]]
            mark[own] = True
            n = sizes[left]
            common = np.add.reduceat(mark[flat], np.cumsum(n) - n, dtype=np.int64)
            mark[own] = False
            ok = common / (n + sizes[i] - common) >= similarity
            if ok.any():
                a += [nodes[i]] * int(ok.sum())
                b += nodes[left[ok]].tolist()
                todo += left[ok].tolist()
                flat, left = flat[np.repeat(~ok, n)], left[~ok]
    return np.array(a, np.int64), np.array(b, np.int64)


def _exact(similarity: float):
    """Rows (block, tile, node, shingles) sorted by (block, tile) -> forest of the exact links within each."""

    def work(batches):
        held, key = Forest(), None
        nodes: list[int] = []
        sets: list[np.ndarray] = []

        def links_of():
            if len(nodes) > 1:
                yield from held.add(*exact_links(np.array(nodes, np.int64), np.array([len(z) for z in sets]), np.concatenate(sets), similarity))
            nodes.clear()
            sets.clear()

        for x in batches:
            for block, tile, node, shingles in zip(*(x[c].to_pylist() for c in ("block", "tile", "node", "shingles")), strict=True):
                if (block, tile) != key:
                    yield from links_of()
                    key = (block, tile)
                nodes.append(node)
                sets.append(np.frombuffer(shingles, "<u8"))
        yield from links_of()
        yield from held.rest()

    return work


def text_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, k1, k2, class) of every row: the keys are those of its id and text (`row_keys`), rows of one class are connected by links.

    Two texts are linked if their sets of k-word shingles (64-bit hashes of them) have this Jaccard similarity or more.
    Equal sets are one node; wordless and null texts are one.  Candidates are the pairs whose SimHash fingerprints, of the sets, `links`
    finds within 2 bits, and, as fingerprints of 64 bits differ in some ten of them at 0.8, those that share a band of minima of the sets (Broder, "On the
    Resemblance and Containment of Documents", 1997), of a number of bands that depends on nothing but the similarity.
    Every link is then verified on the sets themselves.

    A bucket of more than BUCKET nodes, and a group of candidates of more than SLICE shingles, falls into slices.  Each is first
    compared with itself and with one of them, which joins a group of copies; then what isn't of its largest class is
    compared with all of it.  So no pair of two classes is left out, and a group of copies takes time in proportion to it.
    """
    k1, k2 = row_keys(F.col(id_col), F.col(text))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    n_bands = bands(similarity)

    def describe(batches):
        for x in batches:
            sets, sizes = shingle_sets(*text_bytes(x["text"]), k)
            keys, sketch = np.zeros((len(sizes), n_bands), np.int64), np.zeros((len(sizes), n_bands * ROWS), np.uint8)
            if len(sets):
                keys[sizes > 0], sketch[sizes > 0] = _keys_of(sets, sizes[sizes > 0], n_bands)
            ends = np.cumsum(sizes)
            digests = [xxhash.xxh3_128_digest(sets[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(majority(sets, sizes).view(np.int64)), pa.array(list(keys), pa.list_(pa.int64())), pa.array([r.tobytes() for r in sketch], pa.binary())]
            yield pa.RecordBatch.from_arrays([x["id"], x["k1"], x["k2"], *columns], ["id", "k1", "k2", "digest", "n", "fp", "keys", "sketch"])

    own = cut(map_arrow(rows, describe, "id long, k1 long, k2 long, digest binary, n long, fp long, keys array<long>, sketch binary"))
    distinct = own.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "fp", "keys", "sketch")], F.min(F.struct("k1", "k2")).alias("of"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    blocks = _candidates(distinct.where("n > 0"), n_bands, similarity)

    members = cut(distinct.join(blocks, distinct["node"] == blocks["id"]).select("node", F.col("component").alias("block"), "n", "of.k1", "of.k2"))
    of_texts = members.select("node", "block", "k1", "k2")
    # One row of each node, found by its keys; repeated ones are dropped before anything is shuffled for that.
    whole = rows.select("k1", "k2", "text").join(shipped(of_texts), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", "block", "text")

    def sets_of(batches):
        for x in batches:
            sets, sizes = shingle_sets(*text_bytes(x["text"]), k)
            ends = np.cumsum(sizes)
            shingles = pa.array([sets[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([x["node"], x["block"], shingles], ["node", "block", "shingles"])

    sets = written(map_arrow(whole, sets_of, "node long, block long, shingles binary"), "shingles")
    sizes = cut(members.groupBy("block").agg(F.ceil(F.sum("n") / SLICE).cast("long").alias("of")))

    def verified(tiled: DataFrame) -> DataFrame:
        dealt = tiled.repartition(partitions(docs), "block", "tile").sortWithinPartitions("block", "tile", "node")
        return components(map_arrow(dealt.select("block", "tile", "node", "shingles"), _exact(similarity), "a long, b long"))

    found = cut(verified(_first_tiles(sets.join(sizes, "block"))))
    large = sizes.where("of > 1").select("block")
    if not large.isEmpty():
        some = members.select("node", "block", "n").join(large, "block").join(found, F.col("node") == F.col("id"), "left")
        rest = _rest_tiles(some.select("node", F.col("block").alias("group"), F.col("n").alias("weight"), F.coalesce("component", "node").alias("class")), SLICE)
        if not rest.isEmpty():
            found = _joined(found, verified(sets.join(rest.select("node", "tile"), "node")))
    classes = distinct.join(found, distinct["node"] == found["id"], "left").select("digest", F.coalesce("component", "node").alias("class"))
    return own.select("id", "k1", "k2", "digest").join(classes, "digest").select("id", "k1", "k2", "class")


def _candidates(nodes: DataFrame, n_bands: int, similarity: float) -> DataFrame:
    """(id, component) of the nodes (node, n, fp, keys, sketch) that some candidate pair holds."""
    width = n_bands * ROWS
    keyed = nodes.select("node", F.posexplode("keys").alias("k", "v")).select(F.xxhash64("k", "v").alias("v"), "node")
    counts = cut(keyed.groupBy("v").agg(F.count("*").alias("count")).where("count > 1"))
    met = cut(keyed.join(counts, "v"))
    sketches = nodes.select("node", "n", "sketch")

    def similar(tiled: DataFrame) -> DataFrame:
        dealt = tiled.join(sketches, "node").repartition(partitions(nodes), "v", "tile").sortWithinPartitions("v", "tile", "node")
        return map_arrow(dealt.select("v", "tile", "node", "n", "sketch"), _similar_links(similarity, least_matches(width, similarity), width), "a long, b long")

    zero = F.lit(0).cast("long")
    hot = met.where(F.col("count") > BUCKET).select("v", "node", F.ceil(F.col("count") / TILE).cast("long").alias("of"))
    tiled = met.where(F.col("count") <= BUCKET).select("v", "node", zero.alias("tile")).unionAll(_first_tiles(hot).select("v", "node", "tile"))
    # SimHash: equal fingerprints, and those within 2 bits.
    fps = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    near = links(fps.select("fp"), 2)
    ends = near.join(fps.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    edges = similar(tiled).unionAll(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).unionAll(nodes.select("node", "fp").join(fps, "fp").select(F.col("node").alias("a"), F.col("first").alias("b")))
    found = components(edges)
    if hot.isEmpty():
        return found
    found = cut(found)
    some = hot.join(found, F.col("node") == F.col("id"), "left")
    rest = _rest_tiles(some.select("node", F.col("v").alias("group"), F.lit(1).cast("long").alias("weight"), F.coalesce("component", "node").alias("class")), TILE)
    return found if rest.isEmpty() else _joined(found, similar(rest.withColumnRenamed("group", "v")))


def _first_tiles(rows: DataFrame) -> DataFrame:
    """Rows (node, of: number of slices of its group) with ``tile``: the slice of each, and all of them for those of slice 0."""
    own = F.pmod(F.xxhash64("node"), F.col("of"))
    return rows.withColumn("tile", F.explode(F.when(own == 0, F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).otherwise(F.array(own))))


def _rest_tiles(rows: DataFrame, size: int) -> DataFrame:
    """``group, node, tile`` of the groups whose rows (node, group, weight, class) are of several classes.

    A tile has a slice of what isn't of the group's largest class, and a slice of the whole group, of about ``size`` weight each.
    """
    by = rows.groupBy("group", "class").agg(F.sum("weight").alias("w"))
    per = by.groupBy("group").agg(F.max(F.struct("w", "class")).alias("most"), F.sum("w").alias("total")).where(F.col("total") > F.col("most.w"))
    parts = cut(per.select("group", F.col("most.class").alias("giant"), F.ceil(F.col("total") / size).cast("long").alias("all"), F.ceil((F.col("total") - F.col("most.w")) / size).cast("long").alias("rest")))
    dealt = rows.join(parts, "group").withColumns({"a": F.pmod(F.xxhash64("node"), F.col("rest")), "b": F.pmod(F.xxhash64("node", F.lit(1)), F.col("all"))})
    zero = F.lit(0).cast("long")
    across = F.transform(F.sequence(zero, F.col("rest") - 1), lambda a: a * F.col("all") + F.col("b"))
    along = F.transform(F.sequence(zero, F.col("all") - 1), lambda b: F.col("a") * F.col("all") + b)
    return cut(dealt.select("group", "node", F.explode(F.when(F.col("class") == F.col("giant"), across).otherwise(F.array_union(across, along))).alias("tile")))


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components of two graphs together; ``found`` is (id, component), ``more`` that or edges (a, b)."""
    a, b = more.columns
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more.select(F.col(a).alias("a"), F.col(b).alias("b"))))


def row_keys(id_: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that tell rows of other ids or texts apart; a null text is an empty one."""
    row = [F.isnull(id_), id_, F.coalesce(text, F.lit(""))]
    return F.xxhash64(F.lit(1), *row), F.xxhash64(F.lit(2), *row)


def shipped(keys: DataFrame) -> DataFrame:
    """Narrow rows, broadcast where there are SHIPPED_ROWS of them at most, else left to a join by shuffle."""
    return F.broadcast(keys) if keys.count() <= SHIPPED_ROWS else keys


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay if one of each class of `text_classes` does: that of the smallest id, and of the rows without an id one too.

    Rows of one id and text are one document; documents of one id but other texts are not.  Whole rows are shuffled only where
    more than SHIPPED_ROWS of them go or are repeated.
    """
    classes = text_classes(docs, id_col, text, k, similarity)
    each = cut(classes.groupBy("k1", "k2", "class").agg(F.first("id").alias("id"), F.count("*").alias("copies")).withColumn("none", F.isnull("id")))
    best = cut(each.groupBy("class", "none").agg(F.min(F.struct("id", "k1", "k2")).alias("best")))
    judged = each.join(best, ["class", "none"]).select("k1", "k2", "copies", ((F.col("best.k1") == F.col("k1")) & (F.col("best.k2") == F.col("k2"))).alias("stays"))
    special = cut(judged.where("not stays or copies > 1").select("k1", "k2", "stays"))
    k1, k2 = row_keys(F.col(quoted(id_col)), F.col(quoted(text)))
    rows, back, _ = masked(docs, k1=k1, k2=k2)
    out = rows.join(shipped(special.select("k1", "k2")), ["k1", "k2"], "left_anti").select(*back)
    repeated = special.where("stays").select("k1", "k2")
    if repeated.isEmpty():
        return out
    return out.unionAll(rows.join(shipped(repeated), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*back))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) of every document with an id: the smallest id of those that links of `text_classes` connect it with."""
    own = cut(text_classes(docs.where(F.col(id_col).isNotNull()), id_col, text, k, similarity))
    named = own.groupBy("class").agg(F.min("id").alias("component"))
    return own.join(named, "class").select(F.col("id").alias(id_col), "component")
