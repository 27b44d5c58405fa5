"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies; its fractional part is rounded by the pivotal
method on mass (Deville and Tille, "Unequal Probability Sampling without Replacement through a Splitting Method",
Biometrika 1998; with weights: Gandhi et al., "Dependent Rounding", JACM 2006): two documents exchange mass at random
until one of their probabilities is integral, the other goes on to the next pair.  So the words taken from a source are
its target but for the last document's rounding, while each document keeps its expectation.  Rows of a source are dealt
into buckets by hash, each bucket ends with one fractional residual at most, and residuals are combined in a tree.

What is rounded are narrow rows, (hash of the row, size, number of such rows); the rows themselves are read once to make
these and once to be joined with what was decided.  Rows alike in every column are one narrow row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.llm.shared import cut, map_arrow, masked, partitions, row_key, schema_with

#: Rows in a bucket of the first level, on average.
BUCKET_ROWS = 256
#: Residuals combined in one step of the tree.
FAN_IN = 64
#: Bits of a group's number that its bucket takes; the rest are the source's rank.
BUCKET_BITS = 32
#: Narrow source rows up to this many (some 80 bytes each) are broadcast; more are joined by a shuffle, with the same result.
BROADCAST_SOURCES = 100_000
#: Rows that one row of a group of rows alike in every column is repeated to at a time.
REPEATS = 10_000


def targets(sizes: dict[str | None, int], weights: Sequence[float], share: float, most: float) -> dict[str | None, float]:
    """The law of the targets, for sources in memory; `goals` finds the same for a table of them.

    Words to take of each source: ``share`` of all sizes by the sources' weights, none above ``most`` times its size.

    Sources in code point order, null last, take the weights in turn.  What a capped source can't hold is shared again
    by weight among the others until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if total and left * weight[s] / total >= most * sizes[s]]
        if not over or total == 0:
            out |= {s: left * weight[s] / total if total else 0.0 for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        left = max(left - sum(out[s] for s in over), 0.0)
        open_ = [s for s in open_ if s not in over]
    return out


def pivot(size: np.ndarray, part: np.ndarray, draws: np.ndarray, open_size: float, open_part: float):
    """One run over documents; gives the rounded values (nan for the one that stays open), who closed the earlier open one, and the open one.

    Returns ``(out, closed_to, open_index, open_part)``: out[i] in {0, 1, nan}; closed_to is 0 or 1 if the document that
    was open before got closed, else None; open_index is that of the open document, -1 for the one open before, None
    for none.
    """
    out = np.empty(len(size))
    closed_to, at, a, p = None, (-1 if open_part > 0 else None), open_size, open_part
    sizes, parts, us = size.tolist(), part.tolist(), draws.tolist()
    for i, (b, q, u) in enumerate(zip(sizes, parts, us, strict=True)):
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[i] = round(q)
            continue
        if b <= 0:  # nothing to exchange: rounded alone
            out[i] = 1.0 if u < q else 0.0
            continue
        if at is None:
            at, a, p = i, b, q
            out[i] = np.nan
            continue
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        if u * (up + down) < down:
            p, q, full = p + up / a, q - up / b, (a * (1 - p) <= b * q)
            keep_new = full
            if full:
                p = 1.0
            else:
                q = 0.0
        else:
            full = a * p <= b * (1 - q)
            p, q = p - down / a, q + down / b
            keep_new = full
            if full:
                p = 0.0
            else:
                q = 1.0
        if keep_new:  # the open one is decided, the new one stays open unless it came out integral too
            if at == -1:
                closed_to = p
            else:
                out[at] = p
            if 1e-12 < q < 1 - 1e-12:
                at, a, p = i, b, q
                out[i] = np.nan
            else:
                out[i], at = round(q), None
        else:
            out[i] = q
            if not 1e-12 < p < 1 - 1e-12:
                if at == -1:
                    closed_to = float(round(p))
                else:
                    out[at] = round(p)
                at = None
    return out, closed_to, at, (p if at is not None else 0.0)


def _round_groups(names: list[str], level: int):
    """Batches sorted by (_group, size descending) -> the same rows with _up (0 or 1), or null and _part for a group's residual."""
    g_at, s_at, p_at = (names.index(c) for c in ("_group", "_size", "_part"))

    def emit(row: pa.RecordBatch, up, part) -> pa.RecordBatch:
        columns = list(row.columns)
        columns[p_at] = pa.array(part, pa.float64())
        return pa.RecordBatch.from_arrays([*columns, pa.array(up, pa.int32(), from_pandas=True)], [*names, "_up"])

    def work(batches):
        held: pa.RecordBatch | None = None  # the open document of the group that goes on
        held_part, group, rng = 0.0, None, None
        for x in batches:
            g = x.column(g_at).to_numpy(zero_copy_only=False)
            size = x.column(s_at).to_numpy(zero_copy_only=False).astype(float)
            part = x.column(p_at).to_numpy(zero_copy_only=False).astype(float)
            up, left = np.empty(len(g)), part.copy()
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
            kept = None
            for k, lo in enumerate(starts):
                hi = starts[k + 1] if k + 1 < len(starts) else len(g)
                if rng is None or g[lo] != group:
                    if held is not None:  # the last group is over: its open document is its residual
                        yield emit(held, [None], [held_part])
                        held, held_part = None, 0.0
                    group = g[lo]
                    rng = np.random.Generator(np.random.PCG64([int(group) & 0xFFFFFFFFFFFFFFFF, level]))
                a = float(held.column(s_at)[0].as_py()) if held is not None else 0.0
                out, closed, at, p = pivot(size[lo:hi], part[lo:hi], rng.random(hi - lo), a, held_part)
                up[lo:hi] = out
                if closed is not None:
                    yield emit(held, [int(closed)], [0.0])
                    held, held_part = None, 0.0
                if at == -1:
                    held_part = p
                elif at is None:
                    held, held_part = None, 0.0
                else:
                    left[lo + at] = p
                    if hi == len(g):  # may go on in the next batch
                        held, held_part = x.slice(lo + at, 1), p
                        kept = lo + at
            rest = np.ones(len(g), bool)
            if kept is not None:
                rest[kept] = False
            done = x if rest.all() else x.filter(pa.array(rest))
            yield emit(done, up[rest], left[rest])
        if held is not None:
            yield emit(held, [None], [held_part])

    return work


def _rounded(df: DataFrame, level: int) -> DataFrame:
    df = df.repartition(partitions(df), "_group").sortWithinPartitions("_group", F.desc("_size"), "_t1", "_t2")
    return map_arrow(df, _round_groups(df.columns, level), schema_with(df, _up="int"))


def ranked(sources: DataFrame, source: str) -> DataFrame:
    """sources with ``_rank``: their place in code point order, null last.  Ranges of sources are ranked apart and offset by the counts before them."""
    dealt = sources.repartitionByRange(partitions(sources), F.col(source).asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(source).asc_nulls_last()))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("_rank", F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before")


def goals(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources(_rank, _n, ...)`` with ``_goal``, by the law of `targets`.

    The driver sees sums for each weight, not the sources: a source is capped if its part of what is left is more than it may
    give, which raises the others' parts, so that those capped stay so, until no further one is.
    """
    k = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % k + 1).cast("int"))

    def sums(over: Column) -> tuple[int, int, float]:
        """Capped sources, their sizes, and the weight of the others."""
        rows = sources.groupBy((F.col("_rank") % k).alias("i")).agg(F.count_if(over).alias("over"), F.count_if(~over).alias("open"), F.sum(F.when(over, F.col("_n"))).alias("n")).collect()
        return sum(r["over"] for r in rows), sum(r["n"] or 0 for r in rows), sum(float(weights[r["i"]]) * r["open"] for r in sorted(rows, key=lambda r: r["i"]))

    all_ = sources.agg(F.sum("_n")).first()[0] or 0
    over, capped = F.lit(False), 0
    left, (_, _, total) = share * all_, sums(over)
    while total > 0:
        own = F.lit(left) * weight / F.lit(total)
        over = own >= F.lit(float(most)) * F.col("_n")
        now, n, rest = sums(over)
        if now == capped:
            break
        capped, left, total = now, max(share * all_ - most * n, 0.0), rest
    part = F.lit(left) * weight / F.lit(total) if total > 0 else F.lit(0.0)
    return sources.withColumn("_goal", F.when(over, F.lit(float(most)) * F.col("_n")).otherwise(part).cast("double"))


def decisions(narrow: DataFrame, weights: Sequence[float], share: float, most: float, source: str) -> DataFrame:
    """``narrow(_t1, _t2, _size, _count, source)`` with ``source_size``, ``target``, ``_whole`` (copies of each such row at least) and ``_more`` (rows of the ``_count`` that get one more)."""
    sources = narrow.groupBy(source).agg(F.sum(F.col("_size") * F.col("_count")).alias("_n"), F.sum("_count").alias("_rows"))
    found = goals(cut(ranked(sources, source)), weights, share, most)
    rate = F.when(F.col("_n") > 0, F.least(F.col("_goal") / F.col("_n"), F.lit(float(most)))).otherwise(F.lit(0.0))
    found = found.withColumn("_rate", rate).withColumn("_whole", F.floor(F.col("_rate") + 1e-9).cast("int"))
    rates = cut(found.select(F.col(source).alias("_source"), "_rank", F.col("_n").alias("source_size"), F.col("_goal").alias("target"), "_whole", F.greatest(F.col("_rate") - F.col("_whole"), F.lit(0.0)).alias("_rest"), F.ceil(F.col("_rows") / BUCKET_ROWS).cast("long").alias("_buckets")))
    seen = rates.agg(F.count("*").alias("n"), F.max("_buckets").alias("deepest")).first()
    rated = narrow.join(F.broadcast(rates) if seen["n"] <= BROADCAST_SOURCES else rates, narrow[source].eqNullSafe(F.col("_source"))).drop("_source", source)
    # Of rows alike in every column all whole ones of their expected copies are sure; one of them keeps the fraction.
    mass = F.col("_rest") * F.col("_count")
    rated = rated.withColumn("_sure", F.floor(mass + 1e-9)).withColumn("_part", F.greatest(mass - F.col("_sure"), F.lit(0.0))).drop("_rest")
    # _group: rank of the source, then the bucket; a parent's number drops factors of FAN_IN.
    rated = rated.withColumn("_group", F.shiftleft("_rank", BUCKET_BITS) + F.pmod(F.col("_t1"), F.col("_buckets"))).drop("_rank", "_buckets")
    first = cut(_rounded(rated, 0))
    left = cut(first.where("_up is null").select("_group", "_size", "_part", "_t1", "_t2", F.col("_group").alias("_first")))
    deepest, decided, level = seen["deepest"] or 1, None, 1
    while deepest > 1:
        deepest = -(-deepest // FAN_IN)
        mask = (1 << BUCKET_BITS) - 1
        up_one = F.col("_group") - F.col("_group").bitwiseAND(F.lit(mask).cast("long")) + F.expr(f"(_group & {mask}L) div {FAN_IN}")
        out = cut(_rounded(left.withColumn("_group", up_one), level))
        done = out.where("_up is not null").select("_first", F.col("_up").alias("_later"))
        decided = done if decided is None else decided.union(done)
        left = out.where("_up is null").drop("_up")
        level += 1
    # The last residual of a source has nothing left to pair with: the nearer whole number keeps the source nearest its target.
    last = left.select("_first", (F.col("_part") >= 0.5).cast("int").alias("_later"))
    decided = (last if decided is None else decided.union(last)).withColumnRenamed("_first", "_group")
    # Only the residual rows, one in a bucket, are joined.
    settled = first.where("_up is not null").withColumn("_later", F.lit(None).cast("int"))
    both = settled.unionByName(first.where("_up is null").join(decided, "_group", "left"))
    return both.select("_t1", "_t2", "_size", "_count", "source_size", "target", "_whole", (F.col("_sure") + F.coalesce("_up", "_later", F.lit(0))).alias("_more"))


def mix(df: DataFrame, size: Column, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, source_col: str = "source") -> DataFrame:
    """df with ``size`` (long), ``source_size``, ``target`` (of the row's source) and ``copies`` (int) for every row.

    ``sum(copies * size)`` of each source is its target but for one document's rounding; copies are 0 to ``most`` rounded
    up, and never take more than ``most`` times a document's size where ``most`` is whole.  A null source is a source
    of its own, a null size counts 0, repeated rows are rows of their own (which of them gets more copies makes no
    difference), long texts count whole, existing columns of these names are replaced, others may have any name, and an
    empty table stays empty.  The choice depends on the rows alone: reruns agree.  The driver sees sums, not sources.
    """
    own, back, new = masked(df, "size", "source_size", "target", "copies", _size=F.coalesce(size, F.lit(0)).cast("long"))
    columns = list(new.values())
    keyed = own.withColumns({"_t1": row_key(own, columns, 1), "_t2": row_key(own, columns, 2)})
    narrow = cut(keyed.groupBy("_t1", "_t2", "_size", F.col(new[source_col]).alias("_from")).agg(F.count("*").alias("_count")))
    decided = cut(decisions(narrow, weights, share, most, "_from"))
    rows = keyed.drop("_size")
    told = [F.col("_size").alias("size"), "source_size", "target"]
    once = rows.join(decided.where("_count = 1 or _more = 0 or _more = _count"), ["_t1", "_t2"])
    out = once.select(*back, *told, (F.col("_whole") + (F.col("_more") > 0).cast("int")).alias("copies"))
    # Some of several rows alike in every column get one more: one of them is kept and repeated as often as they are.
    several = decided.where("_count > 1 and _more > 0 and _more < _count")
    if several.isEmpty():
        return out
    parts = [F.struct((F.col("_whole") + F.lit(i)).alias("copies"), n.alias("n")) for i, n in ((1, F.col("_more")), (0, F.col("_count") - F.col("_more")))]
    pieces = several.withColumn("_part", F.explode(F.array(*parts))).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_part.n") - 1, F.lit(REPEATS).cast("long"))))
    pieces = pieces.select("_t1", "_t2", *told, "_part.copies", F.least(F.lit(REPEATS), F.col("_part.n") - F.col("_at")).alias("_rows"), "_at")
    kept = rows.join(several.select("_t1", "_t2"), ["_t1", "_t2"], "left_semi").groupBy("_t1", "_t2").agg(F.first(F.struct(*columns)).alias("own"))
    again = kept.join(pieces, ["_t1", "_t2"]).repartition("_t1", "_at", "copies").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return out.unionAll(again.select("own.*", "size", "source_size", "target", "copies"))
