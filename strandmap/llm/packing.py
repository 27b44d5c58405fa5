"""Packing into optimal length buckets.

A dynamic program over the global histogram of lengths chooses the bucket borders of least padding; inside each bucket
documents, in the order of a hash, form batches whose padded size stays within a token budget.  All of it runs as
DataFrame expressions but for the program itself, which sees each distinct length and its count: of documents with W
words in all there are at most sqrt(2 W) of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.llm.shared import cut, masked, partitions, row_key

#: A range of a bucket with this many times its share of rows is looked through for rows alike in every column.
FULL = 4


def _layer(best: np.ndarray, rows: np.ndarray, total: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first j lengths, the last bucket being i .. j-1, and that i, from the ``best`` of one bucket less.

    The best i doesn't fall as j grows (moving both ends of two crossing buckets apart never saves padding), so the
    middle j of a range is solved and halves what is left to try on both sides; all ranges of one depth are solved at once.
    """
    n = len(tops)
    now, from_ = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    lo, hi, least, most = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(lo):
        j = (lo + hi) // 2
        width = np.minimum(most, j - 1) - least + 1
        start = np.cumsum(width) - width
        i = np.arange(int(width.sum())) - np.repeat(start - least, width)
        at = np.repeat(j, width)
        cost = best[i] + (tops[at - 1] * (rows[at] - rows[i]) - (total[at] - total[i]))
        low = np.minimum.reduceat(cost, start)
        hit = np.flatnonzero(cost == np.repeat(low, width))
        owner = np.repeat(np.arange(len(j)), width)[hit]
        first = hit[np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))]  # of equal ones the leftmost
        now[j], from_[j] = low, i[first]
        lo, hi, least, most = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (least, from_[j]), (from_[j], most)))
        left = lo <= hi
        lo, hi, least, most = lo[left], hi[left], least[left], most[left]
    return now, from_


def borders(counts: np.ndarray, sums: np.ndarray, tops: np.ndarray, buckets: int) -> list[int]:
    """Last cell of each bucket so that the padding, each length raised to its bucket's largest, is least.

    Cells are in order of length, with a count, a sum of lengths and a largest length each.  Of equal paddings the one
    with fewer buckets is taken.
    """
    n = len(counts)
    rows = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    total = np.concatenate([[0.0], np.cumsum(sums, dtype=float)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = []
    results = []
    for _ in range(min(buckets, n)):
        best, from_ = _layer(best, rows, total, np.asarray(tops, float))
        back.append(from_)
        results.append(best[n])
    if not results:
        return []
    k = int(np.argmin(results))
    ends, j = [], n
    for step in range(k, -1, -1):
        ends.append(j - 1)
        j = int(back[step][j])
    return ends[::-1]


def _bucket_of(length: Column, tops: list[int], first: int) -> Column:
    """Number of the first bucket, from ``first`` on, whose largest length isn't below ``length``: a binary search in expressions."""
    if len(tops) <= 1:
        return F.lit(first)
    half = len(tops) // 2
    return F.when(length <= tops[half - 1], _bucket_of(length, tops[:half], first)).otherwise(_bucket_of(length, tops[half:], first + half))


def pack(df: DataFrame, length: Column | str, budget: int = 8192, buckets: int = 16) -> DataFrame:
    """df with ``length``, ``bucket`` (0 on), ``padded`` (the bucket's largest length), ``batch`` (0 on in the bucket) and ``place``.

    ``padded * documents`` of a batch is at most ``budget``, but for documents longer than that, which are batches of
    their own.  Every document is kept whole.  Null lengths count 0; documents of one length may be in any order; repeated
    rows are places of their own, in a row; an empty table stays empty; existing columns of these names are replaced, others
    may have any name.
    """
    spark = df.sparkSession
    value = F.col(length) if isinstance(length, str) else length
    rows, back, new = masked(df, "length", "bucket", "padded", "batch", "place", _length=F.coalesce(value, F.lit(0)).cast("long"))
    cells = rows.groupBy("_length").agg(F.count("*").alias("n")).toArrow().sort_by("_length")  # a row for each distinct length
    lengths, counts = (cells[c].to_numpy() for c in ("_length", "n"))
    ends = borders(counts, counts * lengths.astype(float), lengths, buckets)
    n_all = int(counts.sum())
    per_group = max(n_all // (4 * partitions(df)), 1)
    table, at = [], 0
    for e in ends:
        n, top = int(counts[at : e + 1].sum()), int(lengths[e])
        table.append((top, max(1, budget // max(top, 1)), -(-n // per_group)))
        at = e + 1
    # Literals of a value for each bucket: no join.
    tops, batch_rows, ranges = (F.array(*[F.lit(x).cast("long") for x in column]).cast("array<bigint>") for column in (zip(*table, strict=True) if table else ((), (), ())))
    own_bucket = _bucket_of(F.col("_length"), [t[0] for t in table], 0)
    of_bucket = {n: F.get(x, F.col("_bucket")) for n, x in (("_padded", tops), ("_rows", batch_rows), ("_groups", ranges))}
    # The rank in a bucket is the rank by hash; ranges of the hash are ranked apart, so that no task holds a whole bucket.
    columns = list(new.values())
    keyed = rows.withColumns({"_t1": row_key(rows, columns, 1), "_t2": row_key(rows, columns, 2), "_bucket": own_bucket}).withColumns(of_bucket)
    keyed = keyed.withColumn("_group", F.expr("(shiftrightunsigned(_t1, 33) * _groups) div 2147483648"))
    groups = cut(keyed.groupBy("_bucket", "_group").agg(F.count("*").alias("_n")))
    before = groups.select("_bucket", "_group", "_n", (F.sum("_n").over(Window.partitionBy("_bucket").orderBy("_group")) - F.col("_n")).alias("_before"))
    told = [F.col("_length").alias("length"), F.col("_bucket").alias("bucket"), F.col("_padded").alias("padded"), F.expr("_rank div _rows").alias("batch"), F.expr("_rank % _rows").alias("place")]
    key = ["_bucket", "_group", "_t1", "_t2"]
    # Rows alike in every column have one hash: many of them would make one range a task's whole work.
    full = groups.where(F.col("_n") > FULL * per_group).select("_bucket", "_group")
    heavy = None
    if not full.isEmpty():
        # The hashes with a share of rows of their own, at most 4 for each partition: they come first in their range.
        heavy = cut(keyed.join(F.broadcast(full), ["_bucket", "_group"], "left_semi").groupBy(*key).agg(F.count("*").alias("_count")).where(F.col("_count") > per_group))
    if heavy is None or heavy.isEmpty():
        ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy("_bucket", "_group").orderBy("_t1", "_t2")))
        placed = ranked.join(before, ["_bucket", "_group"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
        return placed.select(*back, *told)
    shift = heavy.groupBy("_bucket", "_group").agg(F.sum("_count").alias("_shift"))
    before = before.join(F.broadcast(shift), ["_bucket", "_group"], "left").withColumn("_first", F.col("_before") + F.coalesce("_shift", F.lit(0)))
    ranked = keyed.join(F.broadcast(heavy), key, "left_anti").withColumn("_row", F.row_number().over(Window.partitionBy("_bucket", "_group").orderBy("_t1", "_t2")))
    placed = ranked.join(before, ["_bucket", "_group"]).withColumn("_rank", F.col("_first") + F.col("_row") - 1).select(*back, *told)
    # One of the rows is kept and repeated as often as they were counted, in pieces of a range's share.
    ahead = F.sum("_count").over(Window.partitionBy("_bucket", "_group").orderBy("_t1", "_t2")) - F.col("_count")
    starts = heavy.withColumn("_ahead", ahead).join(before.select("_bucket", "_group", "_before"), ["_bucket", "_group"])
    pieces = starts.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1, F.lit(per_group).cast("long"))))
    pieces = pieces.withColumn("_many", F.least(F.lit(per_group), F.col("_count") - F.col("_at")))
    kept = ["_length", "_padded", "_rows"]
    one = keyed.join(F.broadcast(heavy), key, "left_semi").groupBy(*key).agg(*[F.first(c).alias(c) for c in kept], F.first(F.struct(*columns)).alias("_own"))
    again = one.join(pieces, key).repartition("_bucket", "_group", "_t1", "_at").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1)))
    again = again.withColumn("_rank", F.col("_before") + F.col("_ahead") + F.col("_at") + F.col("_i"))
    return placed.unionAll(again.select("_own.*", *told))
