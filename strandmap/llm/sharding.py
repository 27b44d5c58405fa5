"""Sharding by histogram sort: shards of near equal bytes, equal texts side by side.

Rows are ordered by (hash of the text, hash of the id, hash of the other columns).  The bytes and rows below candidate key
boundaries are counted exactly over all partitions, probes are refined only where a splitter isn't within its
tolerance, and once all are, rows are exchanged once, by key range.  Rows alike in every column, of which there may be
more than a shard holds, are counted, not exchanged, and dealt out by their number.  Everything runs as DataFrame expressions.
(Harsh, Kale and Solomonik, "Histogram Sort with Sampling", SPAA 2019, describe the scheme of refined probes.)
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.llm.shared import cut, masked, row_key

#: First probes: this many top bits of the text hash, so 65,536 counts reach the driver.
TOP_BITS = 16
#: Probes in each refined cell, and in all of them together: so many counts reach the driver in one round.
CELLS, PROBES = 512, 1 << 20
SHIFT = 64 - TOP_BITS
OFFSET = 1 << (TOP_BITS - 1)
_COLS = ("_k1", "_k2", "_k3")


@dataclass(order=True)
class Splitter:
    """Rows with a key of at least ``key`` lie right of it; ``bytes`` and ``rows`` are the exact counts below it."""

    key: tuple[int, int, int]
    bytes: int = field(compare=False)
    rows: int = field(compare=False)


@dataclass(frozen=True)
class Tie:
    """Rows alike in every column, too many to lie on one side of a splitter; ``before`` are the rows below them."""

    key: tuple[int, int, int]
    before: int
    rows: int


@dataclass
class _Bin:
    top: int
    start: tuple[int, int, int]
    bytes: int
    rows: int
    lows: tuple[int, int, int]
    highs: tuple[int, int, int]
    bytes_before: int = 0
    rows_before: int = 0


def size_bytes(text):
    """UTF-8 bytes of the text, none for null, plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def keys(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list]:
    """df under masked names with its sort key and size, and the columns that give its names back.

    The third hash is of all other columns, nulls told apart, so rows of one key are alike in every column.
    """
    positive = F.lit((1 << 62) - 1).cast("long")
    masked_df, own, new = masked(df, "size", "shard", "slot")
    text, id_ = F.col(new[text_col]), F.col(new[id_col])
    rest = [c for n, c in new.items() if n not in (text_col, id_col)]
    keyed = masked_df.select(
        "*",
        F.xxhash64(text).alias("_k1"),
        F.xxhash64(F.lit("id"), id_).bitwiseAND(positive).alias("_k2"),
        row_key(masked_df, rest, 3).bitwiseAND(positive).alias("_k3"),
        size_bytes(text).alias("_size"),
    )
    return keyed.withColumn("_top", F.shiftright("_k1", SHIFT).cast("int")), own


def _counts() -> list:
    """Bytes and rows of a group of keys, and the least and greatest value of each key column."""
    ends = [f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in _COLS]
    return [F.sum("_size").alias("bytes"), F.count("*").alias("rows"), *ends]


def _bins(rows, start) -> list[_Bin]:
    return [_Bin(r["_top"], start(r), r["bytes"], r["rows"], tuple(r[f"lo{c}"] for c in _COLS), tuple(r[f"hi{c}"] for c in _COLS)) for r in rows]


def _cumulate(bins: list[_Bin], bytes_before: int, rows_before: int) -> list[_Bin]:
    bins.sort(key=lambda b: b.start)
    for b in bins:
        b.bytes_before, b.rows_before = bytes_before, rows_before
        bytes_before, rows_before = bytes_before + b.bytes, rows_before + b.rows
    return bins


def splitters(key_table: DataFrame, shards: int, ranges: int, tolerance: float) -> tuple[list[Splitter], list[Splitter], list[Tie]]:
    """Splitters between shards (by bytes; within a tie only their counts count), all splitters (with those of finer ranges, by bytes
    and rows alike, and those around ties), and the ties."""
    top = key_table.groupBy("_top").agg(*_counts()).collect()  # 2 ** TOP_BITS rows at most
    bins = _cumulate(_bins(top, lambda r: (r["_top"] << SHIFT, -1, -1)), 0, 0)
    all_bytes, all_rows = sum(b.bytes for b in bins), sum(b.rows for b in bins)
    if not all_rows:
        return [], [], []
    mean = all_bytes / all_rows
    n = shards * ranges

    def by_bytes(b, r):
        return b

    def by_work(b, r):
        return b + mean * r

    wanted = [("shard", j, by_bytes, j * all_bytes / shards, tolerance * all_bytes / shards) for j in range(1, shards)]
    wanted += [("range", j, by_work, j * 2 * all_bytes / n, all_bytes / n) for j in range(1, n)]
    found: dict[tuple[str, int], Splitter] = {}
    ties: dict[tuple, _Bin] = {}
    open_: dict[int, list] = {0: wanted}
    lists = {0: bins}
    while open_:
        cells: dict[tuple, tuple[_Bin, list]] = {}
        for at, targets in open_.items():
            own = lists[at]
            for w in targets:
                kind, j, measure, target, allowed = w
                i = max(bisect_right(own, target, key=lambda b: measure(b.bytes_before, b.rows_before)) - 1, 0)
                b = own[i]
                left = target - measure(b.bytes_before, b.rows_before)
                right = measure(b.bytes_before + b.bytes, b.rows_before + b.rows) - target
                if min(left, right) <= allowed or b.rows == 1:
                    if left <= right:
                        found[kind, j] = Splitter(b.start, b.bytes_before, b.rows_before)
                    elif i + 1 < len(own):
                        found[kind, j] = Splitter(own[i + 1].start, own[i + 1].bytes_before, own[i + 1].rows_before)
                    else:  # right of all rows of this cell: the next key that any row can have
                        found[kind, j] = Splitter((b.highs[0], b.highs[1], b.highs[2] + 1), b.bytes_before + b.bytes, b.rows_before + b.rows)
                elif b.lows == b.highs:  # rows alike in every column: split by their number
                    ties[b.lows] = b
                    if kind == "shard":
                        size = b.bytes // b.rows
                        m = min(max(round(left / size), 0), b.rows)
                        found[kind, j] = Splitter(b.lows, b.bytes_before + m * size, b.rows_before + m)
                else:
                    cells.setdefault(b.start, (b, []))[1].append(w)
        open_, lists = {}, {}
        if not cells:
            break
        table = []
        for at, (b, targets) in enumerate(cells.values()):
            col = next(i for i in range(3) if b.lows[i] != b.highs[i])
            width = (b.highs[col] - b.lows[col]) // max(min(CELLS, PROBES // len(cells)), 2) + 1
            table.append((at, b.top, col, b.lows[col], width, *b.lows, *b.highs))
            open_[at] = targets
        schema = "at int, _top int, col int, lo long, width long, " + ", ".join(f"{n}{c} long" for n in ("lo", "hi") for c in _COLS)
        # One row for each unresolved splitter at most: shards * ranges.
        probe = F.broadcast(key_table.sparkSession.createDataFrame(table, schema))
        inside = key_table.join(probe, "_top")
        for i, c in enumerate(_COLS):  # columns left of the split one are single values here
            inside = inside.where(F.when(F.col("col") >= i, F.col(c).between(F.col(f"lo{c}"), F.col(f"hi{c}"))).otherwise(True))
        inside = inside.select("at", "_top", "col", "lo", "width", *_COLS, "_size")
        value = F.when(F.col("col") == 0, F.col("_k1")).when(F.col("col") == 1, F.col("_k2")).otherwise(F.col("_k3"))
        counted = inside.withColumn("_value", value).withColumn("cell", F.expr("(_value - lo) div width")).groupBy("at", "_top", "cell").agg(*_counts())
        rows: dict[int, list] = {}
        for r in counted.collect():  # PROBES rows at most, or two for each unresolved splitter
            rows.setdefault(r["at"], []).append(r)
        for at, (b, _) in enumerate(cells.values()):
            col, lo, width = table[at][2], table[at][3], table[at][4]

            def start(r, col=col, lo=lo, width=width, b=b):
                if r["cell"] == 0:
                    return b.start
                return (*b.lows[:col], lo + r["cell"] * width, *(-1,) * (2 - col))

            lists[at] = _cumulate(_bins(rows[at], start), b.bytes_before, b.rows_before)
    cuts = [found["shard", j] for j in range(1, shards)]
    distinct = {s.key: s for s in found.values()}
    for key, b in ties.items():  # a tie is a range of its own
        distinct[key] = Splitter(key, b.bytes_before, b.rows_before)
        after = (key[0], key[1], key[2] + 1)
        distinct[after] = Splitter(after, b.bytes_before + b.bytes, b.rows_before + b.rows)
    return cuts, sorted(distinct.values()), [Tie(k, b.rows_before, b.rows) for k, b in ties.items()]


def _pieces(ties: list[Tie], cuts: list[int], most: int) -> list[tuple]:
    """(key, shard, first slot, rows) of the parts that the ties fall into: each in one shard, of ``most`` rows at most."""
    out = []
    starts = [0, *cuts]
    for t in ties:
        at, end = t.before, t.before + t.rows
        while at < end:
            k = bisect_right(cuts, at)
            stop = min(end, at + most, cuts[k] if k < len(cuts) else end)
            out.append((*t.key, k, at - starts[k], stop - at))
            at = stop
    return out


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges: int = 16, tolerance: float = 0.01) -> DataFrame:
    """df with ``size`` (UTF-8 bytes of the text plus 16), ``shard`` and ``slot`` (gapless from 0 within the shard).

    Shards differ from an equal share of all bytes by ``tolerance`` of a share on either side, or by one row.  Equal
    texts are neighbours in the order of shards and slots; a group of them, also of rows alike in every column, is split
    only where a shard's border would otherwise miss its tolerance.  Null texts are a group of size 16 each, null ids are ids
    like others.  One long row stays whole.  Existing columns of these names are replaced, others may have any name; an
    empty table stays empty.
    """
    spark = df.sparkSession
    keyed, own = keys(df, id_col, text_col)
    key_table = cut(keyed.select("_top", *_COLS, "_size"))
    cuts, every, ties = splitters(key_table, shards, ranges, tolerance)
    # Range r begins at the r-th splitter; the rows below it tell its shard and how many of them lie before it there.
    starts = [Splitter((-(1 << 63), -1, -1), 0, 0), *every]
    cut_rows = [c.rows for c in cuts]
    shard_rows = [0, *cut_rows]
    table = []
    for r, s in enumerate(starts):
        k = bisect_right(cut_rows, s.rows)
        table.append((r, k, s.rows - shard_rows[k]))
    by_range = F.broadcast(spark.createDataFrame(table, "_range int, _shard int, _before long"))  # shards * ranges rows
    inner: dict[int, list] = {}
    edges = []
    for s in every:
        if s.key[1:] == (-1, -1) and s.key[0] == (s.key[0] >> SHIFT) << SHIFT:
            edges.append(s.key[0] >> SHIFT)
        else:
            inner.setdefault(s.key[0] >> SHIFT, []).append(s.key)
    at, rows = 0, []
    edge_set = set(edges)
    for top in range(-OFFSET, OFFSET):
        at += top in edge_set
        rows.append((top, at, inner.get(top)))
        at += len(inner.get(top, ()))
    by_top = F.broadcast(spark.createDataFrame(rows, "_top int, _base int, _inner array<struct<a: long, b: long, c: long>>"))  # 2 ** TOP_BITS rows
    key = F.struct(F.col("_k1").alias("a"), F.col("_k2").alias("b"), F.col("_k3").alias("c"))
    free = keyed
    if ties:
        # As many rows as there are shards and ranges at most; a null text or id has a hash too.
        tied = F.broadcast(spark.createDataFrame([t.key for t in ties], "_k1 long, _k2 long, _k3 long"))
        free = keyed.join(tied, list(_COLS), "left_anti")
    ranged = free.join(by_top, "_top").withColumn("_range", F.col("_base") + F.coalesce(F.size(F.filter("_inner", lambda x: x <= key)), F.lit(0))).drop("_base", "_inner", "_top")
    order = Window.partitionBy("_range").orderBy(*_COLS)
    placed = ranged.withColumn("_row", F.row_number().over(order)).join(by_range, "_range")
    out = placed.select(*own, F.col("_size").alias("size"), F.col("_shard").alias("shard"), (F.col("_before") + F.col("_row") - 1).alias("slot"))
    if not ties:
        return out
    # One row of each tie is kept, and repeated as often as it was counted: in pieces, so that no task makes a whole tie.
    whole = F.struct(*[c for c in keyed.columns if c[0] == "c"]).alias("own")
    one = keyed.join(tied, list(_COLS), "left_semi").groupBy(*_COLS).agg(F.first(whole).alias("own"), F.first("_size").alias("_size"))
    n_all = key_table.count()
    pieces = _pieces(ties, cut_rows, max(n_all // (shards * ranges), 1))
    dealt = F.broadcast(spark.createDataFrame(pieces, "_k1 long, _k2 long, _k3 long, _shard int, _slot long, _rows long"))
    again = one.join(dealt, list(_COLS)).repartition("_shard", "_slot").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)))
    again = again.select("own.*", F.col("_size").alias("size"), F.col("_shard").alias("shard"), (F.col("_slot") + F.col("_i")).alias("slot"))
    return out.unionAll(again)
