"""Places and helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder is made and set as the checkpoint folder on a single machine (tests); on a cluster that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not place:
        current = sc._jsc.sc().getCheckpointDir()
        place = current.get() if current.isDefined() else None
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="strandmap-")
        spark.conf.set("spark.checkpoint.dir", place) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(place)
    return place


def own_folder(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, so that a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder, for wide rows that are read more than once."""
    folder = own_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def word_count(text) -> F.col:
    """Number of words of a text column, JVM-side and without regular expressions; null counts 0."""
    t = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    # Each run of spaces becomes a space and a mark; marks are counted.
    t = F.trim(F.replace(t, F.lit("\x01"), F.lit("x")))
    t = F.replace(F.replace(t, F.lit(" "), F.lit(" \x01")), F.lit("\x01 "), F.lit(""))
    marks = F.transform(F.array(t), lambda x: F.when(x == "", 0).otherwise(F.octet_length(x) - F.octet_length(F.replace(x, F.lit("\x01"), F.lit(""))) + 1))
    return F.element_at(marks, 1).cast("long")


def put(uri: str, data: bytes) -> None:
    """Write a file in a folder of `own_folder` (its scheme must be one that pyarrow opens); used on executors."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)


def get(uri: str) -> bytes:
    """Read a file of `put`."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def masked(df: DataFrame, *replaced: str, **helpers: Column) -> tuple[DataFrame, list[Column], dict[str, str]]:
    """df with its columns renamed to c0, c1, ... and further columns ``helpers``, so that none of these can clash with df's own.

    Columns named in ``replaced`` are left out.  Gives the frame, the columns that bear their own names again, and the new name of each.
    """
    names = df.drop(*replaced).columns
    new = {n: f"c{i}" for i, n in enumerate(names)}
    out = df.select(*[F.col(quoted(n)).alias(c) for n, c in new.items()], *[c.alias(n) for n, c in helpers.items()])
    return out, [F.col(c).alias(n) for n, c in new.items()], new


def row_key(df: DataFrame, columns: list[str], seed: int) -> Column:
    """64-bit hash of all columns of a row that tells nulls from each other's places; nested ones are hashed as text."""
    kinds = dict(df.dtypes)
    flat = [F.to_json(F.struct(c)) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in columns]
    nulls = [F.isnull(c) for c in columns]
    return F.xxhash64(F.lit(seed), *nulls, *flat)


def quoted(name: str) -> str:
    """A column name as a reference: dots and blanks in it mean nothing."""
    return "`" + name.replace("`", "``") + "`"


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def schema_with(df: DataFrame, **more: str) -> T.StructType:
    """The schema of df and further nullable columns, given as name="type"."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in more.items())])


#: Bytes of one Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, work: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(work, schema)`` whose Python workers give memory back at the end of a task, in batches of BATCH_BYTES.

    Workers live on between tasks beside the executor's heap; what allocators keep would count against it.  Batches of
    10,000 whole texts would be large, so the session's limit in bytes is lowered unless it has been set.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) == "67108864b":  # Spark's default
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def lean(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(ctypes.util.find_library("c") or None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(lean, schema)
