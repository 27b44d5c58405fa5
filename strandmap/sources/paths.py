"""Path rules, cloud credentials and small-file reading."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from strandmap.errors import InvalidArgument, InvalidExtension, NotAFile, ReadFault, SourceNotFound

# URI schemes of object stores, by the Hadoop connector that reads them; others are passed as they are.
CLOUD = {"s3": "s3a", "s3a": "s3a", "gs": "gs", "gcs": "gs", "az": "abfss", "azure": "abfss", "abfs": "abfs", "abfss": "abfss", "adl": "adl"}
SHARED = {"hdfs", "viewfs", "file", "webhdfs"}

FileReader = Callable[[str], str]


def checked(path: str, extension: str | None = None, base: str | None = None) -> str:
    """The path to read: cloud paths by their connector's scheme, local ones if they are files (relative ones below ``base``)."""
    if extension and os.path.splitext(urlsplit(path).path)[1].lower() != f".{extension}":
        raise InvalidExtension(f"'{path}' must end with .{extension}")
    scheme = urlsplit(path).scheme if "://" in path else ""
    if scheme in CLOUD:
        return CLOUD[scheme] + path[len(scheme) :]
    if scheme in SHARED:
        return path
    if scheme:
        raise InvalidArgument(f"unknown scheme '{scheme}' in '{path}'")
    full = os.path.join(base or "", path)
    if not os.path.exists(full):
        raise SourceNotFound(f"no file '{path}'")
    if not os.path.isfile(full):
        raise NotAFile(f"'{path}' is not a file")
    return os.path.abspath(full)


def is_local(path: str) -> bool:
    return "://" not in path


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A small file as text: local ones directly, others by Spark."""
    try:
        if is_local(path):
            with open(path, encoding="utf-8") as f:
                return f.read()
        session = spark or SparkSession.getActiveSession()
        return session.read.text(path, wholetext=True).first()[0]
    except (OSError, UnicodeDecodeError) as e:
        raise ReadFault(f"'{path}' can't be read: {e}") from e


def configure(spark: SparkSession, options: dict[str, str]) -> None:
    """Storage credentials for Hadoop's connectors; without any the environment's are used."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in options.items():
        conf.set(k.removeprefix("spark.hadoop."), v)
