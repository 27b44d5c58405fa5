"""Outputs of a program: written beside their destinations, moved there on commit, removed on abort.

All file work goes through Hadoop's file systems, so destinations may be local or in any store Spark can write.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from strandmap.errors import ReadFault
from strandmap.sources.paths import CLOUD

#: Up to this many bytes the parts of an output are joined into one file; larger ones stay a folder of parts.
ONE_FILE = 1 << 30


def target(path: str) -> str:
    scheme, sep, rest = path.partition("://")
    return f"{CLOUD.get(scheme, scheme)}://{rest}" if sep else path


class Outputs:
    def __init__(self, spark: SparkSession):
        self.spark, self._staged = spark, []
        self._jvm = spark.sparkContext._jvm

    def _path(self, path: str) -> tuple[JavaObject, JavaObject]:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write_lines(self, df: DataFrame, path: str, head: str = "", layout: str = "auto", tail: str = "", one_file: int = ONE_FILE) -> None:
        """Write column ``value``; ``layout`` is one ``file``, a ``folder`` of parts, or ``auto``: a file up to ``one_file`` bytes.

        ``head`` starts a file, ``tail`` ends it; a folder has the head in ``_header``.
        """
        dest = target(path)
        staged = f"{dest}.staged-{uuid.uuid4().hex}"
        self._staged.append((staged, dest))
        df.write.text(staged)
        folder, fs = self._path(staged)
        if layout == "folder":
            self._head(staged, fs, head)
            return
        parts = sorted((s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
        if layout == "auto" and sum(s.getLen() for s in parts) > one_file:
            self._head(staged, fs, head)
            return
        whole, _ = self._path(f"{staged}.one")
        fs.setWriteChecksum(False)  # else a local file gets a hidden companion
        out = fs.create(whole, True)
        fs.setWriteChecksum(True)
        try:
            if head:
                out.write(bytearray(head.encode()))
            for s in parts:
                if s.getLen():
                    source = fs.open(s.getPath())
                    try:
                        self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                    finally:
                        source.close()
            if tail:
                out.write(bytearray(tail.encode()))
        finally:
            out.close()
        fs.delete(folder, True)
        fs.rename(whole, folder)

    def _head(self, folder: str, fs: JavaObject, head: str) -> None:
        """In a folder the head stands in a file that readers of the parts pass over."""
        if head:
            out = fs.create(self._path(f"{folder}/_header")[0], True)
            out.write(bytearray(head.encode()))
            out.close()

    def commit(self) -> None:
        """Move everything to its destination, replacing what is there."""
        for staged, dest in self._staged:
            s, fs = self._path(staged)
            d, _ = self._path(dest)
            if fs.exists(d):
                fs.delete(d, True)
            if d.getParent() is not None and not fs.exists(d.getParent()):
                fs.mkdirs(d.getParent())
            if not fs.rename(s, d):
                raise ReadFault(f"'{dest}' can't be written")
        self._staged = []

    def abort(self) -> None:
        for staged, _ in self._staged:
            for name in (staged, f"{staged}.one"):
                p, fs = self._path(name)
                if fs.exists(p):
                    fs.delete(p, True)
        self._staged = []
