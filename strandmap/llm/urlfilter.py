"""URL filter over a sorted digest array.

Rules are stored as an array of sorted 64-bit xxhash keys and, in the same order, their full strings.  The two files
are memory-mapped, probed by vectorised binary search, and every hit is confirmed against the stored string, so that a
digest collision never decides.  `judge` takes a list of rules and ships its array to every executor; `judge_table`
takes a table of rules of any size, of which each task has the array of a range of hashes.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.llm.shared import map_arrow, own_folder, partitions, schema_with

Rule = tuple[str, str, str]
"""(host, path prefix, verdict); written ``host + path``, for example ``example.net/en/``."""


def host_col(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_col(url):
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def arrays(verdicts: dict[str, str]) -> tuple[bytes, bytes]:
    """The digest array and the strings (their number and offsets first) in digest order, of rule strings with their verdicts."""
    rows = sorted((xxhash.xxh64_intdigest(s.encode()), s, v) for s, v in verdicts.items())
    texts = [f"{v}\t{s}".encode() for _, s, v in rows]
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.array([k for k, _, _ in rows], np.uint64).tobytes(), np.int64(len(rows)).tobytes() + offsets.tobytes() + b"".join(texts)


def build(rules: Sequence[Rule], folder: str, name: str) -> tuple[str, str]:
    """Write both files of `arrays` to a local folder; gives their paths.  The last of equal rules counts."""
    paths = os.path.join(folder, f"{name}.keys"), os.path.join(folder, f"{name}.text")
    for path, data in zip(paths, arrays({h + p: v for h, p, v in rules}), strict=True):
        with open(path, "wb") as f:
            f.write(data)
    return paths


def _ship(spark: SparkSession, rules: Sequence[Rule]) -> tuple[str, str]:
    """Put both files of `arrays` into the shared folder, from where each executor fetches them once; gives their names there."""
    folder = own_folder(spark, "rules")
    jvm, names = spark.sparkContext._jvm, []
    for kind, data in zip(("keys", "text"), arrays({h + p: v for h, p, v in rules}), strict=True):
        name = f"{folder.rpartition('/')[2]}.{kind}"
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        try:
            for lo in range(0, len(data), 1 << 20):
                out.write(bytearray(data[lo : lo + (1 << 20)]))
        finally:
            out.close()
        spark.sparkContext.addFile(f"{folder}/{name}")
        names.append(name)
    return names[0], names[1]


class DigestArray:
    """Memory-mapped view of the files of `build`."""

    def __init__(self, keys: str, text: str):
        self.keys = np.memmap(keys, np.uint64, "r") if os.path.getsize(keys) else np.zeros(0, np.uint64)
        self.raw = np.memmap(text, np.uint8, "r")
        n = int(self.raw[:8].view(np.int64)[0])
        self.offsets = self.raw[8 : 8 + 8 * (n + 1)].view(np.int64)
        self.base = 8 + 8 * (n + 1)

    def stored(self, i: int) -> tuple[str, str]:
        """(verdict, full string) of entry i."""
        v, _, s = bytes(self.raw[self.base + self.offsets[i] : self.base + self.offsets[i + 1]]).decode().partition("\t")
        return v, s

    def find(self, strings: list[str]) -> list[int]:
        """Entry of each string, or -1."""
        if not len(self.keys) or not strings:
            return [-1] * len(strings)
        digests = np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), np.uint64, len(strings))
        lo = np.searchsorted(self.keys, digests)
        out = [-1] * len(strings)
        for j in np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == digests):
            i = int(lo[j])
            while i < len(self.keys) and self.keys[i] == digests[j]:  # several strings may share a digest
                if self.stored(i)[1] == strings[j]:
                    out[j] = i
                    break
                i += 1
        return out


def probes(host: str, path: str, lengths: Sequence[int], labels: int) -> list[str]:
    """Every rule string that could fit, longest first; of equally long ones the longer host first.

    Rules have hosts of so many ``labels`` at most, and paths of these ``lengths``.
    """
    own = host.rsplit(".", labels)[-labels:] if labels else []
    hosts = [".".join(own[i:]) for i in range(len(own))]
    found = [(len(h) + n, len(h), h + path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [s for _, _, s in sorted(found, key=lambda x: (-x[0], -x[1]))]


def judge(urls: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """urls with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest rule string
    wins, of equals the longer host; of equal rules the last counts.  Where no rule fits, rule is null and the verdict is
    ``default``: the array doesn't hold the url.  Null urls and urls without ``://`` have empty host and path.  Long urls
    are judged whole, repeated ones each; an empty table stays empty, an empty list of rules fits nothing.
    """
    df = urls.drop("host", "path", "rule", "verdict")
    df = df.withColumn("host", host_col(F.col(url))).withColumn("path", path_col(F.col(url)))
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    labels = max((h.count(".") + 1 for h, _, _ in rules), default=0)
    keys, texts = _ship(urls.sparkSession, rules)
    names = df.columns

    def work(batches):
        array = DigestArray(SparkFiles.get(keys), SparkFiles.get(texts))
        for x in batches:
            hosts, paths = x.column(names.index("host")).to_pylist(), x.column(names.index("path")).to_pylist()
            asked, owner = [], []
            for j, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                for s in probes(h, p, lengths, labels):
                    asked.append(s)
                    owner.append(j)
            rule: list[str | None] = [None] * len(hosts)
            verdict = [default] * len(hosts)
            for j, s, i in zip(owner, asked, array.find(asked), strict=True):
                if i >= 0 and rule[j] is None:
                    verdict[j], rule[j] = array.stored(i)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*names, "rule", "verdict"])

    return map_arrow(df, work, schema_with(df, rule="string", verdict="string"))


def _probe_ranges(batches):
    """Rows (range, verdict, rule) sorted by range, in each the rules (with a verdict) first, then the strings asked -> those that are rules."""
    with tempfile.TemporaryDirectory() as scratch:  # this task's own; mapped files needn't outlive it
        array, own, verdicts = None, None, {}
        for x in batches:
            found: list[tuple[str, str]] = []
            asked: list[str] = []

            def answer(array, asked, found):
                found += [(v, s) for v, s in (array.stored(i) for i in array.find(asked) if i >= 0)]
                asked.clear()

            for r, v, s in zip(*(x[c].to_pylist() for c in ("range", "verdict", "rule")), strict=True):
                if r != own:
                    if array is not None:
                        answer(array, asked, found)
                    asked.clear()
                    array, own, verdicts = None, r, {}
                if v is not None:
                    verdicts[s] = v
                    continue
                if array is None:
                    array = DigestArray(*build([("", k, w) for k, w in verdicts.items()], scratch, str(r)))
                asked.append(s)
            if array is not None:
                answer(array, asked, found)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in found], pa.string()) for i in (1, 0)], ["rule", "verdict"])


def judge_table(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """`judge` by a table ``rules(host, path, verdict)`` of any size: no executor has all of it.

    Rules and the distinct strings that urls ask for are dealt into ``ranges`` ranges of a hash (as many as there are shuffle
    partitions); a task sorts the digests of a range, maps them and probes them.  Of equal rules the greatest verdict counts;
    those with nulls are left out.
    """
    df = urls.drop("host", "path", "rule", "verdict")
    df = df.withColumn("host", host_col(F.col(url))).withColumn("path", path_col(F.col(url)))
    known = rules.where("host is not null and path is not null and verdict is not null")
    shape = known.agg(F.collect_set(F.length("path")).alias("lengths"), F.max(F.length("host") - F.length(F.replace("host", F.lit("."))) + 1).alias("labels")).first()
    lengths, most = sorted(shape["lengths"], reverse=True), shape["labels"] or 1
    labels = F.split("host", r"\.")
    own = F.slice(labels, F.greatest(F.size(labels) - most + 1, F.lit(1)), F.lit(most))
    hosts = F.transform(F.sequence(F.lit(1), F.size(own)), lambda i: F.array_join(F.slice(own, i, F.size(own)), "."))
    asked = df.select("host", "path").distinct().withColumn("h", F.explode(hosts))
    heads = [F.when(F.length("path") >= n, F.expr(f"substring(path, 1, {n})")) for n in lengths]
    asked = asked.select("host", "path", "h", F.explode(F.array(*heads).cast("array<string>")).alias("head")).where("head is not null")
    asked = asked.select("host", "path", F.length("h").alias("n_host"), F.concat("h", "head").alias("rule"))
    n = ranges or partitions(df)
    unique = known.groupBy(F.concat("host", "path").alias("rule")).agg(F.max("verdict").alias("verdict"))
    both = unique.select("rule", "verdict").unionAll(asked.select("rule", F.lit(None).cast("string").alias("verdict")).distinct())
    both = both.select(_range(n).alias("range"), "verdict", "rule").repartition(n, "range").sortWithinPartitions("range", F.col("verdict").asc_nulls_last())
    found = map_arrow(both, _probe_ranges, "rule string, verdict string")
    best = asked.join(found, "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "n_host")).alias("best"))
    return df.join(best, ["host", "path"], "left").select(*df.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _range(n: int) -> Column:
    return F.pmod(F.xxhash64("rule"), F.lit(n)).cast("int")
