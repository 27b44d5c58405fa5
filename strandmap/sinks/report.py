"""CSV reports of a frame's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.operators.frame import Frame
from strandmap.sinks.output import Outputs


def cell(c, name: str):
    """One CSV cell: nulls are empty, quotes are doubled, cells with a comma, quote or line break are quoted."""
    s = c.cast("string")
    return F.coalesce(F.when(s.rlike('[,"\\r\\n]') | (s == ""), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s), F.lit(""))


def header(names: list[str]) -> str:
    quoted = ['"' + n.replace('"', '""') + '"' if any(x in n for x in ',"\r\n') else n for n in names]
    return ",".join(quoted) + "\n"


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[cell(F.col(f"`{n}`"), n) for n in df.columns]).alias("value"))


def write_csv(frame: Frame, path: str, outputs: Outputs | None = None, strict: bool = False, layout: str = "auto") -> str:
    """Write the mapped view with a header; an empty report is its header alone (nothing at all if ``strict``)."""
    df = frame.mapped()
    own = outputs or Outputs(df.sparkSession)
    head = "" if strict and df.isEmpty() else header(df.columns)
    try:
        own.write_lines(csv_lines(df), path, head, layout)
        if outputs is None:
            own.commit()
    except BaseException:
        if outputs is None:
            own.abort()
        raise
    return path
