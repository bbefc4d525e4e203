"""Report export.

The original front ends turned a fetched result into a one-sheet spreadsheet
in memory. Here a report is written by the executors: every task writes its
own part file with a header row, so nothing passes through the driver. Only a
top-k report may ask for a single output file.

An export is offered only for a report that has rows. The rows are counted by
the job that writes them, into a folder beside the target; then the folder
takes the target's name, or, if it holds no row, is discarded. No second scan
tells whether there is anything to write, and a failed job leaves no target.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meterwise.params import LIMIT_MAX

FORMATS = ("csv", "parquet", "json")


def write_report(df: DataFrame, path: str, fmt: str = "csv", single_file_rows: int | None = None,
                 overwrite: bool = False) -> str | None:
    """Write ``df`` to ``path``; returns ``path``, or None if ``df`` has no row:
    then nothing is written (and with ``overwrite`` what was there stays).

    ``single_file_rows`` is the row limit of a top-k report: at most that many
    rows pass through one task into one file; a larger report is refused an
    output of this kind. A path that exists is an error unless ``overwrite``.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {fmt!r}")
    out = df
    if single_file_rows is not None:
        if not 1 <= single_file_rows <= LIMIT_MAX:
            raise ValueError(f"a single file holds at most {LIMIT_MAX} rows")
        out = df.limit(single_file_rows).coalesce(1)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.exists(target) and not overwrite:
        raise FileExistsError(f"{path} already exists")
    beside = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    rows = Observation()
    writer = out.observe(rows, F.count(F.lit(1)).alias("n")).write
    if fmt == "csv":
        writer = writer.option("header", True)
    getattr(writer, fmt)(beside)
    written = spark._jvm.org.apache.hadoop.fs.Path(beside)
    if not rows.get["n"]:
        files.delete(written, True)
        return None
    if overwrite:
        files.delete(target, True)
    if not files.rename(written, target):
        raise OSError(f"the report lies at {beside}: it could not be renamed to {path}")
    return path
