"""Stage tables whose shuffle files go as soon as they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import session

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For rows of megabytes: row groups and pages of a few rows, so that neither reader nor writer holds dozens of them, and
#: no second compression of compressed bytes, whose buffers lie outside the heap.
LARGE_ROWS = {
    "compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20),
    "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8",
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8",
}


def stage(df: DataFrame, name: str = "stage", large_rows: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back; nobody needs its shuffles afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        if not large_rows:
            return session.stage(df, name)
        path = session.stage_path(df.sparkSession, name)
        df.write.options(**LARGE_ROWS).parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        if before is None:
            conf.unset(CLEAN)
        else:
            conf.set(CLEAN, before)
