"""Line handling of fetched pages (re-aim of the single-page fetch that reads a page's
lines and joins them with newlines).

The fetch itself needs a network and runs on one machine, so it is not
rebuilt; what remains is line splitting and re-joining, applied to the whole
text of every row of a page table as a column expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise_lines(df: DataFrame, col: str = "html", out: str = "text") -> DataFrame:
    """Split ``col`` on CR/LF line breaks and re-join the lines with ``\\n``."""
    lines = F.split(F.col(col), "\r?\n", -1)
    return df.withColumn(out, F.array_join(lines, "\n")).withColumn("n_lines", F.size(lines))


def explode_lines(df: DataFrame, col: str = "html", keys=("page_id",)) -> DataFrame:
    """One row per line with its 0-based position."""
    return df.select(*keys, F.posexplode(F.split(F.col(col), "\r?\n", -1)).alias("line_no",
                                                                                   "line"))
