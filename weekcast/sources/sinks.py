"""File sinks and stage materialisation (K1, K4, K5).

``write_csv`` writes in parallel (one file per partition); a single output
file is an explicit opt-in because ``coalesce(1)`` funnels the whole result
through one task.  ``materialize`` replaces the write / rename / re-read
between stages: it writes Parquet under the shared checkpoint folder and
reads it back, which also cuts the lineage (executor loss then recomputes
from the stage, not from the raw inputs).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.functions.calendar import week_add, yearweek_str
from weekcast.session import checkpoint_dir


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True,
              single_file: bool = False, sep: str = ",") -> None:
    if mode not in ("overwrite", "append", "ignore", "error", "errorifexists"):
        raise ValueError(f"bad save mode {mode}")
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", str(header).lower()).option("sep", sep).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


#: Most rows of one file of a weekly table.
ROWS_PER_FILE = 5_000_000


def write_weeks(df: DataFrame, path: str, week_col: str = "yearweek", weeks=None,
                fmt: str = "parquet", **options) -> list[str]:
    """Write ``df`` into the table at ``path``, partitioned by week, so that a run can be
    repeated (K1, K4): the weeks in ``df`` replace those weeks of the table, weeks that the
    table lacks are added, and all others stay.

    ``weeks``: the weeks that this run delivers, if known.  Those without a row in ``df`` are
    removed from the table (and returned), and a row of any other week is an error before the
    table changes.  A job that fails leaves the table as it was: Spark's dynamic partition
    overwrite moves the new folders in when all tasks are done.  A large week is written by
    several tasks (AQE splits what the rebalance gathers), a small one as one file.
    """
    rows, spark = df, df.sparkSession
    known = [] if weeks is None else sorted({str(w) for w in weeks})
    if weeks is not None:
        given = F.col(week_col).cast("string")
        fail = F.raise_error(F.concat(F.lit("row of a week that is not delivered: "),
                                      F.coalesce(given, F.lit("NULL"))))
        rows = rows.withColumn(week_col, F.when(given.isin(known), F.col(week_col)).otherwise(
            fail.cast(df.schema[week_col].dataType)))
    before = {w: _files(spark, path, week_col, w) for w in known}
    (rows.hint("rebalance", week_col).write.mode("overwrite").format(fmt).options(**options)
         .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
         .partitionBy(week_col).save(path))
    # a week that was written has new files; one that kept its files had no row
    gone = [w for w in known if before[w] and before[w] == _files(spark, path, week_col, w)]
    for w in gone:
        folder, fs = _folder(spark, path, week_col, w)
        fs.delete(folder, True)
    return gone


def _folder(spark: SparkSession, path: str, week_col: str, week: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"{week_col}={week}")
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str, week_col: str, week: str) -> set[str]:
    """Names of the files of one week of a weekly table."""
    folder, fs = _folder(spark, path, week_col, week)
    return {f.getPath().getName() for f in fs.listStatus(folder)} if fs.exists(folder) else set()


def read_weeks(spark: SparkSession, path: str, week_col: str = "yearweek", since=None,
               until=None, last: int | None = None, fmt: str = "parquet", schema=None,
               **options) -> DataFrame:
    """The table that ``write_weeks`` wrote, weeks as strings, in the order of its columns.

    ``since`` / ``until`` bound the weeks; ``last`` keeps the table's last week and the
    ``last`` weeks before it (F15).  Every bound is a filter on the partition column, the last
    one by a one-row subquery: folders of other weeks are not opened.
    """
    reader = spark.read.format(fmt).options(**options)
    fields = (schema or reader.load(path).schema).fields
    typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name.lower() == week_col.lower()
                          else f for f in fields])
    table = spark.read.format(fmt).options(**options).schema(typed).load(path)
    if last is not None:
        start = table.agg(yearweek_str(F.max(F.col(week_col).cast("int"))).alias("w")) \
            .select(week_add("w", -last).alias("start"))
        since = start.scalar() if since is None else F.greatest(F.lit(since), start.scalar())
    out = table
    if since is not None:
        out = out.filter(F.col(week_col) >= (since if isinstance(since, Column) else F.lit(since)))
    if until is not None:
        out = out.filter(F.col(week_col) <= F.lit(until))
    return out


def bucketed(df: DataFrame, name: str, keys, buckets: int | None = None) -> DataFrame:
    """``df`` written once as a table of ``buckets`` buckets by ``keys``, sorted in each (K5).

    Frames bucketed alike on their join keys are joined, and aggregated by them, without an
    exchange, however often.  The default number of buckets is the session's number of
    shuffle partitions.  The files are in the shared stage folder, the table's name is fresh.
    Meant for keys whose rows are bounded (a series, a week of an item): a hot key stays in
    one bucket.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = stage_path(spark, name)
    table = os.path.basename(path).replace("-", "_")
    (df.repartition(n, *keys).write.format("parquet").mode("overwrite").option("path", path)
       .bucketBy(n, *keys).sortBy(*keys).saveAsTable(table))
    return spark.table(table)


def keyed(df: DataFrame, name: str, key: str, block_mb: int = 8) -> DataFrame:
    """``df`` written once in the order of ``key`` for point lookups.

    Rows are sorted by the key in range partitions, row groups are small (``block_mb``) and
    carry a Bloom filter of the key: a filter on the key (``joins.by_key``) opens the row
    groups whose range and Bloom filter admit it, and skips the others, instead of running
    the plan behind ``df`` again.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    (df.orderBy(key).write.mode("overwrite")
       .option(f"parquet.bloom.filter.enabled#{key}", "true")
       .option("parquet.block.size", str(block_mb << 20)).parquet(path))
    return spark.read.parquet(path)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a stage in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "stages", f"{name}-{uuid.uuid4().hex[:12]}")


def remove_stages(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Remove stage folders that nothing wrote to for so long; the number removed.

    Stages of running jobs must outlive their readers, so the age is the deployment's choice.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(os.path.join(checkpoint_dir(spark), "stages"))
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return 0
    limit = jvm.java.lang.System.currentTimeMillis() - older_than_hours * 3_600_000
    old = [f.getPath() for f in fs.listStatus(root) if f.getModificationTime() < limit]
    return sum(fs.delete(p, True) for p in old)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    The job runs at once, while the plan that reads the stage is still being built.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
