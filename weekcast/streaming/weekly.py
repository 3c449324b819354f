"""Weekly sales as an incremental Structured Streaming aggregation.

The batch weekly aggregation, fed by new line-item files as they arrive, in
any order: the line stream is joined to the static dimension tables
(stream-static joins, no state for the join), then summed per (region,
brand, ISO week) with the aggregate's state kept in the checkpoint folder, so
a restarted or failed query resumes from its last committed batch.

Line files are not ordered by ship date, so no watermark closes a week: a
late line always counts.  The state holds one sum per (region, brand, week),
which the calendar bounds.  Every micro-batch writes the sums it changed
under its own batch number; ``current_weekly_sales`` reads the latest of each
key, which equals the batch aggregate of all files seen so far.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weekcast.functions.calendar import yearweek
from weekcast.plans.datasets import customer_geo
from weekcast.session import checkpoint_dir
from weekcast.sources.tables import load

KEYS = ["regionid", "product", "week_start"]


def weekly_sales_stream(spark: SparkSession, lineitem_dir: str, dims_dir: str) -> DataFrame:
    """Streaming DataFrame of (regionid, product, week_start, yearweek, qty)."""
    schema = spark.read.parquet(lineitem_dir).schema
    li = (spark.readStream.schema(schema).parquet(lineitem_dir)
          .select("l_orderkey", "l_partkey", "l_quantity",
                  F.col("l_shipdate").cast("timestamp").alias("ship_ts")))
    o = load(spark, dims_dir, "orders", ["o_orderkey", "o_custkey"])
    og = o.join(customer_geo(spark, dims_dir), o.o_custkey == F.col("c_custkey"))
    p = load(spark, dims_dir, "part", ["p_partkey", "p_brand"])
    f = li.join(og, li.l_orderkey == og.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    w = F.window("ship_ts", "7 days", startTime="4 days")  # epoch is a Thursday: Monday starts
    agg = (f.groupBy(F.col("r_name").alias("regionid"), F.col("p_brand").alias("product"), w)
            .agg(F.sum("l_quantity").alias("qty")))
    return agg.select("regionid", "product", F.col("window.start").cast("date").alias("week_start"),
                      yearweek(F.col("window.start")).alias("yearweek"), "qty")


def start_weekly_sales(spark: SparkSession, lineitem_dir: str, dims_dir: str, out_dir: str,
                       name: str = "weekly_sales", trigger_once: bool = False) -> StreamingQuery:
    """Run the stream; each micro-batch overwrites ``out_dir/batch=<n>`` with the sums it
    changed, so a batch that is run again after a failure leaves no copy."""
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={number}"))

    writer = (weekly_sales_stream(spark, lineitem_dir, dims_dir).writeStream
              .outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if trigger_once else writer
    return writer.start()


def current_weekly_sales(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest sum of every key."""
    rows = spark.read.parquet(out_dir)
    latest = rows.groupBy(*KEYS, "yearweek").agg(F.max_by("qty", "batch").alias("qty"))
    return latest.select("regionid", "product", "yearweek", "qty")
