"""Parquet table access for the provided star schema.

``load`` selects only the requested columns so the scan's ``ReadSchema`` is
pruned even before Catalyst's own column pruning runs, and any filter written
on the returned frame is pushed into the Parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str,
         columns: list[str] | None = None) -> DataFrame:
    """Read table ``name`` from ``sf_dir``; project to ``columns`` when given."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        missing = [c for c in columns if c.lower() not in {x.lower() for x in df.columns}]
        if missing:
            raise ValueError(f"{name}: missing columns {missing}")
        df = df.select(*columns)
    return df
