"""JDBC read / write.

Connection details always come from the caller; nothing is hard-coded.  A
read with a numeric partition column is split into ``num_partitions``
parallel range queries instead of one connection pulling the whole table;
writes go out with one connection per partition and a bounded batch size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DRIVERS = {
    "oracle": "oracle.jdbc.OracleDriver",
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}


def driver_for(url: str) -> str | None:
    """JDBC driver class inferred from a ``jdbc:<vendor>:`` URL."""
    parts = url.split(":")
    return _DRIVERS.get(parts[1]) if len(parts) > 1 and parts[0] == "jdbc" else None


def read_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 partition_column: str | None = None, lower_bound=None, upper_bound=None,
                 num_partitions: int | None = None, fetch_size: int = 10000,
                 single_connection: bool = False, **extra) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``; validates the partitioned-read set.

    Without a partition column the whole table comes through one connection and
    one task, which must be asked for with ``single_connection``.
    """
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    drv = extra.pop("driver", None) or driver_for(url)
    if drv:
        opts["driver"] = drv
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    part = [partition_column, lower_bound, upper_bound, num_partitions]
    if any(p is not None for p in part):
        if any(p is None for p in part):
            raise ValueError("partitioned JDBC read needs partition_column, lower_bound, "
                             "upper_bound and num_partitions together")
        if single_connection:
            raise ValueError("single_connection excludes a partitioned read")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    elif not single_connection:
        raise ValueError("give partition_column, lower_bound, upper_bound and num_partitions, "
                         "or single_connection=True for a small table")
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_table(spark: SparkSession, url: str, table: str, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**read_options(url, table, **kw)).load()


def write_options(url: str, table: str, user: str | None = None, password: str | None = None,
                  batch_size: int = 10000, truncate: bool = True, **extra) -> dict[str, str]:
    opts = {"url": url, "dbtable": table, "batchsize": str(batch_size),
            "truncate": str(truncate).lower()}
    drv = extra.pop("driver", None) or driver_for(url)
    if drv:
        opts["driver"] = drv
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def write_table(df: DataFrame, url: str, table: str, mode: str = "overwrite",
                max_connections: int | None = None, **kw) -> None:
    """Write ``df`` to a JDBC table; ``max_connections`` caps parallel writers."""
    if mode not in ("overwrite", "append", "ignore", "error", "errorifexists"):
        raise ValueError(f"bad save mode {mode}")
    out = df.coalesce(max_connections) if max_connections else df
    out.write.format("jdbc").options(**write_options(url, table, **kw)).mode(mode).save()
