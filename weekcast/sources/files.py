"""CSV ingest with declared schemas, typed views and a reject table.

The raw layer reads every column as STRING (no ``inferSchema`` pass over the
data) and binds the declared columns to the header by name, in any case and order.  ``typed`` then converts with
``try_cast`` so a malformed number becomes NULL instead of failing the job
under ANSI mode, and ``rejects`` lists the rows whose conversion failed or
whose week key is malformed, so bad input is visible rather than silently
dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.functions.calendar import valid_yearweek

# Typed column layouts of the datasets the workload reads (see FIXTURES.md).
SCHEMAS: dict[str, dict[str, str]] = {
    "product_volume": {"REGIONID": "string", "PRODUCTGROUP": "string", "YEARWEEK": "string",
                       "VOLUME": "double"},
    "channel_seasonality": {"REGIONID": "string", "PRODUCTGROUP": "string", "PRODUCT": "string",
                            "YEARWEEK": "string", "YEAR": "int", "WEEK": "int", "QTY": "double"},
    "sellout": {"REGIONID": "string", "PRODUCT": "string", "YEARWEEK": "string", "QTY": "double"},
    "region_master": {"REGIONID": "string", "REGIONNAME": "string"},
    "actual_sales": {"REGIONSEG1": "string", "PRODUCTSEG1": "string", "PRODUCTSEG2": "string",
                     "REGIONSEG2": "string", "REGIONSEG3": "string", "PRODUCTSEG3": "string",
                     "YEARWEEK": "string", "YEAR": "int", "WEEK": "int", "QTY": "double"},
    "promotion": {"REGIONSEG": "string", "SALESID": "string", "PRODUCTGROUP": "string",
                  "ITEM": "string", "TARGETWEEK": "string", "PLANWEEK": "string",
                  "MAP_PRICE": "double", "IR": "double", "PMAP": "double", "PMAP10": "double",
                  "PRO_PERCENT": "double"},
    "promotion_data": {"REGIONID": "string", "PRODUCTGROUP": "string", "YEARWEEK": "string",
                       "PRICE": "double", "DISCOUNT": "double"},
    "decision_tree_input": {"REGIONID": "string", "PRODUCT": "string", "ITEM": "string",
                            "YEARWEEK": "int", "HOLIDAY": "string", "PROMOTION": "string",
                            "PRO_PERCENT": "double", "QTY": "double"},
    "parameters": {"CATEGORY": "string", "NAME": "string", "VALUE": "string"},
}

_KNOWN_OPTIONS = {"header", "sep", "delimiter", "encoding", "quote", "escape", "mode",
                  "nullValue", "emptyValue", "comment", "multiLine", "dateFormat",
                  "timestampFormat", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace",
                  "columnNameOfCorruptRecord", "lineSep"}


def string_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


#: Raw line of a row that has too few or too many fields (``load_csv(keep_corrupt=True)``).
CORRUPT = "_corrupt_record"


def load_csv(spark: SparkSession, path: str, columns, sep: str = ",", header: bool = True,
             keep_corrupt: bool = False, **options) -> DataFrame:
    """Raw all-STRING CSV scan of ``path`` (any Hadoop FS URI: file, hdfs, s3a...).

    ``columns`` is the list of columns wanted (or a key of ``SCHEMAS``).  With
    a header they are found by name, in any case; other columns of the file
    are left out and a missing one is an error.  Files of one path must agree
    in their header: a file with another one fails instead of being read into
    the wrong columns.  Without a header the columns go by position.

    A row with too few fields gets NULLs and one with too many loses the rest;
    with ``keep_corrupt`` the column ``CORRUPT`` holds the line of such rows,
    for ``rejects``.  Unknown reader options are rejected instead of being
    silently ignored (a misspelt ``Delimeter`` used to fall back to comma, S3).
    """
    if isinstance(columns, str):
        columns = list(SCHEMAS[columns])
    bad = [k for k in options if k not in _KNOWN_OPTIONS]
    if bad:
        raise ValueError(f"unknown CSV options {bad}")

    def reader():
        r = spark.read.option("mode", "PERMISSIVE").option("sep", sep).option("header", header)
        for k, v in options.items():
            r = r.option(k, v)
        return r

    names = list(columns)
    if header:  # one line of one file is read for the names
        names = reader().option("inferSchema", "false").csv(path).columns
    schema = string_schema([*names, CORRUPT] if keep_corrupt else names)
    r = reader().schema(schema).option("enforceSchema", not header)
    if keep_corrupt:  # fields are counted only when all columns are parsed
        r = r.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", "false")
    df = r.csv(path)
    require_columns(df, columns)
    own = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{own[c.lower()]}`").alias(c) for c in columns],
                     *([CORRUPT] if keep_corrupt else []))


def require_columns(df: DataFrame, names) -> None:
    """Fail fast on missing columns (case-insensitive), instead of index -1."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def typed(df: DataFrame, types: dict[str, str] | str) -> DataFrame:
    """Cast the raw string columns to their declared types with ``try_cast``."""
    if isinstance(types, str):
        types = SCHEMAS[types]
    require_columns(df, types)
    declared = {c.lower() for c in types}
    return df.select(*[
        (F.col(c).try_cast(t) if t != "string" else F.col(c)).alias(c) for c, t in types.items()
    ] + [c for c in df.columns if c.lower() not in declared])


def rejects(raw: DataFrame, types: dict[str, str] | str, week_cols=("YEARWEEK",)) -> DataFrame:
    """Rows of ``raw`` that do not convert cleanly, with a reason column: malformed numbers,
    keys that name no week, and (if ``raw`` has ``CORRUPT``) rows of the wrong field count."""
    if isinstance(types, str):
        types = SCHEMAS[types]
    reasons = []
    for c, t in types.items():
        if t != "string":
            reasons.append(F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(),
                                  F.lit(f"bad {t} in {c}")))
    for c in week_cols:
        if c in types:
            reasons.append(F.when(F.col(c).isNotNull() & ~valid_yearweek(c),
                                  F.lit(f"bad week key in {c}")))
    if CORRUPT in raw.columns:
        reasons.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("wrong number of fields")))
    reason = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    return raw.withColumn("_reject_reason", reason).filter(F.col("_reject_reason") != "")


def from_rows(spark: SparkSession, rows, schema: T.StructType | str) -> DataFrame:
    """In-memory rows with an explicit schema."""
    return spark.createDataFrame(rows, schema)
