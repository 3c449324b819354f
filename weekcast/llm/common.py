"""Helpers shared by the text operators of this subpackage.

Texts reach Python as Arrow batches (``mapInArrow``) whose row count is kept small, so a
task holds a few hundred texts at a time whatever the table's size.  A *word* is a maximal
run of bytes that are not ASCII white space (``[^\\x20\\x09-\\x0D]+``) unless an operator
says otherwise; working on UTF-8 bytes is exact, because every byte of a multi-byte
character is above 0x7F.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.sources.sinks import materialize

__all__ = ["WORD_BYTES", "ALNUM_BYTES", "LOWER", "arrow_rows", "byte_texts", "bounded_batches",
           "fresh", "materialize", "private", "str_texts", "word_bounds"]

#: Rows of one Arrow batch of documents; bounds the memory of a Python worker.
BATCH_ROWS = 512

#: True for the bytes of words split at ASCII white space.
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[9, 10, 11, 12, 13, 32]] = False

#: True for ASCII letters and digits and for every byte of a non-ASCII character.
ALNUM_BYTES = np.zeros(256, dtype=bool)
ALNUM_BYTES[48:58] = ALNUM_BYTES[65:91] = ALNUM_BYTES[97:123] = ALNUM_BYTES[128:] = True

#: Maps the bytes A-Z to a-z and leaves the rest.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's default of 10,000 rows an Arrow batch; a set value stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def str_texts(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def word_bounds(buf: np.ndarray, is_word: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte buffer."""
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = is_word[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (any case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def private(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with, for the columns of an operator."""
    prefix, have = "_w_", [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in have):
        prefix = "_" + prefix
    return prefix


def arrow_rows(df: DataFrame, columns: list[str], fn, fields: list[T.StructField],
               keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (all by default) plus the columns that ``fn`` makes.

    ``fn(arrays)`` gets the Arrow arrays of ``columns`` for one batch and returns one list
    or array for each of ``fields``.  Rows stay in place: no shuffle.
    """
    bounded_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(keep + columns)])
    order = {c: i for i, c in enumerate(source.columns)}
    kept, asked = [order[c] for c in keep], [order[c] for c in columns]
    names = [*keep, *[f.name for f in fields]]
    arrow = [_ARROW[f.dataType.simpleString()] for f in fields]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = fn([batch.column(i) for i in asked])
            arrays = [batch.column(i) for i in kept]
            arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=t)
                       for x, t in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
          "string": pa.string(), "array<bigint>": pa.list_(pa.int64()),
          "array<string>": pa.list_(pa.string())}
