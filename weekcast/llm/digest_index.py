"""Exact dedup against a persistent digest index (operator 11).

The index is a folder of digests, bucketed and sorted by digest: (digest, keep_id, delivery),
one row for each different text ever delivered.  A delivery of documents is deduplicated in
three steps.

1. Its digests (SHA-256 of the whole text in UTF-8) are pre-aggregated: one row a digest, with
   the largest id, which stays.  Copies collapse before the shuffle.
2. A sort-merge anti-join against the index leaves the digests that it lacks.  The index is
   read by bucket, so it is never shuffled, however large it grew; only the delivery is.
3. Those are appended, one sorted file a bucket.  What an earlier delivery brought stays.

Verdicts join each row to its digest's entry.  The digest of a text with very many copies is a
hot key there, and ``tiles.tiled_join`` splits it.

A delivery that runs again, also after a failure, finds its own digests in the index under its
own name and gives the same verdicts; the anti-join keeps it from adding them twice.  One
writer at a time.  ``compact`` merges the files of many deliveries.

Defined results: a null text counts as empty, and all empty texts are equal; a null id is
smaller than any other; of rows that repeat id and text one stays; an empty table gives an
empty table and appends nothing; extra columns are ignored, or carried by ``new_documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.llm.common import materialize, private
from weekcast.operators.tiles import tiled_join


def digest_of(text):
    """SHA-256 (32 bytes) of a text column; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """A digest index in the folder ``path`` of a shared file system."""

    def __init__(self, spark: SparkSession, path: str, data: str, buckets: int, id_type: str):
        self.spark, self.path, self.buckets, self.id_type = spark, path, buckets, id_type
        self._attach(data)

    @classmethod
    def create(cls, spark: SparkSession, path: str, id_type: str = "bigint",
               buckets: int | None = None) -> DigestIndex:
        """A new, empty index; the number of buckets stays (default: the session's number of
        shuffle partitions)."""
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        index = cls(spark, path, f"data-{uuid.uuid4().hex[:12]}", n, id_type)
        index._write_spec()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        """An index that an earlier session wrote."""
        spec = spark.read.parquet(f"{path}/spec").first()
        return cls(spark, path, spec["data"], spec["buckets"], spec["id_type"])

    def _write_spec(self) -> None:
        self.spark.createDataFrame([(self.data, self.buckets, self.id_type)],
                                   "data string, buckets int, id_type string") \
            .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/spec")

    def _attach(self, data: str) -> None:
        """Name the files in this session's catalog, which knows their buckets then."""
        self.data, self.table = data, f"digest_index_{uuid.uuid4().hex[:12]}"
        place = f"{self.path}/{data}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id {self.id_type}, delivery STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{place}'")

    def frame(self) -> DataFrame:
        """The index as it is now: digest, keep_id, delivery."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def missing(self, rows: DataFrame) -> DataFrame:
        """The digests of ``rows`` (id, digest) that the index lacks, with the largest id.

        The aggregate is stored first: the optimizer would move the join with a small index
        below it, to the rows, and shuffle every copy of a hot text.
        """
        fresh = materialize(rows.groupBy("digest").agg(F.max("id").alias("keep_id")), "digest-fresh")
        return fresh.join(self.frame().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame, delivery: str) -> None:
        """Add the digests of ``rows`` (id, digest) that the index lacks."""
        new = self.missing(rows).select("digest", F.col("keep_id").cast(self.id_type),
                                        F.lit(delivery).alias("delivery"))
        new.repartition(self.buckets, "digest").write.insertInto(self.table)

    def compact(self) -> None:
        """Rewrite the index with one sorted file a bucket; a reader of the old files is not
        disturbed."""
        old = self.frame()
        self._attach(f"data-{uuid.uuid4().hex[:12]}")
        old.repartition(self.buckets, "digest").write.insertInto(self.table)
        self._write_spec()

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, digest, row, delivery) with keep_id, group_size and kept.

        ``row`` numbers the rows of the stored frame.  ``keep_id`` is the index's; a row is
        kept if its delivery brought the text first and it is the one with the largest id
        there; group_size counts the equal texts in ``rows``.
        """
        best = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", (-F.col("row")).alias("back")))
        groups = rows.groupBy("digest", "delivery").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        groups = materialize(groups, "digest-groups")
        sizes = groups.groupBy("digest").agg(F.sum("n").alias("group_size"))
        entry = self.frame().withColumnRenamed("delivery", "first").hint("merge")
        known = groups.join(sizes, "digest").join(entry, "digest").select(
            "digest", "delivery", "keep_id", "group_size",
            F.when(F.col("first") == F.col("delivery"), -F.col("best.back")).alias("keep_row"))
        out = tiled_join(rows, known, ["digest", "delivery"], left_number="row")
        kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
        return out.withColumn("kept", kept).drop("keep_row")


def digest_rows(docs: DataFrame, delivery, id_col: str = "doc_id", text_col: str = "text",
                carry: dict | None = None) -> DataFrame:
    """(id, digest, row, delivery) of every row, stored: the texts are read once.  ``delivery``
    is a name or a column; ``carry`` names more columns to store."""
    label = F.lit(delivery) if isinstance(delivery, str) else delivery
    more = [c.alias(k) for k, c in (carry or {}).items()]
    return materialize(docs.select(
        F.col(f"`{id_col}`").alias("id"), digest_of(F.col(f"`{text_col}`")).alias("digest"),
        F.monotonically_increasing_id().alias("row"), label.alias("delivery"), *more), "digests")


def new_documents(docs: DataFrame, index: DigestIndex, delivery: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Deliver ``docs``: the rows whose text the index did not have, one of each text, with the
    columns of ``docs``; their digests are appended.

    Rows are chosen by ids, digests and two hashes of the whole row.  The texts are read once
    more and joined to those keys, which differ between copies, so a hot text is spread.
    """
    p = private(docs)
    every = [F.col(f"`{c}`") for c in docs.columns]
    hashes = {"a": F.xxhash64(*every), "b": F.xxhash64(F.lit(1), *every)}
    rows = digest_rows(docs, delivery, id_col, text_col, hashes)
    index.append(rows, delivery)
    kept = index.verdicts(rows).filter("kept").select("digest", "id", "a", "b")
    same = rows.groupBy("digest", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = materialize(kept.join(same, ["digest", "a", "b"], "left").select(
        *[F.col(c).alias(p + c) for c in ("digest", "id", "a", "b")],
        F.coalesce("n", F.lit(1)).alias(f"{p}n")), "digest-kept")
    on = (digest_of(F.col(f"`{text_col}`")) == F.col(f"{p}digest")) \
        & F.col(f"`{id_col}`").eqNullSafe(F.col(f"{p}id")) \
        & (hashes["a"] == F.col(f"{p}a")) & (hashes["b"] == F.col(f"{p}b"))
    out = docs.join(kept, on)
    if kept.filter(F.col(f"{p}n") > 1).isEmpty():
        return out.select(*every)
    several = out.filter(F.col(f"{p}n") > 1).dropDuplicates([f"{p}digest"])  # rows repeated whole
    return out.filter(F.col(f"{p}n") == 1).union(several).select(*every)


def keep_largest(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Deliver ``docs`` in two ranges of a numeric id, the upper one first: of equal texts the
    row with the largest id stays.  Returns id, keep_id, group_size, kept, digest."""
    ends = docs.agg(F.min(f"`{id_col}`").alias("lo"), F.max(f"`{id_col}`").alias("hi")).first()
    middle = 0 if ends["lo"] is None else (ends["lo"] + ends["hi"]) // 2
    upper = F.coalesce(F.col(f"`{id_col}`") > F.lit(middle), F.lit(False))
    rows = digest_rows(docs, F.when(upper, "upper").otherwise("lower"), id_col, text_col)
    for delivery in ("upper", "lower"):
        index.append(rows.filter(F.col("delivery") == delivery), delivery)
    return index.verdicts(rows).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest")
