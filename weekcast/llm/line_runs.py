"""Line dedup by a suffix array over line ids (operator 3), DataFrame functions only.

The corpus is read as one sequence of lines (lines without a word are left out of it), each
document closed by an end that equals nothing.  A *run* is a sequence of lines within a
document.  Where a run of at least ``min_words`` words already stands earlier in the corpus
(by id, then line), the later copy is deleted: from each line ``s`` on, the longest run that also
stands from any earlier line on, if it has ``min_words`` words (lines without a word between
deleted lines go with them).  So every maximal repeated run goes, whichever earlier copy it
agrees with furthest.

Prefix doubling.  Rank 0 orders the lines by their ids (128 bits of hash); rank k + 1 orders
the suffixes by the pair (rank k here, rank k 2**k lines on), so equal ranks at level k are
suffixes that agree in their first 2**k lines: an interval of the suffix array whose longest
common prefix is at least that.  Ranks are given to the *distinct* pairs, by a range-
partitioned sort, so no task holds the array; suffixes whose pair occurs once can be part of
no longer repeat and leave, so the levels shrink.

Intervals.  The interval of ``s`` at depth ``q`` (the fewest lines from ``s`` on with ``min_words``
words) is the class of its two (overlapping) windows of 2**k lines; if ``s`` is not its earliest
member, ``s`` starts a copy.  Going down the levels once, a class is parted by the rank of the
next 2**k lines: whoever is not the earliest of its part extends and moves to the part; the
earliest stays (others of the class may agree with it on fewer lines) and also stands in the
part as a witness.  A line that starts a copy, like the line after it, ends no later than that
one, so only the last of consecutive ones, and the classes they are in, go down the levels.

Groups: a line or passage that a third of all rows share is one row in each ranking (counted
before the shuffle), and its joins are splittable by AQE.  Windows go by document only.

Defined results: a null text stays null; an empty one stays empty; a null id counts as the
last; rows that repeat an id come in the order of their stored rows; a document whose text
is all deleted stays with an empty text; an empty table gives an empty table; extra columns
stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekcast.llm.common import materialize, private

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct ``keys`` that occur twice or more, with a rank in their order."""
    pairs = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return materialize(pairs.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), name)


def _lines(docs: DataFrame, row: str, text_col: str) -> DataFrame:
    """(row, pos, idx, a, b, words) of every line with a word; idx counts those lines only."""
    lines = F.filter(F.transform(
        F.split(F.col(f"`{text_col}`"), "\n", -1), lambda line, pos: F.struct(
            pos.alias("pos"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"),
            F.regexp_count(line, F.lit(WORD)).alias("words"))), lambda x: x["words"] > 0)
    return docs.select(F.col(row).alias("row"), F.posexplode(lines).alias("idx", "line")) \
        .select("row", "idx", "line.*")


def _levels(base: DataFrame) -> list[DataFrame]:
    """Level k: (row, idx, r) of the suffixes whose first 2**k lines occur twice or more."""
    levels = [base.select("row", "idx", "r")]
    while True:
        k = len(levels) - 1
        step = 1 << k
        ahead = Window.partitionBy("row").orderBy("idx").rangeBetween(step, step)
        pairs = levels[k].withColumn("r2", F.first("r").over(ahead)).filter("r2 is not null")
        pairs = materialize(pairs, f"lines-pairs{k}")
        ranks = _ranked(pairs, ["r", "r2"], f"lines-ranks{k + 1}")
        if ranks.isEmpty():
            return levels
        levels.append(materialize(pairs.join(ranks, ["r", "r2"]).select(
            "row", "idx", F.col("rank").alias("r")), f"lines-level{k + 1}"))


def _shortest(base: DataFrame, min_words: int) -> DataFrame:
    """(row, idx, q, k): the fewest repeated lines from idx on with ``min_words`` words."""
    by_line = Window.partitionBy("row").orderBy("idx")
    run = base.withColumn("new", (F.col("idx") - F.lag("idx", 1, -2).over(by_line) != 1).cast("int")) \
        .withColumn("run", F.sum("new").over(by_line)) \
        .withColumn("upto", F.sum("words").over(by_line))
    # each line asks for the first line of its run by whose end enough words have passed
    asks = run.select("row", "run", "idx", F.explode(F.array(
        F.struct(F.col("upto").alias("at"), F.lit(1).alias("is_end")),
        F.struct((F.col("upto") - F.col("words") + min_words).alias("at"), F.lit(0).alias("is_end"))))
        .alias("e")).select("row", "run", "idx", "e.at", "e.is_end")
    back = Window.partitionBy("row", "run").orderBy(F.desc("at"), F.desc("is_end")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    asks = asks.withColumn("last", F.min(F.when(F.col("is_end") == 1, F.col("idx"))).over(back))
    q = (F.col("last") - F.col("idx") + 1).cast("int")
    found = asks.filter("is_end = 0 and last is not null").select("row", "idx", q.alias("q"))
    # the exponent of the largest power of two that is not above q
    return found.withColumn("k", (F.length(F.bin("q")) - 1).cast("int"))


def _classes(docs_order: DataFrame, levels: list[DataFrame], short: DataFrame) -> DataFrame:
    """(row, idx, no_id, id, q, erow, eidx, copy) of the lines whose first ``q`` lines stand twice
    or more: the class's earliest line, and whether it is another one."""
    every = levels[0].withColumn("k", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        every = every.union(level.withColumn("k", F.lit(k)))
    left = every.select("row", "idx", "k", F.col("r").alias("ra"))
    right = every.select("row", F.col("idx").alias("idx2"), "k", F.col("r").alias("rb"))
    tail = F.expr("idx + q - shiftleft(1, k)")
    sites = short.join(left, ["row", "idx", "k"]).withColumn("idx2", tail.cast("int")) \
        .join(right, ["row", "idx2", "k"]).drop("idx2").join(docs_order, "row")
    sites = materialize(sites, "lines-sites")
    # written on its own, so that the join back has exchanges of its own, which AQE can split
    # where many sites share a passage
    first = materialize(sites.groupBy("q", "ra", "rb").agg(
        F.min(_place()).alias("e"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "lines-first")
    return sites.join(first, ["q", "ra", "rb"]).select(
        "row", "idx", "no_id", "id", "q", F.col("e.row").alias("erow"), F.col("e.idx").alias("eidx"),
        ((F.col("e.row") != F.col("row")) | (F.col("e.idx") != F.col("idx"))).alias("copy"))


def _place():
    """A line's place in the corpus."""
    return F.struct("no_id", "id", "row", "idx")


def _extended(classes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(row, idx, end): the lines up to ``end`` also stand from an earlier line on."""
    order = Window.partitionBy("row").orderBy("idx")
    goes_on = (F.lead("idx").over(order) == F.col("idx") + 1) & F.lead("copy").over(order)
    classes = materialize(classes.withColumn("asks", F.col("copy") & ~F.coalesce(goes_on, F.lit(False)))
                          .withColumn("len", F.col("q")), "lines-classes")
    key = ["erow", "eidx", "len"]
    asked = classes.filter("asks").select(*key).distinct()
    state = materialize(classes.join(asked, key, "left_semi").drop("q", "copy"), "lines-asked")
    for k in range(len(levels) - 1, -1, -1):
        ahead = levels[k].select("row", F.col("idx").alias("at"), "r")
        state = materialize(state.withColumn("at", F.col("idx") + F.col("len")).join(ahead, ["row", "at"], "left")
                            .drop("at"), f"lines-ahead{k}")
        parts = state.filter("r is not null").groupBy(*key, "r").agg(
            F.min(_place()).alias("f"), F.count(F.lit(1)).alias("n"), F.max("asks").alias("some"))
        parts = materialize(parts.filter("n > 1 and some").select(
            *key, "r", F.col("f.row").alias("frow"), F.col("f.idx").alias("fidx")), f"lines-parts{k}")
        moved = F.col("frow").isNotNull()
        is_first = (F.col("frow") == F.col("row")) & (F.col("fidx") == F.col("idx"))
        old = F.struct(*key, "asks")
        new = F.struct(F.col("frow").alias("erow"), F.col("fidx").alias("eidx"),
                       (F.col("len") + (1 << k)).alias("len"), (F.col("asks") & ~is_first).alias("asks"))
        state = state.join(parts, [*key, "r"], "left").select(
            "row", "idx", "no_id", "id", F.explode(F.array_compact(F.array(
                F.when(~moved | is_first, old), F.when(moved, new)))).alias("c")) \
            .select("row", "idx", "no_id", "id", "c.*")
    inner = classes.filter("copy and not asks").select("row", "idx", (F.col("idx") + F.col("q")).alias("end"))
    return inner.union(state.filter("asks").select("row", "idx", (F.col("idx") + F.col("len")).alias("end")))


def _deleted(base: DataFrame, ends: DataFrame) -> DataFrame:
    """(row, cuts): sorted, disjoint ranges of line positions to delete."""
    order = Window.partitionBy("row").orderBy("idx")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = base.select("row", "idx", "pos").join(ends, ["row", "idx"], "left") \
        .withColumn("reach", F.max("end").over(sofar)).filter("reach > idx")
    gone = gone.withColumn("new", (F.col("idx") - F.lag("idx", 1, -2).over(order) != 1).cast("int")) \
        .withColumn("part", F.sum("new").over(order))
    cuts = gone.groupBy("row", "part").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                                           F.count(F.lit(1)).alias("lines"))
    return cuts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("cuts"),
                                   F.sum("lines").alias("lines"))


def repeated_runs(docs: DataFrame, row: str, text_col: str, id_col: str,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """(row, cuts, lines): line ranges to delete of the rows that have any, and how many of
    the lines in them have a word.  ``row`` names a stored column that is unique."""
    lines = materialize(_lines(docs, row, text_col), "lines")
    ids = _ranked(lines, ["a", "b"], "lines-ids")
    base = materialize(lines.join(ids, ["a", "b"]).select(
        "row", "pos", "idx", "words", F.col("rank").alias("r")), "lines-level0")
    levels = _levels(base)
    ident = F.col(f"`{id_col}`")
    order = docs.select(F.col(row).alias("row"), ident.isNull().alias("no_id"), ident.alias("id"))
    classes = _classes(order, levels, _shortest(base, min_words))
    return _deleted(base, materialize(_extended(classes, levels), "lines-ends"))


def _without(text, cuts):
    """The text without the lines in the cuts (sorted, disjoint ranges of positions)."""
    lines = F.split(text, "\n", -1)
    # a kept range goes from the end of one cut to the start of the next
    kept = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.slice(
        lines, F.when(i == 0, 1).otherwise(F.get(cuts, i - 1)["hi"] + 2),
        F.when(i == F.size(cuts), F.size(lines)).otherwise(F.get(cuts, i)["lo"])
        - F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["hi"] + 1)))
    return F.array_join(F.flatten(kept), "\n")


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """``docs`` with later copies of repeated runs deleted from the texts, and a column of the
    number of lines deleted (its name is returned too)."""
    p = private(docs)
    row = f"{p}row"
    stored = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "lines-docs")
    cuts = repeated_runs(stored, row, text_col, id_col, min_words).select(
        F.col("row").alias(f"{p}r"), F.col("cuts").alias(f"{p}cuts"), F.col("lines").alias(f"{p}lines"))
    text = F.col(f"`{text_col}`")
    clean = F.when(F.col(f"{p}cuts").isNull(), text).otherwise(_without(text, F.col(f"{p}cuts")))
    joined = stored.join(cuts, F.col(row) == F.col(f"{p}r"), "left")
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
                         F.coalesce(F.col(f"{p}lines"), F.lit(0)).alias(f"{p}removed")), f"{p}removed"


def remove_repeated_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                         min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted; the columns stay."""
    return dedup_lines(docs, text_col, id_col, min_words)[0].select(
        *[F.col(f"`{c}`") for c in docs.columns])
