"""Mixing sources to target weights by Pareto order sampling (operator 7).

Every source gets a target of words by its weight; a target above ``max_copies`` times the
source's own size is cut there and the excess is shared again by weight.

Inclusion odds.  Within a source a document's expected copies grow with the binary digits of
its size (its *class*): ``rate = c * class``, at most ``max_copies``, where ``c`` is such that
the expected words are the target.  ``floor(rate)`` copies are taken for certain; what is left
of the target is filled by Pareto order sampling with the unequal inclusion probabilities
``p = rate - floor(rate)``: documents are ranked by their random odds divided by their
inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and taken from the front.  The rank is held
as ``t = odds / (1 + odds)``, a number in (0, 1).

``u`` comes from a hash of the row (id, text, source), a seed and, for rows repeated whole, an
occurrence number: reruns agree, and rows that share an id, or have none, are drawn one by one.

The sample's size is fixed in *words*: the front of the ranking is taken as far as it fits;
the words that the first document too long for the rest leaves open are filled in further
passes from the front of the documents that still fit, and at last one document that is too
long by less than it fills is taken: the one that comes nearest to the target.

No source is ranked in one task: words are summed by (source, slice of t), the slice in
which the target is reached follows from at most ``SLICES`` sums a source, and only the
documents of that slice are put in order.  Classes are at most 64 a source.

Defined results: a null text has size 0 and is never taken for its words (taken 0); a null
source comes last in the order of sources; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekcast.llm.common import materialize
from weekcast.operators.tiles import tiled_join
from weekcast.operators.windows import global_index

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 4096
PASSES = 4


def words_of(text):
    """Number of words of a text column; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(ident, text, source):
    """MD5 of the id, the text's MD5 and the source; null counts as empty."""
    empty = F.lit("")
    return F.md5(F.concat_ws(":", F.coalesce(ident.cast("string"), empty),
                             F.md5(F.coalesce(text, empty)), F.coalesce(source, empty)))


def uniform(key, occurrence, seed: str):
    """A number in (0, 1) from a row's key, its occurrence and the seed: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", key, occurrence.cast("string"), F.lit(seed)))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.0,
                   max_copies: int = 3) -> DataFrame:
    """Target words of each source: columns ``src_null``, ``src``, ``source_size``, ``target``.

    Two numbers a round reach the driver (words to share, weight to share them by); a round
    ends with more sources cut at their limit, or is the last.
    """
    sums = sizes.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    ranked = global_index(sums, [F.col("src_null"), F.col("src")], "rank", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * max_copies
    table = materialize(ranked.select("src_null", "src", "source_size", weight.alias("weight"),
                                      limit.alias("limit")), "mix-weights")
    total = table.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    words = int(total * share) if share != 1.0 else total
    factor = (0, 1)
    cut = F.lit(False)
    while True:
        left = table.filter(~cut).agg(F.sum("weight").alias("w")).first()["w"] or 0
        full = table.filter(cut).agg(F.sum("limit").alias("n")).first()["n"] or 0
        if not left:
            break
        factor = (words - full, left)
        now = cut | (F.col("weight") * F.lit(factor[0]) > F.col("limit") * F.lit(factor[1]))
        if table.filter(now & ~cut).isEmpty():
            break
        cut = F.col("weight") * F.lit(factor[0]) > F.col("limit") * F.lit(factor[1])
    target = F.when(cut, F.col("limit").cast("double")).otherwise(
        F.col("weight").cast("double") * F.lit(float(factor[0])) / F.lit(float(factor[1])))
    return table.select("src_null", "src", "source_size", target.alias("target"))


def numbered_copies(sizes: DataFrame, key: str) -> DataFrame:
    """``sizes`` with ``occurrence``: 0, 1, ... among the rows that share ``key``.

    Only rows that are repeated whole are numbered, by one range-partitioned sort, so a row
    that makes up a third of the table is spread.
    """
    several = materialize(sizes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "mix-repeated")
    if several.isEmpty():
        return sizes.withColumn("occurrence", F.lit(0))
    several = several.select(F.col(key).alias("again"))
    alone = sizes.join(several, F.col(key) == F.col("again"), "left_anti").withColumn("occurrence", F.lit(0))
    copies = global_index(sizes.join(several, F.col(key) == F.col("again"), "left_semi"), [F.col(key)], "at",
                          "mix-copies")
    first = copies.groupBy(F.col(key).alias("again")).agg(F.min("at").alias("first"))
    ranked = tiled_join(copies.withColumn("again", F.col(key)), first, ["again"], left_number="at")
    return alone.unionByName(ranked.select(*sizes.columns, (F.col("at") - F.col("first")).cast("int").alias("occurrence")))


def class_rates(sizes: DataFrame, targets: DataFrame, max_copies: int = 3) -> DataFrame:
    """(source, class, target, source_size, whole, p, certain): the expected copies of each class of
    sizes, and the words that the source's whole copies take."""
    key = ["src_null", "src"]
    sums = sizes.filter("size > 0").groupBy(*key, "class").agg(F.sum("size").alias("words")).join(targets, key)
    longer = Window.partitionBy(*key).orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.partitionBy(*key).orderBy(F.col("class").desc()).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(*key)
    # with the classes above this one at their limit, the factor that meets the target
    full = F.coalesce(F.sum("words").over(longer), F.lit(0)) * max_copies
    factor = (F.col("target") - full) / F.sum(F.col("class") * F.col("words")).over(shorter)
    fits = sums.withColumn("factor", factor).withColumn(
        "fits", F.when(F.col("factor") * F.col("class") <= max_copies, F.struct("class", "factor")))
    c = F.max("fits").over(every)["factor"]
    rate = F.greatest(F.least(F.coalesce(c * F.col("class"), F.lit(float(max_copies))), F.lit(float(max_copies))),
                      F.lit(0.0))
    rated = fits.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    return rated.select(*key, "class", "target", "source_size", "whole", (F.col("rate") - F.col("whole")).alias("p"),
                        F.sum(F.col("whole") * F.col("words")).over(every).alias("certain"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=(5, 2, 1), share: float = 1.0,
        max_copies: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken."""
    source, text = F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`")
    ident = F.col(f"`{id_col}`")
    key = ["src_null", "src"]
    rows = materialize(docs.select(
        ident.alias("id"), source.alias("source"), source.isNull().alias("src_null"),
        F.coalesce(source, F.lit("")).alias("src"), words_of(text).alias("size"),
        row_key(ident, text, source).alias("key")), "mix-rows")
    rows = numbered_copies(rows, "key").withColumn("u", uniform(F.col("key"), F.col("occurrence"), seed)) \
        .withColumn("class", F.length(F.bin("size"))).drop("key", "occurrence")
    targets = source_targets(rows, weights, share, max_copies)
    rates = materialize(class_rates(rows, targets, max_copies), "mix-rates")
    own = rates.select(*key, "class", "whole", "p")
    u, p = F.col("u"), F.col("p")
    part = u * (1 - p)
    sizes = materialize(rows.join(own, [*key, "class"], "left").withColumn(
        "t", F.when(p > 0, part / (part + (1 - u) * p))).drop("u", "class"), "mix-sizes")
    certain = rates.select(*key, "certain").distinct()
    state = targets.join(certain, key, "left").select(
        *key, "source_size", "target",
        F.greatest(F.col("target") - F.coalesce("certain", F.lit(0)), F.lit(0.0)).alias("rest0"))
    for k in range(PASSES):
        state = materialize(state, f"mix-pass{k}")
        open_rows = sizes.join(state, key).filter(
            F.col("t").isNotNull() & (F.col("size") <= F.col(f"rest{k}")) & ~_taken(k)).select(
                *key, "size", "t", f"rest{k}", F.floor(F.col("t") * SLICES).cast("int").alias("slice"))
        open_rows = materialize(open_rows, f"mix-rows{k}")
        slices = open_rows.groupBy(*key, "slice", f"rest{k}").agg(F.sum("size").alias("words"))
        before = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = slices.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        at = slices.filter((F.col("before") <= F.col(f"rest{k}"))
                           & (F.col("before") + F.col("words") > F.col(f"rest{k}")))
        inside = open_rows.join(at.select(*key, "slice", "before"), [*key, "slice"])
        upto = Window.partitionBy(*key, "slice").orderBy("t").rangeBetween(
            Window.unboundedPreceding, Window.currentRow)
        reached = inside.withColumn("cum", F.col("before") + F.sum("size").over(upto)).filter(
            F.col("cum") <= F.col(f"rest{k}"))
        cut = reached.groupBy(*key).agg(F.max("t").alias("cut_in"), F.max("cum").alias("cum_in"))
        low = at.select(*key, (F.col("slice") / F.lit(float(SLICES))).alias("low"),
                        F.col("before").alias("cum_low")).join(cut, key, "left")
        every = slices.groupBy(*key).agg(F.sum("words").alias("cum_all"))
        last = every.join(low, key, "left").select(
            *key, F.coalesce("cut_in", "low", F.lit(1.0)).alias(f"cut{k}"),
            F.coalesce("cum_in", "cum_low", "cum_all").alias("used"))
        state = state.join(last, key, "left").withColumn(
            f"rest{k + 1}", F.col(f"rest{k}") - F.coalesce(F.col("used"), F.lit(0))).drop("used")
    state = materialize(state, "mix-cuts")
    rest = F.col(f"rest{PASSES}")
    near = sizes.join(state, key).filter(
        F.col("t").isNotNull() & (F.col("size") < 2 * rest) & ~_taken(PASSES)) \
        .groupBy(*key).agg(F.min(F.struct(F.abs(F.col("size") - rest).alias("gap"), F.col("t").alias("t"),
                                          F.col("size").alias("size"))).alias("near"))
    state = materialize(state.join(near, key, "left"), "mix-last")
    last = (F.col("t") == F.col("near.t")) & (F.col("size") == F.col("near.size"))
    extra = F.col("t").isNotNull() & (_taken(PASSES) | F.coalesce(last, F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0))
    return sizes.join(state, key).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size",
        "target", copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"))


def _taken(passes: int):
    """Whether one of the first passes took the document."""
    hit = F.lit(False)
    for k in range(passes):
        hit = hit | F.coalesce((F.col("size") <= F.col(f"rest{k}")) & (F.col("t") <= F.col(f"cut{k}")),
                               F.lit(False))
    return hit
