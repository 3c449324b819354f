"""Fan-out joins on hot keys.

A join that keeps every match sends all rows of a key, and all pairs of them, to one task.
AQE splits one skewed side; it cannot split a key that is hot on both.  ``tiled_join`` counts
the keys of both sides first.  A heavy key's left rows are dealt into ``pl`` parts and its
right rows into ``pr``; part ``i`` of the left meets part ``j`` of the right in tile
``(i, j)``, so every pair of rows meets exactly once and no tile holds more than about a
stated share of either side or of the result.  Light keys are one tile, (0, 0).

The pairs of a key that is hot on both sides grow with the square of its rows.  Where many of
its right rows are equal, ``times`` keeps them as one row and its number: each left row still
meets every different right row, and the number tells how often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.sources.sinks import materialize

#: Largest share of a side's rows, or of the joined rows, that one tile is to hold.
SHARE = 1 / 64
#: A key with at most so many rows and pairs is never split: such a tile fits any task.
LEAST_ROWS, LEAST_PAIRS = 10_000, 1_000_000

_P = "_tile_"


def _same(a: DataFrame, b: DataFrame, keys, other) -> object:
    cond = None
    for k, o in zip(keys, other):
        c = a[k].eqNullSafe(b[o])
        cond = c if cond is None else cond & c
    return cond


def _numbered(df: DataFrame, number: str | None, name: str) -> DataFrame:
    """``df`` with a row number that stays the same between readings (``{_P}row``)."""
    if number is not None:
        return df.withColumn(f"{_P}row", F.col(number))
    return materialize(df.withColumn(f"{_P}row", F.monotonically_increasing_id()), name)


def heavy_keys(left: DataFrame, right: DataFrame, keys, share: float = SHARE,
               least_rows: int = LEAST_ROWS, least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """The keys that ``tiled_join`` splits: ``keys`` (as ``_tile_k0``, ...), the rows of both
    sides ``nl`` and ``nr`` and the parts ``pl`` and ``pr``.

    A key is heavy if it holds more than ``share`` of a side or of the pairs, so there are at
    most ``3 / share`` of them.  Three sums reach the driver.
    """
    names = [f"{_P}k{i}" for i in range(len(keys))]
    aliases = [F.col(k).alias(n) for k, n in zip(keys, names)]
    lc = left.groupBy(*aliases).agg(F.count(F.lit(1)).alias("nl"))
    rc = right.groupBy(*aliases).agg(F.count(F.lit(1)).alias("nr"))
    nl, nr = F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0))
    counts = materialize(lc.join(rc, names, "full").select(*names, nl.alias("nl"), nr.alias("nr")),
                         "tile-counts")
    pairs = F.col("nl").cast("double") * F.col("nr")
    s = counts.agg(F.sum("nl").alias("l"), F.sum("nr").alias("r"), F.sum(pairs).alias("p")).first()
    cap_l, cap_r = (max(least_rows, int((s[x] or 0) * share)) for x in "lr")
    cap_p = float(max(least_pairs, (s["p"] or 0) * share))
    pl, pr = F.ceil(F.col("nl") / cap_l), F.ceil(F.col("nr") / cap_r)
    cut = counts.filter((F.col("nl") > cap_l) | (F.col("nr") > cap_r) | (pairs > cap_p)) \
        .withColumn("pl", F.greatest(pl, F.lit(1))).withColumn("pr", F.greatest(pr, F.lit(1)))
    # still too many pairs a tile: the larger side is cut further
    more = F.greatest(F.ceil(pairs / (F.col("pl") * F.col("pr")) / cap_p), F.lit(1))
    longer = F.col("nl") / F.col("pl") >= F.col("nr") / F.col("pr")
    return cut.withColumn("more", more).select(
        *names, "nl", "nr",
        F.when(longer, F.col("pl") * F.col("more")).otherwise(F.col("pl")).cast("int").alias("pl"),
        F.when(longer, F.col("pr")).otherwise(F.col("pr") * F.col("more")).cast("int").alias("pr"))


def tiles(left: DataFrame, right: DataFrame, keys, share: float = SHARE,
          least_rows: int = LEAST_ROWS, least_pairs: int = LEAST_PAIRS,
          left_number: str | None = None, right_number: str | None = None,
          keep_null_keys: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tile (``_tile_i``, ``_tile_j``), each row once per tile it meets.

    ``*_number`` name a column that numbers the rows of a stored side; without it the side is
    written to the shared stage folder with such a number.  Parts come from that number, so
    they are the same when a lost task runs again, and copies of one row are spread too.
    """
    keys = list(keys)
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    left = left if keep_null_keys else left.filter(known)
    left, right = _numbered(left, left_number, "tile-left"), _numbered(right.filter(known), right_number, "tile-right")
    heavy = materialize(heavy_keys(left, right, keys, share, least_rows, least_pairs), "tile-heavy")
    names = [f"{_P}k{i}" for i in range(len(keys))]

    def dealt(df, mine, other, own_parts, other_parts):
        split = df.join(F.broadcast(heavy), _same(df, heavy, keys, names), "left")
        part = F.pmod(F.xxhash64(f"{_P}row"), F.coalesce(F.col(own_parts), F.lit(1)))
        every = F.sequence(F.lit(0), F.coalesce(F.col(other_parts), F.lit(1)) - 1)
        met = F.coalesce((F.col("nr") > 0) & (F.col("pr") > 1), F.lit(False))
        return split.select(*[df[c] for c in df.columns], part.cast("int").alias(mine),
                            F.explode(every).alias(other), met.alias(f"{_P}met"))

    return (dealt(left, f"{_P}i", f"{_P}j", "pl", "pr"),
            dealt(right, f"{_P}j", f"{_P}i", "pr", "pl"))


def tiled_join(left: DataFrame, right: DataFrame, keys, how: str = "inner", share: float = SHARE,
               least_rows: int = LEAST_ROWS, least_pairs: int = LEAST_PAIRS,
               left_number: str | None = None, right_number: str | None = None,
               times: str | None = None) -> DataFrame:
    """Equi-join on same-named ``keys`` that splits heavy keys on both sides.

    The columns of ``left`` and those of ``right`` that are no keys.  ``how`` is inner or
    left; NULL keys match nothing, and with ``left`` a hot NULL key is spread like any other.

    ``times`` names a column to add: equal rows of ``right`` then meet a left row once, and it
    holds how many rows of the plain join that row stands for (1 for a left row without a
    match).  Repeating each row so often gives the plain join.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    keys = list(keys)
    if times is not None:
        if right_number is not None:
            raise ValueError("numbered right rows are all different: give times or right_number")
        if times.lower() in {c.lower() for c in right.columns}:
            raise ValueError(f"the right side has a column {times}")
        right = right.groupBy(*right.columns).agg(F.count(F.lit(1)).alias(times))
    extra = [c for c in right.columns if c not in keys]
    if clash := {c.lower() for c in extra} & {c.lower() for c in left.columns}:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    a, b = tiles(left, right, keys, share, least_rows, least_pairs, left_number, right_number,
                 keep_null_keys=how == "left")
    b = b.select(*[F.col(k).alias(f"{_P}r{i}") for i, k in enumerate(keys)], *extra,
                 F.col(f"{_P}i").alias(f"{_P}ri"), F.col(f"{_P}j").alias(f"{_P}rj"))
    cond = (a[f"{_P}i"] == b[f"{_P}ri"]) & (a[f"{_P}j"] == b[f"{_P}rj"])
    for i, k in enumerate(keys):
        cond = cond & (a[k] == b[f"{_P}r{i}"])
    joined = a.join(b, cond, how)
    if how == "left":  # a left row stands in pr tiles: an empty one of them is no missing match
        joined = joined.filter(F.col(f"{_P}ri").isNotNull() | ~F.col(f"{_P}met"))
    return joined.select(*[a[c] for c in left.columns],
                         *[b[c] if c != times else F.coalesce(b[c], F.lit(1)).alias(c) for c in extra])
