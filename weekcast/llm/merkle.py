"""Merkle dataset manifest with proofs by descent of a content-addressed DAG (operator 12).

Leaves.  ``H`` is the lowercase hex SHA-256 of its inputs one after the other.  A row's leaf is
H of its columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.

Trees.  The leaves of a group (source) ascend by id; while several nodes remain, every
``FANOUT`` consecutive ones become their H (the last run may have fewer).  What remains is the
group's subroot; the subroots, in the groups' order, likewise give the root.

Records.  Every inner node is stored as (digest, children): the node's digest is its address.
A height's records are one Parquet stage; equal nodes are one record when they are read.

Proofs.  Requests for leaves descend from the root.  At each height a request's node is looked
up by its digest, the digit of its rank (base ``FANOUT``) selects the child to go on with, and
the unselected children, left and right of it, are collected as one path segment.  Requests
that share a node descend as one row until they part, so a height has at most one row for each
of its nodes.  At the leaves the segments are reversed: a proof reads from the leaf up.

No step holds a group in one task: ranks come from one range-partitioned sort, the groups'
numbers are joined by tiles, runs of ``FANOUT`` are grouped by (group, run), and the number of
rounds is the height of the largest tree.  The driver learns the largest group's size, the
number of groups and the root.

Defined results: null groups come first and are a group; null ids come first in their group,
rows with the same id in the order of their leaves; repeated rows are leaves of their own; an
empty table has no root and no proofs; columns that are not named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import materialize
from weekcast.operators.tiles import tiled_join
from weekcast.operators.windows import global_index

FANOUT = 16


def H(*parts):
    """Lowercase hex SHA-256 of string columns, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns) -> object:
    """The leaf of a row with these columns."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return H(*parts)


@dataclass
class Manifest:
    """``leaves``: grp, pos (rank in its group), leaf and the carried columns; ``subroots``: grp,
    digest, height; ``inner`` and ``top``: the stages of the groups' trees and of the tree over
    the subroots by height (digest, children, ...); ``root``: its digest, None for an empty table."""
    leaves: DataFrame
    subroots: DataFrame
    inner: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def records(self) -> DataFrame:
        """The whole store: one (digest, children) for each different inner node."""
        out = None
        for stage in [*self.inner, *self.top]:
            part = stage.select("digest", "children")
            out = part if out is None else out.unionByName(part)
        return out.dropDuplicates(["digest"])


def _heights(n: int) -> int:
    """Heights of a tree over ``n`` nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def _next_height(nodes: DataFrame, name: str) -> DataFrame:
    """The parents (grp, pos, n, digest, children) of the nodes (grp, pos, n, digest) of groups
    with ``n`` > 1 nodes at this height."""
    runs = nodes.filter("n > 1").groupBy("grp", F.floor(F.col("pos") / FANOUT).alias("pos"), "n").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col("digest")))).alias("run"))
    children = F.transform("run", lambda x: x["digest"])
    return materialize(runs.select(
        "grp", "pos", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"),
        H(F.array_join(children, "")).alias("digest"), children.alias("children")), name)


def build(rows: DataFrame, group: str, ident: str, leaf: str, carry=()) -> Manifest:
    """The manifest of ``rows``: their columns ``group``, ``ident``, ``leaf`` and ``carry``."""
    staged = materialize(rows.select(
        F.col(group).isNull().alias("no_group"), F.coalesce(F.col(group), F.lit("")).alias("group"),
        F.col(ident).alias("ident"), F.col(leaf).alias("leaf"), *[F.col(c) for c in carry]), "merkle-rows")
    sorted_rows = global_index(staged, [F.col("no_group").desc(), F.col("group"), F.col("ident").asc_nulls_first(),
                                        F.col("leaf")], "at", "merkle-leaves")
    sizes = sorted_rows.groupBy("no_group", "group").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = global_index(materialize(sizes, "merkle-sizes"), [F.col("no_group").desc(), F.col("group")], "grp",
                          "merkle-groups")
    ranked = tiled_join(sorted_rows, groups, ["no_group", "group"], left_number="at")
    leaves = materialize(ranked.select("grp", (F.col("at") - F.col("first")).alias("pos"), "n", "ident", "leaf",
                                       *carry), "merkle-ranked")
    most = groups.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("g")).first()
    nodes, inner = leaves.select("grp", "pos", "n", F.col("leaf").alias("digest")), []
    subroots = nodes.filter("n = 1").select("grp", "digest", F.lit(0).alias("height"))
    if not most["g"]:
        return Manifest(leaves, subroots, [], [], None)
    for h in range(1, _heights(most["n"]) + 1):
        inner.append(_next_height(nodes, f"merkle-{h}"))
        nodes = inner[-1].select("grp", "pos", "n", "digest")
        subroots = subroots.unionByName(nodes.filter("n = 1").select("grp", "digest", F.lit(h).alias("height")))
    subroots = materialize(subroots, "merkle-subroots")
    top = []
    nodes = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"),
                            F.lit(most["g"]).cast("long").alias("n"), "digest")
    for h in range(1, _heights(most["g"]) + 1):
        top.append(_next_height(nodes, f"merkle-top-{h}"))
        nodes = top[-1].select("grp", "pos", "n", "digest")
    return Manifest(leaves, subroots, inner, top, nodes.first()["digest"])


def _descend(state: DataFrame, stage: DataFrame, wanted: DataFrame, carry=()) -> DataFrame:
    """One height down: nodes ``state`` (grp, pos, digest, segments, ...), the records of their
    height, and the positions ``wanted`` (grp, pos and the columns ``carry``) below them."""
    records = stage.select("digest", "children").dropDuplicates(["digest"])
    below = wanted.select(F.col("grp").alias("w_grp"), F.floor(F.col("pos") / FANOUT).alias("w_parent"),
                          F.col("pos").alias("w_pos"), *carry)
    found = state.join(records, "digest").join(
        below, (F.col("grp") == F.col("w_grp")) & (F.col("pos") == F.col("w_parent")))
    digit = (F.col("w_pos") % FANOUT).cast("int")
    segment = F.struct(F.array_join(F.slice("children", F.lit(1), digit), "").alias("left"),
                       F.array_join(F.slice("children", digit + 2, F.lit(FANOUT)), "").alias("right"))
    others = [c for c in state.columns if c not in ("grp", "pos", "digest", "segments")]
    return found.select("grp", F.col("w_pos").alias("pos"), F.get("children", digit).alias("digest"),
                        F.concat("segments", F.array(segment)).alias("segments"), *others, *carry)


def prove(manifest: Manifest, requests: DataFrame, carry=()) -> DataFrame:
    """The requested leaves (grp, pos) with ``leaf``, ``subroot`` and ``path``: the segments
    (left, right) of their siblings from the leaf up; the columns ``carry`` of the requests."""
    kind = "array<struct<left:string,right:string>>"
    groups = requests.select(F.col("grp").alias("pos")).distinct().withColumn("grp", F.lit(0).cast("long"))
    wanted_top = [groups]
    for h in range(1, len(manifest.top)):
        wanted_top.append(wanted_top[-1].select("grp", F.floor(F.col("pos") / FANOUT).alias("pos")).distinct())
    none = F.array().cast(kind).alias("segments")
    if manifest.top:
        state = manifest.top[-1].select("grp", "pos", "digest", none)
    else:  # one group: its subroot is the root
        state = manifest.subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), "digest", none)
    for h in range(len(manifest.top), 0, -1):
        state = _descend(state, manifest.top[h - 1], wanted_top[h - 1])
    # the position in the top tree is the group's number
    heights = manifest.subroots.select(F.col("grp").alias("own"), "height")
    start = state.join(heights, F.col("pos") == F.col("own"))
    start = materialize(start.select(
        F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "digest", "segments",
        F.col("digest").alias("subroot"), "height"), "merkle-starts")
    wanted = [requests.select("grp", "pos", *carry)]
    for h in range(1, len(manifest.inner)):
        wanted.append(materialize(wanted[-1].select("grp", F.floor(F.col("pos") / FANOUT).alias("pos")).distinct(),
                                  f"merkle-wanted-{h}"))
    cols = ["grp", "pos", "digest", "segments", "subroot"]
    state = None
    for h in range(len(manifest.inner), 0, -1):
        begun = start.filter(F.col("height") == h).select(*cols)
        state = begun if state is None else state.unionByName(begun)
        state = _descend(state, manifest.inner[h - 1], wanted[h - 1], carry if h == 1 else ())
    lone = start.filter("height = 0").select(*cols).join(wanted[0], ["grp", "pos"])
    state = lone if state is None else state.unionByName(lone)
    return state.select("grp", "pos", F.col("digest").alias("leaf"), "subroot",
                        F.reverse("segments").alias("path"), *carry)


def proof_digest(path):
    """H of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(leaf, path):
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda node, x: H(x["left"], node, x["right"]))
