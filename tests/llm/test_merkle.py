"""Merkle manifest against a plain reading of its definition."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weekcast.llm import merkle
from weekcast.llm.queries import QUERIES

COLS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(top node, the siblings (left, right) of every node from the bottom up)."""
    paths, levels = [[] for _ in nodes], [nodes]
    where = list(range(len(nodes)))
    while len(levels[-1]) > 1:
        now = levels[-1]
        for k, at in enumerate(where):
            run = at // 16 * 16
            paths[k].append(("".join(now[run:at]), "".join(now[at + 1:run + 16])))
            where[k] = at // 16
        levels.append([H("".join(now[i:i + 16])) for i in range(0, len(now), 16)])
    return levels[-1][0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ends, low = [], {}
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in mine])
        ends.append(top)
        low[s] = list(zip(mine, paths))
    root, above = tree(ends)
    out = []
    for k, s in enumerate(order):
        for r, path in low[s]:
            path = path + above[k]
            given = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                given = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                given = H(left + given + right)
            out.append((r[0], leaf(r), ends[k], root, H("".join(a + b for a, b in path)), given, given == root))
    return out


def corpus(sizes, seed=3):
    rng = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((rng.choice([None, *range(50)]) if s == "ties" else len(rows), s,
                         rng.choice([None, "", "en", "dé"]), rng.choice([None, 0, -5]),
                         rng.choice([None, "", "Äa\U0001F600", "UPPER and lower", "x" * 50_000, f"Text {len(rows)}"])))
    return rows


@pytest.mark.parametrize("sizes", [
    {"big": 600, None: 40, "": 17, "one": 1, "ties": 300, "Zed": 16, "é": 256},
    {"alone": 1}, {None: 16}, {"seventeen": 17}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_matches_brute_force(spark, tmp_path, sizes):
    rows = corpus(sizes)
    rows += rows[:3] + rows[:3]  # rows repeated whole
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, brute(rows)))


def manifest_of(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("grp", F.lit("clash")).withColumn("at", F.lit(1))
    leaves = docs.withColumn("leaf", merkle.leaf_digest([F.col(c) for c in COLS]))
    return merkle.build(leaves, "source", "doc_id", "leaf")


def test_records_are_addressed_by_their_content(spark):
    rows = corpus({"a": 300, "b": 20})
    # two sources whose rows are all alike share their inner nodes
    rows += [(1, "same", "en", 1, "t")] * 64
    manifest = manifest_of(spark, rows)
    records = manifest.records().collect()
    assert len({r.digest for r in records}) == len(records)
    assert all(r.digest == H("".join(r.children)) and 1 <= len(r.children) <= 16 for r in records)
    assert manifest.root in {r.digest for r in records}
    same = leaf((1, "same", "en", 1, "t"))
    assert sum(r.children == [same] * 16 for r in records) == 1  # four equal runs, one record


def test_some_requests_get_the_same_proofs(spark):
    manifest = manifest_of(spark, corpus({"a": 300, "b": 20, "c": 1}))
    every = manifest.leaves.select("grp", "pos")
    some = every.filter("pos % 97 = 0")

    def found(df):
        return {(r.grp, r.pos): (r.leaf, r.subroot, tuple(map(tuple, r.path))) for r in df.collect()}

    full = found(merkle.prove(manifest, every))
    part = found(merkle.prove(manifest, some))
    assert len(full) == 321 and len(part) == 6 and all(full[k] == v for k, v in part.items())
    assert merkle.prove(manifest, every.limit(0)).count() == 0
    leaves = {(r.grp, r.pos): r.leaf for r in manifest.leaves.collect()}
    assert all(full[k][0] == v for k, v in leaves.items())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    assert df.count() == 0 and df.schema["verified"].dataType.simpleString() == "boolean"
