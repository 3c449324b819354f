"""Exact dedup against a persistent index: brute force, repeated deliveries, plans."""

import hashlib
import random

from pyspark.sql import functions as F

from weekcast.llm import digest_index
from weekcast.llm.digest_index import DigestIndex
from weekcast.sources.sinks import stage_path


def fresh_index(spark, buckets=4):
    return DigestIndex.create(spark, stage_path(spark, "test-index"), buckets=buckets)


def brute(rows):
    """(id, keep_id, group_size, digest) of (id, text) rows and how many rows of each are kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        out.append((i, max(known) if known else None, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return out, len(groups)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    texts = [None, "", " ", "a", "A", "é", "é", "x" * 200_000, "\U0001F600", "line\nline"]
    rows = [(i, rng.choice(texts) if i % 3 else "the hot text") for i in range(n)]
    return rows + [(None, "a"), (None, "only null ids"), (None, "only null ids"), rows[5], rows[5], (7, "z"), (7, "z")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_largest_id_stays(spark):
    rows = corpus()
    got = digest_index.keep_largest(frame(spark, rows).repartition(5), fresh_index(spark)).collect()
    want, groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got), key=repr) == sorted(want, key=repr)
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({bytes(r.digest) for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_deliveries_keep_what_came_first(spark):
    index = fresh_index(spark)
    one = frame(spark, [(1, "a"), (2, "a"), (3, "b")])
    two = frame(spark, [(9, "a"), (8, "c"), (7, "c"), (6, None)])
    first = sorted(map(tuple, digest_index.new_documents(one, index, "one").collect()))
    assert first == [(2, "a"), (3, "b")]
    second = sorted(map(tuple, digest_index.new_documents(two, index, "two").collect()), key=repr)
    assert second == [(6, None), (8, "c")]
    # a delivery that runs again gives the same documents and adds nothing
    before = sorted(map(repr, index.frame().collect()))
    assert sorted(map(tuple, digest_index.new_documents(one, index, "one").collect())) == first
    assert sorted(map(tuple, digest_index.new_documents(two, index, "two").collect()), key=repr) == second
    assert sorted(map(repr, index.frame().collect())) == before and len(before) == 4
    # opened by its folder, and after merging its files
    again = DigestIndex.open(spark, index.path)
    assert again.buckets == 4 and sorted(map(repr, again.frame().collect())) == before
    again.compact()
    third = DigestIndex.open(spark, index.path)
    assert sorted(map(repr, third.frame().collect())) == before
    assert third.missing(digest_index.digest_rows(two, "three").select("id", "digest")).count() == 0
    assert digest_index.new_documents(frame(spark, [(1, "c"), (2, "d")]), third, "three").collect()[0].text == "d"


def test_rows_repeated_whole_and_other_columns(spark):
    docs = spark.createDataFrame([(None, "a", 1, "x"), (None, "a", 1, "x"), (None, "a", 2, "x"), (5, "b", 1, "y"),
                                  (5, "b", 1, "y"), (5, "b", 2, "z"), (4, "b", 9, "z")],
                                 "doc_id long, text string, digest int, _w_id string")
    got = digest_index.new_documents(docs, fresh_index(spark), "d").collect()
    assert [r.asDict().keys() for r in got] == [dict.fromkeys(docs.columns).keys()] * 2
    assert sorted((r.text, r.doc_id) for r in got) == [("a", None), ("b", 5)]
    assert digest_index.new_documents(docs.limit(0), fresh_index(spark), "d").count() == 0
    index = fresh_index(spark)
    assert digest_index.keep_largest(docs.limit(0), index).count() == 0 and index.frame().count() == 0


def test_index_is_joined_without_an_exchange_of_it(spark):
    index = fresh_index(spark, buckets=8)
    index.append(digest_index.digest_rows(frame(spark, corpus()), "d"), "d")
    plan = index.missing(digest_index.digest_rows(frame(spark, corpus(2)), "e"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t")], "doc_id string, text string")
    index = DigestIndex.create(spark, stage_path(spark, "test-index"), "string", 2)
    assert [r.doc_id for r in digest_index.new_documents(docs, index, "d").collect()] == ["b"]
    assert index.frame().select(F.length("digest")).first()[0] == 32
