"""Mixing: targets with null, equal and repeated rows; unequal inclusion odds."""

import random

import pytest
from pyspark.sql import functions as F

from weekcast.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def taken_of(spark, rows):
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(out) == len(rows)
    assert all(r.taken <= 3 * r.size for r in out)
    sums = {}
    for r in out:
        have = sums.setdefault(r.source, [0, r.target])
        have[0] += r.taken
    return out, sums


@pytest.mark.parametrize("ids", ["null", "equal", "whole"])
def test_rows_without_ids_of_their_own(spark, ids):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(5, 15), "a") for i in range(300)]
    for i in range(300):
        text = "same text of six words here" if ids == "whole" else f"w{i} " * 10
        rows.append((None if ids == "null" else 7, text, "b"))
    out, sums = taken_of(spark, rows)
    for source, (taken, target) in sums.items():
        assert abs(taken - target) <= 0.02 * target, (source, taken, target)
    b = [r for r in out if r.source == "b"]
    assert len({r.taken for r in b}) == 2  # some rows of one id are taken, others are not
    again, _ = taken_of(spark, rows[::-1])
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_longer_documents_have_higher_odds(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([4, 60, 900]), "a") for i in range(600)] + [(1000 + i, "w " * 2000, "b") for i in range(40)]
    out, sums = taken_of(spark, rows)
    share = {n: [r.copies > 0 for r in out if r.source == "a" and r.size == n] for n in (4, 60, 900)}
    share = {n: sum(x) / len(x) for n, x in share.items()}
    assert 0 < share[4] < share[60] < share[900]
    # expected copies are in proportion to the digits of the size, where none is capped
    rates = {r["class"]: r.whole + r.p for r in mixing.class_rates(
        spark.createDataFrame([(r.size, False, r.source, len(bin(r.size)) - 2) for r in out],
                              "size long, src_null boolean, src string, class int"),
        spark.createDataFrame([(False, "a", 1, sums["a"][1]), (False, "b", 1, sums["b"][1])],
                              "src_null boolean, src string, source_size long, target double")).filter("src = 'a'").collect()}
    assert rates[10] / rates[3] == pytest.approx(10 / 3) and rates[6] / rates[3] == pytest.approx(2)
    assert sum(rates[len(bin(r.size)) - 2] * r.size for r in out if r.source == "a") == pytest.approx(sums["a"][1])


def test_the_odds_change_the_order(spark):
    """Documents are not taken in the order of their random numbers alone."""
    rng = random.Random(5)
    rows = [(i, "w " * (2 if i % 2 else 300), "a") for i in range(400)] + [(900 + i, "w " * 3000, "b") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    u = {r.doc_id: r.u for r in df.select("doc_id", mixing.uniform(
        mixing.row_key(F.col("doc_id"), F.col("text"), F.col("source")), F.lit(0), "mix").alias("u")).collect()}
    out = [r for r in mixing.mix(df).collect() if r.source == "a"]
    most = min(r.copies for r in out)
    extra = [u[r.doc_id] for r in out if r.copies > most]
    none = [u[r.doc_id] for r in out if r.copies == most]
    assert max(extra) > min(none)
    long = [r.copies > 0 for r in out if r.size == 300]
    short = [r.copies > 0 for r in out if r.size == 2]
    assert sum(long) > sum(short) > 0
    rng.shuffle(rows)


def test_caps_and_odd_sources(spark):
    rows = [(1, None, "empty"), (2, "", "empty"), (3, "a b c", "tiny"), (4, "w " * 5000, "big"), (5, "x " * 5000, None),
            (6, "y " * 10, "")]
    out, sums = taken_of(spark, rows)
    assert sums["empty"] == [0, 0.0]
    assert {r.source: r.taken for r in out}["tiny"] == 9  # three times its size
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "a")], SCHEMA)).first().taken == 0
    clash = spark.createDataFrame([(1, "a b", "s", 1, 2.0)], SCHEMA + ", class int, t double")
    assert mixing.mix(clash).first().size == 2
