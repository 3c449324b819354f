import pytest
from pyspark.sql import functions as F

from support import rows
from weekcast.operators import clean, joins
from weekcast.sources import files


def test_null_fill_subset(spark):
    df = spark.createDataFrame([(None, None, "a")], "VOLUME double, TARGET double, R string")
    out = clean.fill_nulls(df, 0.0, ["VOLUME"]).collect()[0]
    assert (out.VOLUME, out.TARGET) == (0.0, None)
    # a string fill value only touches string columns
    s = spark.createDataFrame([(None, None)], "A double, B string")
    r = clean.fill_nulls(s, "0").collect()[0]
    assert (r.A, r.B) == (None, "0")


def test_null_filters(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 4.0)], "v double, t double")
    assert clean.rows_with_nulls(df).count() == 2
    assert rows(clean.rows_without_nulls(df)) == [(3.0, 4.0)]
    assert df.filter(clean.null_at_position(df, -1)).count() == 1


def test_clamps_and_week_filters(spark):
    df = spark.createDataFrame([("201552", -5.0), ("201553", 800000.0), ("2016041", 10.0)],
                               "yearweek string, qty double")
    c = clean.clamp_column(df, "qty", 0.0, 700000.0)
    assert rows(c, "qty") == [(0.0,), (10.0,), (700000.0,)]
    assert rows(clean.valid_week(df), "yearweek") == [("201552",), ("2016041",)]
    assert rows(df.filter(clean.key_length_ok()), "yearweek") == [("201552",), ("201553",)]
    assert clean.drop_long_keys(df).count() == 2


def test_params_filter_wildcards(spark):
    df = spark.createDataFrame([("A01", "ST1"), ("A02", "ST2"), ("A03", "ST3")],
                               "r string, p string")
    schema = "CATEGORY string, NAME string, VALUE string"
    p1 = spark.createDataFrame([("COMMON", "VALID_REGION", "A01"),
                                ("COMMON", "VALID_PRODUCT", "ST2")], schema)
    assert rows(clean.params_filter(df, p1, "r", "p"), "r") == [("A01",), ("A02",)]
    assert clean.params_filter(df, p1, "r", "p", combine="and").count() == 0
    p2 = spark.createDataFrame([("COMMON", "VALID_REGION", "ALL"),
                                ("COMMON", "VALID_PRODUCT", "ST2")], schema)
    assert clean.params_filter(df, p2, "r", "p", combine="and").count() == 1
    p3 = spark.createDataFrame([("OTHER", "X", "Y")], schema)  # nothing set: keep all
    assert clean.params_filter(df, p3, "r", "p").count() == 3


def test_overlay_first_last_fanout(spark):
    left = spark.createDataFrame([(" A ",), ("B",)], "k string")
    right = spark.createDataFrame([("A", "X", 1), ("A ", "Y", 2)], "k string, v string, o int")
    first = joins.lookup(left, right, ["k"], ["k"], "v", ["o"], default=F.trim(left.k),
                         pick="first", trim=True)
    last = joins.lookup(left, right, ["k"], ["k"], "v", ["o"], default=F.trim(left.k),
                        pick="last", trim=True)
    assert rows(first, "v") == [("B",), ("X",)]
    assert rows(last, "v") == [("B",), ("Y",)]
    fan = joins.overlay_fanout(left, right, "k", "k", "v", out="u")
    assert rows(fan, "u", "u_nvl2") == [("B", "B"), ("X", "X"), ("Y", "Y")]


def test_lookup_default_and_no_fanout(spark):
    left = spark.createDataFrame([("a", "w1"), ("a", "w2"), ("b", "w1")], "acc string, wk string")
    right = spark.createDataFrame([("a", "w1", 0.1, 2), ("a", "w1", 0.3, 1)],
                                  "acc string, wk string, pct double, ord int")
    out = joins.lookup(left, right, ["acc", "wk"], ["acc", "wk"], "pct", ["ord"], default=0.0)
    assert rows(out) == [("a", "w1", 0.3), ("a", "w2", 0.0), ("b", "w1", 0.0)]


def test_master_join_kinds(spark):
    facts = spark.createDataFrame([("R1", 1.0), ("R2", 2.0)], "regionid string, qty double")
    master = spark.createDataFrame([("R1", "one"), ("R3", "three")],
                                   "regionid string, regionname string")
    n = {h: joins.join_master(facts, master, "regionid", "regionid", h).count()
         for h in ("inner", "left", "right")}
    assert n == {"inner": 1, "left": 2, "right": 2}


def test_malformed_csv(spark, tmp_path):
    p = tmp_path / "vol.csv"
    p.write_text("REGIONID,PRODUCTGROUP,YEARWEEK,VOLUME\n"
                 "A01,ST1,201601,\n"
                 "A01,ST1,201602\n"
                 "A01,ST1,201603,5,extra\n"
                 "A01,ST1,2016041,7\n"
                 "A01,ST1,201605,12.5x\n")
    raw = files.load_csv(spark, str(p), "product_volume")
    typed = files.typed(raw, "product_volume")
    got = rows(typed, "YEARWEEK", "VOLUME")
    assert got == [("201601", None), ("201602", None), ("201603", 5.0), ("2016041", 7.0),
                   ("201605", None)]
    bad = {r.YEARWEEK: r._reject_reason for r in files.rejects(raw, "product_volume").collect()}
    assert set(bad) == {"2016041", "201605"}
    # rows of the wrong field count are reported when their lines are kept
    whole = files.load_csv(spark, str(p), "product_volume", keep_corrupt=True)
    assert rows(whole.drop(files.CORRUPT)) == rows(raw)
    bad = {r.YEARWEEK: r._reject_reason for r in files.rejects(whole, "product_volume").collect()}
    assert set(bad) == {"2016041", "201605", "201602", "201603"}
    assert bad["201602"] == bad["201603"] == "wrong number of fields"
    with pytest.raises(ValueError):
        files.load_csv(spark, str(p), "product_volume", Delimeter=",")
    with pytest.raises(ValueError):
        files.require_columns(raw, ["PLANWEE"])


def test_csv_columns_go_by_header_name(spark, tmp_path):
    p = tmp_path / "sellout.csv"
    p.write_text("Product,REGIONID,Qty,YearWeek,EXTRA\nP1,R1,5,201601,x\n")
    got = files.typed(files.load_csv(spark, str(p), "sellout"), "sellout")
    assert [tuple(r) for r in got.select("REGIONID", "PRODUCT", "YEARWEEK", "QTY").collect()] == \
        [("R1", "P1", "201601", 5.0)]
    assert got.columns == ["REGIONID", "PRODUCT", "YEARWEEK", "QTY"]
    q = tmp_path / "short.csv"
    q.write_text("PRODUCT,REGIONID,QTY\nP1,R1,5\n")
    with pytest.raises(ValueError):
        files.load_csv(spark, str(q), "sellout")
    bare = tmp_path / "bare.csv"
    bare.write_text("R1,P1,201601,5\n")
    assert rows(files.load_csv(spark, str(bare), "sellout", header=False)) == [("R1", "P1", "201601", "5")]


def test_files_with_different_headers_are_not_mixed(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    (d / "a.csv").write_text("REGIONID,PRODUCT,YEARWEEK,QTY\nR1,P1,201601,5\n")
    (d / "b.csv").write_text("PRODUCT,REGIONID,YEARWEEK,QTY\nP1,R1,201601,5\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.load_csv(spark, str(d), "sellout").collect()


def test_typed_view_of_lower_case_frames(spark):
    df = spark.createDataFrame([("R", "P", "201601", "5x")],
                               "regionid string, product string, yearweek string, qty string")
    t = files.typed(df, "sellout")
    assert len(t.columns) == 4 and t.first()[3] is None
