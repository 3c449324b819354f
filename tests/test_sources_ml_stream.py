import os
import uuid

import pytest
from pyspark.sql import functions as F

from support import SF_SMALL, rows
from weekcast.functions import calendar as cal
from weekcast.operators import ml
from weekcast.plans import datasets as ds
from weekcast.sources import files, jdbc, sinks


def test_csv_round_trip(spark, tmp_path):
    ws = ds.weekly_sales(spark, SF_SMALL)
    out = str(tmp_path / "ws")
    sinks.write_csv(ws.toDF("REGIONID", "PRODUCT", "YEARWEEK", "QTY"), out)
    back = files.typed(files.load_csv(spark, out, "sellout"), "sellout")
    assert back.count() == ws.count()
    assert back.agg(F.sum("QTY")).first()[0] == ws.agg(F.sum("qty")).first()[0]
    sinks.write_csv(back, out, mode="append", single_file=True)
    assert files.load_csv(spark, out, "sellout").count() == 2 * ws.count()


def test_materialize_under_checkpoint_dir(spark):
    df = ds.weekly_sales(spark, SF_SMALL)
    m = sinks.materialize(df, "weekly")
    assert m.count() == df.count()
    assert spark.conf.get("spark.checkpoint.dir") in m.inputFiles()[0]


def test_stages_are_removed_by_age(spark):
    path = sinks.materialize(spark.range(3), "old").inputFiles()[0]
    sinks.remove_stages(spark, older_than_hours=1)
    assert os.path.exists(path.removeprefix("file://"))


def test_jdbc_options():
    o = jdbc.read_options("jdbc:postgresql://h/db", "t", user="u", password="p",
                          partition_column="id", lower_bound=0, upper_bound=100, num_partitions=8)
    assert o["driver"] == "org.postgresql.Driver" and o["numPartitions"] == "8"
    assert jdbc.read_options("jdbc:oracle:thin:@h:1521/x", "t", single_connection=True)["driver"] \
        == "oracle.jdbc.OracleDriver"
    with pytest.raises(ValueError):  # a whole table through one connection is asked for
        jdbc.read_options("jdbc:oracle:thin:@h:1521/x", "t")
    with pytest.raises(ValueError):
        jdbc.read_options("jdbc:postgresql://h/db", "t", partition_column="id")
    w = jdbc.write_options("jdbc:postgresql://h/db", "t", batch_size=500)
    assert w["batchsize"] == "500" and w["truncate"] == "true"


def test_decision_tree_and_metrics(spark):
    inp = ds.dt_input(spark, SF_SMALL)
    train, test = ml.split_by_week(inp, "yearweek", 199952)
    pred = ml.fit_predict(ml.decision_tree_model(), train, test)
    assert pred.count() == test.count()
    m = ml.evaluate(pred)
    twin = ml.regression_metrics(pred).first()
    assert abs(m["rmse"] - twin.rmse) < 1e-9 and abs(m["mae"] - twin.mae) < 1e-9


def test_kmeans(spark):
    seg = ml.kmeans_segments(ds.student_like(spark, SF_SMALL), ["sw", "db", "and"], k=2)
    assert {r.prediction for r in seg.select("prediction").distinct().collect()} <= {0, 1}


def test_stream_equals_batch_for_files_in_any_order(spark, tmp_path):
    """Line files that are not ordered by ship date arrive twice, with a stop in between: the
    current sums equal the batch aggregate of all files seen, late lines included."""
    from weekcast.streaming import current_weekly_sales, start_weekly_sales
    li = spark.read.parquet(os.path.join(SF_SMALL, "lineitem.parquet"))
    src, out = tmp_path / "lineitem", str(tmp_path / "out")
    half = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(2))
    name = f"ws_{uuid.uuid4().hex[:8]}"  # a stream resumes from its name's checkpoint

    def arrive(folder, part):
        li.filter(half == part).repartition(3).write.parquet(str(src / folder))
        q = start_weekly_sales(spark, str(src / "*"), SF_SMALL, out, name=name, trigger_once=True)
        q.awaitTermination(300)
        return current_weekly_sales(spark, out)

    first = arrive("a", 0)
    assert 0 < first.agg(F.sum("qty")).first()[0] < li.agg(F.sum("l_quantity")).first()[0]
    assert rows(arrive("b", 1)) == rows(ds.weekly_sales(spark, SF_SMALL))


def test_kmeans_rejects_null_features(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (5.0, 5.0)], "a double, b double")
    with pytest.raises(Exception):
        ml.kmeans_segments(df, ["a", "b"]).collect()


def test_sink_modes_and_partitioned_parquet(spark, tmp_path):
    df = ds.weekly_sales(spark, SF_SMALL)
    out = str(tmp_path / "ws_parquet")
    sinks.write_parquet(df, out, partition_by=["regionid"])
    back = spark.read.parquet(out)
    assert back.count() == df.count()
    assert back.filter("regionid = 'ASIA'").count() == df.filter("regionid = 'ASIA'").count()
    with pytest.raises(ValueError):
        sinks.write_csv(df, str(tmp_path / "x"), mode="upsert")
    with pytest.raises(ValueError):
        jdbc.write_table(df, "jdbc:postgresql://h/db", "t", mode="upsert")
