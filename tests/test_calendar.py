import datetime as dt
import random

from pyspark.sql import functions as F

from weekcast.functions import calendar as cal


def _py_add(yw, g):
    y, w = int(yw[:4]), int(yw[4:])
    d = dt.date.fromisocalendar(y, w, 1) + dt.timedelta(weeks=g)
    iy, iw, _ = d.isocalendar()
    return f"{iy:04d}{iw:02d}"


def test_week_add_fixtures(spark):
    df = spark.createDataFrame([("200352", 53), ("201401", 110), ("201553", 1), ("201627", -20),
                                ("201501", 52)], "yw string, g int")
    got = {r.yw: r.r for r in df.select("yw", cal.week_add("yw", F.col("g")).alias("r"))
           .collect()}
    assert got == {"200352": "200453", "201401": "201606", "201553": "201601",
                   "201627": "201607", "201501": "201553"}


def test_weeks_in_year(spark):
    df = spark.createDataFrame([(y,) for y in (2004, 2009, 2015, 2016, 2020, 2021)], "y int")
    got = {r.y: r.n for r in df.select("y", cal.weeks_in_year(F.col("y")).alias("n")).collect()}
    assert got == {2004: 53, 2009: 53, 2015: 53, 2016: 52, 2020: 53, 2021: 52}


def test_week_add_matches_iso_model_and_round_trips(spark):
    rnd = random.Random(7)
    cases = []
    for _ in range(3000):
        y = rnd.randint(2000, 2030)
        w = rnd.randint(1, 53 if dt.date(y, 12, 28).isocalendar()[1] == 53 else 52)
        cases.append((f"{y}{w:02d}", rnd.randint(-260, 260)))
    df = spark.createDataFrame(cases, "yw string, g int")
    out = df.select("yw", "g", cal.week_add("yw", F.col("g")).alias("r"))
    out = out.select("yw", "g", "r", cal.week_add("r", -F.col("g")).alias("back"),
                     cal.weeks_between("yw", "r").alias("between"))
    for r in out.collect():
        assert r.r == _py_add(r.yw, r.g)
        assert r.back == r.yw
        assert r.between == r.g


def test_yearweek_and_monday_of_dates(spark):
    df = spark.createDataFrame([(dt.date(2016, 1, 1),), (dt.date(2015, 12, 28),),
                                (dt.date(2019, 12, 30),)], "d date")
    got = [(r.yw, r.m) for r in df.select(cal.yearweek("d").alias("yw"),
                                          cal.week_start("d").alias("m")).orderBy("d").collect()]
    assert got == [("201553", dt.date(2015, 12, 28)), ("201553", dt.date(2015, 12, 28)),
                   ("202001", dt.date(2019, 12, 30))]


def test_malformed_week_keys_give_null(spark):
    bad = ["", "2016ab", None, "201660", "201600", "20163", "2016-1", "201699", "201453", "2016011",
           "000001"]
    df = spark.createDataFrame([(x,) for x in bad], "yw string")
    assert all(r.m is None for r in df.select(cal.monday("yw").alias("m")).collect())


def test_week_53_only_where_the_year_has_it(spark):
    df = spark.createDataFrame([("201553",), ("201653",), ("202053",)], "yw string")
    got = {r.yw: r.m for r in df.select("yw", cal.monday("yw").alias("m")).collect()}
    assert got == {"201553": dt.date(2015, 12, 28), "201653": None, "202053": dt.date(2020, 12, 28)}


def test_wing_length():
    assert cal.wing_length(17) == 8 and cal.wing_length(5) == 2
    import pytest
    with pytest.raises(ValueError):
        cal.wing_length(4)


def test_hundredths_half_up_matches_decimal(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from weekcast.functions import scalar as sc
    rnd = random.Random(11)
    cases = [(rnd.randint(0, 10**9), rnd.randint(1, 10**5)) for _ in range(4000)]
    cases += [(1, 8), (5, 200), (125, 1000), (3, 2), (0, 7)]  # exact ties and zero
    from weekcast.functions.scalar import half_up_div
    odd = spark.createDataFrame([(2.5, 1), (0.9, 1), (-2.5, 1), (0.005, 1), (-0.005, 1), (1.0, 3)],
                                "n double, d long")
    assert [r.h for r in odd.select(sc.hundredths_half_up("n", "d").alias("h")).collect()] == \
        [250, 90, -250, 1, 0, 33]
    big = spark.createDataFrame([(2**62 + 1, 3)], "n long, d long")
    r = big.select(sc.int_div("n", "d").alias("q"), half_up_div("n", "d").alias("h")).first()
    assert r.q == (2**62 + 1) // 3 and r.h == (2 * (2**62 + 1) + 3) // 6
    df = spark.createDataFrame(cases, "n long, d long")
    out = df.select("n", "d", sc.hundredths_half_up("n", "d").alias("h"),
                    sc.int_div("n", "d").alias("q"))
    for r in out.collect():
        want = int((Decimal(r.n) / Decimal(r.d) * 100).quantize(Decimal(1), ROUND_HALF_UP))
        assert r.h == want and r.q == r.n // r.d
