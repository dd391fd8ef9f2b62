import math

import pytest
from pyspark.sql import functions as F

from fixtura.functions import predicates as P
from fixtura.functions import scalars as S


def one(spark, _expr, **values):
    kinds = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "double"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(_expr.alias("x")).first()["x"]


@pytest.mark.parametrize("position,actions,rec,count,hit", [("DEF", 10.0, 0.0, 10, 1), ("DEF", 9.0, 20.0, 9, 0), ("MID", 8.0, 4.0, 12, 1), ("MID", 8.0, 3.0, 11, 0), ("FWD", 4.0, 8.0, 12, 1), ("mid", 12.0, None, 12, 1), ("GK", 40.0, 40.0, None, 0), ("DEF", None, 1.0, None, None), ("XX", 20.0, 0.0, 20, None)])
def test_labels(spark, position, actions, rec, count, hit):
    df = spark.createDataFrame([(position, actions, rec)], "p string, a double, r double").withColumn("n", S.label_count("p", "a", "r")).withColumn("h", S.label_hit("p", "n"))
    r = df.first()
    assert (r["n"], r["h"]) == (count, hit)


@pytest.mark.parametrize("minutes,chance,p", [(90.0, None, 0.97), (30.0, None, 0.63), (1.0, None, 0.0), (90.0, 25.0, 0.25), (200.0, 100.0, 0.97), (None, None, 0.0)])
def test_play_probability(spark, minutes, chance, p):
    got = spark.createDataFrame([(minutes, chance)], "m double, c double").select(S.play_probability("m", "c").alias("x")).first()["x"]
    assert got == pytest.approx(p)


@pytest.mark.parametrize("status,chance,scale,ok,bad", [("i", 0.0, 0.0, False, True), ("d", 75.0, 0.75, True, False), ("a", None, 1.0, True, False), ("i", None, 0.0, True, True), ("a", 0.0, 0.0, True, True), ("d", 50.0, 0.5, True, True), ("i", 25.0, 0.25, True, True)])
def test_availability(spark, status, chance, scale, ok, bad):
    r = spark.createDataFrame([(status, chance)], "s string, c double").select(S.availability("s", "c").alias("a"), S.eligible("s", "c").alias("e"), S.flagged("s", "c").alias("f")).first()
    assert (r["a"], r["e"], r["f"]) == (scale, ok, bad)


def test_numbers_and_finite(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("nan",), ("inf",), (None,)], "t string").select(S.number("t").alias("n")).withColumn("f", S.finite("n"))
    assert [(r["n"], r["f"]) for r in df.collect()] == [(1.5, True), (None, False), (None, False), (math.inf, False), (None, False)]


def test_coerce_fills_event_and_round(spark):
    df = S.coerce(spark.createDataFrame([("3", None), (None, "4"), ("x", "5")], "GW string, round string"), ["GW", "round"])
    assert [(r["GW"], r["round"]) for r in df.collect()] == [(3, 3), (4, 4), (5, 5)]
    assert S.coerce(spark.createDataFrame([("2",)], "round string"), ["round"]).first()["GW"] == 2


def test_times_and_seasons(spark):
    df = spark.createDataFrame([("2025-09-25T00:00:00Z",), ("2025-09-25T02:00:00+02:00",), ("2025-09-25T00:00:00",), ("soon Z",)], "t string").select(S.utc("t").alias("u"))
    got = [r["u"] for r in df.collect()]
    assert got[0] == got[1] and got[0] is not None and got[2] is None and got[3] is None
    seasons = spark.createDataFrame([("2024-25",), ("2000-01",), ("1999-00",), ("2024-26",), ("2024",)], "s string").select(S.previous_season("s").alias("p"))
    assert [r["p"] for r in seasons.collect()] == ["2023-24", "1999-00", "1998-99", None, None]


def test_difficulty_both_ways(spark):
    df = spark.createDataFrame([(True, 2, 4), (False, 2, 4)], "h boolean, a int, b int")
    assert [r["x"] for r in df.select(S.fixture_difficulty("h", "a", "b").alias("x")).collect()] == [4, 2]
    assert [r["x"] for r in df.select(S.fixture_difficulty("h", "a", "b", "home").alias("x")).collect()] == [2, 4]


def test_blend_lift_and_intervals(spark):
    c = F.col
    df = spark.createDataFrame([(40.0, "a", 30.0, 38.0, 1.0, 85.0), (0.0, "a", 30.0, 38.0, 1.0, 85.0), (40.0, "d", 30.0, 38.0, 1.0, 85.0)], "raw double, s string, ps double, pg double, l1 double, pm double")
    df = df.withColumn("b", S.blended_minutes(c("raw"), c("s"), c("ps"), c("pg"), c("l1"), c("pm"))).withColumn("lift", S.minutes_lift(c("b"), c("raw")))
    assert [(r["b"], r["lift"]) for r in df.collect()] == [(85, 2.0), (85, 1.0), (40, 1.0)]
    q = spark.createDataFrame([(10.0, 90.0, 0.25), (6.0, 45.0, 0.1), (4.0, 0.0, 0.4)], "hi double, m double, d double")
    made = S.interval_columns(F.lit(0.0), c("hi"), 0.0, 0.0, F.lit(1.0), F.lit(1.0), c("m"), c("d"))
    assert [r["x"] for r in q.select(made["e_points_p90"].alias("x")).collect()] == pytest.approx([10.5, 3.2, 0.8])


def test_weighted_points(spark):
    values = {"passing_yards": 250.0, "passing_tds": 2.0, "interceptions": 1.0, "rushing_yards": 20.0, "rushing_tds": 0.0, "receptions": 0.0, "receiving_yards": 0.0, "receiving_tds": 0.0, "fumbles_lost": 0.0}
    assert one(spark, S.weighted_points(), **values) == 18.0
    assert one(spark, S.weighted_points(), **(values | {"receptions": None})) is None


@pytest.mark.parametrize("limit,made,left", [(3, 0, 3), (3, 2, 1), (2, 2, 0), (0, 0, 0), (1, 2, 0), (-1, 0, None)])
def test_free_transfers(spark, limit, made, left):
    assert one(spark, S.free_transfers("a", "b", F.lit(None).cast("string")), a=limit, b=made) == left


def test_small_text_expressions(spark):
    assert one(spark, S.slug("n"), n="  Éa -- Ñb! ") == "ea-nb"
    assert one(spark, S.slug("n"), n="Šeško Ǆ Øl ﬁn") == "sesko-dz-l-fin" and one(spark, S.slug("n"), n="Ω") == ""
    assert one(spark, S.fixture_text("h", "o"), h=False, o="X") == "@ X"
    assert one(spark, S.event_status("f", "d", "c"), f=True, d=False, c=False) == "review"
    assert one(spark, S.position_name("p"), p=3) == "MID" and one(spark, S.position_name("p"), p=9) is None
    picks = spark.sql("select array(named_struct('web_name','A','is_captain',false,'multiplier',1), named_struct('web_name','B','is_captain',true,'multiplier',3)) as p")
    assert picks.select(S.captain_label("p").alias("x")).first()["x"] == "B (TC)"
    assert spark.sql("select array(named_struct('web_name','A','is_captain',false,'multiplier',1)) as p").select(S.captain_label("p").alias("x")).first()["x"] == "-"


def test_feature_names_and_zero_fill(spark):
    df = spark.createDataFrame([(1, None, "x", 2.0, None)], "value int, minutes_l1 double, name_l1 string, total_points double, prior_games int")
    assert S.feature_names(df, {"total_points"}, {"value"}) == ["minutes_l1", "value"]
    r = S.zero_filled(df, ["minutes_l1", "goals_r3"]).first()
    assert (r["minutes_l1"], r["goals_r3"], r["prior_games"]) == (0, 0, 0)


def test_scaled_calibration(spark):
    df = spark.createDataFrame([(0.4, 1.0, "MID"), (0.4, 0.5, "DEF"), (0.4, 0.0, "MID"), (0.4, 0.8, "GK")], "p double, s double, q string")
    got = [r["x"] for r in df.select(S.rescaled(S.unscaled(F.col("p") * F.col("s"), F.col("s")), F.col("s"), F.col("q")).alias("x")).collect()]
    assert got == pytest.approx([0.4, 0.2, 0, 0])


def test_pool_and_masks(spark):
    df = spark.createDataFrame([(1, "a", None, False), (2, "i", 0.0, False), (3, "i", 0.0, True), (4, "d", 50.0, None)], "id int, status string, chance double, owned boolean")
    assert [r["id"] for r in df.where(P.buyable(chance="chance")).collect()] == [1, 3]
    nums = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, float("nan")), (3.0, 4.0)], "a double, b double")
    assert nums.where(P.all_finite("a", "b")).count() == 2 and nums.where(P.common_played(["a"], None)).count() == 0
