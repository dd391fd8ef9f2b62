import pytest
from pyspark.sql import functions as F

from fixtura.operators import checks, lags, opponent, priors
from fixtura.plans.panel import build, featured, labelled

from .helpers import event, raises, rows


def by_fixture(df, *names):
    return {r["fixture"]: tuple(r[n] for n in names) for r in df.collect()}


def test_lags(spark):
    df = rows(spark, event(1, 1, minutes=90), event(2, 2, minutes=10), event(3, 3, minutes=45))
    got = by_fixture(lags.add_lags(df, ["minutes"]), "minutes_l1", "minutes_r3")
    assert got == {1: (None, None), 2: (90, 90), 3: (10, 50)}


def test_double_event_rows_agree(spark):
    df = rows(spark, event(1, 10, minutes=90, total_points=6), event(2, 21, minutes=10, total_points=1), event(2, 22, minutes=80, total_points=8), event(3, 30, minutes=45, total_points=2))
    got = by_fixture(lags.add_lags(df, ["minutes", "total_points"]), "minutes_l1", "minutes_r3", "total_points_l1", "total_points_r3")
    assert got[21] == got[22] == (90, 90, 6, 6) and got[30] == (80, 60, 8, 5)
    assert df.withColumn("f", lags.first_of_event()).where("f").count() == 3


def test_one_exchange_and_sort_serve_all_lags(spark):
    plan = lags.add_lags(rows(spark, event(1, 1)), ["minutes", "total_points"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("+- Sort") <= 2


def test_later_rows_never_reach_features(spark):
    import random

    rng = random.Random(0)
    base = [event(g, g * 10 + f, minutes=rng.randint(0, 90), total_points=rng.randint(0, 15), player_code=p, team=t, position=rng.choice(["GK", "DEF", "MID"])) | {"opponent": o} for p, t, o in (("a", "A", "B"), ("b", "B", "A")) for g in range(1, 9) for f in range(rng.choice([1, 1, 2]))]
    changed = [r if r["GW"] < 5 else r | {"minutes": 90 - r["minutes"], "total_points": 99} for r in base]
    names = ["minutes_l1", "minutes_r3", "minutes_r5", "total_points_l1", "total_points_r5", "opp_xgc_r5", "opp_xgc_home_r5"]
    frame = lambda rs: by_fixture(featured(rows(spark, *[{k: v for k, v in r.items() if k != "opponent"} for r in rs]).withColumn("opponent", F.when(F.col("team") == "A", "B").otherwise("A")), ["minutes", "total_points"]).where("GW <= 5").withColumn("fixture", F.concat_ws("/", "player_code", "fixture")), *names)
    assert frame(base) == frame(changed)


def test_duplicates(spark):
    same = rows(spark, event(1, 1), event(1, 1))
    key = ["season", "GW", "player_code", "fixture"]
    assert checks.conflicting_duplicates(same, key).count() == 0 and checks.drop_exact_duplicates(same, key).count() == 1
    with pytest.raises(checks.CheckFailed, match="rows of one key differ"):
        checks.enforce([checks.conflicting_duplicates(rows(spark, event(1, 1, minutes=90), event(1, 1, minutes=45)), key)])


def test_season_end_form(spark):
    df = rows(spark, *[event(g, g, minutes=m, total_points=p) for g, m, p in ((35, 90, 7), (36, 90, 11), (37, 90, 9), (38, 0, 0))])
    r = priors.end_form(df, ["minutes", "total_points"]).first()
    assert (r["window_from"], r["window_to"], r["minutes_l1"], r["total_points_l1"]) == (35, 37, 90, 9)
    assert priors.end_totals(df).first()["prior_games"] == 3
    never = priors.end_form(rows(spark, event(1, 1, minutes=0, total_points=0)), ["minutes"]).first()
    assert never["minutes_l1"] == 0


def test_first_event_carries_over(spark):
    old = [event(g, g, season="2023-24", total_points=p) for g, p in ((36, 8), (37, 6), (38, 10))]
    df = rows(spark, *old, event(1, 1, total_points=2), event(2, 2, total_points=3), event(1, 5, player_code="new"))
    out = priors.first_event_override(lags.add_lags(df, ["minutes", "total_points"]), df, ["minutes", "total_points"])
    got = {(r["season"], r["GW"], r["player_code"]): (r["total_points_l1"], r["total_points_r3"], r["minutes_l1"]) for r in out.collect()}
    assert got["2024-25", 1, "p"] == (10, 8, 90) and got["2024-25", 2, "p"][0] == 2 and got["2024-25", 1, "new"] == (None, None, None)


def test_prior_totals(spark):
    df = rows(spark, event(1, 1, season="2023-24", minutes=90, total_points=6), event(2, 2, season="2023-24", minutes=0, total_points=0), event(1, 1), event(1, 2, player_code="new"))
    got = {(r["season"], r["player_code"], r["fixture"]): (r["is_new"], r["prior_games"], r["prior_ppg"]) for r in priors.join_prior(df).collect()}
    assert got["2024-25", "p", 1] == (0, 1, 6) and got["2024-25", "new", 2] == (1, 0, 0) and got["2023-24", "p", 1] == (1, 0, 0)


def test_orders_shift_by_a_season(spark):
    df = rows(spark, event(1, 1, season="2023-24"), event(2, 2, season="2023-24"), event(1, 1), event(1, 3, player_code="p2"))
    df = df.withColumn("penalties_order", F.when((F.col("season") == "2023-24") & (F.col("GW") == 2), 1.0).when(F.col("season") == "2024-25", 3.0))
    got = {(r["season"], r["player_code"], r["fixture"]): r["penalties_order"] for r in priors.shifted_orders(df, ["penalties_order"]).collect()}
    assert got == {("2023-24", "p", 1): 0, ("2023-24", "p", 2): 0, ("2024-25", "p", 1): 1, ("2024-25", "p2", 3): 0}
    told = spark.createDataFrame([("p", 2.0), ("p", 1.0)], "player_code string, penalties_order double")
    assert {r["penalties_order"] for r in priors.attach_orders(df, told, ["penalties_order"]).where("player_code = 'p'").collect()} == {1.0}
    registry = spark.createDataFrame([("2024-25", 7, 4.0)], "season string, element int, penalties_order double")
    kept = priors.set_piece_orders(df.withColumn("element", F.lit(7)), registry, ["penalties_order", "corners_order"]).where("season = '2024-25'").first()
    assert (kept["penalties_order"], kept["corners_order"]) == (4, None)


def opponents(spark):
    made = []
    for g, conceded in ((1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0)):
        made.append(event(g, g, team="B", player_code="kb", position="GK", was_home=g in (1, 3), expected_goals_conceded=conceded))
        made.append(event(g, g, team="A", player_code="ka", position="GK", was_home=g in (2, 4), expected_goals_conceded=1.0))
    return rows(spark, *made).withColumn("opponent", F.when(F.col("team") == "A", "B").otherwise("A"))


def test_opponent_rolls(spark):
    df = opponents(spark)
    teams = opponent.team_conceded(df)
    out = {(r["team"], r["GW"]): (r["opp_xgc_r5"], r["opp_xgc_home_r5"], r["opp_xgc_away_r5"]) for r in opponent.join_opponent(df, opponent.rolls(teams)).collect()}
    assert out["A", 3] == (15, 10, 20) and out["A", 1] == (0, 0, 0)
    ends = {r["team"]: (r["xgc_r5"], r["xgc_home_r5"], r["xgc_away_r5"]) for r in opponent.next_event(teams).collect()}
    assert ends["B"] == (25, 20, 30)
    live = spark.createDataFrame([("B",), ("nobody",)], "opponent_name string")
    got = {r["opponent_name"]: r["opp_xgc_r5"] for r in opponent.join_opponent_end(live, opponent.next_event(teams)).collect()}
    assert got == {"B": 25, "nobody": 0}
    assert {(r["team"], r["opponent"]) for r in opponent.opponents_by_side(df.drop("opponent")).collect()} == {("A", "B"), ("B", "A")}


def test_keepers_come_first(spark):
    both = rows(spark, event(1, 1, player_code="g", position="GK", expected_goals_conceded=9.0), event(1, 1, player_code="d", position="DEF", expected_goals_conceded=0.1))
    none = rows(spark, event(1, 1, player_code="m", expected_goals_conceded=2.0), event(1, 1, player_code="d", position="DEF", expected_goals_conceded=4.0))
    assert opponent.team_conceded(both).first()["xgc"] == 9 and opponent.team_conceded(none).first()["xgc"] == 3
    assert opponent.team_conceded(rows(spark, event(1, 1, minutes=0))).first()["xgc"] == 0


def test_opponent_ids_become_names(spark):
    df = rows(spark, event(1, 1)).withColumn("opponent_team", F.lit("2"))
    teams = spark.createDataFrame([("2024-25", 2, "B")], "season string, id int, name string")
    assert opponent.opponent_names(df, teams).first()["opponent"] == "B"
    assert opponent.opponent_names(df.withColumn("opponent_team", F.lit("B")), teams).first()["opponent"] == "B"


def test_target_form(spark):
    df = rows(spark, event(1, 1, minutes=90), event(2, 2, minutes=45), event(5, 5, minutes=0)).withColumn("element", F.lit(101))
    targets = spark.createDataFrame([(101, 6), (102, 6)], "element int, GW int")
    got = {r["element"]: (r["minutes_l1"], r["minutes_r3"]) for r in lags.form_at(df, targets, ["minutes"]).collect()}
    assert got == {101: (0, 45), 102: (0, 0)}


def test_build(spark):
    raw = rows(spark, event(1, 1), event(1, 1), event(2, 2, player_code="q", minutes=10)).drop("player_code", "defcon_hit", "started").withColumn("element", F.col("fixture")).withColumn("opponent", F.lit("B"))
    players = spark.createDataFrame([("2024-25", 1, 77)], "season string, element int, code int")
    fixtures = spark.createDataFrame([("2024-25", 1, 2, 4)], "season string, id int, team_h_difficulty int, team_a_difficulty int")
    got = {r["player_code"]: (r["fdr"], r["is_new"], r["defcon_hit"]) for r in build(raw, players, fixtures, ["minutes"]).collect()}
    assert got == {"77": (4, 1, None), "2024-25:2": (None, 1, None)}
    with pytest.raises(checks.CheckFailed, match="many-to-one"):
        build(raw, players.unionByName(players), fixtures, ["minutes"])
    assert labelled(raw).first()["xp_is_leaky"] is True


def test_export_contract(spark):
    assert raises("a key occurs more than once", checks.duplicate_keys(rows(spark, event(1, 1), event(1, 1)), ["season", "GW", "player_code", "fixture"]))
    two = rows(spark, event(1, 1), event(1, 2)).withColumn("minutes_l1", F.when(F.col("fixture") == 1, 90.0))
    assert raises("different lags", checks.divergent_lags(two, ["minutes_l1"]))
    with pytest.raises(checks.CheckFailed, match="xP"):
        checks.forbid_columns(["xP", "minutes_l1"], ["xP", "total_points"])
