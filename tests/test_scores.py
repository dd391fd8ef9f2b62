import random

import pytest
from pyspark.sql import functions as F

from fixtura.operators import baselines, checks, intervals, metrics, models
from fixtura.functions.scalars import weighted_points

HISTORY = {"QB_A": ("QB", [18.0, 25.0, 12.0, 18.5]), "RB_A": ("RB", [20.0, 13.5, 19.5, 19.0]), "TE_A": ("TE", [7.5, 5.5, 17.5, 9.0]), "WR_A": ("WR", [11.0, 23.5, 8.5, 24.0])}
FROZEN = {"QB_A": ("QB", 19.2, 1), "QB_NEW": ("QB", 14.5, 1), "RB_A": ("RB", 18.5, 1), "RB_NEW": ("RB", 12.0, 1), "TE_A": ("TE", 8.0, 1), "WR_A": ("WR", 20.0, 1), "WR_DNP": ("WR", 0.0, 0)}


def slice_(spark):
    history = spark.createDataFrame([("2025", w + 1, p, pos, x) for p, (pos, xs) in HISTORY.items() for w, x in enumerate(xs)], "season string, week int, player_id string, position string, points double")
    frozen = spark.createDataFrame([("2025", 5, p, v[0]) for p, v in FROZEN.items()], "season string, week int, player_id string, position string")
    actuals = spark.createDataFrame([("2025", 5, p, v[1], v[2]) for p, v in FROZEN.items()], "season string, week int, player_id string, points double, played int")
    return history, frozen, actuals


def test_football_slice(spark):
    history, frozen, actuals = slice_(spark)
    own = baselines.baselines(frozen, history)
    got = {r["player_id"]: (r["baseline_ewma4"], r["baseline_position_median"]) for r in own.collect()}
    assert got == {"QB_A": (17.768, 18.25), "QB_NEW": (18.25, 18.25), "RB_A": (18.544, 19.25), "RB_NEW": (19.25, 19.25), "TE_A": (10.212, 8.25), "WR_A": (17.4, 17.25), "WR_DNP": (17.25, 17.25)}
    r = metrics.frozen(baselines.with_actuals(own, actuals), "points", ["baseline_ewma4", "baseline_position_median"]).first()
    assert (r["n_frozen"], r["n_played"], r["n_dnp"]) == (7, 6, 1)
    assert (r["mae_baseline_ewma4"], r["rmse_baseline_ewma4"], r["median_ae_baseline_ewma4"]) == (4.934, 7.347429, 2.6)
    assert (r["mae_baseline_position_median"], r["rmse_baseline_position_median"], r["median_ae_baseline_position_median"]) == (4.707143, 7.302421, 2.75)
    assert baselines.evidence(own.select("player_id", "baseline_ewma4"), actuals).count() == 7


def test_ewma_is_the_recursion(spark):
    rng = random.Random(1)
    rows = [(p, w, rng.random() * 30) for p in range(8) for w in range(rng.randint(1, 7))]
    got = {r["player_id"]: r["ewma"] for r in baselines.ewma(spark.createDataFrame(rows, "player_id int, week int, points double"), order=("week",)).collect()}
    for p, v in got.items():
        xs = [x for q, _, x in rows if q == p][-4:]
        e = xs[0]
        for x in xs[1:]:
            e = 0.4 * x + 0.6 * e
        assert v == pytest.approx(e)


def test_frozen_rules(spark):
    from fixtura.functions.scalars import utc

    history, frozen, actuals = slice_(spark)
    key, position = ["season", "week", "player_id"], ["QB", "RB", "WR", "TE"]
    good = [*checks.bad_history(history, F.lit("2025"), F.lit(5)), *checks.bad_snapshot(frozen, position), *checks.bad_actuals(frozen, actuals, key)]
    checks.enforce(good)
    for rule, bad in {
        "frozen week or beyond": checks.bad_history(history.withColumn("week", F.lit(5)), F.lit("2025"), F.lit(5)),
        "another season": checks.bad_history(history, F.lit("2024"), F.lit(5)),
        "one season and week": checks.bad_snapshot(frozen.withColumn("week", F.when(F.col("player_id") == "QB_A", 4).otherwise(5)), position),
        "position is not allowed": checks.bad_snapshot(frozen, ["QB"]),
        "duplicate candidates": checks.bad_snapshot(frozen.unionByName(frozen), position),
        "missing actuals": checks.bad_actuals(frozen, actuals.where("player_id <> 'QB_A'"), key),
        "duplicate actuals": checks.bad_actuals(frozen, actuals.unionByName(actuals), key),
        "must be 0": checks.bad_actuals(frozen, actuals.withColumn("points", F.lit(1.0)), key),
        "non-numeric": checks.bad_actuals(frozen, actuals.withColumn("points", F.lit("x")), key),
    }.items():
        with pytest.raises(checks.CheckFailed, match=rule):
            checks.enforce(bad)
    seen = spark.createDataFrame([("a", "2025-09-25T00:00:00Z"), ("b", "2025-09-25T00:00:01Z"), ("c", "yesterday")], "player_id string, observed_at string").withColumn("at", utc("observed_at"))
    late = checks.after_cutoff(seen, "at", utc(F.lit("2025-09-25T00:00:00Z")), ["player_id"])
    assert [r["key"] for r in late.orderBy("key").collect()] == ["player_id=b", "player_id=c"] and "later than allowed" in late.first()["rule"]
    assert weighted_points({"points": 1.0}) is not None


def test_weekly_score(spark):
    board = spark.createDataFrame([(1, 6.0, 5.0), (2, 2.0, 3.0), (3, 4.0, None), (4, None, 2.0), (5, 1.0, 0.0)], "id int, e_points_final double, ep_next double")
    actual = spark.createDataFrame([(1, 8.0, 90), (2, 0.0, 0), (3, 4.0, 75), (4, 3.0, 90), (5, 0.0, 0), (5, 9.0, 0)], "id int, total_points double, minutes int")
    r = metrics.weekly(metrics.match_actuals(board, actual).withColumns({"season": F.lit("s"), "GW": F.lit(1)}), "total_points", "e_points_final", "ep_next").first()
    assert r["n_common"] == 3 and r["mae_model"] == pytest.approx(5 / 3) and r["mae_baseline"] == 2 and r["n_played"] == 1 and (r["mae_model_played"], r["mae_baseline_played"]) == (2, 3)
    with pytest.raises(checks.CheckFailed, match="e_points_final"):
        checks.score_inputs(board.drop("e_points_final"), "e_points_final", "ep_next", "ep_next")


def frame(spark, rows, names="y double, lo double, hi double"):
    return spark.createDataFrame(rows, names)


def test_coverage_and_pinball(spark):
    nan = float("nan")
    assert metrics.coverage(frame(spark, [(1.0, 0.0, 2.0), (2.0, 1.0, 3.0), (3.0, 2.0, 4.0), (4.0, 3.0, 5.0), (5.0, 10.0, 11.0)]), "y", "lo", "hi").first()["coverage"] == 0.8
    assert metrics.coverage(frame(spark, [(1.0, 0.0, 2.0), (2.0, 3.0, 4.0), (nan, 0.0, 1.0), (4.0, 3.0, 5.0)]), "y", "lo", "hi").first()["coverage"] == pytest.approx(2 / 3)
    assert metrics.pinball_loss(frame(spark, [(0.0, 1.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double"), "y", "p", 0.1).first()["pinball"] == pytest.approx(1 / 3)


def test_shift_and_nudge(spark):
    inside = frame(spark, [(float(i), -1.0, 100.0 if i < 80 else -0.5) for i in range(100)])
    r = intervals.shift(inside, "y", "lo", "hi").first()
    assert (r["coverage"], r["shift_low"], r["shift_high"]) == (0.8, 0, 0)
    narrow = frame(spark, [(float(i), 40.0, 60.0) for i in range(101)])
    s = intervals.shift(narrow, "y", "lo", "hi").first()
    moved = narrow.withColumns({"lo": F.col("lo") + s["shift_low"], "hi": F.col("hi") + s["shift_high"]})
    assert 0.75 <= metrics.coverage(moved, "y", "lo", "hi").first()["coverage"] <= 0.9
    atom = frame(spark, [(i, 0.0, 0.0, 1.0) for i in range(91)] + [(100 + i, 9.0, 0.0, 1.0) for i in range(9)], "id int, y double, lo double, hi double")
    assert intervals.shift(atom, "y", "lo", "hi").first()["shift_high"] == 0
    done = intervals.nudge(atom, "y", "lo", "hi", ["id"])
    assert done.where("nudged").count() == 1 and metrics.coverage(done, "y", "lo", "hi").first()["coverage"] == pytest.approx(0.9)
    few = frame(spark, [(i, float(i % 4 == 0), 0.5, 1.0) for i in range(40)], "id int, y double, lo double, hi double")
    more = intervals.nudge(few, "y", "lo", "hi", ["id"])
    assert metrics.coverage(more, "y", "lo", "hi").first()["coverage"] == pytest.approx(0.75) and more.where("lo > hi").count() == 0


def test_log_loss_auc_reliability(spark):
    df = frame(spark, [(0.0, 0.1), (1.0, 0.9), (0.0, 0.2), (1.0, 0.8)], "y double, p double")
    r = metrics.log_loss(df, "y", "p").first()
    assert r["brier"] == pytest.approx(0.025) and r["log_loss"] == pytest.approx(0.164252, abs=1e-6)
    rng = random.Random(2)
    rows = [(float(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(400)]
    want = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in rows if y for z, b in rows if not z]
    assert metrics.auc(frame(spark, rows, "y double, p double"), "y", "p").first()["auc"] == pytest.approx(sum(want) / len(want))
    assert metrics.auc(frame(spark, [(1.0, 0.5)], "y double, p double"), "y", "p").first()["auc"] is None
    import numpy as np

    bins = {r["bin"]: (r["n"], r["mean_pred"]) for r in metrics.reliability(frame(spark, rows, "y double, p double"), "y", "p").collect()}
    p = np.array([x for _, x in rows])
    edges = np.unique(np.quantile(p, np.linspace(0, 1, 11)))
    at = np.maximum(np.searchsorted(edges, p, "left") - 1, 0)
    assert bins == {int(b): (int((at == b).sum()), pytest.approx(p[at == b].mean())) for b in np.unique(at)}
    same = metrics.reliability(frame(spark, [(1.0, 0.35)] * 5, "y double, p double"), "y", "p").collect()
    assert [(r["bin"], r["n"]) for r in same] == [(3, 5)]


def test_slices_and_comparison(spark):
    df = spark.createDataFrame([(6.0, 5.0, 90), (0.0, 1.0, 0), (2.0, 2.0, 60)], "y double, f double, minutes int")
    got = {r["slice"]: (r["mae"], r["n"]) for r in metrics.slices(df, "y", ["f"]).collect()}
    assert got["played"] == (0.5, 2) and got["haulers"] == (1, 1) and got["all"][1] == 3
    assert metrics.comparison({"m": df.agg(F.avg("y").alias("a"))}).first()["metric"] == "a"


def test_sample_folds_calibration(spark):
    rows = [(i, 0, 0.0) for i in range(400)] + [(400 + i, 60, 2.0) for i in range(80)] + [(480 + i, 90, 9.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, minutes int, total_points double")
    own = models.stratified_sample(df, 100, ["id"])
    n = {r["stratum"]: r["count"] for r in own.groupBy("stratum").count().collect()}
    assert own.count() <= 100 and n["haul"] >= 10 and own.select("id").distinct().count() == own.count()
    lab = df.withColumn("y", (F.col("total_points") > 5).cast("double"))
    f = {(r["y"], r["fold"]): r["count"] for r in models.folds(lab, "y", ["id"]).groupBy("y", "fold").count().collect()}
    assert len(f) == 10 and models.folds(lab, "y", ["id"]).exceptAll(models.folds(lab.repartition(3), "y", ["id"])).count() == 0
    rng = random.Random(3)
    cal = spark.createDataFrame([(i, p := rng.random(), float(rng.random() < p**2)) for i in range(4000)], "id int, p double, y double")
    found, tried = models.choose_calibrator(cal.where("id % 2 = 0"), cal.where("id % 2 = 1"), "p", "y")
    assert found.kind in ("isotonic", "platt") and tried[-1]["log_loss"] < tried[0]["log_loss"]
    iso = models.calibrate(cal, "p", "y", "isotonic")
    got = spark.createDataFrame([(x,) for x in (-1.0, 0.3, 0.8, 2.0)], "p double").select(iso.apply(F.col("p")).alias("q")).collect()
    import numpy as np

    assert [r["q"] for r in got] == pytest.approx(list(np.interp([-1.0, 0.3, 0.8, 2.0], iso.bounds, iso.values)))


def test_heads_and_their_keeping(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, x := rng.random(), None if i % 10 == 0 else rng.random(), 10 * x + rng.random(), float(x > 0.5)) for i in range(600)], "id int, a double, b double, y double, c double")
    head = models.fit(models.regressor(10), df, ["a", "b"], "y")
    out = models.predict(head, df, ["a", "b"], "p")
    assert out.count() == 600 and out.stat.corr("p", "y") > 0.9
    models.save(head, f"{tmp_path}/head")
    assert models.predict(models.load(f"{tmp_path}/head"), df, ["a", "b"], "p").exceptAll(out).count() == 0
    assert models.importances(head, ["a", "b"], spark, 1).first()["feature"] == "a"
    q = models.leaf_quantiles(df, df, ["a", "b"], "y")
    assert 0.7 < metrics.coverage(q, "y", "q_low", "q_high").first()["coverage"] <= 0.95
    fields = "id int, head_minutes double, status string, chance double, prior_starts double, prior_games double, starts_l1 double, prior_minutes_pg double, q_low double, q_high double"
    lives = frame(spark, [(1, 45.0, "a", None, 30.0, 38.0, 1.0, 80.0, 1.0, 5.0), (2, 45.0, "i", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 5.0)], fields)
    old = frame(spark, [(1, 45.0, 0.5, 9.0), (2, 0.0, None, 9.0), (3, 90.0, 0.5, 9.0)], "id int, pred_minutes double, pred_defcon double, e_points_p90 double")
    made = {r["id"]: (r["pred_points_p10"], r["pred_points_p90"], r["e_points_p90"]) for r in models.lifted_quantiles(old, lives, 0.0, 1.0).collect()}
    assert made[1] == pytest.approx((80 / 45, 6 * 80 / 45, 3 * 80 / 45 + 1)) and made[2] == (0, 0, 0) and made[3] == (None, None, None)
    assert models.lifted_quantiles(old, lives.drop("q_low"), 0.0, 1.0) is old
    assert models.attach_quantiles(df, q.select("id", "q_low", "q_high")).count() == 600 and models.attach_quantiles(df, df) is df
    oof = models.out_of_fold(df, ["a", "b"], "c", ["id"], trees=3)
    assert oof.count() == 600 and metrics.auc(oof, "c", "oof").first()["auc"] > 0.9
    models.save_calibrator(models.Calibrator("platt", slope=2.0, offset=1.0), spark, f"{tmp_path}/cal")
    assert models.load_calibrator(spark, f"{tmp_path}/cal").slope == 2.0


def test_quantiles_are_exact_for_crowded_values_and_outliers(spark):
    import numpy as np

    rng = random.Random(5)
    rows = [("a", 0.0)] * 300 + [("a", rng.gauss(0, 1)) for _ in range(700)] + [("b", 10.0 ** rng.uniform(-9, 9)) for _ in range(501)] + [("b", None), (None, 1.0), ("c", None)]
    df = frame(spark, rows, "g string, v double").repartition(5)
    got = {r["g"]: r["q"] for r in metrics.quantiles(df, "v", [0.0, 0.1, 0.5, 0.9, 1.0], ["g"]).collect()}
    assert set(got) == {"a", "b"}
    for g, q in got.items():
        assert q == pytest.approx(list(np.percentile([v for x, v in rows if x == g and v is not None], [0, 10, 50, 90, 100])), rel=1e-9, abs=1e-12)
    whole = metrics.quantiles(df, "v", [0.25]).first()["q"]
    assert whole == pytest.approx([float(np.percentile([v for _, v in rows if v is not None], 25))], abs=1e-12)
    assert metrics.quantiles(df.where("false"), "v", [0.5]).collect()[0]["q"] == [None] and metrics.quantiles(df.where("g = 'c'"), "v", [0.5], ["g"]).count() == 0


def test_infinite_and_missing_values(spark):
    """Infinities are ends of the order, NaN and NULL take no part."""
    inf, nan = float("inf"), float("nan")
    rows = [(1.0, inf), (0.0, -inf), (1.0, 0.5), (0.0, 0.5), (0.0, inf), (1.0, nan), (nan, 0.1), (None, 0.2), (1.0, None)]
    seen = [(y, p) for y, p in rows if y == y and p == p and y is not None and p is not None]
    want = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in seen if y for z, b in seen if not z]
    assert metrics.auc(frame(spark, rows, "y double, p double"), "y", "p").first()["auc"] == pytest.approx(sum(want) / len(want))
    df = frame(spark, [("a", -inf), ("a", 1.0), ("a", inf), ("a", nan), ("a", None), ("b", inf), ("b", inf), ("c", nan)], "g string, v double")
    got = {r["g"]: r["q"] for r in metrics.quantiles(df, "v", [0.0, 0.5, 0.75, 1.0], ["g"]).collect()}
    assert got == {"a": [-inf, 1.0, inf, inf], "b": [inf] * 4}
    assert baselines.group_median(df.withColumnsRenamed({"g": "position", "v": "points"})).where("position = 'a'").first()["median"] == 1.0


def test_one_scan_serves_counts_ranks_and_quantiles(spark, sf):
    """The input is read by the histogram's job alone: what is returned reads only what that has written."""
    own = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("n_chars").cast("double").alias("p"), (F.col("doc_id") % 2).cast("double").alias("y"), F.lit(1).alias("played"))
    for done in (metrics.auc(own, "y", "p"), metrics.reliability(own, "y", "p"), metrics.quantiles(own, "p", [0.5]), metrics.frozen(own, "y", ["p"])):
        plan = done._jdf.queryExecution().optimizedPlan().toString()
        assert "histogram-" in done._jdf.queryExecution().executedPlan().toString() or "doc_id" not in plan
        assert "doc_id" not in plan and "n_chars" not in plan


def test_nudge_takes_the_first_rows_without_a_global_limit(spark):
    rng = random.Random(7)
    rows = [(i, float(rng.randint(0, 3)), 0.0, 1.0) for i in range(300)]
    df = frame(spark, rows, "id int, y double, lo double, hi double")
    done = intervals.nudge(df, "y", "lo", "hi", ["id"])
    need = sorted((max(lo - y, y - hi), i) for i, y, lo, hi in rows if max(lo - y, y - hi) > 0)
    inside = len(rows) - len(need)
    assert sorted(r["id"] for r in done.where("nudged").collect()) == sorted(i for _, i in need[: -(-75 * len(rows) // 100) - inside])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def boosted_plainly(x, y, alpha, rounds, rate, least):
    """Boosting under the pinball loss with stumps on one feature, each the split that lowers the squared error of the slopes most."""
    import numpy as np

    now, trees = np.full(len(y), np.quantile(y, alpha)), []
    for _ in range(rounds):
        slope, best = np.where(y - now > 0, alpha, alpha - 1), None
        for cut in np.unique(x)[:-1]:
            left = x <= cut
            if min(left.sum(), (~left).sum()) >= least:
                loss = slope[left].var() * left.sum() + slope[~left].var() * (~left).sum()
                best = min(best or (loss, cut), (loss, cut))
        if best is None:
            break
        left = x <= best[1]
        steps = [rate * np.quantile((y - now)[m], alpha) for m in (left, ~left)]
        now = now + np.where(left, *steps)
        trees.append((best[1], steps))
    return now


def test_boosted_quantiles_against_plain_boosting(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, 500).astype(float)
    y = x**1.5 + rng.normal(0, 1 + x / 4, 500)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double")
    for alpha in (0.1, 0.9):
        head = models.boosted_quantile(df, ["x"], "y", alpha, rounds=6, rate=0.5, depth=1, least=40, cut=3)
        got = [r["q"] for r in models.predict_quantile(head, df, ["x"], "q").orderBy("id").collect()]
        assert got == pytest.approx(list(boosted_plainly(x, y, alpha, 6, 0.5, 40)), abs=1e-9)
        assert abs(np.mean(y <= np.array(got)) - alpha) < 0.06


def test_boosted_quantiles_beat_one_tree_on_rows_held_out(spark):
    rng = random.Random(11)
    rows = [(i, a := rng.random(), b := rng.random(), 20 * a * a + 6 * b + rng.gauss(0, 1 + 3 * b)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    train, held = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    one = models.leaf_quantiles(train, held, ["a", "b"], "y", depth=5)
    many = models.boosted_quantiles(train, held, ["a", "b"], "y", rounds=10, rate=0.5, least=30)
    for column, alpha in (("q_low", 0.1), ("q_high", 0.9)):
        assert metrics.pinball_loss(many, "y", column, alpha).first()["pinball"] < metrics.pinball_loss(one, "y", column, alpha).first()["pinball"]
    assert many.where("q_low > q_high").count() == 0
    none = models.boosted_quantile(df.where("false"), ["a", "b"], "y", 0.1)
    assert none.trees == [] and models.predict_quantile(none, held, ["a", "b"], "q").agg(F.max("q")).first()[0] == 0.0


@pytest.mark.parametrize("rule,change", [
    ("stored key repeats", lambda s, p: (s.unionByName(s.limit(1)), p)), ("panel key repeats", lambda s, p: (s, p.unionByName(p.limit(1)))),
    ("stored row has no panel row", lambda s, p: (s, p.where("id <> 7"))), ("panel row was not stored", lambda s, p: (s.where("id <> 7"), p)),
])
def test_refit_of_quantiles_needs_aligned_rows(spark, rule, change):
    rng = random.Random(12)
    panel = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(300)], "id int, a double, y double")
    stored, rows = change(panel.select("id", F.lit(1.5).alias("kept"), F.lit(0.0).alias("q_low"), F.lit(0.0).alias("q_high")), panel)
    with pytest.raises(checks.CheckFailed, match=rule):
        models.refit_quantiles(stored, rows, panel, ["a"], "y", ["id"])


def test_refit_changes_the_quantiles_alone(spark):
    rng = random.Random(12)
    panel = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(300)], "id int, a double, y double")
    stored = panel.select("id", F.col("y").alias("kept"), F.lit(9.0).alias("q_low"), F.lit(9.0).alias("q_high"))
    out = models.refit_quantiles(stored, panel, panel, ["a"], "y", ["id"]).collect()
    assert len(out) == 300 and all(r["q_low"] <= r["q_high"] < 9 for r in out) and {r["id"]: r["kept"] for r in out} == {r["id"]: r["y"] for r in panel.collect()}


def test_plan_of_a_calibrator_does_not_grow_with_its_steps(spark):
    import numpy as np

    df = spark.createDataFrame([(x,) for x in (None, -1.0, 0.0, 0.31, 0.5, 1.0, 7.0)], "p double")
    sizes = []
    for n in (2, 3, 7, 1000):
        bounds = list(np.linspace(0, 1, n))
        found = models.Calibrator("isotonic", bounds, [b * b for b in bounds])
        out = df.select("p", found.apply(F.col("p")).alias("q"))
        assert [r["q"] for r in out.collect() if r["p"] is not None] == pytest.approx(list(np.interp([-1.0, 0.0, 0.31, 0.5, 1.0, 7.0], bounds, found.values)))
        sizes.append(out._jdf.queryExecution().analyzed().toString().count("from_json"))
    assert len(set(sizes)) == 1
