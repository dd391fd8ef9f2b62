import itertools
import random

import pytest
from pyspark.sql import functions as F

from fixtura.operators import checks, lineup

SCHEMA = "squad_id int, id int, position string, club string, cost int, points double, flagged boolean"


def squad(rng, s, base=0):
    wants = ["GK"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3
    return [(s, base + i, p, f"c{rng.randint(0, 9)}", 50 + rng.randint(0, 9), float(rng.randint(0, 9)) + i / 100, rng.random() < 0.2) for i, p in enumerate(wants)]


def brute_xi(rows):
    best = None
    for d, m, f in itertools.product(range(3, 6), range(2, 6), range(1, 4)):
        if d + m + f == 10:
            parts = [sorted((r[5] for r in rows if r[2] == p), reverse=True)[:n] for p, n in (("GK", 1), ("DEF", d), ("MID", m), ("FWD", f))]
            if [len(x) for x in parts] == [1, d, m, f]:
                best = max(best or 0, sum(map(sum, parts)))
    return best


def test_best_xi_is_the_optimum(spark):
    rng = random.Random(1)
    squads = {s: squad(rng, s) for s in range(30)}
    df = spark.createDataFrame([r for rows in squads.values() for r in rows], SCHEMA)
    lined = lineup.best_xi(df)
    got = {r["squad_id"]: r for r in lineup.xi_summary(lined).collect()}
    assert all(got[s]["is_legal"] and got[s]["xi_points"] == pytest.approx(brute_xi(rows)) for s, rows in squads.items())
    fit, bad = lineup.fit_xi(df)
    unfit = {s for s, rows in squads.items() if brute_xi([r for r in rows if not r[6]]) is None}
    assert {r["squad_id"] for r in bad.collect()} == unfit and unfit
    own = {r["squad_id"]: r["xi_points"] for r in lineup.xi_summary(fit).collect()}
    assert all(own[s] == pytest.approx(brute_xi([r for r in rows if not r[6]])) for s, rows in squads.items() if s not in unfit)
    order = [(r["position"], r["points"]) for r in lineup.bench(lined).where("squad_id = 0").orderBy("bench_place").collect()]
    assert order[0][0] == "GK" and [p for _, p in order[1:]] == sorted((p for _, p in order[1:]), reverse=True)
    roles = {r["role"]: r["points"] for r in lineup.captains(lined).where("squad_id = 0").collect()}
    assert roles["captain"] == max(r["points"] for r in lined.where("squad_id = 0 and is_xi").collect()) and roles["vice"] <= roles["captain"]


def test_legality_names_each_broken_rule(spark):
    rng = random.Random(2)
    good = [(s, i, p, f"c{i % 8}", 60, x, fl) for s, i, p, _, _, x, fl in squad(rng, 1)]
    df = lineup.best_xi(spark.createDataFrame(good, SCHEMA))
    assert checks.squad_legality(df).count() == 0
    for rule, change in {"budget": df.withColumn("cost", F.lit(70)), "club cap": df.withColumn("club", F.lit("c")), "size": df.where("id <> 14"), "count of FWD": df.where("id <> 14"), "XI size": df.withColumn("is_xi", F.lit(True)), "XI keepers": df.withColumn("is_xi", F.col("position") != "GK")}.items():
        assert rule in {r["detail"] for r in checks.squad_legality(change).collect()}
    totals = lineup.squad_totals(df).first()
    assert (totals["cost"], totals["n_gk"], totals["clubs"], totals["club_max"]) == (900, 2, 8, 2)


def test_one_transfer_against_brute_force(spark):
    rng = random.Random(3)
    squads = {s: squad(rng, s) for s in range(4)}
    market = [(100 + i, rng.choice(["GK", "DEF", "MID", "FWD"]), f"c{rng.randint(0, 9)}", 45 + rng.randint(0, 20), float(rng.randint(0, 14)), rng.random() < 0.1) for i in range(120)]
    bank = {s: rng.randint(0, 5) for s in squads}
    df = spark.createDataFrame([r for rows in squads.values() for r in rows], SCHEMA).drop("flagged")
    got = {s: [round(r["gain"], 6) for r in lineup.one_transfer(df, spark.createDataFrame(market, "id int, position string, club string, cost int, points double, flagged boolean"), spark.createDataFrame(list(bank.items()), "squad_id int, bank int"), hit=0.5).where(f"squad_id = {s}").orderBy("rank").collect()] for s in squads}
    best = lambda rows: max(v for v in [None or 0.0] + [brute_xi(rows) + top(rows)])

    def top(rows):
        """Points of the best starter: the captain is counted twice."""
        return max(max(r[5] for r in rows if r[2] == p) for p in ("GK", "DEF", "MID", "FWD"))

    for s, rows in squads.items():
        gains = []
        for out in rows:
            rest = [r for r in rows if r is not out]
            for i, p, club, cost, points, bad in market:
                if p == out[2] and not bad and cost <= out[4] + bank[s] and sum(r[3] == club for r in rest) < 3:
                    gains.append(round(best([*rest, (s, i, p, club, cost, points, False)]) - best(rows) - 0.5, 6))
        assert got[s] == sorted((g for g in gains if g > 0), reverse=True)[:5]


def test_every_squad_is_searched(spark):
    """The query's gains equal a search of all buys for all squads of the smallest table, done in plain Python."""
    from fixtura.functions import scalars as S
    from fixtura.plans import bindings as B
    from fixtura.plans.score_queries import ln05_one_transfer

    sf = "/root/testdata/sf0.001"
    own = {}
    for r in B.squads(spark, sf).collect():
        own.setdefault(r["squad_id"], []).append((r["squad_id"], r["id"], r["position"], r["club"], r["cost"], r["points"]))
    market = B.board(spark, sf).withColumn("flagged", S.flagged("status", "chance")).where("not flagged").collect()
    worth = lambda rows: brute_xi(rows) + max(max(r[5] for r in rows if r[2] == p) for p in ("GK", "DEF", "MID", "FWD"))
    want = {}
    for s, rows in own.items():
        hold, ids, gains = worth(rows), {r[1] for r in rows}, []
        for out in rows:
            rest = [r for r in rows if r is not out]
            buys = [m for m in market if m["position"] == out[2] and m["cost"] <= out[4] + s % 30 and m["id"] not in ids and sum(r[3] == m["club"] for r in rest) < 3]
            gains += [round(worth([*rest, (s, m["id"], m["position"], m["club"], m["cost"], m["points"])]) - hold, 6) for m in buys]
        want[s] = sorted((g for g in gains if g > 0), reverse=True)[:5]
    got = {s: [] for s in own}
    for r in ln05_one_transfer(spark, sf).orderBy("squad_id", "rank").collect():
        got[r["squad_id"]].append(r["gain"])
    assert {s: pytest.approx(g, abs=1e-6) for s, g in want.items()} == got


def test_no_key_of_the_shop_meets_more_rows_than_players_sold(spark):
    rng = random.Random(6)
    market = [(i, rng.choice(["GK", "DEF", "MID", "FWD"]), f"c{rng.randint(0, 4)}", 45 + rng.randint(0, 6), float(rng.randint(0, 30)), False) for i in range(900)]
    goods, levels = lineup.shop(spark.createDataFrame(market, "id int, position string, club string, cost int, points double, flagged boolean"), 4)
    rows = goods.collect()
    assert len({(r["position"], r["level"]) for r in rows}) == len(rows) == sum(len(r["levels"]) for r in levels.collect())
    for r in rows:
        for club in {m[2] for m in market}:
            best = sorted((-m[4], m[0]) for m in market if m[1] == r["position"] and m[2] == club and m[3] <= r["level"])[:4]
            assert [(g["order"], g["in_id"]) for g in r["goods"] if g["in_club"] == club] == best
