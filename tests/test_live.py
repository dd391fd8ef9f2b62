import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fixtura.functions import predicates as P
from fixtura.functions.scalars import slug, utc
from fixtura.operators import checks, live
from fixtura.plans.live_board import publish
from fixtura.sources import snapshots

from .helpers import raises

FX = "id int, event int, kickoff_time string, finished boolean, finished_provisional boolean, team_h int, team_a int, team_h_difficulty int, team_a_difficulty int"


def fixtures(spark, *rows):
    """rows: (id, event, home, away[, finished])."""
    return spark.createDataFrame([(i, e, f"2025-09-{i:02d}T12:00:00Z", bool(f), bool(f), h, a, 2, 4) for i, e, h, a, *f in rows], FX)


def test_next_fixtures(spark):
    fx = fixtures(spark, (1, 1, 1, 2), (2, 2, 1, 3), (3, None, 2, 3))
    got = {r["team"]: (r["event"], r["opponent"], r["fdr"]) for r in live.next_fixtures(fx).collect()}
    assert got == {1: (1, 2, 2), 2: (1, 1, 4), 3: (2, 1, 4)}
    only = live.next_fixtures(fixtures(spark, (1, 4, 1, 3), (2, 5, 1, 2), (3, 6, 1, 3), (4, 6, 2, 3)), F.lit(5))
    assert {(r["team"], r["event"]) for r in only.collect()} == {(1, 5), (2, 5)}
    own = live.next_by_kickoff(live.sides(fx.withColumn("kickoff_time", F.when(F.col("id") != 1, F.col("kickoff_time")))))
    assert {r["team"]: r["opponent"] for r in own.collect()}[1] == 3


def test_double_and_missing_live_fixtures(spark):
    sides = live.sides(fixtures(spark, (1, 5, 1, 2), (2, 5, 1, 3)))
    teams = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    with pytest.raises(checks.CheckFailed, match="double live fixture: 1 .*team=1, event=5"):
        checks.enforce(checks.live_board_gaps(sides, teams))
    assert raises("team has no fixture", checks.live_board_gaps(sides, teams))
    assert [(r["team"], r["event"]) for r in live.double_events(sides).collect()] == [(1, 5)]


EVENTS = "id int, finished boolean, data_checked boolean, is_current boolean, is_next boolean"


def test_event_choice(spark):
    ev = spark.createDataFrame([(1, True, True, False, False), (2, True, False, True, False), (3, False, False, False, True), (4, False, False, False, False)], EVENTS)
    assert live.next_event(ev).first()["event"] == 3
    assert live.next_event(ev.withColumn("is_next", F.lit(False))).first()["event"] == 3
    assert live.next_event(ev.where("finished").withColumn("is_next", F.lit(False))).collect() == []
    assert live.latest_final(ev).first()["event"] == 1
    ctx = live.event_context(ev).first()
    assert (ctx["current"], ctx["next"], ctx["finished"]) == (2, 3, [1, 2])
    modal = spark.createDataFrame([(2,), (1,), (1,), (2,), (None,)], "event int")
    assert live.modal_event(modal).first()["event"] == 1
    picks = spark.createDataFrame([(9, 1, 100), (9, 2, 101)], "entry_id int, event int, element int")
    assert [r["element"] for r in live.newest_picks(picks, ev).collect()] == [101]


def test_admissible_history(spark):
    rows = spark.createDataFrame([(1, "2025-08-01", True, True), (2, "2025-09-30", True, True), (5, "2025-08-02", True, True), (0, "2025-08-02", True, True), (2, "2025-08-03", True, False), (3, None, True, True)], "GW int, kickoff_time string, finished boolean, finished_provisional boolean")
    assert live.admitted(rows, F.lit(5), [F.lit("2025-09-01")]).count() == 1
    assert tuple(live.excluded_count(rows, F.lit(5), [F.lit("2025-09-01")]).first()) == (1, 5)


def test_board_slugs_rosters(spark):
    teams = spark.createDataFrame([(2, "A b"), (1, "a-B"), (3, "C")], "id int, name string")
    assert {r["id"]: r["slug"] for r in live.unique_slugs(teams, slug("name")).collect()} == {1: "a-b", 2: "a-b-2", 3: "c"}
    board = spark.createDataFrame([(1, "T", "MID", "x", 5.0), (2, "T", "GK", "y", 1.0), (3, "T", "MID", "a", 5.0)], "id int, team_name string, position string, web_name string, e_points_final double")
    assert {r["id"]: r["place"] for r in live.roster(board).collect()} == {2: 1, 3: 2, 1: 3}
    raw = spark.createDataFrame([(1, "a", None, "MID", 90.0, 6.0, 0.25, 0.0, 0.0, 0.0, 0.0), (2, "i", 0.0, "DEF", 90.0, 6.0, 0.25, 0.0, 0.0, 0.0, 0.0), (3, "a", None, "GK", 45.0, 4.0, 0.9, 0.0, 0.0, 0.0, 0.0)], "id int, status string, chance_of_playing_next_round double, position string, head_minutes double, head_points double, head_defcon double, prior_starts double, prior_games double, starts_l1 double, prior_minutes_pg double")
    assert [(r["id"], r["e_points_final"]) for r in publish(raw).collect()] == [(1, 6.5), (3, 2.0), (2, 0.0)]


SQUADS = {31: "Harbour", 44: "Mill Lane", 58: "Orchard"}
PLAYERS = {7001: (31, 3, 5501), 7002: (31, 1, 5502), 7003: (44, 4, 5503), 7004: (58, 2, 5504)}  # team, kind, stable code
GAMES = {610: (4, "2025-09-13T14:00:00Z", 31, 44), 611: (4, "2025-09-14T16:30:00Z", 58, 31), 640: (5, "2025-09-27T11:30:00Z", 44, 58)}
#: element, game -> minutes, points, conceded
PLAYED = {(7001, 610): (77, 5, "0.8"), (7001, 611): (90, 2, "1.9"), (7003, 610): (12, 1, "0.1"), (7004, 611): (90, 9, "0.0")}


def bundle(folder, change=lambda b: b):
    """Three clubs, four players, two games played and one to come; player 7002 has no history."""
    own = {p: [(g, v) for (q, g), v in PLAYED.items() if q == p] for p in PLAYERS}
    elements = [{"id": p, "code": code, "element_type": kind, "team": team, "minutes": sum(v[0] for _, v in own[p]), "starts": sum(v[0] > 60 for _, v in own[p]), "total_points": sum(v[1] for _, v in own[p]), "web_name": f"P{p}", "status": "a"} for p, (team, kind, code) in PLAYERS.items()]
    events = [{"id": e, "deadline_time": f"2025-09-{day}T10:00:00Z", "finished": e < 5, "data_checked": e < 5, "is_current": e == 4, "is_next": e == 5} for e, day in ((4, 13), (5, 27))]
    boot = {"teams": [{"id": t, "name": name, "short_name": name[:3].upper()} for t, name in SQUADS.items()], "events": events, "elements": elements}
    fx = [{"id": g, "event": e, "kickoff_time": at, "finished": e < 5, "finished_provisional": e < 5, "team_h": h, "team_a": a, "team_h_difficulty": 3, "team_a_difficulty": 2} for g, (e, at, h, a) in GAMES.items()]
    history = {p: [{"element": p, "fixture": g, "round": GAMES[g][0], "kickoff_time": GAMES[g][1], "minutes": v[0], "starts": int(v[0] > 60), "total_points": v[1], "was_home": PLAYERS[p][0] == GAMES[g][2], "expected_goals_conceded": v[2]} for g, v in rows] for p, rows in own.items()}
    manifest = {"format_version": 1, "season": "2025-26", "captured_at_utc": "2025-09-26T07:15:00Z", "bootstrap_source": "boot", "fixtures_source": "fix", "covered_element_ids": list(PLAYERS), "history_rows_by_element": {str(p): len(rows) for p, rows in own.items()}}
    b = {"boot": boot, "fx": fx, "history": history, "manifest": manifest}
    change(b)
    (folder / "history").mkdir()
    (folder / "bootstrap.json").write_text(json.dumps(b["boot"]))
    (folder / "fixtures.json").write_text(json.dumps(b["fx"]))
    for i, rows in b["history"].items():
        (folder / "history" / f"{i}.json").write_text(json.dumps({"history": rows}))
    b["manifest"].setdefault("bootstrap_sha256", hashlib.sha256((folder / "bootstrap.json").read_bytes()).hexdigest())
    b["manifest"].setdefault("fixtures_sha256", hashlib.sha256((folder / "fixtures.json").read_bytes()).hexdigest())
    (folder / "manifest.json").write_text(json.dumps(b["manifest"]))


def rules(spark, folder, as_of="2025-09-26T20:00:00Z"):
    d = str(folder)
    elements, teams, events = snapshots.bootstrap(spark, f"{d}/bootstrap.json")
    fx, manifest = snapshots.fixtures(spark, f"{d}/fixtures.json"), snapshots.manifest(spark, f"{d}/manifest.json")
    rows = snapshots.player_histories(spark, f"{d}/history").where("fixture is not null")
    el = elements.select(F.col("id").alias("element"), "code", "minutes", "starts", "total_points")
    at = utc(F.lit(as_of))
    hashes = manifest.select(F.explode(F.array(F.struct(F.lit("bootstrap.json").alias("name"), F.col("bootstrap_sha256").alias("sha256")), F.struct(F.lit("fixtures.json").alias("name"), F.col("fixtures_sha256").alias("sha256")))).alias("x")).select("x.*")
    files = snapshots.file_hashes(spark, [f"{d}/bootstrap.json", f"{d}/fixtures.json"])
    met = live.history_with_meta(rows, fx, elements.select("id", "code"))
    return [
        *checks.bad_capture(manifest.withColumn("captured", utc("captured_at_utc")), at, "2025-26", {"bootstrap_source": "boot", "fixtures_source": "fix"}),
        checks.bad_hashes(hashes, files), *checks.bad_coverage(snapshots.covered(manifest), el, snapshots.declared_rows(manifest), rows), *checks.bad_alignment(met),
        checks.bad_totals(el, rows), checks.late_as_of(events.withColumn("deadline_time", utc("deadline_time")), 5, at), checks._said(rows.where("element <> file_element"), "element differs from file", ["element"]),
        checks.bad_fields(rows.withColumn("position", F.lit("MID")).withColumn("expected_goals_conceded", F.col("expected_goals_conceded").try_cast("double")), ["minutes", "expected_goals_conceded"]),
    ]


def test_good_bundle_passes(spark, tmp_path):
    bundle(tmp_path)
    checks.enforce(rules(spark, tmp_path))


CHANGES = [
    ("unsupported snapshot version", lambda b: b["manifest"].update(format_version=7)),
    ("snapshot season differs", lambda b: b["manifest"].update(season="2023-24")),
    ("captured after as_of", lambda b: b["manifest"].update(captured_at_utc="2025-09-26T20:00:01Z")),
    ("too old", lambda b: b["manifest"].update(captured_at_utc="2025-09-25T19:59:59Z")),
    ("bootstrap_source is not", lambda b: b["manifest"].update(bootstrap_source="mirror")),
    ("file hash differs", lambda b: b["manifest"].update(fixtures_sha256="ab" * 32)),
    ("element is covered twice", lambda b: b["manifest"]["covered_element_ids"].append(7003)),
    ("covered element is unknown", lambda b: b["manifest"]["covered_element_ids"].append(7999)),
    ("element is not covered", lambda b: b["manifest"]["covered_element_ids"].remove(7002)),
    ("stable code is not unique", lambda b: b["boot"]["elements"][3].update(code=5501)),
    ("history row count differs", lambda b: b["manifest"]["history_rows_by_element"].update({"7001": 1})),
    ("history row count differs", lambda b: b["history"][7003].clear()),
    ("unknown fixture", lambda b: b["history"][7004][0].update(fixture=699)),
    ("unknown element", lambda b: b["history"][7001][1].update(element=7777)),
    ("element differs from file", lambda b: b["history"][7001][1].update(element=7002)),
    ("event differs from fixture", lambda b: b["history"][7003][0].update(round=5)),
    ("kickoff differs from fixture", lambda b: b["history"][7004][0].update(kickoff_time="2025-09-14T16:31:00Z")),
    ("cumulative totals differ", lambda b: b["boot"]["elements"][2].update(minutes=13)),
    ("cumulative totals differ", lambda b: b["boot"]["elements"][1].update(total_points=1)),
    ("as_of is not before the deadline", lambda b: b["boot"]["events"][1].update(deadline_time="2025-09-26T20:00:00Z")),
    ("required field is missing", lambda b: b["history"][7004][0].update(expected_goals_conceded="n/a")),
]


@pytest.mark.parametrize("rule,change", CHANGES, ids=[f"{i}-{c[0]}" for i, c in enumerate(CHANGES)])
def test_changed_bundle_fails(spark, tmp_path, rule, change):
    bundle(tmp_path, change)
    with pytest.raises(checks.CheckFailed, match=rule):
        checks.enforce(rules(spark, tmp_path))


def test_prior_season_rules(spark):
    df = spark.createDataFrame([("2024-25", "p", 1, "2025-05-01"), ("2024-25", "q", 2, None), ("2024-25", "r", 3, "2025-09-01")], "season string, player_code string, fixture int, kickoff_time string")
    bad = checks.bad_prior(df, "2024-25", F.lit("2025-08-01"))
    assert raises("prior kickoff is unknown", bad) and raises("not before the cutoff", bad) and not raises("absent", bad)
    assert raises("prior season is absent", checks.bad_prior(df, "2023-24", F.lit("2025-08-01")))
    assert df.where(P.known_before("2024-25", F.lit("2025-08-01"))).count() == 1


def test_names_plans_records(spark):
    saved = spark.createDataFrame([("Ann",), ("bob",), ("Zed",)], "name string")
    registry = spark.createDataFrame([(1, "ann"), (2, "Bob"), (3, "BOB")], "id int, web_name string")
    told, bad = checks.unique_names(saved, registry)
    assert [r["id"] for r in told.collect()] == [1] and raises("ambiguous", bad) and raises("unknown", bad)
    values = checks.bad_names(spark.createDataFrame([("a", 1.0004), ("b", 2.0), ("c", 1.0)], "n string, v double"), spark.createDataFrame([("a", 1.0), ("b", 2.1)], "n string, v double"), "n", "v")
    assert raises("no match", values) and [r["key"] for r in values[1].collect()] == ["n=b"]
    plan = (1, list(range(15)), list(range(11)), list(range(11, 15)), [1], [20], 0, 1, 5)
    schema = "plan_id int, squad array<int>, xi array<int>, bench array<int>, sold array<int>, bought array<int>, captain int, vice int, bank int"
    good = spark.createDataFrame([plan], schema)
    assert checks.plan_sanity(good).count() == 0
    for c, v, rule in (("bank", -1, "bank"), ("captain", 12, "captain in XI"), ("vice", 0, "vice is another"), ("bench", [11, 12, 13], "bench is the rest"), ("sold", [], "transfers balance")):
        assert [r["detail"][: len(rule)] for r in checks.plan_sanity(good.withColumn(c, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<int>"))).collect()] == [rule]
    records = spark.createDataFrame([(1, "final", "fine"), (2, "done", "Bearer abcdefghijklmnopqrst")], "gw int, status string, note string")
    assert raises("credential", checks.public_record(records, ["gw"])) and raises("status is not explicit", checks.public_record(records, ["gw"]))
    with pytest.raises(checks.CheckFailed, match="entry_id"):
        checks.public_record(records.withColumn("entry_id", F.lit(1)), ["gw"])


def test_growing_sides_are_not_broadcast(spark):
    from fixtura.operators import opponent

    key, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    fixtures = spark.createDataFrame([(1, "S", 2, 3, 4, 5)], "id int, season string, team_h int, team_a int, team_h_difficulty int, team_a_difficulty int")
    rows = spark.createDataFrame([(1, 1, 1, True, "S")], "fixture int, element int, team int, was_home boolean, season string")
    elements = spark.createDataFrame([(1,)], "id int")
    spark.conf.set(key, "-1")
    try:
        made = [live.history_with_meta(rows, fixtures, elements), opponent.difficulty(rows, fixtures, F.col("team_h_difficulty"))]
        assert all("BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() for df in made)
        assert [r["opponent"] for r in made[0].collect()] == [3] and [r["fdr"] for r in made[1].collect()] == [4]
    finally:
        spark.conf.set(key, was)
