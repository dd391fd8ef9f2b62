"""Queries over the panel binding: lags, priors, opponents, labels, set-piece orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fixtura.functions import predicates as P
from fixtura.functions import scalars as S
from fixtura.operators import checks, lags, live, opponent, priors
from fixtura.plans import bindings as B
from fixtura.plans.panel import featured, labelled
from fixtura.plans.registry import query, six

KEY = ["season", "GW", "player_code", "fixture"]
W = 'PARTITION BY season, player_code ORDER BY "GW", kickoff_time, fixture'
E = 'PARTITION BY season, player_code, "GW" ORDER BY kickoff_time, fixture ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING'
SQL_NAME = {"minutes": "minutes", "total_points": "total_points", "expected_goals_conceded": "xgc"}
_raw = ", ".join(f"lag({c}, 1) OVER ({W}) AS {n}_l1, avg({c}) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS {n}_r3, avg({c}) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS {n}_r5" for n, c in SQL_NAME.items())
LAG_NAMES = [f"{n}_{s}" for n in SQL_NAME for s in ("l1", "r3", "r5")]
#: CTE g: the labelled panel with all lags, equal within events
LAGS = f"{B.PANEL}, g0 AS (SELECT *, {_raw} FROM l), g AS (SELECT * EXCLUDE ({', '.join(LAG_NAMES)}), {', '.join(f'first_value({n}) OVER ({E}) AS {n}' for n in LAG_NAMES)} FROM g0)"


def rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def panel(spark, sf_dir):
    return labelled(B.panel(spark, sf_dir), starts="started")


@query(f'WITH {B.PANEL} SELECT season, "GW", player_code, fixture, round(lag(minutes, 1) OVER ({W}), 6) AS minutes_l1, round(lag(total_points, 1) OVER ({W}), 6) AS total_points_l1 FROM p', cast={"minutes_l1": "DOUBLE"})
def wn01_lag1(spark, sf_dir):
    return B.panel(spark, sf_dir).select(*KEY, *[six(lags.lag_one(c).cast("double"), f"{c}_l1") for c in ("minutes", "total_points")])


@query(f'WITH {B.PANEL} SELECT season, "GW", player_code, fixture, round(avg(minutes) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS minutes_r3, round(avg(total_points) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS total_points_r5 FROM p')
def wn02_shifted_rolls(spark, sf_dir):
    return B.panel(spark, sf_dir).select(*KEY, six(lags.rolling("minutes", 3), "minutes_r3"), six(lags.rolling("total_points", 5), "total_points_r5"))


@query(f'WITH {LAGS} SELECT season, "GW", player_code, fixture, {rounded(LAG_NAMES)} FROM g', cast={"minutes_l1": "DOUBLE"})
def wn03_event_broadcast(spark, sf_dir):
    return lags.add_lags(B.panel(spark, sf_dir), B.LAGGED).select(*KEY, *[six(F.col(c).cast("double"), c) for c in LAG_NAMES])


@query(f'WITH {B.PANEL} SELECT season, "GW", player_code, fixture, CAST(row_number() OVER (PARTITION BY season, player_code, "GW" ORDER BY kickoff_time, fixture) = 1 AS INTEGER) AS is_first FROM p')
def wn11_first_of_event(spark, sf_dir):
    return B.panel(spark, sf_dir).select(*KEY, lags.first_of_event().cast("int").alias("is_first"))


@query(f"""WITH {B.PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY season, player_code ORDER BY "GW" DESC, kickoff_time DESC, fixture DESC) AS rn FROM p)
SELECT season, player_code, 11 AS "GW", round(coalesce(max(CASE WHEN rn = 1 THEN minutes END), 0), 6) AS minutes_l1, round(coalesce(avg(CASE WHEN rn <= 3 THEN minutes END), 0), 6) AS minutes_r3, round(coalesce(avg(CASE WHEN rn <= 5 THEN total_points END), 0), 6) AS total_points_r5 FROM r GROUP BY ALL""", cast={"minutes_l1": "DOUBLE"})
def wn08_sentinel_form(spark, sf_dir):
    own = B.panel(spark, sf_dir)
    targets = own.select("season", "player_code").distinct().withColumn("GW", F.lit(11))
    form = lags.form_at(own, targets, ["minutes", "total_points"], entity=("season", "player_code"))
    return form.select("season", "player_code", "GW", six(F.col("minutes_l1").cast("double"), "minutes_l1"), six("minutes_r3"), six("total_points_r5"))


SEASONS = "ss AS (SELECT season, lag(season) OVER (ORDER BY season) AS previous, lead(season) OVER (ORDER BY season) AS next FROM (SELECT DISTINCT season FROM p))"
TOTALS = f"""{SEASONS}, t AS (SELECT season, player_code, count(*) AS prior_games, coalesce(sum(minutes), 0)::DOUBLE AS prior_minutes, coalesce(sum(total_points), 0) AS prior_points, coalesce(sum(xg), 0) AS prior_xg,
 coalesce(sum(xa), 0) AS prior_xa, coalesce(sum(defcon_hit), 0)::DOUBLE AS prior_defcon, coalesce(sum(started), 0)::DOUBLE AS prior_starts FROM l WHERE minutes > 0 GROUP BY ALL),
 tt AS (SELECT *, prior_points / prior_games AS prior_ppg, prior_minutes / prior_games AS prior_minutes_pg, prior_xg / greatest(prior_minutes, 1.0) * 90 AS prior_xg90, prior_defcon / prior_games AS prior_defcon_rate FROM t),
 pr AS (SELECT tt.* EXCLUDE (season), ss.next AS season FROM tt JOIN ss USING (season) WHERE ss.next IS NOT NULL)"""
PRIOR = list(priors.PRIOR)


@query(f"WITH {B.PANEL}, {SEASONS} SELECT season, previous, next FROM ss")
def wn09_season_succession(spark, sf_dir):
    return priors.succession(B.panel(spark, sf_dir))


@query(f"WITH {B.PANEL}, {TOTALS} SELECT season, player_code, {rounded(PRIOR)} FROM pr", cast={"prior_games": "DOUBLE"})
def ag01_prior_season(spark, sf_dir):
    return priors.prior_season(panel(spark, sf_dir)).select("season", "player_code", *[six(F.col(c).cast("double"), c) for c in PRIOR])


@query(f'WITH {B.PANEL}, {TOTALS} SELECT l.season, l."GW", l.player_code, l.fixture, CAST(pr.prior_games IS NULL AS INTEGER) AS is_new, {", ".join(f"round(coalesce(pr.{c}, 0), 6) AS {c}" for c in PRIOR)} FROM l LEFT JOIN pr USING (season, player_code)', cast={"prior_games": "DOUBLE"})
def jn06_prior_join(spark, sf_dir):
    return priors.join_prior(panel(spark, sf_dir)).select(*KEY, "is_new", *[six(F.col(c).cast("double"), c) for c in PRIOR])


FORM = """x0 AS (SELECT *, CAST(minutes > 0 AS INTEGER) AS i, max(CAST(minutes > 0 AS INTEGER)) OVER (PARTITION BY season, player_code) AS ever,
 row_number() OVER (PARTITION BY season, player_code ORDER BY CAST(minutes > 0 AS INTEGER) DESC, "GW" DESC, kickoff_time DESC, fixture DESC) AS rn FROM l),
 fm AS (SELECT season, player_code, min("GW") AS window_from, max("GW") AS window_to, """ + ", ".join(f"max(CASE WHEN rn = 1 THEN {c} END)::DOUBLE AS {n}_l1, avg(CASE WHEN rn <= 3 THEN {c} END) AS {n}_r3, avg({c}) AS {n}_r5" for n, c in SQL_NAME.items()) + " FROM x0 WHERE rn <= 5 AND i = ever GROUP BY ALL)"


@query(f"WITH {B.PANEL}, {FORM} SELECT season, player_code, window_from, window_to, {rounded(LAG_NAMES)} FROM fm")
def wn04_last_played(spark, sf_dir):
    return priors.end_form(panel(spark, sf_dir), B.LAGGED).select("season", "player_code", "window_from", "window_to", *[six(c) for c in LAG_NAMES])


OVERRIDE = f"""{LAGS}, {SEASONS}, {FORM}, o AS (SELECT g.* EXCLUDE ({", ".join(LAG_NAMES)}), {", ".join(f'CASE WHEN g."GW" = 1 THEN coalesce(fm.{n}, g.{n}) ELSE g.{n} END AS {n}' for n in LAG_NAMES)}
 FROM g LEFT JOIN ss ON ss.season = g.season LEFT JOIN fm ON fm.season = ss.previous AND fm.player_code = g.player_code)"""


@query(f'WITH {OVERRIDE} SELECT season, "GW", player_code, fixture, {rounded(LAG_NAMES)} FROM o')
def jn07_gw1_override(spark, sf_dir):
    own = panel(spark, sf_dir)
    return priors.first_event_override(lags.add_lags(own, B.LAGGED), own, B.LAGGED).select(*KEY, *[six(F.col(c).cast("double"), c) for c in LAG_NAMES])


@query(f"WITH {B.PANEL} SELECT season, player_code, count_if(minutes > 0) AS prior_games, sum(minutes)::DOUBLE AS prior_minutes, round(sum(total_points), 6) AS prior_points, sum(started)::DOUBLE AS prior_starts FROM l GROUP BY ALL", cast={"prior_games": "BIGINT"})
def ag04_end_totals(spark, sf_dir):
    return priors.end_totals(panel(spark, sf_dir)).select("season", "player_code", "prior_games", "prior_minutes", six("prior_points"), "prior_starts")


KNOWN = 'fk AS (SELECT season, player_code, arg_min(pen, ("GW", kickoff_time, fixture)) FILTER (pen IS NOT NULL) AS penalties_order, arg_min(cor, ("GW", kickoff_time, fixture)) FILTER (cor IS NOT NULL) AS corners_order FROM l GROUP BY ALL)'


@query(f"WITH {B.PANEL}, {KNOWN} SELECT * FROM fk")
def ag03_first_non_null(spark, sf_dir):
    return priors.first_known(B.panel(spark, sf_dir), B.ORDERS)


@query(f'WITH {B.PANEL}, {SEASONS}, {KNOWN} SELECT l.season, l."GW", l.player_code, l.fixture, coalesce(fk.penalties_order, 0) AS penalties_order, coalesce(fk.corners_order, 0) AS corners_order FROM l LEFT JOIN ss ON ss.season = l.season LEFT JOIN fk ON fk.season = ss.previous AND fk.player_code = l.player_code')
def jn04_prior_order_shift(spark, sf_dir):
    return priors.shifted_orders(B.panel(spark, sf_dir), B.ORDERS).select(*KEY, *B.ORDERS)


@query(f"""WITH {B.PANEL}, mn AS (SELECT player_code, min(ROW(pen, cor)) FILTER (season = 'S0' AND pen IS NOT NULL AND cor IS NOT NULL) AS o FROM l GROUP BY 1)
SELECT l.season, l."GW", l.player_code, l.fixture, coalesce(mn.o[1], 0) AS penalties_order, coalesce(mn.o[2], 0) AS corners_order FROM l LEFT JOIN mn USING (player_code)""")
def jn05_given_orders(spark, sf_dir):
    own = B.panel(spark, sf_dir)
    return priors.attach_orders(own, own.where("season = 'S0' and penalties_order is not null and corners_order is not null"), B.ORDERS).select(*KEY, *B.ORDERS)


@query(f"""WITH {B.PANEL} SELECT l.season, l."GW", l.fixture, coalesce(CASE WHEN c.c_custkey % 3 <> 0 THEN CAST(c.c_custkey * 10 AS VARCHAR) END, l.season || ':' || l.player_code) AS player_code
FROM l LEFT JOIN customer c ON c.c_custkey = CAST(l.player_code AS BIGINT)""")
def jn01_stable_codes(spark, sf_dir):
    rows = B.panel(spark, sf_dir).withColumn("element", F.col("player_code").cast("long"))
    c = B.read(spark, sf_dir, "customer")
    coded = c.withColumn("c_custkey", F.when(F.col("c_custkey") % 3 == 0, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")))  # keys without a partner
    players = reduce(lambda a, b: a.unionByName(b), [coded.select(F.lit(s).alias("season"), F.col("c_custkey").alias("element"), (F.col("c_custkey") * 10).alias("code")) for s in ("S0", "S1", "S2")])
    return priors.stable_codes(rows, players).select("season", "GW", "fixture", "player_code")


TEAMS = """tm0 AS (SELECT season, team, "GW", sum(CASE WHEN position = 'GK' THEN xgc * minutes END) AS kx, sum(CASE WHEN position = 'GK' THEN minutes END) AS km, sum(xgc * minutes) AS x, sum(minutes) AS m, avg(CAST(was_home AS INTEGER)) >= 0.5 AS is_home FROM l GROUP BY ALL),
 tm AS (SELECT season, team, "GW", is_home, CASE WHEN km > 0 THEN kx / km WHEN m > 0 THEN x / m ELSE 0.0 END AS xgc FROM tm0)"""


def _rolls(source: str, out: str) -> str:
    t = 'PARTITION BY season, team ORDER BY "GW"'
    side = f'avg(xgc) OVER (PARTITION BY season, team, is_home ORDER BY "GW" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)'
    last = lambda v: f"coalesce(last_value(CASE WHEN is_home = {v} THEN sd END IGNORE NULLS) OVER ({t} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f'{out}0 AS (SELECT *, {side} AS sd FROM {source}), {out} AS (SELECT *, coalesce(avg(xgc) OVER ({t} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS xgc_r5, {last("true")} AS xgc_home_r5, {last("false")} AS xgc_away_r5 FROM {out}0)'


@query(f'WITH {B.PANEL}, {TEAMS} SELECT season, team, "GW", CAST(is_home AS INTEGER) AS is_home, round(xgc, 6) AS xgc FROM tm')
def ag02_team_xgc(spark, sf_dir):
    return opponent.team_conceded(B.panel(spark, sf_dir)).select("season", "team", "GW", F.col("is_home").cast("int").alias("is_home"), six("xgc"))


@query(f'WITH {B.PANEL}, {TEAMS}, {_rolls("tm", "ro")} SELECT season, team, "GW", round(xgc_r5, 6) AS xgc_r5 FROM ro')
def wn05_team_rolls(spark, sf_dir):
    return opponent.rolls(opponent.team_conceded(B.panel(spark, sf_dir))).select("season", "team", "GW", six("xgc_r5"))


@query(f'WITH {B.PANEL}, {TEAMS}, {_rolls("tm", "ro")} SELECT season, team, "GW", round(xgc_home_r5, 6) AS xgc_home_r5, round(xgc_away_r5, 6) AS xgc_away_r5 FROM ro')
def wn06_side_rolls(spark, sf_dir):
    return opponent.rolls(opponent.team_conceded(B.panel(spark, sf_dir))).select("season", "team", "GW", six("xgc_home_r5"), six("xgc_away_r5"))


NEXT = 'ne AS (SELECT season, team, max("GW") + 1 AS "GW", CAST(NULL AS BOOLEAN) AS is_home, CAST(NULL AS DOUBLE) AS xgc, true AS is_next FROM tm GROUP BY ALL), tn AS (SELECT season, team, "GW", is_home, xgc, false AS is_next FROM tm UNION ALL SELECT * FROM ne)'


@query(f'WITH {B.PANEL}, {TEAMS}, {NEXT}, {_rolls("tn", "ro")} SELECT season, team, "GW", round(xgc_r5, 6) AS xgc_r5, round(xgc_home_r5, 6) AS xgc_home_r5, round(xgc_away_r5, 6) AS xgc_away_r5 FROM ro WHERE is_next')
def wn07_next_event(spark, sf_dir):
    return opponent.next_event(opponent.team_conceded(B.panel(spark, sf_dir))).select("season", "team", "GW", *[six(c) for c in opponent.STATS])


@query(f'WITH {B.PANEL}, {TEAMS} SELECT season, team, max("GW") + 1 AS "GW" FROM tm GROUP BY ALL')
def ag08_next_sentinel(spark, sf_dir):
    return opponent.with_next_event(opponent.team_conceded(B.panel(spark, sf_dir))).where("is_next").select("season", "team", "GW")


OPP = f"{TEAMS}, {_rolls('tm', 'ro')}"
OPP_COLUMNS = [f"opp_{c}" for c in opponent.STATS]
OPP_SELECT = ", ".join(f"round(coalesce(ro.{c}, 0), 6) AS opp_{c}" for c in opponent.STATS)


@query(f'WITH {B.PANEL}, {OPP} SELECT l.season, l."GW", l.player_code, l.fixture, {OPP_SELECT} FROM l LEFT JOIN ro ON ro.season = l.season AND ro.team = l.opponent AND ro."GW" = l."GW"')
def jn10_opponent_join(spark, sf_dir):
    own = B.panel(spark, sf_dir)
    return opponent.join_opponent(own, opponent.rolls(opponent.team_conceded(own))).select(*KEY, *[six(c) for c in OPP_COLUMNS])


@query(f"""WITH {B.PANEL}, {TEAMS}, {NEXT}, {_rolls("tn", "ro")}, ends AS (SELECT team, xgc_r5, xgc_home_r5, xgc_away_r5 FROM ro WHERE is_next AND season = 'S2')
SELECT l.fixture, {", ".join(f"round(coalesce(ends.{c}, 0), 6) AS opp_{c}" for c in opponent.STATS)} FROM l LEFT JOIN ends ON ends.team = l.opponent WHERE l.season = 'S2'""")
def jn11_opponent_end(spark, sf_dir):
    own = B.panel(spark, sf_dir).where("season = 'S2'")
    ends = opponent.next_event(opponent.team_conceded(own))
    return opponent.join_opponent_end(own.withColumn("opponent_name", F.col("opponent")), ends).select("fixture", *[six(c) for c in OPP_COLUMNS])


SIDE_SQL = "fs AS (SELECT season, k AS pair, min(CASE WHEN was_home THEN team END) AS home, min(CASE WHEN NOT was_home THEN team END) AS away FROM l GROUP BY ALL)"


@query(f"WITH {B.PANEL}, {SIDE_SQL} SELECT l.season, l.fixture, CASE WHEN was_home THEN away ELSE home END AS opponent FROM l JOIN fs ON fs.season = l.season AND fs.pair = l.k")
def jn09_fixture_sides(spark, sf_dir):
    own = B.panel(spark, sf_dir).withColumn("pair", F.col("k"))
    return opponent.opponents_by_side(own.drop("opponent"), fixture="pair").select("season", "fixture", "opponent")


@query(f"WITH {B.PANEL} SELECT season, fixture, n_name AS opponent FROM l LEFT JOIN nation ON n_nationkey = l.opponent")
def jn08_opponent_names(spark, sf_dir):
    own = B.panel(spark, sf_dir).withColumn("opponent_team", F.col("opponent").cast("string")).drop("opponent")
    n = B.read(spark, sf_dir, "nation")
    teams = reduce(lambda a, b: a.unionByName(b), [n.select(F.lit(s).alias("season"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")) for s in ("S0", "S1", "S2")])
    return opponent.opponent_names(own, teams).select("season", "fixture", "opponent")


FLAG = f"""{OVERRIDE}, {TOTALS.replace(SEASONS + ", ", "")}, {OPP} SELECT o.season, o."GW", o.player_code, o.fixture, round(o.defcon_count, 6) AS defcon_count, o.defcon_hit, {", ".join(f"round(o.{n}, 6) AS {n}" for n in LAG_NAMES)},
 CAST(pr.prior_games IS NULL AS INTEGER) AS is_new, {", ".join(f"round(coalesce(pr.{c}, 0), 6) AS {c}" for c in PRIOR)}, {OPP_SELECT}
 FROM o LEFT JOIN pr ON pr.season = o.season AND pr.player_code = o.player_code LEFT JOIN ro ON ro.season = o.season AND ro.team = o.opponent AND ro."GW" = o."GW" """


@query("WITH " + FLAG, cast={"defcon_hit": "DOUBLE", "prior_games": "DOUBLE"})
def flagship_panel_features(spark, sf_dir):
    out = featured(panel(spark, sf_dir), B.LAGGED)
    return out.select(*KEY, six("defcon_count"), "defcon_hit", *[six(F.col(c).cast("double"), c) for c in LAG_NAMES], "is_new", *[six(F.col(c).cast("double"), c) for c in PRIOR], *[six(c) for c in OPP_COLUMNS])


@query(f"WITH {B.PANEL} SELECT position, count(defcon_count) AS known, sum(defcon_count) AS total, max(defcon_count) AS most FROM l GROUP BY ALL")
def scl02_label_count(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("position").agg(F.count("defcon_count").alias("known"), F.sum("defcon_count").alias("total"), F.max("defcon_count").alias("most"))


@query(f"WITH {B.PANEL} SELECT fixture, position, defcon_hit FROM l", cast={"defcon_hit": "DOUBLE"})
def scl03_label_hit(spark, sf_dir):
    return panel(spark, sf_dir).select("fixture", "position", "defcon_hit")


@query(f"WITH {B.PANEL} SELECT fixture, CAST(minutes > 0 AS INTEGER) AS played, least(1.0, greatest(0.0, started))::DOUBLE AS started FROM l")
def scl04_flags(spark, sf_dir):
    return labelled(B.panel(spark, sf_dir), starts="started").select("fixture", "played", "started")


@query(f"WITH {B.PANEL}, {B.FIXTURES} SELECT l.season, l.fixture, CASE WHEN l.was_home THEN f.team_a_difficulty ELSE f.team_h_difficulty END AS fdr FROM l LEFT JOIN f ON f.id = l.fixture")
def scl05_fdr(spark, sf_dir):
    own = B.panel(spark, sf_dir)
    fx = B.fixtures(spark, sf_dir).join(own.select("season", F.col("fixture").alias("id")), "id")
    return opponent.difficulty(own, fx, S.fixture_difficulty("was_home", "team_h_difficulty", "team_a_difficulty")).select("season", "fixture", "fdr")


@query(f"WITH {B.PANEL} SELECT fixture, round(total_points * least(1.0, greatest(0.0, minutes / 90)), 6) AS gated FROM l")
def scl06_decompose(spark, sf_dir):
    return B.panel(spark, sf_dir).select("fixture", six(S.gated("total_points", "minutes"), "gated"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events")
def scl01_coerce(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    return e.select("event_id", S.number(F.get_json_object("props", "$.k")).alias("k"), S.number("event_type").alias("bad"))


@query(f"WITH {B.PANEL} SELECT season, count(*) AS n, sum(minutes)::BIGINT AS minutes FROM l WHERE season IN ('S0', 'S1') GROUP BY ALL")
def flt01_season_split(spark, sf_dir):
    return P.seasons(B.panel(spark, sf_dir), ["S0", "S1"]).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("minutes").alias("minutes"))


@query(f"WITH {LAGS} SELECT fixture FROM g WHERE total_points IS NOT NULL AND total_points_r3 IS NOT NULL AND total_points_r5 IS NOT NULL AND minutes > 0")
def flt03_common_played(spark, sf_dir):
    return lags.add_lags(B.panel(spark, sf_dir), ["total_points"]).where(P.common_played(["total_points", "total_points_r3", "total_points_r5"], "minutes")).select("fixture")


@query(f'WITH {LAGS} SELECT fixture FROM g WHERE defcon_hit IS NOT NULL AND total_points_r3 IS NOT NULL AND position <> \'GK\' AND "GW" > 5 AND minutes > 0')
def flt04_label_holdout(spark, sf_dir):
    own = lags.add_lags(panel(spark, sf_dir), ["total_points"])
    return own.where(P.label_holdout("defcon_hit", "total_points_r3", 5)).select("fixture")


@query(f'WITH {B.PANEL} SELECT fixture FROM l WHERE season IN (\'S0\', \'S1\') AND position <> \'GK\' AND minutes > 0 AND defcon_hit IS NOT NULL AND "GW" <= 5')
def flt05_label_training(spark, sf_dir):
    return panel(spark, sf_dir).where(P.label_training("defcon_hit", ["S0", "S1"], 5)).select("fixture")


@query(f"WITH {B.PANEL} SELECT fixture FROM l WHERE minutes > 0")
def flt10_played(spark, sf_dir):
    return B.panel(spark, sf_dir).where(S.played("minutes")).select("fixture")


@query(f"WITH {B.PANEL} SELECT fixture FROM l WHERE season = 'S1' AND kickoff_time < TIMESTAMP '2024-01-15 00:00:00'")
def flt11_known_before(spark, sf_dir):
    return B.panel(spark, sf_dir).where(P.known_before("S1", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))).select("fixture")


@query("""WITH f AS (SELECT *, CAST(day(ts) AS INTEGER) AS d FROM events), ok AS (SELECT event_type IN ('click', 'view') AND event_id % 3 <> 0 AND d > 0 AND d < 20 AND ts < TIMESTAMP '2024-01-18 12:00:00' AS ok FROM f)
SELECT count_if(ok) AS n_admitted, count_if(NOT ok) AS n_excluded FROM ok""", cast={"n_admitted": "BIGINT", "n_excluded": "BIGINT"})
def flt06_admissible(spark, sf_dir):
    return live.excluded_count(B.fixtures(spark, sf_dir), F.lit(20), [F.lit("2024-01-18 12:00:00").cast("timestamp_ntz")], "event")


@query(f"WITH {B.FIXTURES} SELECT id, event FROM f WHERE NOT finished AND event = 12")
def flt07_unfinished(spark, sf_dir):
    return B.fixtures(spark, sf_dir).where(P.unfinished(target=F.lit(12))).select("id", "event")


@query(f"WITH {B.FIXTURES} SELECT id FROM f WHERE finished AND finished_provisional")
def flt08_final(spark, sf_dir):
    return B.fixtures(spark, sf_dir).withColumn("data_checked", F.col("finished_provisional")).where(P.final_event()).select("id")


@query(f"WITH {B.FIXTURES} SELECT id, team, opponent, CAST(was_home AS INTEGER) AS was_home, fdr FROM s")
def so04_unpivot(spark, sf_dir):
    return live.sides(B.fixtures(spark, sf_dir)).select("id", "team", "opponent", F.col("was_home").cast("int").alias("was_home"), "fdr")


@query(f"WITH {B.FIXTURES}, r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY event, kickoff_time, id) AS rn FROM s WHERE NOT finished) SELECT team, id, event, opponent FROM r WHERE rn = 1")
def st03_next_fixture(spark, sf_dir):
    return live.next_fixtures(B.fixtures(spark, sf_dir)).select("team", "id", "event", "opponent")


@query(f"WITH {B.FIXTURES} SELECT team, arg_min(opponent, (kickoff_time, id)) AS opponent, arg_min(event, (kickoff_time, id)) AS event FROM s GROUP BY team")
def st05_next_by_kickoff(spark, sf_dir):
    return live.next_by_kickoff(live.sides(B.fixtures(spark, sf_dir))).select("team", "opponent", "event")


@query(f"WITH {B.FIXTURES} SELECT team, event, count(*) AS n_fixtures FROM s GROUP BY ALL HAVING count(*) >= 2")
def ag06_double_events(spark, sf_dir):
    return live.double_events(live.sides(B.fixtures(spark, sf_dir)))


@query(f"WITH {B.FIXTURES} SELECT event, count(*) AS n FROM f GROUP BY event ORDER BY n DESC, event LIMIT 1")
def ag07_modal_event(spark, sf_dir):
    return live.modal_event(B.fixtures(spark, sf_dir))


EVENT_TABLE = "ev AS (SELECT CAST(day(ts) AS INTEGER) AS id, count_if(event_type = 'error') = 0 AND day(ts) < 12 OR day(ts) < 9 AS finished, day(ts) < 8 AS data_checked, day(ts) = 9 AS is_current, day(ts) = 10 AS is_next, round(avg(value), 6) AS average_entry_score FROM events GROUP BY day(ts))"


def event_table(spark, sf_dir):
    d = F.dayofmonth("ts").alias("id")
    own = B.read(spark, sf_dir, "events").groupBy(d).agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.avg("value").alias("average_entry_score"))
    i = F.col("id")
    return own.select("id", (((F.col("bad") == 0) & (i < 12)) | (i < 9)).alias("finished"), (i < 8).alias("data_checked"), (i == 9).alias("is_current"), (i == 10).alias("is_next"), six("average_entry_score"))


@query(f"WITH {EVENT_TABLE} SELECT max(id) AS event FROM ev WHERE finished AND data_checked")
def st06_latest_final(spark, sf_dir):
    return live.latest_final(event_table(spark, sf_dir))


@query(f"WITH {EVENT_TABLE} SELECT coalesce(min(CASE WHEN is_next THEN id END), min(CASE WHEN NOT finished THEN id END)) AS event FROM ev")
def st07_next_event(spark, sf_dir):
    return live.next_event(event_table(spark, sf_dir))


@query(f"""WITH {EVENT_TABLE} SELECT min(CASE WHEN is_current THEN id END) AS "current", min(CASE WHEN is_next THEN id END) AS "next", array_to_string(list_sort(list(id) FILTER (finished)), ',') AS finished FROM ev""")
def st08_event_context(spark, sf_dir):
    return live.event_context(event_table(spark, sf_dir)).withColumn("finished", F.array_join(F.transform("finished", lambda x: x.cast("string")), ","))


@query(f"WITH {EVENT_TABLE} SELECT id, CASE WHEN finished AND data_checked THEN 'final' WHEN finished THEN 'review' WHEN is_current THEN 'live' END AS status, CASE WHEN finished AND data_checked THEN 'verified' ELSE 'provisional' END AS label FROM ev")
def scl21_event_status(spark, sf_dir):
    return event_table(spark, sf_dir).select("id", S.event_status("finished", "data_checked", "is_current").alias("status"), S.verification("finished", "data_checked").alias("label"))


@query(f"""WITH {EVENT_TABLE}, hist AS (SELECT CAST(day(ts) AS INTEGER) AS event, round(sum(value), 6) AS points FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY 1)
SELECT event, points, CASE WHEN finished AND data_checked THEN 'final' WHEN finished THEN 'review' ELSE 'live' END AS status, round(points - average_entry_score, 6) AS vs_avg FROM hist JOIN ev ON ev.id = event WHERE finished OR is_current""")
def jn15_entry_weeks(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    first = e.agg(F.min("user_id").alias("user_id"))
    history = e.join(F.broadcast(first), "user_id").groupBy(F.dayofmonth("ts").alias("event")).agg(six(F.sum("value"), "points"))
    return live.entry_weeks(history, event_table(spark, sf_dir)).select("event", "points", "status", six("vs_avg"))


@query("""WITH t AS (SELECT o_custkey AS element, count(*) AS "rows", sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT c_custkey AS element, coalesce("rows", 0) AS "rows", round(coalesce(total, 0), 2) AS total_points FROM customer LEFT JOIN t ON element = c_custkey""")
def ag05_element_totals(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("element"), F.lit(0).alias("minutes"), F.lit(0).alias("starts"), F.col("o_totalprice").alias("total_points"))
    return live.totals_by_element(B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("element")), o).select("element", "rows", F.round("total_points", 2).alias("total_points"))


@query('SELECT l_orderkey, l_linenumber, CAST(count(*) AS VARCHAR) AS n FROM (SELECT DISTINCT * FROM lineitem) GROUP BY ALL HAVING count(*) > 1')
def val03_conflicts(spark, sf_dir):
    found = checks.conflicting_duplicates(B.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    at = lambda i: F.regexp_extract("key", r"l_orderkey=(\d+), l_linenumber=(\d+)", i)
    return found.select(at(1).cast("long").alias("l_orderkey"), at(2).cast("int").alias("l_linenumber"), F.col("detail").alias("n"))


@query("SELECT count(*) AS n, sum(k1)::BIGINT AS keys FROM (SELECT l_orderkey AS k1, l_linenumber FROM lineitem GROUP BY ALL)")
def st02_dedupe(spark, sf_dir):
    return checks.drop_exact_duplicates(B.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("SELECT count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def val01_duplicates(spark, sf_dir):
    return checks.duplicate_keys(B.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("detail").cast("long")).alias("n_rows"))


@query("SELECT count(*) AS n FROM (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 1)")
def val02_many_to_one(spark, sf_dir):
    return checks.many_to_one(B.read(spark, sf_dir, "part"), ["p_brand"]).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {B.PANEL}, g0 AS (SELECT *, lag(minutes, 1) OVER ({W}) AS minutes_l1, avg(minutes) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS minutes_r3 FROM l)
SELECT count(*) AS n FROM (SELECT 1 FROM g0 GROUP BY season, "GW", player_code HAVING count(DISTINCT minutes_l1) + max(CAST(minutes_l1 IS NULL AS INTEGER)) > 1 OR count(DISTINCT round(minutes_r3, 9)) + max(CAST(minutes_r3 IS NULL AS INTEGER)) > 1)""")
def val04_lag_divergence(spark, sf_dir):
    own = lags.add_lags(B.panel(spark, sf_dir), ["minutes"], (3,), broadcast_event=False).withColumn("minutes_r3", F.round("minutes_r3", 9))
    return checks.divergent_lags(own, ["minutes_l1", "minutes_r3"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def val05_post_cutoff(spark, sf_dir):
    return checks.after_cutoff(B.read(spark, sf_dir, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), ["event_id"]).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT event_id, user_id, CAST(day(ts) AS INTEGER) AS d, CASE WHEN event_id % 17 = 0 THEN day(ts) + 1 ELSE day(ts) END AS round FROM events)
SELECT 'event differs from fixture' AS rule, count(*) AS n FROM h WHERE round <> d HAVING count(*) > 0 UNION ALL SELECT 'unknown element', count(*) FROM h WHERE user_id NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0""")
def val12_alignment(spark, sf_dir):
    fx = B.fixtures(spark, sf_dir)
    e = B.read(spark, sf_dir, "events").select(F.col("user_id").alias("element"), F.col("event_id").alias("fixture"), F.col("ts").alias("kickoff_time"), (F.dayofmonth("ts") + (F.col("event_id") % 17 == 0).cast("int")).alias("round"), (F.col("event_id") % 2 == 0).alias("was_home"))
    elements = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return checks.violations(checks.bad_alignment(live.history_with_meta(e, fx, elements))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS n FROM customer LEFT JOIN t ON o_custkey = c_custkey WHERE coalesce(n, 0) <> CASE WHEN c_custkey % 10 = 0 THEN 3 ELSE coalesce(n, 0) END""")
def val14_totals(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("element"), F.lit(1).alias("minutes"), F.lit(0).alias("starts"), F.lit(0).alias("total_points"))
    n = o.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    c = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("element")).join(n, "element", "left")
    told = c.select("element", F.when(F.col("element") % 10 == 0, 3).otherwise(F.coalesce("n", F.lit(0))).alias("minutes"), F.lit(0).alias("starts"), F.lit(0).alias("total_points"))
    return checks.bad_totals(told, o).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {B.FIXTURES} SELECT count(*) AS n FROM (SELECT DISTINCT team, event FROM (SELECT team, event FROM s WHERE NOT finished GROUP BY ALL HAVING count(*) > 1))")
def val17_double_fixtures(spark, sf_dir):
    own = live.sides(B.fixtures(spark, sf_dir).where(P.unfinished()))
    return checks.live_board_gaps(own, B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")))[0].agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def so06_id_difference(spark, sf_dir):
    c = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("element"), F.col("c_custkey").alias("code"))
    o = B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("element")).distinct()
    return checks.bad_coverage(o, c)[2].agg(F.count(F.lit(1)).alias("n"))
