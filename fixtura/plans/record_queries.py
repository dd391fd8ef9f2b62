"""Queries over live joins, record checks, unions and shares: the operators that the other two modules leave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fixtura.functions import predicates as P
from fixtura.functions import scalars as S
from fixtura.operators import baselines, checks, lags, lineup, live, metrics, models, opponent, priors, sinks
from fixtura.plans import bindings as B
from fixtura.plans.live_board import publish
from fixtura.plans.panel_queries import LAGS, TEAMS, event_table, panel
from fixtura.plans.registry import query, six
from fixtura.plans.score_queries import BLEND, EWMA, FEATURES, FROZEN, HISTORY, KEY, SCALE, forecasts, frozen_rows, history


def one(df):
    return df.agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LAGS} SELECT count(*) AS n FROM g WHERE total_points IS NOT NULL AND total_points_r3 IS NOT NULL AND minutes_r5 IS NOT NULL AND total_points_l1 IS NOT NULL")
def flt02_common_mask(spark, sf_dir):
    return one(forecasts(spark, sf_dir).where(P.all_finite("total_points", "total_points_r3", "minutes_r5", "total_points_l1")))


@query(f"WITH {B.FIXTURES}, {B.PANEL} SELECT l.fixture, f.team_h_difficulty, f.team_a_difficulty FROM l LEFT JOIN f ON f.id = l.fixture")
def jn02_fixture_difficulty(spark, sf_dir):
    own = B.panel(spark, sf_dir)
    fx = B.fixtures(spark, sf_dir).join(own.select("season", F.col("fixture").alias("id")), "id")
    return opponent.difficulty(own, fx, F.lit(None).cast("int")).select("fixture", "team_h_difficulty", "team_a_difficulty")


@query(f"""WITH {B.PANEL}, rg AS (SELECT player_code, min(pen) AS pen FROM l WHERE season = 'S1' AND pen IS NOT NULL GROUP BY 1)
SELECT l.fixture, rg.pen AS penalties_order FROM l LEFT JOIN rg USING (player_code)""")
def jn03_set_piece_orders(spark, sf_dir):
    own = B.panel(spark, sf_dir)
    registry = own.where("season = 'S1' and penalties_order is not null").select("player_code", "penalties_order")
    return priors.set_piece_orders(own, registry, ["penalties_order"]).select("fixture", "penalties_order")


@query("""WITH nx AS (SELECT n_nationkey AS team, n_regionkey AS opponent FROM nation), pr AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS prior FROM orders GROUP BY 1), cu AS (SELECT o_custkey AS k, count(*) AS minutes_l1 FROM orders GROUP BY 1)
SELECT c_custkey AS element, nx.opponent, pr.prior, cu.minutes_l1 FROM customer LEFT JOIN nx ON nx.team = c_nationkey LEFT JOIN pr ON pr.k = c_custkey LEFT JOIN cu ON cu.k = c_custkey""")
def jn12_live_rows(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders")
    elements = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("element"), F.col("c_custkey").alias("player_code"), F.col("c_nationkey").alias("team"))
    fixtures = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").alias("opponent"))
    prior = o.groupBy(F.col("o_custkey").alias("player_code")).agg(F.round(F.sum("o_totalprice"), 2).alias("prior"), F.min(F.lit(-1)).cast("long").alias("minutes_l1"))
    current = o.groupBy(F.col("o_custkey").alias("element")).agg(F.count(F.lit(1)).alias("minutes_l1"))
    return live.live_rows(elements, fixtures, prior, current, ["minutes_l1"]).select("element", "opponent", "prior", "minutes_l1")


@query("WITH a AS (SELECT o_custkey, min((o_totalprice, o_orderkey)) AS a FROM orders GROUP BY 1) SELECT c_custkey AS id, a[1] AS total_points FROM customer JOIN a ON o_custkey = c_custkey")
def jn13_match_actuals(spark, sf_dir):
    board = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    actuals = B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("total_points"), "o_orderkey")
    return metrics.match_actuals(board, actuals).select("id", "total_points")


@query(f"WITH {B.SQUADS} SELECT squad_id, sq.id AS element, p_type AS web_name, n_name AS team_name, l.n AS minutes FROM sq JOIN part ON p_partkey = sq.id LEFT JOIN nation ON n_nationkey = p_size LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1) l ON l_partkey = sq.id")
def jn16_picked(spark, sf_dir):
    picks = B.squads(spark, sf_dir).select("squad_id", F.col("id").alias("element"))
    elements = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("element"), F.col("p_type").alias("web_name"), F.col("p_size").alias("team"))
    teams = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), F.col("n_name").alias("team_name"))
    stats = B.read(spark, sf_dir, "lineitem").groupBy(F.when(F.col("l_partkey") % 3 == 0, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("element")).agg(F.count(F.lit(1)).alias("minutes"))
    return live.picked(picks, elements, teams, stats).select("squad_id", "element", "web_name", "team_name", "minutes")


@query("""WITH s AS (SELECT DISTINCT upper(CASE WHEN p_size > 25 THEN p_name || ' ' || p_partkey ELSE p_brand END) AS name FROM part), r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name || ' ' || p_partkey END AS web_name FROM part),
j AS (SELECT name, count(r.id) AS n, min(r.id) AS id FROM s LEFT JOIN r ON lower(r.web_name) = lower(s.name) GROUP BY 1) SELECT name, id FROM j WHERE n = 1""")
def jn17_unique_names(spark, sf_dir):
    part = B.read(spark, sf_dir, "part")
    own = F.concat_ws(" ", "p_name", "p_partkey")
    saved = part.select(F.upper(F.when(F.col("p_size") > 25, own).otherwise(F.col("p_brand"))).alias("name")).distinct()
    registry = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(own).alias("web_name"))
    return checks.unique_names(saved, registry)[0].select("name", "id")


@query("""WITH r AS (SELECT p_name, min(p_size) AS v FROM part WHERE p_size > 10 GROUP BY 1), b AS (SELECT p_name, p_size FROM part)
SELECT 'name has no match' AS rule, count(*) AS n FROM b WHERE p_name NOT IN (SELECT p_name FROM r) HAVING count(*) > 0 UNION ALL SELECT 'value differs', count(*) FROM b JOIN r USING (p_name) WHERE p_size <> v HAVING count(*) > 0""")
def val09_name_values(spark, sf_dir):
    part = B.read(spark, sf_dir, "part")
    own = checks.bad_names(part, part.where("p_size > 10").select("p_name", "p_size"), "p_name", "p_size")
    return checks.violations(own).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {B.FIXTURES} SELECT e.event_id AS fixture, CASE WHEN e.event_id % 2 = 0 THEN f.team_h ELSE f.team_a END AS team, CASE WHEN e.event_id % 2 = 0 THEN f.team_a ELSE f.team_h END AS opponent, c_custkey AS el_id FROM events e LEFT JOIN f ON f.id = e.event_id AND f.finished LEFT JOIN customer ON c_custkey = e.user_id AND c_custkey % 5 > 0")
def jn19_history_meta(spark, sf_dir):
    rows = B.read(spark, sf_dir, "events").select(F.col("event_id").alias("fixture"), F.col("user_id").alias("element"), (F.col("event_id") % 2 == 0).alias("was_home"))
    elements = B.read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 == 0, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("id"))
    return live.history_with_meta(rows, B.fixtures(spark, sf_dir).where("finished"), elements).select("fixture", "team", "opponent", "el_id")


@query(f"WITH {B.MONTHS}, {HISTORY}, {EWMA}, {FROZEN} SELECT player_id, round(baseline_position_median, 4) AS baseline_position_median, ac.points FROM bs LEFT JOIN ac USING (player_id)")
def jn20_evidence(spark, sf_dir):
    frozen, past, now = history(spark, sf_dir)
    own = baselines.evidence(baselines.baselines(frozen, past).select("player_id", "baseline_position_median"), now.select("player_id", "points"))
    return own.select("player_id", F.round("baseline_position_median", 4).alias("baseline_position_median"), "points")


@query(f"""WITH {B.PANEL} SELECT count(*) AS n FROM (SELECT 1 FROM l GROUP BY season, "GW", player_code HAVING count(DISTINCT rec) + max(CAST(rec IS NULL AS INTEGER)) > 1)""")
def ag11_distinct_with_nulls(spark, sf_dir):
    return one(checks.divergent_lags(B.panel(spark, sf_dir), ["recoveries"]))


@query(f"WITH {B.SQUADS} SELECT squad_id, count_if(position = 'GK') AS n_gk, count_if(position = 'DEF') AS n_def, count_if(position = 'MID') AS n_mid, count_if(position = 'FWD') AS n_fwd, sum(cost)::BIGINT AS cost FROM xi GROUP BY 1", cast={"n_gk": "BIGINT", "n_def": "BIGINT", "n_mid": "BIGINT", "n_fwd": "BIGINT"})
def ag12_squad_totals(spark, sf_dir):
    return lineup.squad_totals(lineup.best_xi(B.squads(spark, sf_dir))).select("squad_id", "n_gk", "n_def", "n_mid", "n_fwd", "cost")


@query()
def st09_top_importances(spark, sf_dir):
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    return models.importances(models.fit(models.regressor(5), own.where("season <> 'S2'"), FEATURES, "minutes"), FEATURES, spark, 20)


@query("""WITH pk AS (SELECT o_custkey AS entry_id, CAST(o_orderkey % 12 + 1 AS INTEGER) AS event, o_orderkey AS element FROM orders), rk AS (SELECT *, CASE WHEN event = 10 THEN 0 WHEN event = 9 THEN 1 WHEN event < 9 THEN 12 - event END AS r FROM pk),
b AS (SELECT entry_id, min(r) AS m FROM rk GROUP BY 1) SELECT entry_id, event, element FROM rk JOIN b USING (entry_id) WHERE r = m""")
def st12_newest_picks(spark, sf_dir):
    picks = B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry_id"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("event"), F.col("o_orderkey").alias("element"))
    i = F.col("id")
    events = event_table(spark, sf_dir).select("id", (i < 9).alias("finished"), (i == 9).alias("is_current"), (i == 10).alias("is_next"))
    return live.newest_picks(picks, events).select("entry_id", "event", "element")


@query(f"WITH {B.PANEL} SELECT season, count(*) AS n, count(CASE WHEN season <> 'S0' THEN cbi END) AS known FROM l GROUP BY 1")
def so01_union_of_seasons(spark, sf_dir):
    own = B.panel(spark, sf_dir)
    parts = [own.where("season = 'S0'").drop("clearances_blocks_interceptions"), own.where("season = 'S1'"), own.where("season = 'S2'")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count("clearances_blocks_interceptions").alias("known"))


@query(f'WITH {B.PANEL}, {TEAMS} SELECT season, count(*) + count(DISTINCT team) AS n FROM tm GROUP BY 1')
def so02_team_sentinels(spark, sf_dir):
    return opponent.with_next_event(opponent.team_conceded(B.panel(spark, sf_dir))).groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {B.PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY season, player_code ORDER BY "GW" DESC, kickoff_time DESC, fixture DESC) AS rn FROM p WHERE "GW" < 6), t AS (SELECT DISTINCT season, player_code FROM p)
SELECT t.season, t.player_code, round(coalesce(max(CASE WHEN rn = 1 THEN minutes END), 0), 6) AS minutes_l1 FROM t LEFT JOIN r USING (season, player_code) GROUP BY ALL""", cast={"minutes_l1": "DOUBLE"})
def so03_target_sentinels(spark, sf_dir):
    own = B.panel(spark, sf_dir)
    targets = own.select("season", "player_code").distinct().withColumn("GW", F.lit(6))
    return lags.form_at(own.where("GW < 6"), targets, ["minutes"], entity=("season", "player_code")).select("season", "player_code", six(F.col("minutes_l1").cast("double"), "minutes_l1"))


@query(f"WITH {B.PANEL} SELECT count(*) AS n, sum(fixture)::BIGINT AS keys FROM l")
def so05_splits_joined(spark, sf_dir):
    own = B.panel(spark, sf_dir)
    both = P.seasons(own, ["S0", "S1"]).unionByName(P.seasons(own, ["S2"]))
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum("fixture").alias("keys"))


@query("SELECT 'position is not allowed' AS rule, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') HAVING count(*) > 0")
def val07_bad_snapshot(spark, sf_dir):
    frozen = history(spark, sf_dir)[0].withColumns({"season": F.lit("all"), "week": F.lit(1)})
    return checks.violations(checks.bad_snapshot(frozen, ["BUILDING", "MACHINERY"])).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LAGS} SELECT 'field=' || f AS key, CAST(n AS VARCHAR) AS n FROM (SELECT 'minutes_r3' AS f, count_if(minutes_r3 IS NULL) AS n FROM g UNION ALL SELECT 'rec', count_if(rec IS NULL AND position <> 'GK') FROM g) WHERE n > 0")
def val13_bad_fields(spark, sf_dir):
    own = lags.add_lags(B.panel(spark, sf_dir), ["minutes"]).withColumn("rec", F.col("recoveries"))
    return checks.bad_fields(own, ["minutes_r3", "rec"], ["rec"]).select("key", F.col("detail").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT day(ts) AS d, max(ts) AS deadline FROM events GROUP BY 1) WHERE d = 12 AND deadline <= TIMESTAMP '2024-01-13 00:00:00'")
def val15_late_as_of(spark, sf_dir):
    events = B.read(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("id")).agg(F.max("ts").alias("deadline_time"))
    return one(checks.late_as_of(events, 12, F.lit("2024-01-13 00:00:00").cast("timestamp_ntz")))


@query(f"WITH {B.PANEL} SELECT 'prior kickoff is not before the cutoff' AS rule, count(*) AS n FROM l WHERE season = 'S1' AND kickoff_time >= TIMESTAMP '2024-01-16 00:00:00' HAVING count(*) > 0")
def val16_bad_prior(spark, sf_dir):
    own = checks.bad_prior(B.panel(spark, sf_dir), "S1", F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    return checks.violations(own).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'bank' AS detail, count(*) AS n FROM supplier WHERE s_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'captain in XI', count(*) FROM supplier WHERE s_suppkey % 14 > 10 HAVING count(*) > 0")
def val20_plan_sanity(spark, sf_dir):
    ids = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    k = F.col("s_suppkey")
    plans = B.read(spark, sf_dir, "supplier").select(k.alias("plan_id"), ids(0, 14).alias("squad"), ids(0, 10).alias("xi"), ids(11, 14).alias("bench"), F.array(F.lit(1)).alias("sold"), F.array(F.lit(20)).alias("bought"), (k % 14).cast("int").alias("captain"), F.when(k % 14 == 0, 1).otherwise(0).alias("vice"), F.col("s_acctbal").alias("bank"))
    return checks.plan_sanity(plans).groupBy("detail").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '(bearer\s+[a-z0-9._-]{16,}|-----begin [a-z ]*private key-----|\bAKIA[0-9A-Z]{16}\b|password\s*[=:]|token\s*[=:])', 'i')")
def val21_public_record(spark, sf_dir):
    return one(checks.public_record(B.read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])[0])


@query(f"WITH {LAGS} SELECT unnest(['minutes_l1', 'minutes_r3', 'minutes_r5', 'was_home']) AS name, unnest([count(minutes_l1), count(minutes_r3), count(minutes_r5), count(was_home)]) AS known FROM g")
def scl19_feature_names(spark, sf_dir):
    """The allowed features, each with the rows that know it."""
    own = lags.add_lags(B.panel(spark, sf_dir), ["minutes"])
    names = S.feature_names(own, {"minutes", "total_points", "k"}, {"was_home", "total_points"})
    checks.forbid_columns(names, ["minutes", "total_points"])  # VAL-18
    known = own.agg(*[F.count(n).alias(n) for n in names])
    return known.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("known")) for n in names])).alias("x")).select("x.name", "x.known")


@query(f'WITH {LAGS} SELECT fixture, round(abs(total_points - total_points_r3) - abs(total_points - total_points_r5), 6) AS edge FROM g WHERE total_points_r3 IS NOT NULL')
def scl28_edge(spark, sf_dir):
    own = forecasts(spark, sf_dir).where("total_points_r3 is not null")
    return own.select("fixture", six(S.edge(S.absolute_error("total_points", "total_points_r3"), S.absolute_error("total_points", "total_points_r5")), "edge"))


@query(f"WITH {B.SQUADS}, r AS (SELECT squad_id, id, row_number() OVER (PARTITION BY squad_id ORDER BY points DESC, id) AS n FROM xi WHERE is_xi) SELECT squad_id, CASE WHEN squad_id % 5 = 0 THEN '-' ELSE p_name || CASE WHEN squad_id % 3 = 0 THEN ' (TC)' ELSE '' END END AS label FROM r JOIN part ON p_partkey = id WHERE n = 1")
def scl29_captain_label(spark, sf_dir):
    own = lineup.captains(lineup.best_xi(B.squads(spark, sf_dir))).where("role = 'captain'")
    names = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("web_name"))
    pick = F.struct("web_name", (F.col("squad_id") % 5 != 0).alias("is_captain"), F.when(F.col("squad_id") % 3 == 0, 3).otherwise(2).alias("multiplier"))
    return own.join(names, "id").groupBy("squad_id").agg(F.collect_list(pick).alias("picks")).select("squad_id", S.captain_label("picks").alias("label"))


@query(f'WITH {LAGS} SELECT round(avg(abs(total_points - total_points_r5)) FILTER ("GW" = 4), 6) AS mae_event, round(avg(abs(minutes - coalesce(minutes_r3, 0))), 6) AS mae_minutes FROM g')
def met04_minutes_error(spark, sf_dir):
    own = metrics.holdout(forecasts(spark, sf_dir).withColumn("GW", F.when(F.col("GW") == 4, 1).otherwise(0)), "total_points", ["total_points_r5"], minutes=("minutes", "minutes_r3"))
    return own.select(six("mae_first_event", "mae_event"), six("mae_minutes"))


@query(f"WITH {B.MONTHS}, {HISTORY}, {EWMA}, {FROZEN} SELECT player_id, round(abs(actual - baseline_ewma4), 3) AS error FROM fa WHERE played = 0")
def met10_did_not_play(spark, sf_dir):
    return frozen_rows(spark, sf_dir).where("played = 0").select("player_id", F.round(S.absolute_error("actual", "baseline_ewma4"), 3).alias("error"))


@query("SELECT 'train' AS split, count(*) AS \"rows\" FROM part WHERE p_size <= 25 UNION ALL SELECT 'validation', count(*) FROM part WHERE p_size > 25")
def snk02_split_rows(spark, sf_dir):
    part = B.read(spark, sf_dir, "part")
    parts = {"train": part.where("p_size <= 25"), "validation": part.where("p_size > 25")}
    return reduce(lambda a, b: a.unionByName(b), [sinks.content_hash(df).select(F.lit(s).alias("split"), "rows") for s, df in parts.items()])


@query()
def ml16_attached_quantiles(spark, sf_dir):
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    q = models.leaf_quantiles(own.where("season <> 'S2'"), own.where("season = 'S2'"), FEATURES, "total_points").withColumnRenamed("fixture", "id")
    board = panel(spark, sf_dir).where("season = 'S2'").select(F.col("fixture").alias("id"), "player_code")
    return models.attach_quantiles(board, q)


@query(f"""WITH {B.BOARD}, {BLEND}, sc AS (SELECT *, {SCALE} AS scale, CASE WHEN raw = 0 THEN 1.0 ELSE least(2.0, greatest(0.5, blend / raw)) END AS lift FROM bm),
pb AS (SELECT *, blend * scale AS pm, CASE WHEN position = 'GK' THEN 0.0 ELSE head_defcon * scale END AS pd, (head_points - 1.25) * lift * scale AS lo, (head_points + 2.25) * lift * scale AS hi FROM sc)
SELECT id, round(lo, 6) + 0.0 AS pred_points_p10, round(hi, 6) + 0.0 AS pred_points_p90, round(hi * least(1.0, greatest(0.0, pm / 90)) + 2 * pd, 6) AS e_points_p90 FROM pb""")
def ml16_lifted_quantiles(spark, sf_dir):
    own = B.board(spark, sf_dir)
    live = own.withColumns({"q_low": F.col("head_points") - 1, "q_high": F.col("head_points") + 2})
    board = publish(own.withColumnRenamed("chance", "chance_of_playing_next_round")).select("id", "pred_minutes", "pred_defcon")
    return models.lifted_quantiles(board, live, -0.25, 0.25).select("id", six("pred_points_p10"), six("pred_points_p90"), six("e_points_p90"))


@query()
def ml15_refit_quantiles(spark, sf_dir):
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    now = own.where("season = 'S2'")
    return models.refit_quantiles(now.select(*KEY, "total_points"), now, own.where("season <> 'S2'"), FEATURES, "total_points", KEY).select(*KEY, "q_low", "q_high")
