"""Queries over boards, baselines, scores, intervals, heads, squads and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtura.functions import predicates as P
from fixtura.functions import scalars as S
from fixtura.operators import baselines, checks, intervals, lags, lineup, live, metrics, models, sinks
from fixtura.operators.stored import stored
from fixtura.plans import bindings as B
from fixtura.plans.live_board import publish
from fixtura.plans.panel_queries import KEY, LAGS, panel
from fixtura.plans.registry import query, six

# --- boards ---------------------------------------------------------------------------------------------------------

SCALE = "CASE WHEN status IN ('i','s','u','n') AND coalesce(chance, 0) = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, coalesce(chance, 100) / 100)) END"


@query(f"WITH {B.BOARD} SELECT id, {SCALE}::DOUBLE AS scale FROM b")
def scl07_availability(spark, sf_dir):
    return B.board(spark, sf_dir).select("id", S.availability("status", "chance").alias("scale"))


@query(f"WITH {B.BOARD} SELECT id FROM b WHERE (status = 'a' OR chance IS NULL OR chance <> 0) AND points IS NOT NULL")
def scl08_eligible(spark, sf_dir):
    own = B.board(spark, sf_dir).withColumnsRenamed({"chance": "chance_of_playing_next_round", "points": "e_points_final", "cost": "now_cost", "club": "team_name"})
    return P.pickable(own).select("id")


@query(f"WITH {B.BOARD} SELECT id FROM b WHERE status IN ('i','s','u','n') OR coalesce(chance < 75, false)")
def scl09_flagged(spark, sf_dir):
    return B.board(spark, sf_dir).where(S.flagged("status", "chance")).select("id")


_KNOTS = " ".join(f"WHEN m <= {x1} THEN {y0} + (m - {x0}) * {(y1 - y0) / (x1 - x0)!r}" for (x0, y0), (x1, y1) in zip(S.PLAY_KNOTS, S.PLAY_KNOTS[1:], strict=False))


@query(f"WITH {B.BOARD}, pp AS (SELECT id, least(CASE WHEN m <= 0 THEN 0.0 {_KNOTS} ELSE {S.PLAY_KNOTS[-1][1]} END, coalesce(chance / 100, 1.0)) AS p FROM (SELECT *, head_minutes AS m FROM b)) SELECT id, round(CASE WHEN p < 0.05 THEN 0.0 ELSE p END, 6) AS p FROM pp")
def scl10_play_probability(spark, sf_dir):
    return B.board(spark, sf_dir).select("id", six(S.play_probability("head_minutes", "chance"), "p"))


BLEND = """bl AS (SELECT *, least(90.0, greatest(0.0, head_minutes)) AS raw FROM b),
bm AS (SELECT *, CASE WHEN status = 'a' AND prior_starts / nullif(prior_games, 0) >= 0.6 AND starts_l1 >= 0.5 AND prior_minutes_pg >= 60 THEN greatest(raw, least(prior_minutes_pg, 90.0)) ELSE raw END AS blend FROM bl)"""


@query(f"WITH {B.BOARD}, {BLEND} SELECT id, round(blend, 6) AS minutes, round(CASE WHEN raw = 0 THEN 1.0 ELSE least(2.0, greatest(0.5, blend / raw)) END, 6) AS lift FROM bm")
def scl11_blend_lift(spark, sf_dir):
    c = F.col
    own = B.board(spark, sf_dir).withColumn("raw", S.clip("head_minutes", 0.0, 90.0))
    own = own.withColumn("blend", S.blended_minutes(c("raw"), c("status"), c("prior_starts"), c("prior_games"), c("starts_l1"), c("prior_minutes_pg")))
    return own.select("id", six("blend", "minutes"), six(S.minutes_lift(c("blend"), c("raw")), "lift"))


@query(f"""WITH {B.BOARD}, {BLEND}, sc AS (SELECT *, {SCALE} AS scale FROM bm), pb AS (SELECT *, blend * scale AS pm, head_points * scale AS pp, CASE WHEN position = 'GK' THEN 0.0 ELSE head_defcon * scale END AS pd FROM sc)
SELECT id, round(pm, 6) AS pred_minutes, round(pp, 6) AS pred_points, round(pd, 6) AS pred_defcon, round(pp * least(1.0, greatest(0.0, pm / 90)), 6) AS pred_points_decomposed, round(pp * least(1.0, greatest(0.0, pm / 90)) + 2 * pd, 6) AS e_points_final FROM pb""")
def scl12_published(spark, sf_dir):
    own = publish(B.board(spark, sf_dir).withColumnRenamed("chance", "chance_of_playing_next_round"))
    return own.select("id", *[six(x) for x in ("pred_minutes", "pred_points", "pred_defcon", "pred_points_decomposed", "e_points_final")])


@query(f"""WITH {B.BOARD}, iv AS (SELECT id, (head_points - 1 - 0.25) * 1.5 AS lo, greatest(head_points + 2 + 0.25, head_points - 1 - 0.25) * 1.5 AS hi, head_minutes AS m, head_defcon AS d FROM b)
SELECT id, round(lo, 6) AS pred_points_p10, round(hi, 6) AS pred_points_p90, round(hi * least(1.0, greatest(0.0, m / 90)) + 2 * d, 6) AS e_points_p90 FROM iv""")
def scl13_quantile_columns(spark, sf_dir):
    c = F.col
    made = S.interval_columns(c("head_points") - 1, c("head_points") + 2, -0.25, 0.25, F.lit(1.5), F.lit(1.0), c("head_minutes"), c("head_defcon"))
    own = B.board(spark, sf_dir).withColumns(made)
    return own.select("id", *[six(x) for x in made])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity * 0.04 + l_linenumber * 4 + l_discount * -2 + l_tax * 0.1, 6) AS points FROM lineitem")
def scl14_weighted_points(spark, sf_dir):
    w = {"l_quantity": 0.04, "l_linenumber": 4.0, "l_discount": -2.0, "l_tax": 0.1}
    return B.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.weighted_points(w).alias("points"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS at FROM events")
def scl15_utc(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "Z").otherwise("+00:00"))
    return e.select("event_id", F.to_utc_timestamp(S.utc(text), F.current_timezone()).cast("timestamp_ntz").alias("at"))


_Y = "CAST(1990 + o_orderkey % 25 AS INTEGER)"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE printf('%04d-%02d', {_Y} - 1, {_Y} % 100) END AS previous FROM orders")
def scl16_previous_season(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders")
    y = (1990 + F.col("o_orderkey") % 25).cast("int")
    season = F.when(F.col("o_orderkey") % 4 == 0, F.format_string("%d/%d", y, y + 1)).otherwise(F.format_string("%04d-%02d", y, (y + 1) % 100))
    return o.select("o_orderkey", S.previous_season(season).alias("previous"))


@query(f"WITH {B.BOARD} SELECT id, least(1 - 1e-6, greatest(1e-6, head_defcon)) AS p, CASE WHEN position = 'GK' THEN 0.0 WHEN {SCALE} = 0 THEN 0.0 ELSE round((head_defcon / 2) * {SCALE}, 6) END AS scaled FROM b")
def scl17_probabilities(spark, sf_dir):
    own = B.board(spark, sf_dir).withColumn("scale", S.availability("status", "chance"))
    return own.select("id", S.clip_probability("head_defcon").alias("p"), F.round(S.rescaled(F.col("head_defcon") / 2, F.col("scale"), F.col("position")), 6).alias("scaled"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.0::DOUBLE AS prior_goals, coalesce(CASE WHEN l_discount > 0.05 THEN l_discount END, 0) AS disc_l1 FROM lineitem")
def scl18_zero_fill(spark, sf_dir):
    own = B.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("disc_l1"))
    return S.zero_filled(own, ["disc_l1", "prior_goals"])


@query("SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN 'GK' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END AS position FROM part")
def scl20_position_name(spark, sf_dir):
    return B.read(spark, sf_dir, "part").select("p_partkey", S.position_name(F.col("p_size") % 6).alias("position"))


@query(r"""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Ω' ELSE p_name || ' ŠeškoÉ' || CAST(p_size % 3 AS VARCHAR) END AS name FROM part),
t AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^\x00-\x7F]+', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM s),
u AS (SELECT p_partkey, CASE WHEN x = '' THEN 'team-' || CAST(p_partkey AS VARCHAR) ELSE x END AS slug FROM t)
SELECT p_partkey AS id, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY p_partkey) = 1 THEN slug ELSE slug || '-' || CAST(p_partkey AS VARCHAR) END AS slug FROM u""")
def scl24_slugs(spark, sf_dir):
    k = F.col("p_partkey")
    own = B.read(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 10 == 0, "Ω").otherwise(F.concat("p_name", F.lit(" ŠeškoÉ"), (F.col("p_size") % 3).cast("string"))).alias("name"))
    return live.unique_slugs(own, S.slug("name")).select("id", "slug")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 5 = 4 THEN NULL ELSE greatest(0, s_suppkey % 4 - s_suppkey % 3) END AS free FROM supplier")
def scl25_free_transfers(spark, sf_dir):
    k = F.col("s_suppkey")
    made = F.when(k % 5 == 4, -1).otherwise(k % 3)
    return B.read(spark, sf_dir, "supplier").select("s_suppkey", S.free_transfers(k % 4, made, F.when(k % 7 == 0, "wildcard")).alias("free"))


@query(f"WITH {B.FIXTURES} SELECT id, team, CASE WHEN was_home THEN 'vs ' ELSE '@ ' END || n_name AS text FROM s JOIN nation ON n_nationkey = opponent")
def scl27_fixture_text(spark, sf_dir):
    n = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("opponent"), "n_name")
    return live.sides(B.fixtures(spark, sf_dir)).join(F.broadcast(n), "opponent").select("id", "team", S.fixture_text("was_home", "n_name").alias("text"))


@query(f"WITH {B.BOARD} SELECT club AS team_name, count(*) AS players, round(avg(cost), 6) AS mean_cost FROM b GROUP BY club")
def ag13_roster_summary(spark, sf_dir):
    own = B.board(spark, sf_dir).withColumnsRenamed({"club": "team_name", "cost": "now_cost"})
    return live.roster_summary(own).select("team_name", "players", six("mean_cost"))


@query(f"WITH {B.BOARD} SELECT id, row_number() OVER (PARTITION BY club ORDER BY CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 2 WHEN 'MID' THEN 3 ELSE 4 END, points DESC, CAST(id AS VARCHAR)) AS place FROM b", cast={"place": "INTEGER"})
def st04_roster(spark, sf_dir):
    own = B.board(spark, sf_dir).withColumnsRenamed({"club": "team_name", "points": "e_points_final"}).withColumn("web_name", F.col("id").cast("string"))
    return live.roster(own).select("id", "place")


@query(f"WITH {B.BOARD} SELECT id, points AS e_points_final FROM b ORDER BY 2 DESC, 1")
def st01_board_order(spark, sf_dir):
    return live.board_order(B.board(spark, sf_dir).withColumnRenamed("points", "e_points_final")).select("id", "e_points_final")


@query(f"WITH {B.BOARD} SELECT CAST(floor(head_minutes / 10) AS INTEGER) AS bin, round(avg(CASE WHEN cost > 60 THEN 1.0 ELSE 0.0 END), 6) AS play_rate, count(*) AS n FROM b GROUP BY 1")
def ag14_play_curve(spark, sf_dir):
    own = B.board(spark, sf_dir).select(F.col("head_minutes").alias("pred_minutes"), (F.col("cost") > 60).cast("int").alias("minutes"))
    return live.play_curve(own).select("bin", six("play_rate"), "n")


@query("SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def st10_latest_record(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders").select(F.lit("s").alias("season"), F.col("o_custkey").alias("gw"), F.col("o_orderdate").alias("recorded_at"), F.col("o_orderkey").alias("revision"))
    return live.latest_record(o).select(F.col("gw").alias("c_custkey"), F.col("revision").alias("last_order"))


# --- baselines --------------------------------------------------------------------------------------------------------

LAST = "(SELECT max(week) FROM h)"
HISTORY = f"hh AS (SELECT * FROM h WHERE week < {LAST}), fz AS (SELECT c_custkey AS player_id, c_mktsegment AS position FROM customer)"
EWMA = """ew0 AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY week DESC) AS r, least(4, count(*) OVER (PARTITION BY player_id)) AS n FROM hh),
ew AS (SELECT player_id, sum(points * CASE WHEN r < n THEN 0.4 * power(0.6, r - 1) ELSE power(0.6, n - 1) END) AS ewma FROM ew0 WHERE r <= 4 GROUP BY 1), md AS (SELECT position, quantile_cont(points, 0.5) AS median FROM hh GROUP BY 1), gm AS (SELECT player_id, count(*) AS n FROM hh GROUP BY 1),
bs AS (SELECT fz.player_id, fz.position, round(coalesce(ewma, median, 0), 6) AS baseline_ewma4, round(coalesce(median, 0), 6) AS baseline_position_median, coalesce(gm.n, 0) AS history_games FROM fz LEFT JOIN ew USING (player_id) LEFT JOIN md USING (position) LEFT JOIN gm USING (player_id))"""


def history(spark, sf_dir):
    """Candidates, history and the last week's rows. The weekly points are written once: history is read for medians, means and counts."""
    own = stored(B.months(spark, sf_dir), "months")
    last = own.agg(F.max("week").alias("last"))
    both = own.crossJoin(F.broadcast(last))  # one row on the right
    frozen = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_mktsegment").alias("position"))
    return frozen, both.where("week < last").drop("last"), both.where("week = last").drop("last")


@query(f"WITH {B.MONTHS}, {HISTORY}, {EWMA} SELECT player_id, round(ewma, 4) AS ewma FROM ew")
def wn10_ewma4(spark, sf_dir):
    return baselines.ewma(history(spark, sf_dir)[1]).select("player_id", F.round("ewma", 4).alias("ewma"))


@query(f"WITH {B.MONTHS}, {HISTORY}, {EWMA} SELECT position, round(median, 6) AS median FROM md")
def ag09_group_median(spark, sf_dir):
    return baselines.group_median(history(spark, sf_dir)[1]).select("position", six("median"))


@query(f"WITH {B.MONTHS}, {HISTORY}, {EWMA} SELECT player_id, n AS history_games FROM gm")
def ag10_history_games(spark, sf_dir):
    return baselines.games(history(spark, sf_dir)[1])


@query(f"WITH {B.MONTHS}, {HISTORY}, {EWMA} SELECT player_id, position, round(baseline_ewma4, 4) AS baseline_ewma4, round(baseline_position_median, 4) AS baseline_position_median, history_games FROM bs")
def ml11_baselines(spark, sf_dir):
    frozen, past, _ = history(spark, sf_dir)
    return baselines.baselines(frozen, past).select("player_id", "position", F.round("baseline_ewma4", 4).alias("baseline_ewma4"), F.round("baseline_position_median", 4).alias("baseline_position_median"), "history_games")


FROZEN = f"ac AS (SELECT player_id, points FROM h WHERE week = {LAST}), fa AS (SELECT bs.*, coalesce(ac.points, 0) AS actual, CAST(ac.points IS NOT NULL AS INTEGER) AS played FROM bs LEFT JOIN ac USING (player_id))"
_frozen = ", ".join(f"round(avg(abs(actual - {c})), 4) AS mae_{c}, round(sqrt(avg((actual - {c}) * (actual - {c}))), 4) AS rmse_{c}, round(quantile_cont(abs(actual - {c}), 0.5), 4) AS median_ae_{c}" for c in ("baseline_ewma4", "baseline_position_median"))


def frozen_rows(spark, sf_dir):
    frozen, past, now = history(spark, sf_dir)
    own = baselines.baselines(frozen, past)
    out = baselines.with_actuals(own, now.select("player_id", F.col("points").alias("actual"), F.lit(1).alias("played")), ("player_id",))
    return out.withColumns({"actual": F.coalesce("actual", F.lit(0.0)), "played": F.coalesce("played", F.lit(0))})


@query(f"WITH {B.MONTHS}, {HISTORY}, {EWMA}, {FROZEN} SELECT count(*) AS n_frozen, count_if(played = 1) AS n_played, count_if(played = 0) AS n_dnp, {_frozen} FROM fa", cast={"n_played": "BIGINT", "n_dnp": "BIGINT"})
def met10_frozen_score(spark, sf_dir):
    own = metrics.frozen(frozen_rows(spark, sf_dir), "actual", ["baseline_ewma4", "baseline_position_median"])
    return own.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in own.dtypes])


@query(f"WITH {B.MONTHS}, {HISTORY}, {EWMA}, {FROZEN} SELECT player_id, round(baseline_ewma4, 4) AS baseline_ewma4, actual, played FROM fa")
def jn14_frozen_actuals(spark, sf_dir):
    return frozen_rows(spark, sf_dir).select("player_id", F.round("baseline_ewma4", 4).alias("baseline_ewma4"), "actual", "played")


@query(f"WITH {B.MONTHS}, {HISTORY} SELECT 'missing actuals' AS rule, count(*) AS n FROM fz WHERE player_id NOT IN (SELECT player_id FROM h WHERE week = {LAST}) HAVING count(*) > 0")
def val06_bad_actuals(spark, sf_dir):
    frozen, _, now = history(spark, sf_dir)
    return checks.violations(checks.bad_actuals(frozen, now.withColumn("played", F.lit(1)), ["player_id"])).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {B.MONTHS} SELECT 'history reaches the frozen week or beyond' AS rule, count(*) AS n FROM h WHERE week >= {LAST} HAVING count(*) > 0")
def val08_bad_history(spark, sf_dir):
    own = B.months(spark, sf_dir)
    last = own.agg(F.max("week").alias("last"))
    both = own.crossJoin(F.broadcast(last))  # one row on the right
    return checks.violations(checks.bad_history(both, F.lit("all"), F.col("last"))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# --- scores -----------------------------------------------------------------------------------------------------------

COMMON = "total_points IS NOT NULL AND total_points_r5 IS NOT NULL AND total_points_r3 IS NOT NULL"


def forecasts(spark, sf_dir):
    return lags.add_lags(panel(spark, sf_dir), ["total_points", "minutes"])


@query(f"""WITH {LAGS}, c AS (SELECT *, {COMMON} AS m FROM g) SELECT count(*) AS n, count_if(m) AS n_common, round(avg(abs(total_points - total_points_r5)) FILTER (m), 6) AS mae_total_points_r5, round(avg(abs(total_points - total_points_r3)) FILTER (m), 6) AS mae_total_points_r3,
round(avg(abs(minutes - coalesce(minutes_r5, 0))), 6) AS mae_minutes, round(avg(abs(total_points - total_points_r5)) FILTER (m AND "GW" = 1), 6) AS mae_first_event FROM c""", cast={"n_common": "BIGINT"})
def met01_common_mask_mae(spark, sf_dir):
    own = metrics.holdout(forecasts(spark, sf_dir), "total_points", ["total_points_r5", "total_points_r3"], minutes=("minutes", "minutes_r5"))
    return own.select(*[six(c) if t == "double" else F.col(c) for c, t in own.dtypes])


@query(f"""WITH {LAGS}, c AS (SELECT *, total_points_r5 * least(1.0, greatest(0.0, minutes_r5 / 90)) AS gt FROM g), m AS (SELECT * FROM c WHERE total_points IS NOT NULL AND total_points_r5 IS NOT NULL AND gt IS NOT NULL)
SELECT count(*) AS n_common, round(avg(abs(total_points - gt)), 6) AS mae_gated, coalesce(avg(abs(total_points - gt)) <= 0.98, false) AS publish FROM m""")
def met02_publish_rule(spark, sf_dir):
    own = forecasts(spark, sf_dir).withColumn("gated", S.gated("total_points_r5", "minutes_r5"))
    return metrics.holdout(own, "total_points", ["total_points_r5"], gated="gated").select("n_common", six("mae_gated"), "publish")


@query(f'WITH {LAGS}, c AS (SELECT *, {COMMON} AS m FROM g) SELECT season, "GW", count(*) AS n, count_if(m) AS n_common, round(avg(abs(total_points - total_points_r5)) FILTER (m), 6) AS mae_model, round(avg(abs(total_points - total_points_r3)) FILTER (m), 6) AS mae_baseline, count_if(m AND minutes > 0) AS n_played, round(avg(abs(total_points - total_points_r5)) FILTER (m AND minutes > 0), 6) AS mae_model_played, round(avg(abs(total_points - total_points_r3)) FILTER (m AND minutes > 0), 6) AS mae_baseline_played FROM c GROUP BY ALL', cast={"n_common": "BIGINT", "n_played": "BIGINT"})
def met09_weekly_score(spark, sf_dir):
    own = metrics.weekly(forecasts(spark, sf_dir), "total_points", "total_points_r5", "total_points_r3")
    return own.select(*[six(c) if t == "double" else F.col(c) for c, t in own.dtypes])


_SLICES = {"all": "true", "played": "minutes > 0", "haulers": "minutes > 0 AND total_points >= 5"}


@query(f"WITH {LAGS} " + " UNION ALL ".join(f"SELECT '{s}' AS slice, '{f}' AS forecast, round(avg(abs(total_points - {f})), 6) AS mae, count(*) AS n FROM g WHERE {w} AND {f} IS NOT NULL" for s, w in _SLICES.items() for f in ("total_points_r5", "total_points_r3")))
def met11_slices(spark, sf_dir):
    return metrics.slices(forecasts(spark, sf_dir), "total_points", ["total_points_r5", "total_points_r3"]).select("slice", "forecast", six("mae"), "n")


@query(f"WITH {LAGS} " + " UNION ALL ".join(f"SELECT '{m}' AS model, metric, round(v, 6) AS value FROM (SELECT avg(abs(total_points - {m})) AS mae, count(*)::DOUBLE AS n FROM g WHERE {m} IS NOT NULL) UNPIVOT (v FOR metric IN (mae, n))" for m in ("total_points_r5", "total_points_r3")))
def met13_comparison(spark, sf_dir):
    own = forecasts(spark, sf_dir)
    score = lambda f: own.where(F.col(f).isNotNull()).agg(metrics.mean_error("total_points", f).alias("mae"), F.count(F.lit(1)).alias("n"))
    return metrics.comparison({f: score(f) for f in ("total_points_r5", "total_points_r3")}).select("model", "metric", six("value"))


@query(f'WITH {LAGS}, c AS (SELECT * FROM g WHERE {COMMON}), w AS (SELECT season, "GW", avg(abs(total_points - total_points_r3)) - avg(abs(total_points - total_points_r5)) AS edge FROM c GROUP BY ALL) SELECT season, "GW", round(edge, 6) AS edge FROM w')
def met14_scoreboard(spark, sf_dir):
    own = metrics.weekly(forecasts(spark, sf_dir), "total_points", "total_points_r5", "total_points_r3")
    return metrics.scoreboard(own).where("n_common > 0").select("season", "GW", six("edge"))


LABELLED = "lb AS (SELECT quality AS y, n_chars / (n_chars + 2000.0) AS p FROM labels JOIN documents USING (doc_id))"


def probabilities(spark, sf_dir):
    d = B.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return B.read(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("p"))


@query(f"WITH {LABELLED}, s AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM lb GROUP BY p), r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM r")
def met05_auc(spark, sf_dir):
    return metrics.auc(probabilities(spark, sf_dir), "y", "p").select(six("auc"))


@query(f"WITH {LABELLED}, q AS (SELECT y, least(1 - 1e-6, greatest(1e-6, p)) AS p FROM lb) SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, count(*) AS n FROM q")
def met06_logloss_brier(spark, sf_dir):
    return metrics.log_loss(probabilities(spark, sf_dir), "y", "p").select(six("log_loss"), six("brier"), "n")


@query(f"WITH {LABELLED}, ed AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM lb) SELECT CAST(greatest(0, len(list_filter(e, lambda x: x < p)) - 1) AS INTEGER) AS bin, round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS rate, count(*) AS n FROM lb, ed GROUP BY 1")
def met12_reliability(spark, sf_dir):
    return metrics.reliability(probabilities(spark, sf_dir), "y", "p").select("bin", six("mean_pred"), six("rate"), "n")


BOUNDS = f"{LAGS}, iv AS (SELECT season, \"GW\", player_code, fixture, total_points AS y, round(total_points_r5 - 40, 6) AS lo, round(total_points_r5 + 40, 6) AS hi FROM g WHERE total_points_r5 IS NOT NULL AND total_points IS NOT NULL)"


def bounded(spark, sf_dir, width: float = 40):
    own = forecasts(spark, sf_dir).where("total_points_r5 is not null")
    return own.select(*KEY, F.col("total_points").alias("y"), F.round(F.col("total_points_r5") - width, 6).alias("lo"), F.round(F.col("total_points_r5") + width, 6).alias("hi"))


@query(f"WITH {BOUNDS} SELECT round(avg(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n FROM iv")
def met07_coverage(spark, sf_dir):
    return metrics.coverage(bounded(spark, sf_dir), "y", "lo", "hi").select(six("coverage"), "n")


@query(f"WITH {BOUNDS} SELECT round(avg(greatest(0.1 * (y - lo), -0.9 * (y - lo))), 6) AS pinball, count(*) AS n FROM iv")
def met08_pinball(spark, sf_dir):
    return metrics.pinball_loss(bounded(spark, sf_dir), "y", "lo", 0.1).select(six("pinball"), "n")


@query(f"WITH {BOUNDS} SELECT season, fixture, round(abs(y - lo), 6) AS absolute, round((y - lo) * (y - lo), 4) AS squared, round(greatest(0.9 * (y - hi), -0.1 * (y - hi)), 6) AS pinball FROM iv")
def scl26_error_terms(spark, sf_dir):
    return bounded(spark, sf_dir).select("season", "fixture", six(S.absolute_error("y", "lo"), "absolute"), F.round(S.squared_error("y", "lo"), 4).alias("squared"), six(S.pinball("y", "hi", 0.9), "pinball"))


@query(f"""WITH {BOUNDS}, nd AS (SELECT greatest(lo - y, y - hi) AS need FROM iv), t AS (SELECT avg(CASE WHEN need <= 0 THEN 1.0 ELSE 0.0 END) AS coverage, quantile_cont(need, 0.8) AS q FROM nd)
SELECT round(coverage, 6) AS coverage, round(CASE WHEN coverage BETWEEN 0.75 AND 0.9 THEN 0.0 ELSE q END, 5) AS shift_high FROM t""")
def ml07_interval_shift(spark, sf_dir):
    return intervals.shift(bounded(spark, sf_dir), "y", "lo", "hi").select(six("coverage"), F.round("shift_high", 5).alias("shift_high"))


@query(f"""WITH {BOUNDS}, nd AS (SELECT *, greatest(lo - y, y - hi) AS need FROM iv), t AS (SELECT count(*) AS n, count_if(need <= 0) AS i FROM nd),
k AS (SELECT greatest(0, i - CAST(floor(0.9 * n + 1e-9) AS BIGINT)) AS o, greatest(0, CAST(ceil(0.75 * n) AS BIGINT) - i) AS a FROM t), r AS (SELECT nd.*, row_number() OVER (ORDER BY abs(need), season, "GW", player_code, fixture) AS rn FROM nd, k WHERE CASE WHEN o > 0 THEN need <= 0 ELSE need > 0 END)
SELECT count(*) AS n_nudged, count(DISTINCT player_code) AS players FROM r, k WHERE rn <= greatest(o, a)""")
def ml08_nudge(spark, sf_dir):
    done = intervals.nudge(bounded(spark, sf_dir), "y", "lo", "hi", KEY)
    return done.where("nudged").agg(F.count(F.lit(1)).alias("n_nudged"), F.count_distinct("player_code").alias("players"))


# --- heads (tree learners: rows only) -----------------------------------------------------------------------------------

FEATURES = ["minutes_l1", "minutes_r3", "minutes_r5", "total_points_l1", "total_points_r3", "total_points_r5", "k"]


@query()
def ml01_gbt_heads(spark, sf_dir):
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    train, score = own.where("season <> 'S2'"), own.where("season = 'S2'")
    out = models.predict(models.fit(models.regressor(10), train, FEATURES, "minutes"), score, FEATURES, "pred_minutes")
    out = models.predict(models.fit(models.regressor(10), train, FEATURES, "total_points"), out, FEATURES, "pred_points")
    return out.select(*KEY, "pred_minutes", "pred_points", S.gated("pred_points", "pred_minutes").alias("pred_points_decomposed"))


@query()
def ml02_gbt_label(spark, sf_dir):
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    train = own.where(P.label_training("defcon_hit", ["S0", "S1"], 9))
    return models.predict(models.fit(models.classifier(10), train, FEATURES, "defcon_hit"), own.where("season = 'S2'"), FEATURES, "pred_defcon").select(*KEY, "pred_defcon")


@query()
def ml02_live_label(spark, sf_dir):
    """The live head: fitted on all labelled rows of its seasons, those after the holdout's cut included."""
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    train = own.where(P.label_training("defcon_hit", ["S0", "S1"], None))
    return models.predict(models.fit(models.classifier(10), train, FEATURES, "defcon_hit"), own.where("season = 'S2'"), FEATURES, "pred_defcon").select(*KEY, "pred_defcon")


@query()
def ml02_full_label(spark, sf_dir):
    """The holdout head with all its 400 trees."""
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    train = own.where(P.label_training("defcon_hit", ["S0", "S1"], 9))
    return models.predict(models.fit(models.classifier(), train, FEATURES, "defcon_hit"), own.where("season = 'S2'"), FEATURES, "pred_defcon").select(*KEY, "pred_defcon")


@query(f"""WITH {B.PANEL}, t AS (SELECT * FROM l WHERE season IN ('S0', 'S1') AND position <> 'GK' AND minutes > 0 AND defcon_hit IS NOT NULL)
SELECT count(*) FILTER ("GW" <= 9) AS holdout, count(*) AS live FROM t""")
def ml02_training_rows(spark, sf_dir):
    """Rows that the holdout head and the live head are fitted on."""
    own = forecasts(spark, sf_dir)
    return own.agg(*[F.count_if(P.label_training("defcon_hit", ["S0", "S1"], cut)).alias(name) for name, cut in (("holdout", 9), ("live", None))])


@query()
def ml03_leaf_quantiles(spark, sf_dir):
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    return models.leaf_quantiles(own.where("season <> 'S2'"), own.where("season = 'S2'"), FEATURES, "total_points").select(*KEY, "q_low", "q_high")


@query()
def ml03_boosted_quantiles(spark, sf_dir):
    """Heads boosted under the pinball loss, fitted on the first seasons."""
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    return models.boosted_quantiles(own.where("season <> 'S2'"), own.where("season = 'S2'"), FEATURES, "total_points").select(*KEY, "q_low", "q_high")


@query()
def ml04_out_of_fold(spark, sf_dir):
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double")).where("season <> 'S2' and position <> 'GK'")
    return models.out_of_fold(own, FEATURES, "defcon_hit", KEY, trees=3).select(*KEY, "fold", "oof", "defcon_hit")


def _isotonic(rows: str) -> str:
    """The increasing fit of ``rows`` (p, y) by its max-min formula over running sums, at each distinct p: table `fit` (p, g)."""
    return f"""d AS (SELECT p, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS w FROM {rows} GROUP BY p),
u AS MATERIALIZED (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(s) OVER (ORDER BY p) AS cs, sum(w) OVER (ORDER BY p) AS cw, s, w FROM d),
mm AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM u a JOIN u b ON b.i >= a.i),
lo AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM mm),
fit AS (SELECT u.p, max(lo.n) AS g FROM lo JOIN u USING (i) GROUP BY u.p)"""


_KEYED = LABELLED.replace("SELECT ", "SELECT doc_id, ", 1)


@query(f"WITH {_KEYED}, {_isotonic('lb')} SELECT doc_id, y, p, round(g, 6) AS calibrated FROM lb JOIN fit USING (p)")
def ml05_isotonic(spark, sf_dir):
    own = probabilities(spark, sf_dir)
    found = models.calibrate(own, "p", "y", "isotonic")
    return own.select("doc_id", "y", "p", six(found.apply(F.col("p")), "calibrated"))


_LOSS = "avg(-(y * ln(least(1 - 1e-6, greatest(1e-6, {0}))) + (1 - y) * ln(1 - least(1 - 1e-6, greatest(1e-6, {0}))))) AS l_{1}, avg((least(1 - 1e-6, greatest(1e-6, {0})) - y) * (least(1 - 1e-6, greatest(1e-6, {0})) - y)) AS b_{1}"


@query(f"""WITH {_KEYED}, even AS (SELECT * FROM lb WHERE doc_id % 2 = 0), odd AS (SELECT * FROM lb WHERE doc_id % 2 = 1), {_isotonic('even')},
pl AS (SELECT lb.doc_id, lb.y, lb.p, (SELECT {{'p': max(f.p), 'g': max_by(f.g, f.p)}} FROM fit f WHERE f.p < lb.p) AS x0, (SELECT {{'p': min(f.p), 'g': min_by(f.g, f.p)}} FROM fit f WHERE f.p >= lb.p) AS x1 FROM lb),
ca AS (SELECT doc_id, y, p, CASE WHEN x0.p IS NULL THEN x1.g WHEN x1.p IS NULL THEN x0.g ELSE x0.g + (p - x0.p) * (x1.g - x0.g) / (x1.p - x0.p) END AS c FROM pl),
ls AS (SELECT {_LOSS.format('p', 'raw')}, {_LOSS.format('c', 'iso')} FROM ca WHERE doc_id % 2 = 1)
SELECT doc_id, CASE WHEN l_iso < l_raw AND b_iso < b_raw THEN 'isotonic' ELSE 'raw' END AS kind, round(CASE WHEN l_iso < l_raw AND b_iso < b_raw THEN c ELSE p END, 6) AS calibrated FROM ca, ls""")
def ml06_shipped_isotonic(spark, sf_dir):
    """Fitted on even keys, shipped if both losses fall on odd ones; else the forecasts stay raw."""
    own = probabilities(spark, sf_dir)
    found, _ = models.choose_calibrator(own.where("doc_id % 2 = 0"), own.where("doc_id % 2 = 1"), "p", "y", kinds=("isotonic",))
    return own.select("doc_id", F.lit(found.kind).alias("kind"), six(found.apply(F.col("p")), "calibrated"))


@query()
def ml06_calibrator_choice(spark, sf_dir):
    own = probabilities(spark, sf_dir)
    even = F.xxhash64("doc_id") % 2 == 0
    found, tried = models.choose_calibrator(own.where(even), own.where(~even), "p", "y")
    return own.select("doc_id", F.lit(found.kind).alias("kind"), found.apply(F.col("p")).alias("calibrated"), F.lit(len(tried)).alias("attempts"))


@query(f"""WITH {BOUNDS}, cal AS (SELECT greatest(lo - y, y - hi) AS need FROM iv WHERE "GW" <= 5), t AS (SELECT avg(CASE WHEN need <= 0 THEN 1.0 ELSE 0.0 END) AS coverage, quantile_cont(need, 0.8) AS q FROM cal),
sh AS (SELECT CASE WHEN coverage BETWEEN 0.75 AND 0.9 THEN 0.0 ELSE q END AS s FROM t), mv AS (SELECT iv.* REPLACE (lo - s AS lo, greatest(hi + s, lo - s) AS hi) FROM iv, sh), nd AS (SELECT *, greatest(lo - y, y - hi) AS need FROM mv),
tt AS (SELECT count(*) AS n, count_if(need <= 0) AS i FROM nd), k AS (SELECT greatest(0, i - CAST(floor(0.9 * n + 1e-9) AS BIGINT)) AS o, greatest(0, CAST(ceil(0.75 * n) AS BIGINT) - i) AS a FROM tt),
r AS (SELECT nd.*, o, a, row_number() OVER (PARTITION BY need <= 0 ORDER BY abs(need), season, "GW", player_code, fixture) <= CASE WHEN o > 0 AND need <= 0 THEN o WHEN o = 0 AND need > 0 THEN a ELSE 0 END AS nudged FROM nd, k)
SELECT season, "GW", player_code, fixture, round(CASE WHEN nudged AND o = 0 THEN least(lo, y) ELSE lo END, 6) AS q_low, round(CASE WHEN nudged AND o = 0 THEN greatest(hi, y) ELSE hi END, 6) AS q_high FROM r""")
def ml09_shifted_bounds(spark, sf_dir):
    """Bounds from a table instead of a head: the shift found on the first events, order and nudge on all rows."""
    own = bounded(spark, sf_dir).withColumnsRenamed({"lo": "q_low", "hi": "q_high"})
    return models.shifted_quantiles(own, own.where("GW <= 5"), "y", KEY)[0].select(*KEY, six("q_low"), six("q_high"))


@query()
def ml09_shifted_quantiles(spark, sf_dir):
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    scored = models.leaf_quantiles(own.where("season <> 'S2'"), own.where("season = 'S2'"), FEATURES, "total_points")
    return models.shifted_quantiles(scored, scored.where("GW <= 5"), "total_points")[0].select(*KEY, "q_low", "q_high")


@query(f"WITH {LAGS} SELECT fixture, round(total_points_r5, 6) AS baseline_last5 FROM g")
def ml10_last_five(spark, sf_dir):
    return models.last_five(forecasts(spark, sf_dir)).select("fixture", six("baseline_last5"))


@query(f"""WITH {B.PANEL}, t AS (SELECT season, "GW", player_code, fixture, CASE WHEN minutes > 0 AND total_points >= 5 THEN 'haul' WHEN minutes > 0 THEN 'played' ELSE 'blank' END AS stratum FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '42', season, "GW", player_code, fixture)), season, "GW", player_code, fixture) AS n FROM t)
SELECT season, "GW", player_code, fixture, stratum FROM r WHERE n <= CASE stratum WHEN 'haul' THEN 102 WHEN 'played' THEN 256 ELSE 154 END""")
def ml12_stratified_sample(spark, sf_dir):
    return models.stratified_sample(B.panel(spark, sf_dir), 512, KEY).select(*KEY, "stratum")


@query()
def ml13_importances(spark, sf_dir):
    own = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double"))
    return models.importances(models.fit(models.regressor(10), own.where("season <> 'S2'"), FEATURES, "total_points"), FEATURES, spark, 20)


@query(f"WITH {B.BOARD}, sc AS (SELECT *, {SCALE} AS scale FROM b) SELECT id, round(CASE WHEN position = 'GK' OR scale = 0 THEN 0.0 ELSE 1 / (1 + exp(-(2.0 * (head_defcon * scale / scale) - 1.0))) * scale END, 6) AS pred_defcon FROM sc")
def ml14_recalibrate(spark, sf_dir):
    own = B.board(spark, sf_dir).withColumn("scale", S.availability("status", "chance")).withColumn("pred_defcon", F.col("head_defcon") * F.col("scale"))
    return models.recalibrate(own, models.Calibrator("platt", slope=2.0, offset=-1.0)).select("id", six("pred_defcon"))


# --- squads -----------------------------------------------------------------------------------------------------------


@query(f"WITH {B.SQUADS} SELECT squad_id, id, CAST(is_xi AS INTEGER) AS is_xi FROM xi")
def ln01_best_xi(spark, sf_dir):
    return lineup.best_xi(B.squads(spark, sf_dir)).select("squad_id", "id", F.col("is_xi").cast("int").alias("is_xi"))


@query(f"WITH {B.SQUADS.replace('FROM sq)', 'FROM sq WHERE NOT (status = ' + chr(39) + 'i' + chr(39) + ' OR coalesce(chance < 75, false)))', 1)}, n AS (SELECT squad_id, count_if(is_xi) AS n, count_if(is_xi AND position = 'GK') AS gk, count_if(is_xi AND position = 'DEF') AS d, count_if(is_xi AND position = 'MID') AS m, count_if(is_xi AND position = 'FWD') AS f FROM xi GROUP BY 1) SELECT s_suppkey AS squad_id FROM supplier WHERE s_suppkey NOT IN (SELECT squad_id FROM n WHERE n = 11 AND gk = 1 AND d BETWEEN 3 AND 5 AND m BETWEEN 2 AND 5 AND f BETWEEN 1 AND 3)")
def ln02_unfit_squads(spark, sf_dir):
    return lineup.fit_xi(B.squads(spark, sf_dir).withColumn("flagged", S.flagged("status", "chance")))[1]


@query(f"WITH {B.SQUADS} SELECT squad_id, id, row_number() OVER (PARTITION BY squad_id ORDER BY CASE WHEN position = 'GK' THEN 0 ELSE 1 END, points DESC, id) AS bench_place FROM xi WHERE NOT is_xi", cast={"bench_place": "INTEGER"})
def ln03_bench(spark, sf_dir):
    return lineup.bench(lineup.best_xi(B.squads(spark, sf_dir))).select("squad_id", "id", "bench_place")


@query(f"WITH {B.SQUADS} SELECT squad_id, round(sum(points) FILTER (is_xi) + max(points) FILTER (is_xi), 6) AS xi_value FROM xi GROUP BY 1")
def ln04_xi_value(spark, sf_dir):
    return lineup.xi_value(lineup.best_xi(B.squads(spark, sf_dir))).select("squad_id", six("xi_value"))


ONE = f"""{B.SQUADS}, hold AS (SELECT squad_id, sum(points) FILTER (is_xi) + max(points) FILTER (is_xi) AS v FROM xi GROUP BY 1),
cand AS (SELECT o.squad_id, o.id AS out_id, i.id AS in_id, i.points AS in_points, i.position, i.club FROM sq o JOIN b i ON i.position = o.position AND i.cost <= o.cost + o.squad_id % 30 AND i.id <> o.id
 WHERE NOT (i.status = 'i' OR coalesce(i.chance < 75, false)) AND NOT EXISTS (SELECT 1 FROM sq x WHERE x.squad_id = o.squad_id AND x.id = i.id)),
ok AS (SELECT c.* FROM cand c LEFT JOIN sq x ON x.squad_id = c.squad_id AND x.id <> c.out_id AND x.club = c.club GROUP BY ALL HAVING count(x.id) < 3),
nw AS (SELECT squad_id, out_id, in_id, x.position, x.points, x.id FROM ok JOIN sq x USING (squad_id) WHERE x.id <> out_id UNION ALL SELECT squad_id, out_id, in_id, position, in_points, in_id FROM ok),
n1 AS (SELECT *, row_number() OVER (PARTITION BY squad_id, out_id, in_id, position ORDER BY points DESC, id) AS rk, CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 3 WHEN 'MID' THEN 2 ELSE 1 END AS lo, CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 5 WHEN 'MID' THEN 5 ELSE 3 END AS hi FROM nw),
n2 AS (SELECT *, row_number() OVER (PARTITION BY squad_id, out_id, in_id ORDER BY (rk > lo AND rk <= hi) DESC, points DESC, id) AS pl FROM n1),
vl AS (SELECT squad_id, out_id, in_id, sum(points) FILTER (rk <= lo OR (rk <= hi AND pl <= 4)) + max(points) FILTER (rk <= lo OR (rk <= hi AND pl <= 4)) AS value FROM n2 GROUP BY ALL),
gn AS (SELECT vl.*, round(value - v, 6) AS gain, row_number() OVER (PARTITION BY squad_id ORDER BY round(value - v, 6) DESC, out_id, in_id) AS rank FROM vl JOIN hold USING (squad_id) WHERE round(value - v, 6) > 0)"""


@query(f"WITH {ONE} SELECT squad_id, rank, gain FROM gn WHERE rank <= 5", cast={"rank": "INTEGER"})
def ln05_one_transfer(spark, sf_dir):
    """The best transfers of every squad."""
    own = B.squads(spark, sf_dir)
    market = B.board(spark, sf_dir).withColumn("flagged", S.flagged("status", "chance"))
    bank = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("squad_id"), (F.col("s_suppkey") % 30).alias("bank"))
    return lineup.one_transfer(own, market, bank).select("squad_id", "rank", six("gain"))


@query(f"WITH {B.SQUADS}, cl AS (SELECT squad_id, count(*) AS clubs, max(n) AS club_max FROM (SELECT squad_id, club, count(*) AS n FROM xi GROUP BY ALL) GROUP BY 1) SELECT squad_id, sum(cost)::BIGINT AS cost, round(sum(points), 6) AS points, round(sum(points) FILTER (is_xi), 6) AS xi_points, clubs, club_max FROM xi JOIN cl USING (squad_id) GROUP BY squad_id, clubs, club_max")
def ln06_squad_summary(spark, sf_dir):
    return lineup.squad_totals(lineup.best_xi(B.squads(spark, sf_dir))).select("squad_id", "cost", six("points"), six("xi_points"), "clubs", "club_max")


@query(f"WITH {B.SQUADS}, r AS (SELECT *, row_number() OVER (PARTITION BY squad_id ORDER BY points DESC, id) AS n FROM xi WHERE is_xi) SELECT squad_id, id, CASE n WHEN 1 THEN 'captain' ELSE 'vice' END AS role FROM r WHERE n <= 2")
def st11_captains(spark, sf_dir):
    return lineup.captains(lineup.best_xi(B.squads(spark, sf_dir))).select("squad_id", "id", "role")


@query(f"WITH {B.SQUADS}, cl AS (SELECT squad_id, max(n) AS club_max FROM (SELECT squad_id, club, count(*) AS n FROM xi GROUP BY ALL) GROUP BY 1), s AS (SELECT squad_id, sum(cost) AS cost, any_value(club_max) AS club_max FROM xi JOIN cl USING (squad_id) GROUP BY 1) SELECT 'budget' AS detail, count(*) AS n FROM s WHERE cost > 900 HAVING count(*) > 0 UNION ALL SELECT 'club cap', count(*) FROM s WHERE club_max > 3 HAVING count(*) > 0")
def val19_squad_legality(spark, sf_dir):
    return checks.squad_legality(lineup.best_xi(B.squads(spark, sf_dir)), budget=900).groupBy("detail").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {B.BOARD} SELECT id FROM b WHERE ((status = 'a' OR chance IS NULL OR chance <> 0) AND NOT (status IN ('i','s','u','n') OR coalesce(chance < 75, false))) OR id % 50 = 0")
def flt09_buyable(spark, sf_dir):
    own = B.board(spark, sf_dir).withColumn("owned", F.col("id") % 50 == 0)
    return own.where(P.buyable(chance="chance")).select("id")


# --- sinks ------------------------------------------------------------------------------------------------------------


@query(f'WITH {LAGS}, c AS (SELECT * FROM g WHERE {COMMON}), w AS (SELECT season, "GW" AS gw, round(avg(abs(total_points - total_points_r5)), 6) AS mae FROM c GROUP BY ALL) SELECT season, gw, CASE WHEN gw = 5 THEN -1.0 ELSE mae END AS mae FROM w')
def snk06_score_upsert(spark, sf_dir):
    own = metrics.weekly(forecasts(spark, sf_dir), "total_points", "total_points_r5", "total_points_r3").where("n_common > 0").select("season", F.col("GW").alias("gw"), six("mae_model", "mae"))
    return sinks.upserted(own, own.where("gw = 5").withColumn("mae", F.lit(-1.0)))


@query("SELECT printf('%.6f', p_retailprice) AS price, CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand FROM part")
def snk07_canonical(spark, sf_dir):
    own = B.read(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice"))
    return sinks.canonical(own, ["price", "p_partkey", "p_brand"])


@query("SELECT count(*) AS \"rows\" FROM part")
def snk02_content_hash(spark, sf_dir):
    return sinks.content_hash(B.read(spark, sf_dir, "part")).select("rows")
