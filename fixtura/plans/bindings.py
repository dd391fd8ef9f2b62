"""Bindings of the operators' columns to the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


LAGGED = ("minutes", "total_points", "expected_goals_conceded")
ORDERS = ("penalties_order", "corners_order")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as fixture rows: three seasons of ten events, users as players, twenty teams."""
    e = read(spark, sf_dir, "events")
    day, k = F.dayofmonth("ts") - 1, F.get_json_object("props", "$.k").cast("int")
    own = e.select(
        F.concat(F.lit("S"), F.floor(day / 10).cast("string")).alias("season"), (day % 10 + 1).cast("int").alias("GW"), F.col("user_id").cast("string").alias("player_code"),
        F.col("event_id").alias("fixture"), F.col("ts").alias("kickoff_time"), (F.col("user_id") % 20).cast("int").alias("team"), (F.col("event_id") % 2 == 1).alias("was_home"),
        F.when(F.col("event_type") == "signup", "GK").when(F.col("event_type") == "click", "DEF").when(F.col("event_type") == "view", "MID").otherwise("FWD").alias("position"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.least(k, F.lit(90))).alias("minutes"), F.col("value").alias("total_points"), k.alias("k"),
    )
    return own.withColumns({
        "opponent": ((F.col("team") + F.col("GW")) % 20).cast("int"), "started": (F.col("minutes") >= 60).cast("double"), "clearances_blocks_interceptions": (F.col("k") % 15).cast("double"),
        "recoveries": F.when(F.col("k") % 5 != 0, (F.col("k") % 7).cast("double")), "expected_goals_conceded": F.col("k") / 10.0, "expected_goals": F.col("k") / 50.0, "expected_assists": F.col("k") / 80.0,
        "penalties_order": F.when(F.col("k") % 4 == 0, (F.col("k") % 3 + 1).cast("double")), "corners_order": F.when(F.col("k") % 7 == 0, (F.col("k") % 5 + 1).cast("double")),
    })


PANEL = """
e AS (SELECT *, day(ts) - 1 AS d, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
e2 AS (SELECT 'S' || CAST(d // 10 AS VARCHAR) AS season, CAST(d % 10 + 1 AS INTEGER) AS "GW", CAST(user_id AS VARCHAR) AS player_code, event_id AS fixture, ts AS kickoff_time,
       CAST(user_id % 20 AS INTEGER) AS team, event_id % 2 = 1 AS was_home, CASE event_type WHEN 'signup' THEN 'GK' WHEN 'click' THEN 'DEF' WHEN 'view' THEN 'MID' ELSE 'FWD' END AS position,
       CASE WHEN event_type = 'error' THEN 0 ELSE least(k, 90) END AS minutes, value AS total_points, k FROM e),
p AS (SELECT *, CAST((team + "GW") % 20 AS INTEGER) AS opponent, CASE WHEN minutes >= 60 THEN 1.0 ELSE 0.0 END AS started, CAST(k % 15 AS DOUBLE) AS cbi,
      CASE WHEN k % 5 <> 0 THEN CAST(k % 7 AS DOUBLE) END AS rec, CAST(k AS DOUBLE) / 10 AS xgc, CAST(k AS DOUBLE) / 50 AS xg, CAST(k AS DOUBLE) / 80 AS xa,
      CASE WHEN k % 4 = 0 THEN CAST(k % 3 + 1 AS DOUBLE) END AS pen, CASE WHEN k % 7 = 0 THEN CAST(k % 5 + 1 AS DOUBLE) END AS cor FROM e2),
q AS (SELECT *, CASE WHEN position = 'GK' THEN NULL WHEN position IN ('MID', 'FWD') THEN cbi + coalesce(rec, 0) ELSE cbi END AS defcon_count FROM p),
l AS (SELECT *, CASE WHEN position = 'GK' THEN 0.0 WHEN position = 'DEF' THEN CASE WHEN defcon_count >= 10 THEN 1.0 ELSE 0.0 END ELSE CASE WHEN defcon_count >= 12 THEN 1.0 ELSE 0.0 END END AS defcon_hit FROM q)"""


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as fixtures of team pairs; types other than click and view are not yet finished."""
    e = read(spark, sf_dir, "events")
    home = (F.col("user_id") % 20).cast("int")
    done = F.col("event_type").isin("click", "view")
    return e.select(F.col("event_id").alias("id"), F.dayofmonth("ts").cast("int").alias("event"), F.col("ts").alias("kickoff_time"), done.alias("finished"), (done & (F.col("event_id") % 3 != 0)).alias("finished_provisional"), home.alias("team_h"), ((home + 1 + F.col("event_id") % 19) % 20).cast("int").alias("team_a"), (F.col("event_id") % 5 + 1).cast("int").alias("team_h_difficulty"), (F.col("event_id") % 4 + 1).cast("int").alias("team_a_difficulty"))


FIXTURES = """
f AS (SELECT event_id AS id, CAST(day(ts) AS INTEGER) AS event, ts AS kickoff_time, event_type IN ('click', 'view') AS finished, event_type IN ('click', 'view') AND event_id % 3 <> 0 AS finished_provisional,
      CAST(user_id % 20 AS INTEGER) AS team_h, CAST((user_id % 20 + 1 + event_id % 19) % 20 AS INTEGER) AS team_a, CAST(event_id % 5 + 1 AS INTEGER) AS team_h_difficulty, CAST(event_id % 4 + 1 AS INTEGER) AS team_a_difficulty FROM events),
s AS (SELECT id, event, kickoff_time, finished, team_h AS team, team_a AS opponent, true AS was_home, team_h_difficulty AS fdr FROM f
      UNION ALL SELECT id, event, kickoff_time, finished, team_a, team_h, false, team_a_difficulty FROM f)"""


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as a board of players: brands as clubs."""
    k = F.col("p_partkey")
    own = read(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_brand").alias("club"), F.when(k % 8 == 0, "GK").when(k % 8 <= 3, "DEF").when(k % 8 <= 6, "MID").otherwise("FWD").alias("position"), (F.col("p_size") + 35).alias("cost"),
        ((F.col("p_retailprice") - 900) / 10).alias("points"), F.when(k % 11 == 0, "i").when(k % 13 == 0, "d").otherwise("a").alias("status"),
        F.when(k % 11 == 0, F.when(k % 2 == 0, 0.0)).when(k % 13 == 0, F.when(k % 2 == 0, 50.0).otherwise(75.0)).alias("chance"),
        (k % 97).cast("double").alias("head_minutes"), ((k % 31) / 4.0).alias("head_points"), ((k % 10) / 10.0).alias("head_defcon"), (k % 39).cast("double").alias("prior_starts"), (k % 39 + k % 7).cast("double").alias("prior_games"),
        (k % 3 / 2.0).alias("starts_l1"), (k % 90).cast("double").alias("prior_minutes_pg"),
    )
    return own


BOARD = """
b AS (SELECT p_partkey AS id, p_brand AS club, CASE WHEN p_partkey % 8 = 0 THEN 'GK' WHEN p_partkey % 8 <= 3 THEN 'DEF' WHEN p_partkey % 8 <= 6 THEN 'MID' ELSE 'FWD' END AS position, p_size + 35 AS cost, (p_retailprice - 900) / 10 AS points,
      CASE WHEN p_partkey % 11 = 0 THEN 'i' WHEN p_partkey % 13 = 0 THEN 'd' ELSE 'a' END AS status,
      CASE WHEN p_partkey % 11 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 0.0 END WHEN p_partkey % 13 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 50.0 ELSE 75.0 END END AS chance,
      CAST(p_partkey % 97 AS DOUBLE) AS head_minutes, CAST(p_partkey % 31 AS DOUBLE) / 4 AS head_points, CAST(p_partkey % 10 AS DOUBLE) / 10 AS head_defcon, CAST(p_partkey % 39 AS DOUBLE) AS prior_starts, CAST(p_partkey % 39 + p_partkey % 7 AS DOUBLE) AS prior_games,
      CAST(p_partkey % 3 AS DOUBLE) / 2 AS starts_l1, CAST(p_partkey % 90 AS DOUBLE) AS prior_minutes_pg FROM part)"""


def squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A squad of 15 for each supplier: slots look players up by key, so no cross join."""
    n = read(spark, sf_dir, "part").agg(F.floor(F.count(F.lit(1)) / 8).alias("m"))
    slots = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("squad_id"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("j")).crossJoin(F.broadcast(n))  # one row on the right
    j = F.col("j")
    rest = F.when(j < 2, 8).when(j < 7, 1 + j % 3).when(j < 12, 4 + j % 3).otherwise(7)
    own = slots.select("squad_id", (8 * ((F.col("squad_id") * 7 + j * 13) % (F.col("m") - 1)) + rest).alias("id"))
    return own.join(board(spark, sf_dir), "id")


SQUADS = BOARD + """,
m AS (SELECT count(*) // 8 AS m FROM part),
slots AS (SELECT s_suppkey AS squad_id, 8 * ((s_suppkey * 7 + j * 13) % (m - 1)) + CASE WHEN j < 2 THEN 8 WHEN j < 7 THEN 1 + j % 3 WHEN j < 12 THEN 4 + j % 3 ELSE 7 END AS id
          FROM supplier, m, (SELECT unnest(range(0, 15)) AS j)),
sq AS (SELECT squad_id, b.* FROM slots JOIN b USING (id)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY squad_id, position ORDER BY points DESC, id) AS rk, CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 3 WHEN 'MID' THEN 2 ELSE 1 END AS lo, CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 5 WHEN 'MID' THEN 5 ELSE 3 END AS hi FROM sq),
r2 AS (SELECT *, row_number() OVER (PARTITION BY squad_id ORDER BY (rk > lo AND rk <= hi) DESC, points DESC, id) AS pl FROM r1),
xi AS (SELECT *, rk <= lo OR (rk <= hi AND pl <= 4) AS is_xi FROM r2)"""


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` by customer and month as weekly points, segments as positions."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player_id"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("week"), "o_totalprice")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_mktsegment").alias("position"))
    return o.groupBy("player_id", "week").agg(F.round(F.sum("o_totalprice") / 1000, 3).alias("points")).join(c, "player_id").withColumn("season", F.lit("all"))


MONTHS = """
w AS (SELECT o_custkey AS player_id, year(o_orderdate) * 12 + month(o_orderdate) AS week, round(sum(o_totalprice) / 1000, 3) AS points FROM orders GROUP BY ALL),
h AS (SELECT w.*, c_mktsegment AS position FROM w JOIN customer ON c_custkey = player_id)"""
