"""Queries over readers, stored tables and kept models: the given tables are written as the files in question to a scratch folder and read back.

JSON documents hold about DOCUMENT entries each, so that neither a task nor a document holds a whole table.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.functions import scalars as S
from fixtura.operators import checks, metrics, models, sinks
from fixtura.operators.stored import shared_folder
from fixtura.plans import bindings as B
from fixtura.plans.panel_queries import KEY, LAGS
from fixtura.plans.registry import query, six
from fixtura.plans.score_queries import FEATURES, SCALE, forecasts
from fixtura.sources import seasons, snapshots

SEASONS, DOCUMENT = ("S0", "S1", "S2", "S3"), 500


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def as_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def as_documents(df: DataFrame, path: str, arrays: dict[str, tuple[str, list[str]]], key: str) -> None:
    """One JSON document for DOCUMENT keys; ``arrays``: name -> (kind of the rows in it, columns)."""
    named = [F.collect_list(F.when(F.col("kind") == kind, F.struct(*columns))).alias(name) for name, (kind, columns) in arrays.items()]
    df.groupBy(F.floor(F.col(key) / DOCUMENT).alias("doc")).agg(*named).write.partitionBy("doc").json(path)


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- season files -----------------------------------------------------------------------------------------------------


@query(f"""WITH {B.PANEL} SELECT season, fixture, player_code, CAST("GW" AS DOUBLE) AS "GW", CAST(minutes AS DOUBLE) AS minutes, total_points, CASE WHEN season <> 'S1' THEN CAST(k AS DOUBLE) END AS k FROM l""")
def src01_season_rows(spark, sf_dir):
    """Columns drift: one season has no `k`, another says `round` for `GW` and has its columns in another order."""
    path, own = scratch(spark), B.panel(spark, sf_dir).select("season", "fixture", "player_code", "GW", "minutes", "total_points", "k")
    for s in SEASONS:
        rows = own.where(F.col("season") == s).drop("season")
        rows = rows.drop("k") if s == "S1" else rows.select(*reversed(rows.columns)).withColumnRenamed("GW", "round") if s == "S2" else rows
        as_csv(rows, f"{path}/{s}/merged_gw.csv")
    found = seasons.all_seasons(spark, path, SEASONS, ["GW", "round", "minutes", "total_points", "k"])
    return found.select("season", F.col("fixture").cast("long").alias("fixture"), "player_code", "GW", "minutes", "total_points", "k")


@query("SELECT CASE WHEN p_size <= 25 THEN 'S0' ELSE 'S1' END AS season, CAST(p_partkey AS INTEGER) AS element, p_name AS web_name, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 3 + 1 AS DOUBLE) END AS penalties_order FROM part")
def src02_season_players(spark, sf_dir):
    path, k = scratch(spark), F.col("p_partkey")
    own = B.read(spark, sf_dir, "part").select(k.alias("id"), (k * 7).alias("code"), F.col("p_name").alias("web_name"), F.when(k % 4 == 0, (k % 3 + 1).cast("string")).otherwise("none").alias("penalties_order"), F.col("p_brand").alias("junk"), "p_size")
    for s, rows in (("S0", own.where("p_size <= 25")), ("S1", own.where("p_size > 25"))):
        as_csv(rows.drop("p_size"), f"{path}/{s}/players_raw.csv")
    return stacked([seasons.season_players(spark, path, s) for s in ("S0", "S1")]).select("season", "element", "web_name", "penalties_order")


@query(f"WITH {B.FIXTURES} SELECT 'S0' AS season, CAST(id AS INTEGER) AS id, CASE WHEN finished THEN event END AS event, team_h, team_a, team_h_difficulty, team_a_difficulty FROM f")
def src03_season_fixtures(spark, sf_dir):
    path = scratch(spark)
    as_csv(B.fixtures(spark, sf_dir).withColumn("event", F.when(F.col("finished"), F.col("event"))).withColumn("stats", F.lit("[]")), f"{path}/S0/fixtures.csv")
    return seasons.season_fixtures(spark, path, "S0").select("season", "id", "event", "team_h", "team_a", "team_h_difficulty", "team_a_difficulty")


@query("SELECT 'S0' AS season, CAST(s_suppkey AS INTEGER) AS id, s_name AS name, s_name || ', \"' || s_nationkey || '\"' AS short_name FROM supplier")
def src04_season_teams(spark, sf_dir):
    path = scratch(spark)
    short = F.concat("s_name", F.lit(', "'), F.col("s_nationkey").cast("string"), F.lit('"'))
    as_csv(B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), short.alias("short_name"), "s_acctbal"), f"{path}/S0/teams.csv")
    return seasons.season_teams(spark, path, "S0")


@query("SELECT CAST(p_partkey AS INTEGER) AS id, p_retailprice AS total_points, CAST(p_size AS DOUBLE) AS minutes FROM part")
def src09_actuals(spark, sf_dir):
    path = f"{scratch(spark)}/actuals.csv"
    as_csv(B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("total_points"), F.col("p_size").alias("minutes")), path)
    return seasons.actuals(spark, path, ("id", "total_points", "minutes"))


@query("SELECT wanted, 'gw3_b.csv' AS board_file, CAST(p_partkey AS VARCHAR) AS id, CAST(p_size + 2 AS VARCHAR) AS points FROM part, (SELECT unnest(['event 3', 'newest']) AS wanted)")
def src10_selected_board(spark, sf_dir):
    """Event 3's last board by name, and the newest of all: the one written last."""
    path, own = scratch(spark), B.read(spark, sf_dir, "part")
    for name, more in (("gw12.csv", 0), ("gw3_a.csv", 1), ("gw3_b.csv", 2)):
        as_csv(own.select(F.col("p_partkey").alias("id"), (F.col("p_size") + more).alias("points")), f"{path}/{name}")
    found = seasons.boards(spark, path)
    return stacked([seasons.select_board(found, gw).select(F.lit(wanted).alias("wanted"), "board_file", "id", "points") for wanted, gw in (("event 3", 3), ("newest", None))])


@query(f'WITH {B.PANEL} SELECT season, "GW", fixture, minutes, total_points FROM l')
def src11_stored_panel(spark, sf_dir):
    path = scratch(spark)
    sinks.write_panel(B.panel(spark, sf_dir), path, FEATURES)
    return seasons.panel(spark, f"{path}/panel").select("season", "GW", "fixture", "minutes", "total_points")


@query(f"""WITH {B.MONTHS}, {", ".join(f"{n} AS (SELECT * FROM h WHERE week {o} (SELECT max(week) FROM w))" for n, o in (("before", "<"), ("last", "=")))}
SELECT 'history' AS kind, player_id, CAST(week AS DOUBLE) AS week, points FROM before UNION ALL SELECT 'candidate', player_id, CAST(week AS DOUBLE), NULL FROM last
UNION ALL SELECT 'actual', player_id, CAST(week AS DOUBLE), points FROM last""")
def src14_sample_inputs(spark, sf_dir):
    """The sample's week is its configuration's; rows of other weeks are refused by the join with it."""
    path, own = scratch(spark), B.months(spark, sf_dir)
    top = own.agg(F.max("week").alias("top"))  # one row
    told = own.crossJoin(F.broadcast(top))
    as_csv(told.where("week < top").drop("top"), f"{path}/historical_player_weeks.csv")
    as_csv(told.where("week = top").select("season", "week", "player_id", "position"), f"{path}/frozen_candidates.csv")
    as_csv(told.where("week = top").select("season", "week", "player_id", "points"), f"{path}/week5_actuals.csv")
    top.select(F.lit("all").alias("season"), F.col("top").alias("week"), F.lit("2030-01-01T00:00:00Z").alias("cutoff_at")).coalesce(1).write.json(f"{path}/sample_config.json")
    past, candidates, real, config = seasons.sample_inputs(spark, path)
    at = F.broadcast(config.select(F.col("season"), F.col("week").cast("double").alias("week")))  # one row
    parts = (("history", past), ("candidate", candidates.join(at, ["season", "week"])), ("actual", real.join(at, ["season", "week"])))
    return stacked([df.select(F.lit(kind).alias("kind"), F.col("player_id").cast("long").alias("player_id"), "week", *(["points"] if "points" in df.columns else [])) for kind, df in parts])


# --- landed documents -------------------------------------------------------------------------------------------------


@query("""SELECT 'element' AS kind, CAST(p_partkey AS INTEGER) AS id, p_name AS name, CAST(p_size AS INTEGER) AS n FROM part UNION ALL SELECT 'team', CAST(s_suppkey AS INTEGER), s_name, NULL FROM supplier
UNION ALL SELECT 'event', CAST(o_orderkey AS INTEGER), CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END FROM orders""")
def src05_bootstrap(spark, sf_dir):
    path = scratch(spark)
    parts = [
        B.read(spark, sf_dir, "part").select(F.lit("e").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("web_name"), F.col("p_size").alias("now_cost")),
        B.read(spark, sf_dir, "supplier").select(F.lit("t").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        B.read(spark, sf_dir, "orders").select(F.lit("v").alias("kind"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("deadline_time"), (F.col("o_orderstatus") == "F").alias("finished")),
    ]
    as_documents(stacked(parts), path, {"elements": ("e", ["id", "web_name", "now_cost"]), "teams": ("t", ["id", "name"]), "events": ("v", ["id", "deadline_time", "finished"])}, "id")
    elements, teams, events = snapshots.bootstrap(spark, path)
    said = ((elements, "element", "web_name", F.col("now_cost")), (teams, "team", "name", F.lit(None).cast("int")), (events, "event", "deadline_time", F.col("finished").cast("int")))
    return stacked([df.select(F.lit(kind).alias("kind"), "id", F.col(name).alias("name"), n.alias("n")) for df, kind, name, n in said])


@query(f"WITH {B.FIXTURES} SELECT CAST(id AS INTEGER) AS id, event, finished, finished_provisional, team_h, team_a FROM f")
def src06_fixtures(spark, sf_dir):
    path, own = scratch(spark), B.fixtures(spark, sf_dir)
    whole = F.to_json(F.collect_list(F.struct(*own.columns))).alias("value")
    own.groupBy(F.floor(F.col("id") / DOCUMENT).alias("doc")).agg(whole).write.partitionBy("doc").text(path)
    return snapshots.fixtures(spark, path).select("id", "event", "finished", "finished_provisional", "team_h", "team_a")


@query("""SELECT CAST(user_id AS INTEGER) AS file_element, CAST(CASE WHEN event_id % 9 = 0 THEN user_id + 1 ELSE user_id END AS INTEGER) AS element, CAST(event_id AS INTEGER) AS fixture, CAST(day(ts) AS INTEGER) AS round FROM events""")
def src07_player_histories(spark, sf_dir):
    """A folder a player; some rows name another element than their file."""
    path = scratch(spark)
    own = B.read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 9 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("element"), F.col("event_id").alias("fixture"), F.dayofmonth("ts").alias("round"))
    own.groupBy("user_id").agg(F.collect_list(F.struct("element", "fixture", "round")).alias("history")).withColumnRenamed("user_id", "element").repartition("element").write.partitionBy("element").json(path)
    return snapshots.player_histories(spark, path).select("file_element", "element", "fixture", "round")


@query("SELECT CAST(p_partkey AS INTEGER) AS id, CAST(floor(p_retailprice) AS INTEGER) AS total_points, p_size AS minutes FROM part")
def src08_event_live(spark, sf_dir):
    path = scratch(spark)
    stats = F.struct(F.floor("p_retailprice").alias("total_points"), F.col("p_size").alias("minutes"), F.lit(1).alias("bps")).alias("stats")
    as_documents(B.read(spark, sf_dir, "part").select(F.lit("e").alias("kind"), F.col("p_partkey").alias("id"), stats), path, {"elements": ("e", ["id", "stats"])}, "id")
    return snapshots.event_live(spark, path)


@query("SELECT CAST(o_orderkey AS INTEGER) AS event, CAST(floor(o_totalprice) AS INTEGER) AS points, CAST(o_custkey AS INTEGER) AS bank FROM orders")
def src12_entry_history(spark, sf_dir):
    path = scratch(spark)
    own = B.read(spark, sf_dir, "orders").select(F.lit("c").alias("kind"), F.col("o_orderkey").alias("event"), F.floor("o_totalprice").alias("points"), F.col("o_custkey").alias("bank"))
    as_documents(own, path, {"current": ("c", ["event", "points", "bank"]), "past": ("p", ["event"])}, "event")
    return snapshots.entry_history(spark, path).select("event", "points", "bank")


@query("SELECT CAST(l_partkey AS INTEGER) AS element, l_linenumber AS slot, CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END AS multiplier, l_linenumber = 1 AS is_captain, count(*) AS n FROM lineitem GROUP BY ALL")
def src13_picks(spark, sf_dir):
    path, n = scratch(spark), F.col("l_linenumber")
    own = B.read(spark, sf_dir, "lineitem").select(F.lit("p").alias("kind"), "l_orderkey", F.col("l_partkey").alias("element"), n.alias("position"), F.when(n == 1, 2).otherwise(1).alias("multiplier"), (n == 1).alias("is_captain"))
    as_documents(own, path, {"picks": ("p", ["element", "position", "multiplier", "is_captain"])}, "l_orderkey")
    return snapshots.picks(spark, path).groupBy("element", "slot", "multiplier", "is_captain").agg(F.count(F.lit(1)).alias("n"))


# --- stored tables ----------------------------------------------------------------------------------------------------

SPLITS = {"train": ("S0", "S1"), "validation": ("S2",)}


@query(f"WITH {B.PANEL}, n AS (SELECT count(*) AS \"rows\" FROM l) SELECT name, place, \"rows\" FROM n, (SELECT unnest({FEATURES}) AS name, CAST(unnest(range(0, {len(FEATURES)})) AS INTEGER) AS place)")
def snk01_panel_features(spark, sf_dir):
    """The stored feature names in their order, beside the rows of the stored panel."""
    path = scratch(spark)
    sinks.write_panel(B.panel(spark, sf_dir), path, FEATURES)
    rows = F.broadcast(seasons.panel(spark, f"{path}/panel").agg(F.count(F.lit(1)).alias("rows")))  # one row
    return spark.read.parquet(f"{path}/features").crossJoin(rows).select(F.col("feature").alias("name"), "place", "rows")


@query(f"""WITH {B.PANEL} SELECT CASE WHEN season = 'S2' THEN 'validation' ELSE 'train' END AS split, count(*) AS "rows", {len(FEATURES)} AS n_features FROM l WHERE season <> 'S3' GROUP BY ALL""")
def snk02_export_manifest(spark, sf_dir):
    path = scratch(spark)
    sinks.export_splits(B.panel(spark, sf_dir), path, SPLITS, len(FEATURES))
    return spark.read.parquet(f"{path}/manifest").select("split", "rows", "n_features")


@query(f"""WITH {B.PANEL} SELECT season, "GW", fixture, player_code, minutes FROM l WHERE season <> 'S3'""")
def snk03_verified_export(spark, sf_dir):
    path = scratch(spark)
    sinks.export_splits(B.panel(spark, sf_dir), path, SPLITS, len(FEATURES))
    return sinks.read_export(spark, path).select("season", "GW", "fixture", "player_code", "minutes")


@query("SELECT p_partkey AS id, p_retailprice + 1 AS e_points_final FROM part")
def snk04_frozen_board(spark, sf_dir):
    """The second writing replaces the first, before the deadline; the third comes after it and is refused."""
    path, deadline = scratch(spark), dt.datetime(2025, 9, 2)
    own = B.read(spark, sf_dir, "part")
    for more, day in ((0, 1), (1, 1), (2, 3)):
        sinks.write_board(own.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") + more).alias("e_points_final")), path, "2025-26", 3, deadline, dt.datetime(2025, 9, day))
    return sinks.read_table(spark, sinks.board_path(path, "2025-26", 3))


@query(f'WITH {LAGS} SELECT fixture, season, round(total_points_r5, 6) AS prediction FROM g')
def snk05_predictions(spark, sf_dir):
    path = f"{scratch(spark)}/predictions"
    sinks.write_predictions(forecasts(spark, sf_dir).withColumn("prediction", six("total_points_r5")), path, ["fixture", "season", "prediction"], KEY)
    return spark.read.parquet(path)


@query("WITH c AS (SELECT CAST(l_partkey % 50 AS INTEGER) AS gw, count(*) AS n FROM lineitem GROUP BY 1) SELECT gw, 'all' AS season, CASE WHEN gw = 5 THEN -1::BIGINT ELSE n END AS n FROM c")
def snk06_stored_upsert(spark, sf_dir):
    """Written, then one event replaced twice: the second time changes nothing."""
    path = f"{scratch(spark)}/scores"
    own = B.read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).cast("int").alias("gw"), F.lit("all").alias("season")).agg(F.count(F.lit(1)).alias("n"))
    sinks.upsert(own, path)
    for _ in range(2):
        sinks.upsert(own.where("gw = 5").withColumn("n", F.lit(-1).cast("long")), path)
    return sinks.read_table(spark, path)


@query("SELECT 'artifact' AS kind, count(*) AS \"rows\", 'frozen' AS policy FROM part UNION ALL SELECT 'input', sum(length(CAST(p_partkey AS VARCHAR)) + 1)::BIGINT, 'frozen' FROM part")
def snk08_evidence(spark, sf_dir):
    """Rows of an artifact, bytes of the input files."""
    path, own = scratch(spark), B.read(spark, sf_dir, "part")
    own.select(F.col("p_partkey").cast("string")).write.text(path)
    return sinks.evidence_manifest(spark, [f"{path}/*.txt"], {"part": own}, "frozen").groupBy("kind", "policy").agg(F.sum("rows").alias("rows"))


# --- checks -----------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT o_orderkey % 2 = 0 AS v, o_orderkey % 3 = 0 AS w, o_orderkey % 50 - 10 AS age, year(o_orderdate) AS y, o_orderpriority = '1-URGENT' AS src FROM orders)
SELECT unnest(['unsupported snapshot version', 'snapshot season differs', 'snapshot captured after as_of', 'snapshot is too old', 'snapshot year is outside its season', 'source is not the expected source']) AS rule,
unnest([count(*) FILTER (NOT v), count(*) FILTER (NOT w), count(*) FILTER (age < 0), count(*) FILTER (age > 24), count(*) FILTER (y NOT IN (1995, 1996)), count(*) FILTER (NOT src)]) AS n FROM m""")
def val10_snapshot_manifest(spark, sf_dir):
    k = F.col("o_orderkey")
    manifest = B.read(spark, sf_dir, "orders").select(F.when(k % 2 == 0, 1).otherwise(2).alias("format_version"), F.when(k % 3 == 0, "1995-96").otherwise("1994-95").alias("season"), F.col("o_orderdate").alias("captured"), F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 50 - 10 as int))").alias("as_of"), F.col("o_orderpriority").alias("source"))
    return checks.violations(checks.bad_capture(manifest, F.col("as_of"), "1995-96", {"source": "1-URGENT"})).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT 'name=texts-' || CAST(doc_id % 64 AS VARCHAR) || '.txt' AS key FROM documents WHERE text IS NOT NULL AND (doc_id % 64) % 7 = 0")
def val10_file_hashes(spark, sf_dir):
    """The documents as 64 files, hashed as they lie; the manifest knows another content of every seventh."""
    path, k = scratch(spark), F.col("doc_id") % 64
    docs = B.read(spark, sf_dir, "documents").where("text is not null").select(k.alias("part"), "doc_id", "text")
    docs.repartition("part").sortWithinPartitions("part", "doc_id", "text").select("part", "text").write.partitionBy("part").text(path)
    found = snapshots.file_hashes(spark, [f"{path}/part=*/*.txt"], by=r"part=([0-9]+)")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n")
    told = docs.groupBy("part").agg(F.sha2(F.concat(whole, F.when(F.col("part") % 7 == 0, "\nx").otherwise(""), F.lit("\n")), 256).alias("sha256"))
    named = lambda c: F.concat(F.lit("texts-"), F.col(c).cast("string"), F.lit(".txt")).alias("name")
    return checks.bad_hashes(told.select(named("part"), "sha256"), found.select(named("name"), "sha256")).select("key")


@query("""WITH c AS (SELECT l_partkey + 3 AS element, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'element is covered twice' AS rule, count(*) AS n FROM c WHERE n > 1
UNION ALL SELECT 'covered element is unknown', coalesce(sum(n), 0)::BIGINT FROM c ANTI JOIN part ON element = p_partkey
UNION ALL SELECT 'element is not covered', count(*) FROM part ANTI JOIN c ON element = p_partkey
UNION ALL SELECT 'stable code is not unique', count(*) FROM (SELECT p_partkey // 2 AS code FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'history row count differs', count(*) FROM c FULL JOIN part ON element = p_partkey WHERE coalesce(CASE WHEN p_partkey IS NOT NULL THEN 30 END, 0) <> coalesce(n, 0)""")
def val11_history_bundle(spark, sf_dir):
    """Ordered parts, keys moved by three, as covered rows; 30 rows are declared for each."""
    covered = B.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 3).alias("element"))
    k = F.col("p_partkey")
    elements = B.read(spark, sf_dir, "part").select(k.alias("element"), F.when(k % 5 != 0, F.floor(k / 2)).alias("code"))
    rules = checks.bad_coverage(covered, elements, elements.select("element", F.lit(30).alias("n")), covered)
    return checks.violations(rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f'WITH {LAGS} SELECT count(*) AS "rows", count(minutes_r3) AS known, true AS refused FROM g')
def val18_banned_columns(spark, sf_dir):
    """Features with an outcome of their own event are refused, the others pass."""
    own, refused = forecasts(spark, sf_dir), False
    checks.forbid_columns(FEATURES, ["minutes", "total_points"])
    try:
        checks.forbid_columns([*FEATURES, "minutes"], ["minutes", "total_points"])
    except checks.CheckFailed:
        refused = True
    return own.agg(F.count(F.lit(1)).alias("rows"), F.count("minutes_r3").alias("known"), F.lit(refused).alias("refused"))


@query(f'WITH {LAGS} SELECT round(avg(abs(total_points - total_points_r3)), 6) AS mae, true AS refused FROM g')
def val22_score_inputs(spark, sf_dir):
    """The forecast asked for is scored; where it is absent, no other one stands in."""
    own, refused = forecasts(spark, sf_dir), False
    checks.score_inputs(own, "total_points_r3", "total_points", "total_points_r5")
    try:
        checks.score_inputs(own.drop("total_points_r3"), "total_points_r3", "total_points", "total_points_r5")
    except checks.CheckFailed:
        refused = True
    return own.agg(six(metrics.mean_error("total_points", "total_points_r3"), "mae"), F.lit(refused).alias("refused"))


# --- kept models ------------------------------------------------------------------------------------------------------


@query(f"WITH {B.BOARD}, sc AS (SELECT *, {SCALE} AS scale FROM b) SELECT id, round(CASE WHEN position = 'GK' OR scale = 0 THEN 0.0 ELSE 1 / (1 + exp(-(2.0 * (head_defcon * scale / scale) - 1.0))) * scale END, 6) AS pred_defcon FROM sc")
def ml17_kept_calibrator(spark, sf_dir):
    """A calibrator that replaced a raw one, read back and applied."""
    path = f"{scratch(spark)}/calibrator"
    for found in (models.Calibrator("raw"), models.Calibrator("platt", slope=2.0, offset=-1.0)):
        models.save_calibrator(found, spark, path)
    own = B.board(spark, sf_dir).withColumn("scale", S.availability("status", "chance")).withColumn("pred_defcon", F.col("head_defcon") * F.col("scale"))
    return models.recalibrate(own, models.load_calibrator(spark, path)).select("id", six("pred_defcon"))


@query(f"WITH {LAGS} SELECT count(*) AS \"rows\", 0::BIGINT AS differing FROM g WHERE season = 'S2'")
def ml17_kept_head(spark, sf_dir):
    """A head, written and read back, predicts what it did before."""
    own, path = forecasts(spark, sf_dir).withColumn("k", F.col("GW").cast("double")), f"{scratch(spark)}/head"
    tree = DecisionTreeRegressor(labelCol="label", featuresCol="features", maxDepth=5, minInstancesPerNode=50, seed=models.SEED)
    head = models.fit(tree, own.where("season <> 'S2'"), FEATURES, "total_points")
    models.save(head, path)
    both = models.predict(models.load(path), models.predict(head, own.where("season = 'S2'"), FEATURES, "before"), FEATURES, "after")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("differing"))
