"""Season files. Headers drift from season to season, so each season is read alone and joined by name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.functions.scalars import coerce, number
from fixtura.operators.checks import require_columns

ORDERS = ("penalties_order", "corners_and_indirect_freekicks_order", "direct_freekicks_order")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text: types are given by name afterwards, never guessed."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def season_rows(spark: SparkSession, root: str, season: str, numeric: Sequence[str] = ()) -> DataFrame:
    """Fixture rows of one season, tagged with it."""
    return coerce(csv(spark, f"{root}/{season}/merged_gw.csv"), list(numeric)).withColumn("season", F.lit(season))


def all_seasons(spark: SparkSession, root: str, seasons: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [season_rows(spark, root, s, numeric) for s in seasons])


def season_players(spark: SparkSession, root: str, season: str) -> DataFrame:
    """The registry: known columns that are there, `id` as `element`, set-piece orders as numbers."""
    raw = csv(spark, f"{root}/{season}/players_raw.csv")
    want = ("id", "code", "web_name", "first_name", "second_name", "element_type", "team", *ORDERS)
    kept = raw.select(*[c for c in want if c in raw.columns]).withColumnRenamed("id", "element")
    return kept.withColumns({c: number(c) for c in ORDERS if c in kept.columns} | {"element": F.col("element").try_cast("int"), "season": F.lit(season)})


def season_fixtures(spark: SparkSession, root: str, season: str) -> DataFrame:
    raw = csv(spark, f"{root}/{season}/fixtures.csv")
    whole = [c for c in ("id", "event", "team_h", "team_a", "team_h_difficulty", "team_a_difficulty") if c in raw.columns]
    return raw.withColumns({c: number(c).cast("int") for c in whole} | {"season": F.lit(season)})


def season_teams(spark: SparkSession, root: str, season: str) -> DataFrame:
    return csv(spark, f"{root}/{season}/teams.csv").select(F.col("id").try_cast("int").alias("id"), "name", "short_name").withColumn("season", F.lit(season))


def actuals(spark: SparkSession, path: str, required: Sequence[str] = ("id", "total_points")) -> DataFrame:
    raw = csv(spark, path)
    require_columns(raw, required, "actuals")
    return raw.withColumns({c: number(c) for c in raw.columns if c in ("total_points", "minutes")} | {"id": F.col("id").try_cast("int")})


def panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def boards(spark: SparkSession, folder: str) -> DataFrame:
    """All boards of a folder, single files or folders of part files, with the event of their name and the time they were last written."""
    raw = spark.read.option("header", True).csv(f"{folder}/*.csv")
    name = F.regexp_extract("_metadata.file_path", r"([^/]+\.csv)(/[^/]+)?$", 1)
    return raw.withColumns({"board_gw": F.regexp_extract(name, r"gw([0-9]+)", 1).try_cast("int"), "board_file": name, "board_time": F.col("_metadata.file_modification_time")})


def select_board(found: DataFrame, gw: int | None = None) -> DataFrame:
    """One board: the event's last file by name, or without an event the newest file."""
    own = found.where(F.col("board_gw") == gw) if gw is not None else found.where(F.col("board_gw").isNotNull())
    best = own.agg((F.max(F.struct("board_file")) if gw is not None else F.max(F.struct("board_time", "board_file"))).alias("b")).select("b.board_file")
    return own.join(F.broadcast(best), "board_file")


def sample_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """History, frozen candidates, actuals (numbers where they can be) and the sample's configuration."""
    text = {"season", "player_id", "player_name", "position", "team", "opponent", "observed_at", "source_revision"}
    read = lambda name: (df := csv(spark, f"{folder}/{name}.csv")).withColumns({c: number(c) for c in df.columns if c not in text})
    config = spark.read.option("multiLine", True).schema("season string, week int, cutoff_at string").json(f"{folder}/sample_config.json")
    return read("historical_player_weeks"), read("frozen_candidates"), read("week5_actuals"), config
