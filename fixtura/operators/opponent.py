"""What a side conceded before an event, overall and by ground, and its join to the rows that face it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.functions.scalars import KEEPERS, number

CONCEDED = "expected_goals_conceded"
STATS = ("xgc_r5", "xgc_home_r5", "xgc_away_r5")


def team_conceded(rows: DataFrame, value: str = CONCEDED, season: str = "season", team: str = "team", event: str = "GW", position: str = "position") -> DataFrame:
    """A team's value in an event: minutes-weighted mean of its keepers' rows, else of all rows, 0 without minutes; one shuffle."""
    m, x = F.coalesce(F.col("minutes"), F.lit(0)), F.coalesce(F.col(value), F.lit(0.0))
    keeper = F.upper(position).isin(*KEEPERS)
    own = rows.where(F.col(team).isNotNull() & F.col(event).isNotNull()).groupBy(season, team, event).agg(
        F.sum(F.when(keeper, x * m)).alias("__kx"), F.sum(F.when(keeper, m)).alias("__km"),
        F.sum(x * m).alias("__x"), F.sum(m).alias("__m"),
        (F.avg(F.col("was_home").cast("double")) >= 0.5).alias("is_home"),
    )
    mean = F.when(F.col("__km") > 0, F.col("__kx") / F.col("__km")).when(F.col("__m") > 0, F.col("__x") / F.col("__m")).otherwise(0.0)
    return own.select(season, team, event, "is_home", mean.alias("xgc"))


def with_next_event(teams: DataFrame, season: str = "season", team: str = "team", event: str = "GW") -> DataFrame:
    """A row more for each team, one event after its last, without values."""
    ends = teams.groupBy(season, team).agg((F.max(event) + 1).alias(event))
    return teams.withColumn("is_next", F.lit(False)).unionByName(ends.withColumn("is_next", F.lit(True)), allowMissingColumns=True)


def rolls(teams: DataFrame, n: int = 5, season: str = "season", team: str = "team", event: str = "GW") -> DataFrame:
    """Means over the last n events before each row: all, home only and away only; 0 without any."""
    every = Window.partitionBy(season, team).orderBy(event)
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    side = F.avg("xgc").over(Window.partitionBy(season, team, "is_home").orderBy(event).rowsBetween(1 - n, 0))
    own = teams.withColumn("__side", side)
    carried = lambda home: F.coalesce(F.last(F.when(F.col("is_home") == home, F.col("__side")), ignorenulls=True).over(before), F.lit(0.0))
    made = {"xgc_r5": F.coalesce(F.avg("xgc").over(every.rowsBetween(-n, -1)), F.lit(0.0)), "xgc_home_r5": carried(True), "xgc_away_r5": carried(False)}
    return own.withColumns(made).drop("__side")


def next_event(teams: DataFrame) -> DataFrame:
    """The rolls that each team takes into its next event."""
    return rolls(with_next_event(teams)).where("is_next").drop("is_next", "xgc", "is_home")


def opponent_names(rows: DataFrame, teams: DataFrame, kind: str = "auto") -> DataFrame:
    """`opponent` of each row: ids become names. `auto` takes the column for ids if over 90 % of it are numbers."""
    as_number = number(F.col("opponent_team").cast("string"))
    if kind == "auto":
        share = rows.agg(F.avg(F.when(as_number.isNotNull(), 1.0).otherwise(0.0)).alias("s")).first()["s"]
        kind = "id" if (share or 0) > 0.9 else "name"
    if kind == "name":
        return rows.withColumn("opponent", F.col("opponent_team").cast("string"))
    names = teams.select("season", F.col("id").cast("double").alias("__id"), F.col("name").alias("opponent"))
    return rows.withColumn("__id", as_number).join(F.broadcast(names), ["season", "__id"], "left").drop("__id")


def fixture_sides(rows: DataFrame, season: str = "season", fixture: str = "fixture", team: str = "team") -> DataFrame:
    """(season, fixture, home, away) by the two sides' own rows."""
    return rows.groupBy(season, fixture).agg(F.min(F.when(F.col("was_home"), F.col(team))).alias("home"), F.min(F.when(~F.col("was_home"), F.col(team))).alias("away"))


def opponents_by_side(rows: DataFrame, season: str = "season", fixture: str = "fixture", team: str = "team") -> DataFrame:
    """Rows with the other side of their fixture as `opponent`."""
    return rows.join(fixture_sides(rows, season, fixture, team), [season, fixture], "left").withColumn("opponent", F.when(F.col("was_home"), F.col("away")).otherwise(F.col("home"))).drop("home", "away")


def join_opponent(rows: DataFrame, stats: DataFrame, opponent: str = "opponent", season: str = "season", team: str = "team", event: str = "GW") -> DataFrame:
    """Rows with their opponent's rolls at their event; 0 for unknown opponents."""
    own = stats.select(F.col(season), F.col(team).alias(opponent), F.col(event), *[F.col(c).alias(f"opp_{c}") for c in STATS])
    return rows.join(own, [season, opponent, event], "left").withColumns({f"opp_{c}": F.coalesce(F.col(f"opp_{c}"), F.lit(0.0)) for c in STATS})


def join_opponent_end(rows: DataFrame, ends: DataFrame, opponent: str = "opponent_name", team: str = "team") -> DataFrame:
    """Live rows with their opponent's rolls after its last event; 0 for unknown opponents."""
    own = ends.select(F.col(team).alias(opponent), *[F.col(c).alias(f"opp_{c}") for c in STATS])
    return rows.join(F.broadcast(own), opponent, "left").withColumns({f"opp_{c}": F.coalesce(F.col(f"opp_{c}"), F.lit(0.0)) for c in STATS})


def difficulty(rows: DataFrame, fixtures: DataFrame, rule: Column) -> DataFrame:
    """Rows with their fixture's difficulty columns joined and `fdr` by ``rule``."""
    own = fixtures.select("season", F.col("id").alias("fixture"), "team_h_difficulty", "team_a_difficulty")
    return rows.join(own, ["season", "fixture"], "left").withColumn("fdr", rule)
