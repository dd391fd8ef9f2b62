"""The live board: fixtures by side, the next event, admissible history, and joins of snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.functions.predicates import admissible, final_event, unfinished
from fixtura.functions.scalars import event_status


def sides(fixtures: DataFrame) -> DataFrame:
    """Two rows a fixture, one a side: team, opponent, was_home, fdr (each side its own column)."""
    side = lambda own, other, home: F.struct(F.col(f"team_{own}").alias("team"), F.col(f"team_{other}").alias("opponent"), F.lit(home).alias("was_home"), F.col(f"team_{own}_difficulty").alias("fdr"))
    keep = [c for c in ("season", "id", "event", "kickoff_time", "finished", "finished_provisional") if c in fixtures.columns]
    return fixtures.select(*keep, F.inline(F.array(side("h", "a", True), side("a", "h", False))))


def next_fixtures(fixtures: DataFrame, target: Column | None = None) -> DataFrame:
    """The earliest unfinished fixture of each team, by event, kickoff, id."""
    order = Window.partitionBy("team").orderBy("event", F.asc_nulls_last("kickoff_time"), "id")
    return sides(fixtures.where(unfinished(target=target))).withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def next_by_kickoff(sides_: DataFrame) -> DataFrame:
    """Each team's next fixture by (kickoff, or last without one; id): one aggregate, no sort."""
    late = F.coalesce(F.col("kickoff_time").cast("string"), F.lit("9999"))
    return sides_.groupBy("team").agg(F.min_by(F.struct("opponent", "was_home", "event", "kickoff_time"), F.struct(late, "id")).alias("x")).select("team", "x.*")


def double_events(sides_: DataFrame) -> DataFrame:
    return sides_.groupBy("team", "event").agg(F.count(F.lit(1)).alias("n_fixtures")).where("n_fixtures >= 2")


def modal_event(df: DataFrame, event: str = "event") -> DataFrame:
    """The most frequent event, the smallest on ties."""
    return df.where(F.col(event).isNotNull()).groupBy(event).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), event).limit(1)


def next_event(events: DataFrame) -> DataFrame:
    """The first event marked next, else the first unfinished one: one row or none."""
    rank = F.when(F.col("is_next"), 0).when(~F.coalesce(F.col("finished"), F.lit(False)), 1)
    return events.agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "id"))).alias("x")).where("x is not null").select(F.col("x.id").alias("event"))


def latest_final(events: DataFrame) -> DataFrame:
    return events.where(final_event()).agg(F.max("id").alias("event")).where("event is not null")


def event_context(events: DataFrame) -> DataFrame:
    """Current, next and finished events in one row."""
    return events.agg(F.min(F.when(F.col("is_current"), F.col("id"))).alias("current"), F.min(F.when(F.col("is_next"), F.col("id"))).alias("next"), F.sort_array(F.collect_list(F.when(F.col("finished"), F.col("id")))).alias("finished"))


def newest_picks(picks: DataFrame, events: DataFrame) -> DataFrame:
    """The picks of the next event if there are any, else of the current, else of the last finished one."""
    rank = F.when(F.col("is_next"), F.struct(F.lit(0).alias("k"), F.lit(0).alias("v"))).when(F.col("is_current"), F.struct(F.lit(1).alias("k"), F.lit(0).alias("v"))).when(F.col("finished"), F.struct(F.lit(2).alias("k"), (-F.col("id")).alias("v")))
    own = events.select(F.col("id").alias("event"), rank.alias("__rank")).where("__rank is not null")
    ranked = picks.join(F.broadcast(own), "event")
    best = ranked.groupBy("entry_id").agg(F.min("__rank").alias("__best"))
    return ranked.join(best, "entry_id").where("__rank = __best").drop("__rank", "__best")


def history_with_meta(history: DataFrame, fixtures: DataFrame, elements: DataFrame) -> DataFrame:
    """History rows with their fixture's (`fx_`) and element's (`el_`) columns; unknown ones NULL."""
    fx = fixtures.select(*[F.col(c).alias(f"fx_{c}") for c in fixtures.columns])
    el = elements.select(*[F.col(c).alias(f"el_{c}") for c in elements.columns])
    out = history.join(fx, F.col("fixture") == F.col("fx_id"), "left").join(el, F.col("element") == F.col("el_id"), "left")
    return out.withColumns({"team": F.when(F.col("was_home"), F.col("fx_team_h")).otherwise(F.col("fx_team_a")), "opponent": F.when(F.col("was_home"), F.col("fx_team_a")).otherwise(F.col("fx_team_h"))})


def admitted(rows: DataFrame, target: Column, captured: list[Column], event: str = "GW", kickoff: str = "kickoff_time") -> DataFrame:
    """Rows known before the target event."""
    return rows.where(admissible(event, target, kickoff, captured))


def excluded_count(rows: DataFrame, target: Column, captured: list[Column], event: str = "GW", kickoff: str = "kickoff_time") -> DataFrame:
    ok = admissible(event, target, kickoff, captured)
    return rows.agg(F.count_if(ok).alias("n_admitted"), F.count_if(~ok).alias("n_excluded"))


def totals_by_element(elements: DataFrame, history: DataFrame) -> DataFrame:
    """Rows, minutes, starts and points of every element; zeros for those without rows."""
    own = history.groupBy("element").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in ("minutes", "starts", "total_points")])
    out = elements.select("element").join(own, "element", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("rows", "minutes", "starts", "total_points")})


def live_rows(elements: DataFrame, fixtures_next: DataFrame, prior: DataFrame, current: DataFrame | None, lags: list[str]) -> DataFrame:
    """Elements with their next fixture, prior form by stable code and current form by element, whose lags win."""
    out = elements.join(F.broadcast(fixtures_next), "team", "left").join(prior, "player_code", "left")
    if current is not None:
        own = current.select("element", *[F.col(c).alias(f"__{c}") for c in lags])
        out = out.drop(*[c for c in lags if c in out.columns]).join(own, "element", "left").withColumnsRenamed({f"__{c}": c for c in lags})
    return out


def entry_weeks(history: DataFrame, events: DataFrame) -> DataFrame:
    """Entry rows by event with status and points against the average; events that have not begun go."""
    own = events.select(F.col("id").alias("event"), "average_entry_score", event_status("finished", "data_checked", "is_current").alias("status")).where("status is not null")
    return history.join(F.broadcast(own), "event").withColumn("vs_avg", F.col("points") - F.col("average_entry_score"))


def picked(picks: DataFrame, elements: DataFrame, teams: DataFrame, live: DataFrame) -> DataFrame:
    """Slots with their element, team and live statistics."""
    return picks.join(elements, "element", "left").join(F.broadcast(teams), "team", "left").join(live, "element", "left")


def roster(board: DataFrame) -> DataFrame:
    """Place of each row in its team: position order, points, name."""
    order = Window.partitionBy("team_name").orderBy(F.array_position(F.array(*[F.lit(p) for p in ("GK", "DEF", "MID", "FWD")]), F.col("position")), F.desc("e_points_final"), "web_name")
    return board.withColumn("place", F.row_number().over(order))


def roster_summary(board: DataFrame) -> DataFrame:
    return board.groupBy("team_name").agg(F.count(F.lit(1)).alias("players"), F.avg("now_cost").alias("mean_cost"))


def board_order(board: DataFrame) -> DataFrame:
    return board.orderBy(F.desc("e_points_final"), "id")


def latest_record(records: DataFrame) -> DataFrame:
    """The last progress record of each event."""
    return records.groupBy("season", "gw").agg(F.max_by(F.struct(*records.columns), F.struct("recorded_at", "revision")).alias("x")).select("x.*")


def unique_slugs(teams: DataFrame, slug: Column) -> DataFrame:
    """Slugs; one without letters is `team-id`, and all but the first of equal ones get `-id`."""
    own = teams.withColumn("slug", F.coalesce(F.nullif(slug, F.lit("")), F.concat(F.lit("team-"), F.col("id").cast("string"))))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    return own.withColumn("__n", n).withColumn("slug", F.when(F.col("__n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("id").cast("string")))).drop("__n")


def play_curve(df: DataFrame, width: float = 10.0) -> DataFrame:
    """Share of players with minutes by bin of projected minutes."""
    return df.where(F.col("pred_minutes").isNotNull()).groupBy(F.floor(F.col("pred_minutes") / width).cast("int").alias("bin")).agg(F.avg((F.coalesce(F.col("minutes"), F.lit(0)) > 0).cast("double")).alias("play_rate"), F.count(F.lit(1)).alias("n"))
