"""Filters over rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.functions.scalars import eligible, finite, flagged, played


def seasons(df: DataFrame, names: list[str], column: str = "season") -> DataFrame:
    return df.where(F.col(column).isin(*names))


def all_finite(*columns: str) -> Column:
    """The common mask: every value present and finite."""
    return reduce(lambda a, b: a & b, [finite(c) for c in columns])


def common_played(columns: list[str], minutes: str | None) -> Column:
    """The common mask among those who played; empty without a minutes column."""
    return all_finite(*columns) & played(minutes) if minutes else F.lit(False)


def label_holdout(label: str, forecast: str, event: int = 28) -> Column:
    return finite(label) & finite(forecast) & (F.upper("position") != "GK") & (F.col("GW") > event) & played("minutes")


def label_training(label: str, seasons_: list[str], event: int | None = 28) -> Column:
    """Rows that the label's head is fitted on: up to ``event`` for the holdout head, without one all, for the live head."""
    rows = F.col("season").isin(*seasons_) & (F.upper("position") != "GK") & played("minutes") & F.col(label).isNotNull()
    return rows if event is None else rows & (F.col("GW") <= event)


def admissible(event: str, target: Column, kickoff: str, captured: list[Column]) -> Column:
    """Known before the target event: earlier, begun before every capture, finished in both senses."""
    before = reduce(lambda a, b: a & b, [F.col(kickoff) < c for c in captured])
    return F.coalesce((F.col(event) > 0) & (F.col(event) < target) & before & F.col("finished") & F.col("finished_provisional"), F.lit(False))


def unfinished(event: str = "event", target: Column | None = None) -> Column:
    out = ~F.coalesce(F.col("finished"), F.lit(False)) & F.col(event).isNotNull()
    return out if target is None else out & (F.col(event) == target)


def final_event() -> Column:
    return F.coalesce(F.col("finished") & F.col("data_checked"), F.lit(False))


def buyable(owned: str = "owned", status: str = "status", chance: str = "chance_of_playing_next_round") -> Column:
    return (eligible(status, chance) & ~flagged(status, chance)) | F.coalesce(F.col(owned), F.lit(False))


def pickable(df: DataFrame) -> DataFrame:
    """Eligible rows with a score, a price, a position and a team."""
    return df.where(eligible("status", "chance_of_playing_next_round")).na.drop(subset=[c for c in ("e_points_final", "now_cost", "position", "team_name") if c in df.columns])


def known_before(season: str, cutoff: Column) -> Column:
    """Rows of one season that began before the cutoff."""
    return F.coalesce((F.col("season") == season) & (F.col("kickoff_time") < cutoff), F.lit(False))
