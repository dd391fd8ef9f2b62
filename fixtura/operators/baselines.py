"""Baselines of a frozen candidate list: exponential means of recent weeks and position medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixtura.operators.metrics import quantiles


def form(history: DataFrame, value: str = "points", player: str = "player_id", order: tuple[str, ...] = ("season", "week"), span: int = 4, last: int = 4) -> DataFrame:
    """By player `ewma` and `history_games`, all rows counted, in one pass over the history.

    The exponential mean of the last values is without adjustment: weight a(1-a)**(r-1) for the r-th newest, the oldest takes the rest.
    """
    a = 2 / (span + 1)
    rn = F.row_number().over(Window.partitionBy(player).orderBy(*[F.desc(c) for c in order]))
    own = history.withColumns({"__r": rn, "__all": F.count(F.lit(1)).over(Window.partitionBy(player))}).where(F.col("__r") <= last)
    weight = F.when(F.col("__r") < F.least("__all", F.lit(last)), a * F.pow(F.lit(1 - a), F.col("__r") - 1)).otherwise(F.pow(F.lit(1 - a), F.least("__all", F.lit(last)) - 1))
    return own.groupBy(player).agg(F.sum(F.col(value) * weight).alias("ewma"), F.first("__all").alias("history_games"))


def ewma(history: DataFrame, value: str = "points", player: str = "player_id", order: tuple[str, ...] = ("season", "week"), span: int = 4, last: int = 4) -> DataFrame:
    return form(history, value, player, order, span, last).drop("history_games")


def group_median(history: DataFrame, value: str = "points", by: str = "position") -> DataFrame:
    """Exact median; rows without a group take no part."""
    return quantiles(history, value, [0.5], [by]).select(by, F.col("q")[0].alias("median"))


def games(history: DataFrame, player: str = "player_id") -> DataFrame:
    return history.groupBy(player).agg(F.count(F.lit(1)).alias("history_games"))


def baselines(frozen: DataFrame, history: DataFrame, value: str = "points", player: str = "player_id", by: str = "position", order: tuple[str, ...] = ("season", "week")) -> DataFrame:
    """Each candidate's mean (its position's median without history) and position median (0 without), six decimals, halves to even."""
    medians = F.broadcast(group_median(history, value, by))  # one row a position
    out = frozen.join(form(history, value, player, order), player, "left").join(medians, by, "left")
    median = F.coalesce("median", F.lit(0.0))
    return out.withColumns({"baseline_ewma4": F.bround(F.coalesce("ewma", median), 6), "baseline_position_median": F.bround(median, 6), "history_games": F.coalesce("history_games", F.lit(0))}).drop("ewma", "median")


def with_actuals(frozen: DataFrame, actuals: DataFrame, key: tuple[str, ...] = ("season", "week", "player_id")) -> DataFrame:
    """Candidates with their actuals; those without keep NULLs for the check that follows."""
    return frozen.join(actuals, list(key), "left")


def evidence(forecasts: DataFrame, actuals: DataFrame, player: str = "player_id") -> DataFrame:
    """The kept table of forecasts beside actuals."""
    return forecasts.join(actuals, player, "left")
