"""What one period hands to the next: totals, form at its end, and orders that hold over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.functions.scalars import played

PRIOR = ("prior_games", "prior_minutes", "prior_points", "prior_xg", "prior_xa", "prior_defcon", "prior_starts", "prior_ppg", "prior_minutes_pg", "prior_xg90", "prior_defcon_rate")


def succession(df: DataFrame, season: str = "season") -> DataFrame:
    """(season, previous, next) of the seasons present: a handful of rows."""
    w = Window.orderBy(season)
    return df.select(season).where(F.col(season).isNotNull()).distinct().select(season, F.lag(season).over(w).alias("previous"), F.lead(season).over(w).alias("next"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def season_totals(df: DataFrame, season: str = "season", player: str = "player_code") -> DataFrame:
    """Totals of a player's season over the rows with minutes, and their rates."""
    own = df.where(played("minutes")).groupBy(season, player).agg(
        F.count(F.lit(1)).alias("prior_games"),
        *[_zero(F.sum(F.col(c).cast("double"))).alias(n) for c, n in (("minutes", "prior_minutes"), ("total_points", "prior_points"), ("expected_goals", "prior_xg"), ("expected_assists", "prior_xa"), ("defcon_hit", "prior_defcon"), ("started", "prior_starts"))],
    )
    return own.withColumns({
        "prior_ppg": F.col("prior_points") / F.col("prior_games"),
        "prior_minutes_pg": F.col("prior_minutes") / F.col("prior_games"),
        "prior_xg90": F.col("prior_xg") / F.greatest(F.col("prior_minutes"), F.lit(1.0)) * 90,
        "prior_defcon_rate": F.col("prior_defcon") / F.col("prior_games"),
    })


def prior_season(df: DataFrame, season: str = "season", player: str = "player_code") -> DataFrame:
    """Season totals under the season that follows; the last season has no heir and goes."""
    heirs = succession(df, season).where("next is not null").select(F.col(season).alias("__own"), F.col("next").alias("__heir"))
    return season_totals(df, season, player).join(F.broadcast(heirs), F.col(season) == F.col("__own")).withColumn(season, F.col("__heir")).drop("__own", "__heir")


def join_prior(df: DataFrame, season: str = "season", player: str = "player_code") -> DataFrame:
    """Rows with their player's prior totals: `is_new` without any, then zeros."""
    out = df.join(prior_season(df, season, player), [season, player], "left").withColumn("is_new", F.col("prior_games").isNull().cast("int"))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in PRIOR})


def end_form(df: DataFrame, columns: Sequence[str], season: str = "season", player: str = "player_code", event: str = "GW", order: Sequence[str] = ("kickoff_time", "fixture"), last: int = 5) -> DataFrame:
    """l1, r3 and r5 of the last rows with minutes of a player's season; without such a row, of the last rows."""
    whole = Window.partitionBy(season, player)
    down = whole.orderBy(F.desc("__in"), F.desc(event), *[F.desc(c) for c in order])
    kept = df.withColumn("__in", played("minutes").cast("int")).withColumn("__ever", F.max("__in").over(whole)).withColumn("__rn", F.row_number().over(down)).where((F.col("__rn") <= last) & (F.col("__in") == F.col("__ever")))
    rn = F.col("__rn")
    made = [f for c in columns for f in (F.max(F.when(rn == 1, F.col(c).cast("double"))).alias(f"{c}_l1"), F.avg(F.when(rn <= 3, F.col(c))).alias(f"{c}_r3"), F.avg(F.col(c)).alias(f"{c}_r5"))]
    return kept.groupBy(season, player).agg(F.min(event).alias("window_from"), F.max(event).alias("window_to"), *made)


def end_totals(df: DataFrame, season: str = "season", player: str = "player_code") -> DataFrame:
    """End-of-season row of each player: totals over all rows, games and rates over those with minutes."""
    p = played("minutes")
    own = df.groupBy(season, player).agg(
        F.count_if(p).alias("prior_games"),
        *[_zero(F.sum(F.col(c).cast("double"))).alias(n) for c, n in (("minutes", "prior_minutes"), ("total_points", "prior_points"), ("started", "prior_starts"))],
    )
    games = F.nullif(F.col("prior_games"), F.lit(0))
    return own.withColumns({"prior_ppg": _zero(F.col("prior_points") / games), "prior_minutes_pg": _zero(F.col("prior_minutes") / games)})


def first_event_override(lagged: DataFrame, source: DataFrame, columns: Sequence[str], season: str = "season", player: str = "player_code", event: str = "GW") -> DataFrame:
    """In a season's first event the lags are those of the season before, where it has a value."""
    names = [f"{c}_{s}" for c in columns for s in ("l1", "r3", "r5")]
    heirs = succession(source, season).where("next is not null").select(F.col(season).alias("__own"), F.col("next").alias("__heir"))
    form = end_form(source, columns, season, player).join(F.broadcast(heirs), F.col(season) == F.col("__own"))
    form = form.select(F.col("__heir").alias(season), player, *[F.col(n).alias(f"__{n}") for n in names])
    out = lagged.join(form, [season, player], "left")
    return out.withColumns({n: F.when(F.col(event) == 1, F.coalesce(F.col(f"__{n}"), F.col(n))).otherwise(F.col(n)) for n in names}).drop(*[f"__{n}" for n in names])


def first_known(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("season", "player_code"), order: Sequence[str] = ("GW", "kickoff_time", "fixture")) -> DataFrame:
    """Each column's first non-NULL value by key, in an explicit order."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def shifted_orders(df: DataFrame, columns: Sequence[str], season: str = "season", player: str = "player_code") -> DataFrame:
    """Orders of the previous season on this season's rows; 0 without any."""
    told = first_known(df, columns, (season, player)).select(F.col(season).alias("__previous"), player, *[F.col(c).alias(f"__{c}") for c in columns])
    before = succession(df, season).select(season, F.col("previous").alias("__previous"))
    out = df.join(F.broadcast(before), season, "left").join(told, ["__previous", player], "left")
    return out.withColumns({c: F.coalesce(F.col(f"__{c}").cast("double"), F.lit(0.0)) for c in columns}).drop("__previous", *[f"__{c}" for c in columns])


def attach_orders(df: DataFrame, prior: DataFrame, columns: Sequence[str], player: str = "player_code") -> DataFrame:
    """Orders given by player; 0 for players without; of a player's repeated rows the least counts."""
    told = prior.groupBy(player).agg(F.min(F.struct(*columns)).alias("__o")).select(player, *[F.col(f"__o.{c}").alias(c) for c in columns])
    out = df.drop(*[c for c in columns if c in df.columns]).join(told, player, "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def set_piece_orders(df: DataFrame, players: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Orders from the registry, by season and element if both sides have it, else by player code; each key's least row counts."""
    both = set(df.columns) & set(players.columns)
    keys = ["season", "element"] if {"season", "element"} <= both else ["season", "player_code"] if "season" in both else ["player_code"]
    have = [c for c in columns if c in players.columns]
    told = players.groupBy(*keys).agg(F.min(F.struct(*have)).alias("__o")).select(*keys, *[F.col(f"__o.{c}").alias(c) for c in have])
    return df.drop(*[c for c in columns if c in df.columns]).join(told, keys, "left").withColumns({c: F.lit(None).cast("double") for c in columns if c not in have})


def stable_codes(rows: DataFrame, players: DataFrame) -> DataFrame:
    """`player_code` of each row's element; without one, `season:element`."""
    codes = players.select("season", "element", F.col("code").cast("string").alias("player_code"))
    out = rows.drop("player_code").join(codes, ["season", "element"], "left")
    return out.withColumn("player_code", F.coalesce("player_code", F.concat_ws(":", "season", F.col("element").cast("string"))))
