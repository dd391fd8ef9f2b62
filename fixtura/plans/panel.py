"""The panel: fixture rows of many seasons with labels, lags, prior-season and opponent features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.functions.scalars import fixture_difficulty, label_count, label_hit, played
from fixtura.operators.checks import conflicting_duplicates, drop_exact_duplicates, enforce, many_to_one
from fixtura.operators.lags import add_lags
from fixtura.operators.opponent import difficulty, join_opponent, rolls, team_conceded
from fixtura.operators.priors import first_event_override, join_prior, shifted_orders, stable_codes

KEY = ("season", "GW", "player_code", "fixture")


def labelled(rows: DataFrame, actions: str = "clearances_blocks_interceptions", recoveries: str = "recoveries", starts: str = "starts") -> DataFrame:
    """Counts, labels and flags of each row; absent optional columns are NULL."""
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in (actions, recoveries, starts) if c not in rows.columns})
    out = rows.withColumn("defcon_count", label_count("position", actions, recoveries))
    scraped = F.col("xP").cast("double") if "xP" in rows.columns else F.lit(None).cast("double")
    return out.withColumns({"defcon_hit": label_hit("position", "defcon_count"), "played": played("minutes").cast("int"), "started": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(starts).cast("double"))), "xp_scraped": scraped, "xp_is_leaky": F.lit(True)})


def build(rows: DataFrame, players: DataFrame, fixtures: DataFrame, lag_columns: Sequence[str], orders: Sequence[str] = (), check: bool = True) -> DataFrame:
    """All steps in order. Shuffles: one by key for duplicates, one by (season, player), one by (season, team, event)."""
    if check:
        enforce([many_to_one(players, ["season", "element"]), many_to_one(fixtures, ["season", "id"])])
    own = stable_codes(rows, players)
    if check:
        enforce([conflicting_duplicates(own, KEY)])
    own = labelled(difficulty(drop_exact_duplicates(own, KEY), fixtures, fixture_difficulty("was_home", "team_h_difficulty", "team_a_difficulty")))
    return featured(own, lag_columns, orders)


def featured(own: DataFrame, lag_columns: Sequence[str], orders: Sequence[str] = ()) -> DataFrame:
    """Lags with the first event's override, prior totals, shifted orders and the opponent's rolls."""
    out = first_event_override(add_lags(own, lag_columns), own, lag_columns)
    out = join_prior(out)
    if orders:
        out = shifted_orders(out, orders)
    return join_opponent(out, rolls(team_conceded(own))) if "opponent" in out.columns else out
