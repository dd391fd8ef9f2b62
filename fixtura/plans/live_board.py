"""The live board: next fixtures, form, heads, availability, published score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.functions.scalars import availability, blended_minutes, minutes_lift, published

# The board's columns in their order.
COLUMNS = ("id", "player_code", "web_name", "position", "team_name", "opponent_name", "was_home", "fdr", "now_cost", "selected_by_percent", "status", "chance_of_playing_next_round", "news", "ep_next", "pred_minutes", "pred_defcon", "pred_points", "pred_points_decomposed", "e_points_final", "pred_points_p10", "pred_points_p90", "e_points_p90", "event")


def publish(rows: DataFrame) -> DataFrame:
    """Rows with raw heads (`head_minutes`, `head_points`, `head_defcon`) as a board, best first."""
    c = F.col
    raw = F.greatest(F.lit(0.0), F.least(F.lit(90.0), c("head_minutes")))
    own = rows.withColumn("__blend", blended_minutes(raw, c("status"), c("prior_starts"), c("prior_games"), c("starts_l1"), c("prior_minutes_pg")))
    own = own.withColumns({"minutes_lift": minutes_lift(c("__blend"), raw), "scale": availability("status", "chance_of_playing_next_round")})
    out = own.withColumns(published(c("head_points"), c("__blend"), c("head_defcon"), c("scale"), c("position")))
    return out.select(*[x for x in COLUMNS if x in out.columns]).orderBy(F.desc("e_points_final"), "id")
