"""Point-in-time features of an entity's rows: nothing of a row's own event, or of later ones, reaches them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY, EVENT, ORDER = ("season", "player_code"), "GW", ("kickoff_time", "fixture")


def _by_event(entity: Sequence[str], event: str, order: Sequence[str]):
    return Window.partitionBy(*entity).orderBy(event, *order)


def lag_one(c: str, entity: Sequence[str] = ENTITY, event: str = EVENT, order: Sequence[str] = ORDER) -> Column:
    """The previous row's value, rows without minutes included."""
    return F.lag(c, 1).over(_by_event(entity, event, order))


def rolling(c: str, n: int, entity: Sequence[str] = ENTITY, event: str = EVENT, order: Sequence[str] = ORDER) -> Column:
    """Mean of the n rows before this one, NULLs skipped; NULL without any value."""
    return F.avg(c).over(_by_event(entity, event, order).rowsBetween(-n, -1))


def event_value(c: str, entity: Sequence[str] = ENTITY, event: str = EVENT, order: Sequence[str] = ORDER) -> Column:
    """The value at the event's first row, for every row of the event (a NULL stays NULL)."""
    whole = Window.partitionBy(*entity, event).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(c).over(whole)


def first_of_event(entity: Sequence[str] = ENTITY, event: str = EVENT, order: Sequence[str] = ORDER) -> Column:
    return F.row_number().over(Window.partitionBy(*entity, event).orderBy(*order)) == 1


def add_lags(df: DataFrame, columns: Sequence[str], windows: Sequence[int] = (3, 5), entity: Sequence[str] = ENTITY, event: str = EVENT, order: Sequence[str] = ORDER, broadcast_event: bool = True) -> DataFrame:
    """`c_l1` and `c_r<n>` of each column, equal over the rows of one event.

    All columns share one exchange and one sort: the entity's partitioning serves the event's window too.
    """
    made = {}
    for c in columns:
        made[f"{c}_l1"] = lag_one(c, entity, event, order)
        made |= {f"{c}_r{n}": rolling(c, n, entity, event, order) for n in windows}
    out = df.withColumns(made)
    return out.withColumns({c: event_value(c, entity, event, order) for c in made}) if broadcast_event else out


def form_at(history: DataFrame, targets: DataFrame, columns: Sequence[str], entity: Sequence[str] = ("element",), event: str = EVENT, order: Sequence[str] = ORDER, fill: float = 0.0) -> DataFrame:
    """Lags of the target rows (one an entity, at the target event) after the history's rows; NULLs become ``fill``."""
    both = history.withColumn("__target", F.lit(False)).unionByName(targets.withColumn("__target", F.lit(True)), allowMissingColumns=True)
    done = add_lags(both, columns, entity=entity, event=event, order=order).where("__target").drop("__target")
    names = [f"{c}_{s}" for c in columns for s in ("l1", "r3", "r5")]
    return done.withColumns({n: F.coalesce(n, F.lit(fill)) for n in names})
