"""Scores of forecasts: one aggregate each, on one common row mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.functions.predicates import all_finite
from fixtura.functions.scalars import absolute_error, clip_probability, edge, pinball, played
from fixtura.operators.stored import stored


def mean_error(actual: str, forecast: str, where: Column | None = None) -> Column:
    e = absolute_error(actual, forecast)
    return F.avg(e if where is None else F.when(where, e))


def holdout(df: DataFrame, actual: str, forecasts: Sequence[str], gated: str | None = None, limit: float = 0.980, minutes: tuple[str, str] | None = None, event: str = "GW") -> DataFrame:
    """Mean absolute errors of all forecasts on their common mask; with ``gated``, whether it is fit to publish; minutes' error, NULLs as 0; the first event's error."""
    mask = all_finite(actual, *forecasts, *([gated] if gated else []))
    out = [F.count(F.lit(1)).alias("n"), F.count_if(mask).alias("n_common"), *[mean_error(actual, f, mask).alias(f"mae_{f}") for f in forecasts]]
    if gated:
        out += [mean_error(actual, gated, mask).alias("mae_gated"), F.coalesce(mean_error(actual, gated, mask) <= limit, F.lit(False)).alias("publish")]
    if minutes:
        a, b = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in minutes)
        out.append(F.avg(F.abs(a - b)).alias("mae_minutes"))
    out.append(mean_error(actual, forecasts[0], mask & (F.col(event) == 1)).alias("mae_first_event"))
    return df.agg(*out)


def histogram(df: DataFrame, value: str, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row a distinct value (in each group of ``by``) with aggregates of its rows, written once, in ranges of about as many values: `__part`.

    The input is read by this one job only; cuts, totals, ranks and quantiles come from what it has written. NULL and NaN take
    no part, nor do rows without a group; infinities are values like others, at the ends of the order.
    """
    v = F.col(value).cast("double")
    own = df.where(v.isNotNull() & ~F.isnan(v)).where(" and ".join(["true", *(f"`{c}` is not null" for c in by)]))
    each = own.groupBy(*by, v.alias(value)).agg(*[c.alias(name) for name, c in sums.items()])
    return stored(each.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()), "histogram")


def running(own: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """A histogram with sums over all smaller values (of the group): inside a range by window, plus the ranges before, so no task orders more than a range."""
    few = own.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offset = few.select(*by, "__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0.0)).alias(f"__o_{c}") for c in sums])
    inside = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = own.join(offset if by else F.broadcast(offset), [*by, "__part"])  # without groups one row a range
    return out.withColumns({name: F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for c, name in sums.items()}).drop(*[f"__o_{c}" for c in sums])


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the curve, ties half; NULL with one class. Rows without a label or score (NULL, NaN) take no part; infinite scores rank first or last."""
    told = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))).select(F.col(label).cast("double").alias("y"), F.col(score).alias("s"))
    part = running(histogram(told, "s", {"p": F.sum("y"), "n": F.sum(1.0 - F.col("y"))}), "s", {"n": "below"})
    return part.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("a"), F.sum("p").alias("p"), F.sum("n").alias("n")).select((F.col("a") / F.nullif(F.col("p") * F.col("n"), F.lit(0.0))).alias("auc"))


def quantiles_of(own: DataFrame, value: str, count: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles from a histogram whose ``count`` tells each value's rows."""
    total = own.groupBy(*by).agg(F.sum(count).alias("__total"))
    part = running(own, value, {count: "__below"}, by)
    told = part.join(total, list(by)) if by else part.crossJoin(F.broadcast(total))  # one row on the right
    place = [q * (F.col("__total") - 1) for q in at]
    under = lambda p: F.max(F.when(F.col("__below") <= p, F.col(value)))
    ends = told.groupBy(*by).agg(*[x for i, p in enumerate(place) for x in (under(F.floor(p)).alias(f"__a{i}"), under(F.ceil(p)).alias(f"__b{i}"), F.max(p - F.floor(p)).alias(f"__f{i}"))])
    line = lambda a, b, f: F.when((a == b) | (f == 0), a).otherwise(a + f * (b - a))  # noqa: E731  (between two infinities of one sign, that infinity)
    return ends.select(*by, F.array(*[line(F.col(f"__a{i}"), F.col(f"__b{i}"), F.col(f"__f{i}")) for i in range(len(at))]).alias("q"))


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles, by linear interpolation, as an array `q` for each group (one row without groups), from counts of the distinct values: no task gathers a group's values.

    NULL and NaN take no part; a quantile between opposite infinities is NaN.
    """
    own = df.select(*by, F.col(value).cast("double").alias("__v"))
    return quantiles_of(histogram(own, "__v", {"__n": F.count(F.lit(1)).cast("double")}, by), "__v", "__n", at, by)


def log_loss(df: DataFrame, label: str, p: str) -> DataFrame:
    q = clip_probability(p)
    return df.where(all_finite(label, p)).agg(F.avg(-(F.col(label) * F.log(q) + (1 - F.col(label)) * F.log(1 - q))).alias("log_loss"), F.avg((q - F.col(label)) * (q - F.col(label))).alias("brier"), F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, actual: str, low: str, high: str) -> DataFrame:
    return df.where(all_finite(actual, low, high)).agg(F.avg(((F.col(actual) >= F.col(low)) & (F.col(actual) <= F.col(high))).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def pinball_loss(df: DataFrame, actual: str, forecast: str, alpha: float) -> DataFrame:
    return df.where(all_finite(actual, forecast)).agg(F.avg(pinball(actual, forecast, alpha)).alias("pinball"), F.count(F.lit(1)).alias("n"))


def match_actuals(board: DataFrame, actuals: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """Forecasts with their actuals; of repeated actuals the least row counts."""
    rest = [c for c in actuals.columns if c not in key]
    own = actuals.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__a")).select(*key, *[F.col(f"__a.{c}").alias(c) for c in rest])
    return board.join(own, list(key))


def weekly(df: DataFrame, actual: str, model: str, baseline: str, by: Sequence[str] = ("season", "GW"), minutes: str | None = "minutes") -> DataFrame:
    """Model against baseline for every event at once: all common rows, and those who played."""
    mask = all_finite(actual, model, baseline)
    in_ = mask & played(minutes) if minutes else F.lit(False)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(mask).alias("n_common"), mean_error(actual, model, mask).alias("mae_model"), mean_error(actual, baseline, mask).alias("mae_baseline"),
        F.count_if(in_).alias("n_played"), mean_error(actual, model, in_).alias("mae_model_played"), mean_error(actual, baseline, in_).alias("mae_baseline_played"),
    )


def frozen(df: DataFrame, actual: str, forecasts: Sequence[str], did_play: str = "played") -> DataFrame:
    """Rows that were frozen, played and not, and each baseline's errors with the latter kept; six decimals.

    ``df`` is read once, by the histogram of errors; rows and players are counted in it as values of two more kinds.
    """
    six = lambda c: F.round(c, 6)
    kinds = {"|rows": F.lit(0.0), "|played": (F.coalesce(F.col(did_play).cast("int"), F.lit(0)) == 1).cast("double"), "|dnp": (F.coalesce(F.col(did_play).cast("int"), F.lit(0)) == 0).cast("double")}
    kinds |= {f: absolute_error(actual, f) for f in forecasts}
    own = histogram(df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("of"), e.alias("e")) for k, e in kinds.items()]))), "e", {"n": F.count(F.lit(1)).cast("double")}, ["of"])
    of = lambda k, c: F.sum(F.when(F.col("of") == k, c))
    count, e = lambda k, c: F.coalesce(of(k, c), F.lit(0)).cast("long"), F.col("e")
    out = [count("|rows", F.col("n")).alias("n_frozen"), count("|played", e * F.col("n")).alias("n_played"), count("|dnp", e * F.col("n")).alias("n_dnp")]
    for f in forecasts:
        out += [six(of(f, e * F.col("n")) / of(f, F.col("n"))).alias(f"mae_{f}"), six(F.sqrt(of(f, e * e * F.col("n")) / of(f, F.col("n")))).alias(f"rmse_{f}")]
    errors = own.where(~F.col("of").startswith("|"))
    medians = quantiles_of(errors, "e", "n", [0.5], ["of"]).agg(*[six(F.max(F.when(F.col("of") == f, F.col("q")[0]))).alias(f"median_ae_{f}") for f in forecasts])
    return own.agg(*out).crossJoin(F.broadcast(medians))  # one row on either side


def slices(df: DataFrame, actual: str, forecasts: Sequence[str], minutes: str = "minutes", haul: float = 5) -> DataFrame:
    """Errors of each forecast over all rows, those with minutes, and hauls: long form."""
    parts = {"all": F.lit(True), "played": played(minutes), "haulers": played(minutes) & (F.col(actual) >= haul)}
    aggs = [x for s, w in parts.items() for f in forecasts for x in (mean_error(actual, f, w & all_finite(actual, f)).alias(f"m|{s}|{f}"), F.count_if(w & all_finite(actual, f)).alias(f"n|{s}|{f}"))]
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(F.lit(s).alias("slice"), F.lit(f).alias("forecast"), F.col(f"`m|{s}|{f}`").alias("mae"), F.col(f"`n|{s}|{f}`").alias("n")) for s in parts for f in forecasts])))


def reliability(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-frequency bins, right-closed, repeated edges dropped; equal width if fewer than two edges remain. Edges and bins come from one histogram."""
    own = histogram(df.where(all_finite(label, p)).select(F.col(label).cast("double").alias("y"), F.col(p).cast("double").alias("p")), "p", {"y": F.sum("y"), "n": F.count(F.lit(1)).cast("double")})
    ends = quantiles_of(own, "p", "n", [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("e"))
    width = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: i / F.lit(float(bins)))
    ends = ends.select(F.when(F.size("e") > 2, F.col("e")).otherwise(width).alias("e"))
    told = own.crossJoin(F.broadcast(ends))  # one row on the right
    at = F.greatest(F.lit(0), F.size(F.filter("e", lambda e: e < F.col("p"))) - 1)
    return told.groupBy(at.alias("bin")).agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_pred"), (F.sum("y") / F.sum("n")).alias("rate"), F.sum("n").cast("long").alias("n"))


def comparison(tables: dict[str, DataFrame]) -> DataFrame:
    """Metric rows of several models in long form: (model, metric, value)."""
    out = None
    for model, df in tables.items():
        names = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int")]
        long = df.select(F.lit(model).alias("model"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])))
        out = long if out is None else out.unionByName(long)
    return out


def scoreboard(scores: DataFrame, weeks: DataFrame | None = None) -> DataFrame:
    """The model's edge over the baseline by event, with an entry's weeks where given."""
    out = scores.withColumn("edge", edge("mae_baseline", "mae_model"))
    return out if weeks is None else out.join(weeks.select(F.col("event").alias("GW"), "points", "vs_avg", "status"), "GW", "left")
