"""Prediction intervals: a shift that brings coverage into a band, and a nudge for rows on the bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixtura.functions.predicates import all_finite
from fixtura.operators.metrics import histogram, quantiles_of, running
from fixtura.operators.stored import stored

BAND, TARGET = (0.75, 0.90), 0.80


def needs(df: DataFrame, actual: str, low: str, high: str) -> DataFrame:
    """How far each row's interval is from holding its actual: at most 0 inside."""
    return df.where(all_finite(actual, low, high)).withColumn("need", F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high)))


def shift(df: DataFrame, actual: str, low: str, high: str, band: tuple[float, float] = BAND, target: float = TARGET) -> DataFrame:
    """One row: coverage before, and the symmetric shift (shift_low <= 0 <= shift_high, or the reverse) after which it lies in the band.

    In the band already: none. Else the ``target`` quantile of the needs; if ties carry that beyond the band, the largest
    distinct need whose cumulative share stays within it.
    """
    own = histogram(needs(df, actual, low, high).select("need"), "need", {"n": F.count(F.lit(1)).cast("double")})
    total = F.broadcast(own.agg(F.sum("n").alias("total"), (F.sum(F.when(F.col("need") <= 0, F.col("n")).otherwise(0.0)) / F.sum("n")).alias("coverage")))
    counted = running(own, "need", {"n": "below"}).crossJoin(total)  # one row on the right
    q = F.broadcast(quantiles_of(own, "need", "n", [target]).select(F.col("q")[0].alias("q")))
    share = counted.crossJoin(q).withColumn("share", (F.col("below") + F.col("n")) / F.col("total"))  # one row on the right
    at_q = F.max(F.when(F.col("need") <= F.col("q"), F.col("share")))
    fits = F.max(F.when(F.col("share") <= band[1], F.col("need")))
    row = share.agg(F.first("coverage").alias("coverage"), F.first("q").alias("q"), at_q.alias("at_q"), fits.alias("fits"))
    need = F.when(F.col("coverage").between(*band), 0.0).when(F.col("at_q") <= band[1], F.col("q")).otherwise(F.coalesce("fits", "q"))
    return row.select("coverage", (-need).alias("shift_low"), need.alias("shift_high"))


def nudge(df: DataFrame, actual: str, low: str, high: str, key: list[str], band: tuple[float, float] = BAND, eps: float = 1e-6) -> DataFrame:
    """Rows with the fewest intervals moved off (or onto) their actual so that coverage enters the band; `nudged` marks them.

    The first rows by (absolute need, key) are found on two levels: counts of the distinct needs tell at which need they end; of the
    rows at that need alone, counts by ranges of the key tell at which range, and that range is ranked. No task orders more.
    """
    own = needs(df, actual, low, high)
    counts = histogram(own.select(F.abs("need").alias("far"), (F.col("need") <= 0).cast("double").alias("in")), "far", {"inside": F.sum("in"), "outside": F.sum(1 - F.col("in"))})
    told = counts.agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).first()  # two counts
    inside = int(told["inside"] or 0)
    n = inside + int(told["outside"] or 0)
    out_of, into = max(0, inside - int(band[1] * n + 1e-9)), max(0, -(-int(band[0] * n * 1_000_000) // 1_000_000) - inside)
    if not out_of and not into:
        return df.withColumn("nudged", F.lit(False))
    kind, wanted = ("inside", out_of) if out_of else ("outside", into)
    edge = running(counts, "far", {kind: "below"}).where((F.col("below") < wanted) & (F.col("below") + F.col(kind) >= wanted)).select("far", "below").first()  # one row
    pool = own.where(F.col("need") <= 0) if out_of else own.where(F.col("need") > 0)
    tied = stored(pool.where(F.abs("need") == edge["far"]).select(*key).repartitionByRange(*key).withColumn("__part", F.spark_partition_id()), "tied")
    left = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = tied.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(left), F.lit(0)))
    ranked = tied.join(F.broadcast(parts), "__part").withColumn("__place", F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*key)))
    first = ranked.where(F.col("__place") <= wanted - int(edge["below"])).select(*key)
    chosen = pool.where(F.abs("need") < edge["far"]).select(*key).unionByName(first).withColumn("nudged", F.lit(True))
    marked = df.join(chosen, key, "left").withColumn("nudged", F.coalesce("nudged", F.lit(False)))
    y, a, b = F.col(actual), F.col(low), F.col(high)
    at_low = F.abs(y - a) <= F.abs(b - y)
    if out_of:
        new_low, new_high = F.when(at_low, y + eps).otherwise(a), F.when(~at_low, y - eps).otherwise(b)
    else:
        new_low, new_high = F.least(a, y), F.greatest(b, y)
    # a bound that passes the other takes it along
    low_, high_ = F.when(F.col("nudged"), new_low).otherwise(a), F.when(F.col("nudged"), F.greatest(new_high, new_low) if out_of else new_high).otherwise(b)
    low_ = F.when(F.col("nudged") & ~at_low, F.least(low_, new_high)).otherwise(low_) if out_of else low_
    return marked.withColumns({low: low_, high: high_})
