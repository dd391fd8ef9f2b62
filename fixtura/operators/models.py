"""Forecasting heads with Spark ML: boosted trees, leaf quantiles, out-of-fold probabilities, calibration."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.functions.scalars import availability, blended_minutes, clip, finite, interval_columns, minutes_lift
from fixtura.operators.checks import duplicate_keys, enforce, unmatched
from fixtura.operators.intervals import nudge, shift
from fixtura.operators.metrics import histogram, log_loss, quantiles
from fixtura.operators.stored import stored

SEED = 42


def assembled(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vectors. Tree learners refuse missing values: they become -1 beside a flag of their own, in training and scoring alike."""
    made = {f"__{c}": F.when(finite(c), F.col(c).cast("double")).otherwise(-1.0) for c in features} | {f"__{c}_missing": (~finite(c)).cast("double") for c in features}
    return VectorAssembler(inputCols=list(made), outputCol=out).transform(df.withColumns(made)).drop(*made)


def regressor(trees: int = 400, label: str = "label", prediction: str = "prediction") -> GBTRegressor:
    return GBTRegressor(labelCol=label, featuresCol="features", predictionCol=prediction, maxIter=trees, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=40, seed=SEED)


def classifier(trees: int = 400, label: str = "label") -> GBTClassifier:
    return GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=20, seed=SEED)


def feature_table(train: DataFrame, features: Sequence[str], label: str, *more: str) -> DataFrame:
    """Feature vectors, the label and ``more`` columns of the rows with a label, written once: however many trees are fitted, lags and joins are computed once."""
    return stored(assembled(train.where(finite(label)), features).select("features", F.col(label).cast("double").alias("label"), *more), "features")


def fit(learner, train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    return Pipeline(stages=[learner]).fit(feature_table(train, features, label))


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    done = model.transform(assembled(df, features))
    if "probability" in done.columns:
        done = done.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    else:
        done = done.withColumnRenamed("prediction", out)
    return done.drop("features")


def leaf_quantiles(train: DataFrame, score: DataFrame, features: Sequence[str], label: str, low: float = 0.1, high: float = 0.9, depth: int = 5) -> DataFrame:
    """``score`` with q_low and q_high: exact quantiles of the labels in the leaf that a row falls in."""
    tree = DecisionTreeRegressor(labelCol="label", featuresCol="features", maxDepth=depth, minInstancesPerNode=50, leafCol="leaf", seed=SEED)
    model = fit(tree, train, features, label)
    own = quantiles(model.transform(assembled(train.where(finite(label)), features)), label, [low, high], ["leaf"]).withColumnRenamed("q", "__q")
    done = model.transform(assembled(score, features)).join(F.broadcast(own), "leaf", "left")  # one row a leaf: 2**depth at most
    return done.withColumns({"q_low": F.col("__q")[0], "q_high": F.col("__q")[1]}).drop("features", "prediction", "leaf", "__q")


@dataclass
class QuantileHead:
    """A start value, and trees with what each of their leaves adds."""

    start: float
    trees: list[tuple[object, dict[int, float]]]


def leaf_steps(model, leaf: str, steps: dict[int, float]) -> Column:
    """What a row's leaf adds; 0 in a leaf without steps."""
    return F.coalesce(F.element_at(F.from_json(F.lit(json.dumps({str(k): v for k, v in steps.items()})), "map<string,double>"), F.col(leaf).cast("int").cast("string")), F.lit(0.0))


def boosted_quantile(train: DataFrame, features: Sequence[str], label: str, alpha: float, rounds: int = 12, rate: float = 0.4, depth: int = 3, least: int = 40, cut: int = 4) -> QuantileHead:
    """Boosting under the pinball loss of ``alpha``.

    Each round fits a tree to the loss's slope (alpha where the label is above the forecast so far, alpha - 1 elsewhere), and each leaf adds
    ``rate`` times the alpha quantile of its residuals, exact, from counts. The features are one stored table; the forecasts so
    far are stored every ``cut`` rounds, so lineage stays short. Only values by leaf (2**depth) reach the driver.
    """
    rows = feature_table(train, features, label)
    start = quantiles(rows, "label", [alpha]).first()["q"][0]
    head, now = QuantileHead(float(start or 0.0), []), rows.withColumn("now", F.lit(float(start or 0.0)))
    for k in range(rounds if start is not None else 0):
        residual = F.col("label") - F.col("now")
        sloped = now.select("features", F.when(residual > 0, alpha).otherwise(alpha - 1).alias("label"))
        tree = DecisionTreeRegressor(labelCol="label", featuresCol="features", maxDepth=depth, minInstancesPerNode=least, leafCol="leaf", seed=SEED + k).fit(sloped)
        placed = tree.transform(now).drop("prediction")
        steps = {int(r["leaf"]): rate * r["q"][0] for r in quantiles(placed.select("leaf", residual.alias("residual")), "residual", [alpha], ["leaf"]).collect()}  # one row a leaf
        head.trees.append((tree, steps))
        now = placed.withColumn("now", F.col("now") + leaf_steps(tree, "leaf", steps)).drop("leaf")
        if k % cut == cut - 1:
            now = stored(now, "boosted")
    return head


def predict_quantile(head: QuantileHead, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    done = assembled(df, features).withColumn(out, F.lit(head.start))
    for tree, steps in head.trees:
        done = tree.transform(done).withColumn(out, F.col(out) + leaf_steps(tree, "leaf", steps)).drop("leaf", "prediction")
    return done.drop("features")


def boosted_quantiles(train: DataFrame, score: DataFrame, features: Sequence[str], label: str, low: float = 0.1, high: float = 0.9, **more) -> DataFrame:
    """``score`` with q_low and q_high of two boosted heads, in order."""
    out = score
    for alpha, name in ((low, "q_low"), (high, "q_high")):
        out = predict_quantile(boosted_quantile(train, features, label, alpha, **more), out, features, name)
    return out.withColumns({"q_low": F.least("q_low", "q_high"), "q_high": F.greatest("q_low", "q_high")})


def shifted_quantiles(scored: DataFrame, calibration: DataFrame, actual: str, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Quantile columns with the shift fitted on a slice of their own, low <= high; and the shift's row. With ``key``, rows on a bound are nudged on the slice."""
    moved = shift(calibration, actual, "q_low", "q_high")
    row = moved.first()
    low = F.col("q_low") + F.lit(row["shift_low"] or 0.0)
    out = scored.withColumns({"q_high": F.greatest(F.col("q_high") + F.lit(row["shift_high"] or 0.0), low), "q_low": low})
    return (nudge(out, actual, "q_low", "q_high", key) if key else out), moved


def folds(df: DataFrame, label: str, key: Sequence[str], n: int = 5, seed: int = SEED) -> DataFrame:
    """`fold` 0 to n - 1, stratified by label; the same rows give the same folds.

    A row's rank by hash within its label, modulo n. Ranks are two-level: inside 1024 hash ranges by window, plus the ranges before,
    so no task orders a whole label.
    """
    own = df.withColumn("__h", F.xxhash64(F.lit(seed), *key)).withColumn("__b", F.shiftrightunsigned("__h", 54))
    before = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # 1024 rows a label
    offset = own.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n")).select(label, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", *key))
    return own.join(F.broadcast(offset), [label, "__b"]).withColumn("fold", F.pmod(F.col("__o") + inside - 1, F.lit(n)).cast("int")).select(*df.columns, "fold")


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], trees: int = 400, n: int = 5) -> DataFrame:
    """Each row's probability by the model that has not seen it. The rows and their folds are written once for the n fits."""
    own = stored(folds(df.where(finite(label)), label, key, n), "folds")
    parts = [predict(fit(classifier(trees), own.where(F.col("fold") != k), features, label), own.where(F.col("fold") == k), features, "oof") for k in range(n)]
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Calibrator:
    """kind: raw, isotonic or platt. Isotonic: steps are joined by lines, ends are flat."""

    kind: str
    bounds: list[float] | None = None
    values: list[float] | None = None
    slope: float = 1.0
    offset: float = 0.0

    def apply(self, p: Column) -> Column:
        """The calibrated probability. The steps are two constant arrays, whatever their number, and a row finds its own by halving."""
        if self.kind == "platt":
            return 1 / (1 + F.exp(-(self.slope * p + self.offset)))
        if self.kind != "isotonic":
            return p
        n = len(self.bounds)
        b, v = (F.from_json(F.lit(json.dumps(x)), "array<double>") for x in (self.bounds, self.values))
        jumps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
        at = F.aggregate(jumps, F.lit(0), lambda lo, k: F.when((lo + k <= n) & (F.get(b, lo + k - 1) < p), lo + k).otherwise(lo))  # bounds below p
        x0, x1, y0, y1 = F.get(b, at - 1), F.get(b, at), F.get(v, at - 1), F.get(v, at)
        line = y0 + (p - x0) * (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0))
        return F.when(p.isNull(), None).when(at == 0, self.values[0]).when(at >= n, self.values[-1]).otherwise(F.coalesce(line, y1))


def calibrate(df: DataFrame, p: str, label: str, kind: str) -> Calibrator:
    """The isotonic learner, which pools on the driver at the end, gets one row a distinct p: its mean label, weighted by its rows."""
    own = df.where(finite(p) & finite(label)).select(F.col(p).cast("double").alias("p"), F.col(label).cast("double").alias("label"))
    if kind == "isotonic":
        rows = histogram(own, "p", {"label": F.avg("label"), "n": F.count(F.lit(1)).cast("double")})
        model = IsotonicRegression(labelCol="label", featuresCol="p", weightCol="n").fit(rows)
        bounds, values = [float(x) for x in model.boundaries], [float(x) for x in model.predictions]
        return Calibrator("isotonic", bounds, values) if bounds else Calibrator("raw")
    n = own.count()
    rows = VectorAssembler(inputCols=["p"], outputCol="features").transform(own)
    model = LogisticRegression(regParam=1 / max(1, n), standardization=False, maxIter=200).fit(rows)
    return Calibrator("platt", slope=float(model.coefficients[0]), offset=float(model.intercept))


def choose_calibrator(oof: DataFrame, holdout: DataFrame, p: str, label: str, few: int = 500, kinds: Sequence[str] = ("isotonic", "platt")) -> tuple[Calibrator, list[dict]]:
    """The first calibrator of ``kinds`` that strictly lowers both losses on the holdout, else none; Platt is tried first with few positives. Also each attempt's losses."""
    positives = oof.where(F.col(label) == 1).count()
    order = sorted(kinds, reverse=positives < few)
    before = log_loss(holdout, label, p).first()
    tried = [{"kind": "raw", "log_loss": before["log_loss"], "brier": before["brier"], "positives": positives}]
    for kind in order:
        own = calibrate(oof, p, label, kind)
        after = log_loss(holdout.withColumn("__p", own.apply(F.col(p))), label, "__p").first()
        tried.append({"kind": kind, "log_loss": after["log_loss"], "brier": after["brier"], "positives": positives})
        if after["log_loss"] < before["log_loss"] and after["brier"] < before["brier"]:
            return own, tried
    return Calibrator("raw"), tried


def stratified_sample(df: DataFrame, n: int, key: Sequence[str], minutes: str = "minutes", points: str = "total_points", seed: int = SEED) -> DataFrame:
    """At most n rows: hauls (points >= 5), other players, and those without minutes, by quotas; without replacement."""
    stratum = F.when((F.col(minutes) > 0) & (F.col(points) >= 5), "haul").when(F.col(minutes) > 0, "played").otherwise("blank")
    haul = max(min(64, n), n // 5)
    quota = {"haul": haul, "played": max(0, min(n // 2, n - haul)), "blank": max(0, n - haul - n // 2)}
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    own = df.withColumn("stratum", stratum)
    parts = [own.where(F.col("stratum") == s).orderBy(h, *key).limit(q) for s, q in quota.items()]  # a top-k each: no window over a stratum
    return reduce(DataFrame.unionByName, parts)


def importances(model: PipelineModel, features: Sequence[str], spark, top: int | None = None) -> DataFrame:
    """Gain of each feature, its missing flag's added."""
    gains = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(gains[i] + gains[i + len(features)])) for i, c in enumerate(features)]
    out = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out


def last_five(df: DataFrame, out: str = "baseline_last5") -> DataFrame:
    return df.withColumn(out, F.col("total_points_r5"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_calibrator(found: Calibrator, spark, path: str) -> None:
    """The calibrator as a one-row table; a raw one overwrites what was kept before."""
    spark.createDataFrame([(found.kind, found.bounds, found.values, found.slope, found.offset)], "kind string, bounds array<double>, values array<double>, slope double, offset double").write.mode("overwrite").parquet(path)


def load_calibrator(spark, path: str) -> Calibrator:
    return Calibrator(**spark.read.parquet(path).first().asDict())


def refit_quantiles(stored_rows: DataFrame, rows: DataFrame, train: DataFrame, features: Sequence[str], label: str, key: Sequence[str], quantile=leaf_quantiles) -> DataFrame:
    """Stored validation rows with fresh quantiles of ``rows``, the panel's; nothing else of them changes.

    The two must be aligned, or nothing is made: keys are unique on both sides, and every key of one side is one of the other's.
    """
    enforce([duplicate_keys(stored_rows, key, "stored key repeats"), duplicate_keys(rows, key, "panel key repeats"), unmatched(stored_rows, rows, key, "stored row has no panel row"), unmatched(rows, stored_rows, key, "panel row was not stored")])
    new = quantile(train, rows.select(*key, *[c for c in features if c not in key]), features, label).select(*key, "q_low", "q_high")
    return stored_rows.drop("q_low", "q_high").join(new, list(key))


def attach_quantiles(board: DataFrame, quantiles: DataFrame, key: str = "id") -> DataFrame:
    """An existing board with quantile columns by id; without them it stays as it is."""
    if not {"q_low", "q_high"} <= set(quantiles.columns):
        return board
    return board.join(quantiles.select(key, "q_low", "q_high"), key, "left")


def lifted_quantiles(board: DataFrame, live: DataFrame, shift_low: float, shift_high: float, key: str = "id") -> DataFrame:
    """An existing board with fresh interval columns, its heads kept.

    ``live`` has, by key, the raw quantiles q_low and q_high, the minutes head and what tells a regular starter; lift and availability are
    computed again from them, and the upper score from the board's own minutes and label. Without quantiles the board stays as it is.
    """
    if not {"q_low", "q_high"} <= set(live.columns):
        return board
    c, raw = F.col, clip("head_minutes", 0.0, 90.0)
    lift = minutes_lift(blended_minutes(raw, c("status"), c("prior_starts"), c("prior_games"), c("starts_l1"), c("prior_minutes_pg")), raw)
    told = live.select(key, "q_low", "q_high", lift.alias("__lift"), availability("status", "chance").alias("__scale"))
    made = interval_columns(c("q_low"), c("q_high"), shift_low, shift_high, c("__lift"), c("__scale"), c("pred_minutes"), c("pred_defcon"))
    return board.drop(*made).join(told, key, "left").withColumns(made).drop("q_low", "q_high", "__lift", "__scale")


def recalibrate(stored: DataFrame, found: Calibrator, p: str = "pred_defcon", scale: str = "scale") -> DataFrame:
    """Stored forecasts through another calibrator, without refitting a head."""
    s = F.col(scale)
    return stored.withColumn(p, F.when((F.col("position") == "GK") | (s == 0), 0.0).otherwise(found.apply(F.col(p) / F.nullif(s, F.lit(0.0))) * s))
