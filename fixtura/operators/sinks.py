"""Tables that outlive a run: keyed, idempotent, frozen after their deadline, and checkable by content."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.operators.checks import CheckFailed, duplicate_keys, enforce, require_columns
from fixtura.sources.snapshots import file_hashes

# The splits and their seasons.
SPLITS = {"train": ("2021-22", "2022-23", "2023-24", "2024-25"), "validation": ("2025-26",)}


class Conflict(RuntimeError):
    """Another writer has committed the same version first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Committed versions of a kept table, the newest last: number and data folder."""
    fs, log = _fs(spark, f"{path}/_log")
    if not fs.exists(log):
        return []
    numbered = [s.getPath() for s in fs.listStatus(log) if s.getPath().getName().isdigit()]
    return sorted((int(p.getName()), fs.listStatus(p)[0].getPath().getName()) for p in numbered)


def commit(spark: SparkSession, path: str, folder: str, after: int) -> None:
    """Make a finished data folder version ``after`` + 1, by one rename onto that number, which never replaces what is there.

    Until then readers see the old version, from then on the new one; data folders are never changed. A second writer of the same number gets Conflict.
    """
    fs, log = _fs(spark, f"{path}/_log")
    hadoop = spark._jvm.org.apache.hadoop.fs
    made = hadoop.Path(log, f"_{uuid.uuid4().hex}")
    fs.create(hadoop.Path(made, folder), False).close()
    context = hadoop.FileContext.getFileContext(log.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(made, hadoop.Path(log, f"{after + 1:012d}"), plain)
    except Py4JJavaError as e:
        fs.delete(made, True)
        raise Conflict(f"version {after + 1} of {path} is taken") from e


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version of a kept table."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no committed version")
    return spark.read.parquet(f"{path}/{found[-1][1]}")


def replace(df: DataFrame, path: str, after: int | None = None) -> None:
    """Write ``df`` as the next version. ``after``: the version that it was made from; with a newer one there, Conflict. A crash leaves the old version."""
    spark = df.sparkSession
    found = versions(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    commit(spark, path, folder, (found[-1][0] if found else 0) if after is None else after)


def cleaned(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the data of all but the newest ``keep`` versions; readers of these must have ended. The folders that went."""
    old = versions(spark, path)[:-keep]
    for n, folder in old:
        for name in (f"{path}/_log/{n:012d}", f"{path}/{folder}"):
            fs, p = _fs(spark, name)
            fs.delete(p, True)
    return [f for _, f in old]


def write_panel(panel: DataFrame, path: str, features: Sequence[str]) -> None:
    """The panel by season, and the feature names as a table beside it."""
    panel.write.mode("overwrite").partitionBy("season").parquet(f"{path}/panel")
    panel.sparkSession.createDataFrame([(i, f) for i, f in enumerate(features)], "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, hash_xor, hash_sum): the same for the same rows in any order and partitioning."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"), F.coalesce(F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.lit(0)).alias("hash_sum"))


def export_splits(panel: DataFrame, path: str, splits: dict[str, Sequence[str]] = SPLITS, n_features: int = 0, version: int = 1) -> DataFrame:
    """One Parquet folder a split, and a manifest of rows, columns, content hashes and feature count."""
    spark, rows = panel.sparkSession, []
    for split, names in splits.items():
        panel.where(F.col("season").isin(*names)).write.mode("overwrite").parquet(f"{path}/{split}")
        kept = spark.read.parquet(f"{path}/{split}")
        h = content_hash(kept).first()
        rows.append((version, split, kept.columns, h["rows"], h["hash_xor"], h["hash_sum"], n_features, list(names)))
    manifest = spark.createDataFrame(rows, "version int, split string, columns array<string>, rows long, hash_xor long, hash_sum long, n_features int, seasons array<string>")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


def read_export(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """The splits of an export that agree with their manifest (version, columns in order, rows, content, seasons, no overlap), joined."""
    out, seen = None, set()
    for m in spark.read.parquet(f"{path}/manifest").orderBy("split").collect():  # one row a split
        own = spark.read.parquet(f"{path}/{m['split']}")
        h = content_hash(own).first()
        if m["version"] != version:
            raise CheckFailed(f"unsupported export version {m['version']}")
        if own.columns != m["columns"]:
            raise CheckFailed(f"columns of {m['split']} differ from the manifest")
        if (h["rows"], h["hash_xor"], h["hash_sum"]) != (m["rows"], m["hash_xor"], m["hash_sum"]):
            raise CheckFailed(f"content of {m['split']} differs from the manifest")
        if own.where(~F.coalesce(F.col("season").isin(*m["seasons"]), F.lit(False))).limit(1).count() or seen & set(m["seasons"]):
            raise CheckFailed(f"split {m['split']} holds seasons of another")
        seen |= set(m["seasons"])
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise CheckFailed("the export has no split")
    enforce([duplicate_keys(out, ["season", "GW", "player_code", "fixture"])])
    return out


def board_path(path: str, season: str, gw: int) -> str:
    return f"{path}/season={season}/gw={gw}"


def write_board(board: DataFrame, path: str, season: str, gw: int, deadline, now) -> bool:
    """Write one event's board, a kept table of its own, unless it exists and its deadline has passed; whether it was written."""
    own = board_path(path, season, gw)
    found = versions(board.sparkSession, own)
    if found and deadline is not None and deadline <= now:
        return False
    replace(board.drop("season", "gw"), own, found[-1][0] if found else 0)
    return True


def write_predictions(df: DataFrame, path: str, columns: Sequence[str], key: Sequence[str] = ("season", "GW", "player_code", "fixture")) -> None:
    """Validation predictions in a fixed order of columns; keys are required and unique."""
    require_columns(df, [*key, *columns], "predictions")
    enforce([duplicate_keys(df, key)])
    df.select(*columns).write.mode("overwrite").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str] = ("season", "gw")) -> DataFrame:
    """The old rows but those of the new keys, and the new ones, in the order of the keys. Doing it again changes nothing."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new).orderBy(*key)


def upsert(new: DataFrame, path: str, key: Sequence[str] = ("season", "gw"), tries: int = 5) -> None:
    """The same on a kept table. If another writer commits meanwhile, it is done again on that writer's version, so no update is lost."""
    spark = new.sparkSession
    for k in range(tries):
        found = versions(spark, path)
        try:
            replace(upserted(read_table(spark, path), new, key) if found else new.orderBy(*key), path, found[-1][0] if found else 0)
            return
        except Conflict:
            if k == tries - 1:
                raise


def canonical(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    """Fixed columns, numbers as text of six decimals."""
    kinds = dict(df.dtypes)
    return df.select(*[F.format_string(f"%.{places}f", F.col(c).cast("double")).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c) for c in columns])


def canonical_hash(df: DataFrame, columns: Sequence[str], order: Sequence[str], part_rows: int = 10_000, places: int = 6) -> DataFrame:
    """SHA-256 of the canonical rows in levels: (rows, sha256).

    Rows are dealt into parts of about ``part_rows`` by a hash of key and line, ordered by key inside their part and hashed; then the hashes of each
    ``part_rows`` neighbouring parts are, in their order, and so on. The same rows give the same hash in any partitioning, and no task
    gathers more than about ``part_rows`` lines (three levels of parts: up to ``part_rows`` to the fourth rows).
    """
    text = canonical(df, [*dict.fromkeys([*order, *columns])], places)
    line = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in columns]), 256)
    parts = F.broadcast(df.agg((F.floor(F.count(F.lit(1)) / part_rows) + 1).alias("parts")))  # one row
    dealt = text.select(F.struct(*order).alias("k"), line.alias("h"), F.xxhash64(*order, line).alias("at")).crossJoin(parts).withColumn("part", F.pmod("at", "parts"))
    together = lambda k: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "h"))), lambda x: x["h"]), "\n"), 256).alias("h")
    hashed = dealt.groupBy("part").agg(together("k"), F.count(F.lit(1)).alias("n"))
    for _ in range(2):
        hashed = hashed.withColumn("above", F.floor(F.col("part") / part_rows)).groupBy("above").agg(together("part"), F.sum("n").alias("n")).withColumnRenamed("above", "part")
    return hashed.agg(together("part"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select("rows", F.col("h").alias("sha256"))


def evidence_manifest(spark: SparkSession, inputs: Sequence[str], artifacts: dict[str, DataFrame], policy: str) -> DataFrame:
    """Hashes of input files, and rows and hashes of artifacts, under a stated policy."""
    out = file_hashes(spark, list(inputs)).select(F.lit("input").alias("kind"), "name", F.col("bytes").alias("rows"), F.col("sha256").alias("hash"))
    for name, df in artifacts.items():
        out = out.unionByName(content_hash(df).select(F.lit("artifact").alias("kind"), F.lit(name).alias("name"), "rows", F.concat_ws(":", F.col("hash_xor").cast("string"), F.col("hash_sum").cast("string")).alias("hash")))
    return out.withColumn("policy", F.lit(policy))
