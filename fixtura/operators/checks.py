"""Fail-closed checks. A rule is a DataFrame of violations (rule, key, detail); `enforce` runs many as one job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.functions.scalars import finite, number


class CheckFailed(ValueError):
    """Violations were found; the message holds each rule's count and first keys."""


def _said(df: DataFrame, rule: str, key: Sequence[str], detail: Column | str = "") -> DataFrame:
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in key]) if key else F.lit("")
    return df.select(F.lit(rule).alias("rule"), text.alias("key"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def violations(rules: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def enforce(rules: Iterable[DataFrame], keys: int = 3) -> None:
    """Raise CheckFailed unless no rule has a violation. Only counts and the first keys reach the driver."""
    found = violations(rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "detail")).alias("a"), F.max(F.struct("key", "detail")).alias("b"))
    rows = found.orderBy("rule").collect()  # one row a rule
    if rows:
        raise CheckFailed("; ".join(f"{r['rule']}: {r['n']} ({', '.join(dict.fromkeys(f'{x.key} {x.detail}'.strip() for x in (r['a'], r['b'])[: keys]))})" for r in rows))


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise CheckFailed(f"{what} is missing required columns: {', '.join(missing)}")


def require_rows(df: DataFrame, what: str) -> None:
    if df.limit(1).count() == 0:
        raise CheckFailed(f"{what} is empty")


def forbid_columns(columns: Sequence[str], banned: Sequence[str]) -> None:
    """Features must not hold outcomes of their own event."""
    if bad := sorted(set(columns) & set(banned)):
        raise CheckFailed(f"banned columns in features: {', '.join(bad)}")


def duplicate_keys(df: DataFrame, key: Sequence[str], rule: str = "a key occurs more than once") -> DataFrame:
    return _said(df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), rule, key, F.col("n"))


def many_to_one(build: DataFrame, key: Sequence[str], rule: str = "join is not many-to-one") -> DataFrame:
    """The build side of a join must hold each key once."""
    return duplicate_keys(build, key, rule)


def unmatched(left: DataFrame, right: DataFrame, key: Sequence[str], rule: str = "a key has no partner") -> DataFrame:
    """Rows of the left side whose key the right side lacks; NULLs match each other."""
    own = right.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    return _said(left.join(own, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]), "left_anti"), rule, key)


def conflicting_duplicates(df: DataFrame, key: Sequence[str], rule: str = "rows of one key differ") -> DataFrame:
    """Keys with rows that differ anywhere; NULLs equal each other, and so do NaNs. Only a hash of each row is shuffled."""
    rest = [c for c in df.columns if c not in key]
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in rest]), {"ignoreNullFields": "false"})) if rest else F.lit(0)
    return _said(df.groupBy(*key).agg(F.count_distinct(whole).alias("n")).where("n > 1"), rule, key, F.col("n"))


def drop_exact_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each key, once conflicts are excluded."""
    return df.dropDuplicates(list(key))


def divergent_lags(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ("season", "GW", "player_code"), rule: str = "rows of one event carry different lags") -> DataFrame:
    """Events whose rows differ in a lag; NULL counts as a value."""
    kinds = [F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")) for c in columns]
    return _said(df.groupBy(*key).agg(F.greatest(*kinds, F.lit(0)).alias("n")).where("n > 1"), rule, key, F.col("n"))


def after_cutoff(df: DataFrame, observed: str, cutoff: Column, key: Sequence[str], rule: str = "observed later than allowed") -> DataFrame:
    """Rows observed after the cutoff, or at no known time."""
    return _said(df.where(F.coalesce(F.col(observed) > cutoff, F.lit(True))), rule, key, F.col(observed))


def bad_actuals(frozen: DataFrame, actuals: DataFrame, key: Sequence[str], points: str = "points") -> list[DataFrame]:
    """Duplicates, missing ones, those that are no numbers, and points of players who did not play."""
    number_ = number(points)
    return [
        duplicate_keys(actuals, key, "duplicate actuals"),
        _said(frozen.join(actuals, list(key), "left_anti"), "missing actuals", key),
        _said(actuals.where(~finite(number_)), "non-numeric actuals", key, F.col(points)),
        _said(actuals.where((F.coalesce(F.col("played").cast("int"), F.lit(0)) == 0) & (number_ != 0)), "did-not-play actual must be 0", key, F.col(points)),
    ]


def bad_snapshot(frozen: DataFrame, positions: Sequence[str], season: str = "season", week: str = "week", player: str = "player_id") -> list[DataFrame]:
    """One season and week, allowed positions, unique players."""
    spread = frozen.agg(F.count_distinct(season).alias("s"), F.count_distinct(week).alias("w"), F.count(F.lit(1)).alias("n"))
    return [
        _said(spread.where("s <> 1 or w <> 1"), "snapshot must hold one season and week", [], F.concat_ws("/", "s", "w")),
        _said(frozen.where(~F.coalesce(F.col("position").isin(*positions), F.lit(False))), "position is not allowed", [player], F.col("position")),
        duplicate_keys(frozen, [player], "duplicate candidates"),
    ]


def bad_history(history: DataFrame, season: Column, week: Column, points: str = "points") -> list[DataFrame]:
    """History of the frozen season only, before its week, with finite points."""
    key = ["season", "week", "player_id"]
    return [
        _said(history.where(~F.coalesce(F.col("season") == season, F.lit(False))), "history of another season", key),
        _said(history.where(~F.coalesce(F.col("week") < week, F.lit(False))), "history reaches the frozen week or beyond", key),
        _said(history.where(~finite(number(points))), "history points are not finite", key, F.col(points)),
    ]


def bad_names(left: DataFrame, right: DataFrame, name: str, value: str, places: int = 3) -> list[DataFrame]:
    """Names without a partner, and partners whose values differ after rounding."""
    own = right.groupBy(name).agg(F.min(value).alias("__value"))
    both = left.join(own, name)
    return [_said(left.join(own, name, "left_anti"), "name has no match", [name]), _said(both.where(F.round(F.col(value) - F.col("__value"), places) != 0), "value differs", [name], F.col("__value"))]


def bad_capture(manifest: DataFrame, as_of: Column, season: str, sources: dict[str, str], hours: int = 24, version: int = 1) -> list[DataFrame]:
    """Version, season and sources; captured before as_of, at most ``hours`` before, in a year of the season."""
    captured = F.col("captured")
    years = [int(season[:4]), int(season[:4]) + 1]
    rules = {
        "unsupported snapshot version": F.col("format_version") == version,
        "snapshot season differs": F.col("season") == season,
        "snapshot captured after as_of": captured <= as_of,
        "snapshot is too old": captured >= as_of - F.expr(f"interval {hours} hours"),
        "snapshot year is outside its season": F.year(captured).isin(*years),
    } | {f"{c} is not the expected source": F.col(c) == v for c, v in sources.items()}
    return [_said(manifest.where(~F.coalesce(good, F.lit(False))), rule, ["season"]) for rule, good in rules.items()]


def bad_hashes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (name, sha256) against files (name, sha256): missing or different content."""
    own = files.select("name", F.col("sha256").alias("__sha"))
    return _said(manifest.join(own, "name", "left").where(~F.coalesce(F.col("sha256") == F.col("__sha"), F.lit(False))), "file hash differs", ["name"])


def bad_coverage(covered: DataFrame, elements: DataFrame, manifest_counts: DataFrame | None = None, rows: DataFrame | None = None) -> list[DataFrame]:
    """Covered ids (element) are the registry's, each once; stable codes are unique; counts by element agree with the rows."""
    out = [
        duplicate_keys(covered, ["element"], "element is covered twice"),
        _said(covered.join(elements, "element", "left_anti"), "covered element is unknown", ["element"]),
        _said(elements.join(covered, "element", "left_anti"), "element is not covered", ["element"]),
        duplicate_keys(elements.where(F.col("code").isNotNull()), ["code"], "stable code is not unique"),
    ]
    if manifest_counts is not None and rows is not None:
        own = rows.groupBy("element").agg(F.count(F.lit(1)).alias("__n"))
        out.append(_said(manifest_counts.join(own, "element", "full").where(F.coalesce("n", F.lit(0)) != F.coalesce("__n", F.lit(0))), "history row count differs", ["element"]))
    return out


def bad_alignment(rows: DataFrame) -> list[DataFrame]:
    """History rows joined with their fixture (`fx_`) and element (`el_`): keys, codes, position, event and kickoff agree."""
    key = ["element", "fixture"]
    rules = {
        "history key is not an integer": F.col("element").try_cast("int").isNotNull() & F.col("fixture").try_cast("int").isNotNull(),
        "unknown element": F.col("el_id").isNotNull(),
        "unknown fixture": F.col("fx_id").isNotNull(),
        "event differs from fixture": F.col("round").eqNullSafe(F.col("fx_event")) | F.col("fx_id").isNull(),
        "kickoff differs from fixture": F.col("kickoff_time").eqNullSafe(F.col("fx_kickoff_time")) | F.col("fx_id").isNull(),
    }
    if "player_code" in rows.columns:
        rules["code differs from element"] = F.col("player_code").cast("string").eqNullSafe(F.col("el_code").cast("string")) | F.col("el_id").isNull()
    if "position" in rows.columns:
        rules["position differs from element"] = F.col("position").eqNullSafe(F.col("el_position")) | F.col("el_id").isNull()
    return [_said(rows.where(~F.coalesce(good, F.lit(False))), rule, key) for rule, good in rules.items()]


def bad_fields(df: DataFrame, required: Sequence[str], exempt_for_keepers: Sequence[str] = (), key: Sequence[str] = ("element",)) -> DataFrame:
    """Required scoring fields are present and finite (some not asked of keepers): one row for each field with bad rows."""
    bad = [F.count_if(~finite(c) & (F.upper("position") != "GK" if c in exempt_for_keepers else F.lit(True))).alias(c) for c in required]
    counts = df.agg(*bad)
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in required])).alias("x")).select("x.field", "x.n").where("n > 0")
    return _said(long, "required field is missing or not finite", ["field"], F.col("n"))


def bad_totals(elements: DataFrame, history: DataFrame, columns: Sequence[str] = ("minutes", "starts", "total_points")) -> DataFrame:
    """Elements whose history does not add up to the snapshot's totals; those without rows count as zeros."""
    own = history.groupBy("element").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    both = elements.join(own, "element", "left")
    differs = [F.coalesce(F.col(c), F.lit(0)) != F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in columns]
    return _said(both.where(reduce(lambda a, b: a | b, differs)), "cumulative totals differ", ["element"])


def late_as_of(events: DataFrame, event: int, as_of: Column) -> DataFrame:
    """as_of must lie strictly before the event's deadline."""
    return _said(events.where((F.col("id") == event) & ~F.coalesce(as_of < F.col("deadline_time"), F.lit(False))), "as_of is not before the deadline", ["id"], F.col("deadline_time"))


def bad_prior(panel: DataFrame, season: str, cutoff: Column) -> list[DataFrame]:
    """The prior season is there, with kickoffs known and before the cutoff."""
    own = panel.where(F.col("season") == season)
    return [
        _said(own.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "prior season is absent", []),
        _said(own.where(F.col("kickoff_time").isNull()), "prior kickoff is unknown", ["player_code", "fixture"]),
        _said(own.where(F.col("kickoff_time") >= cutoff), "prior kickoff is not before the cutoff", ["player_code", "fixture"]),
    ]


def live_board_gaps(sides: DataFrame, teams: DataFrame) -> list[DataFrame]:
    """Teams with two fixtures in the event, and teams without any."""
    twice = sides.groupBy("team", "event").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return [_said(twice, "double live fixture", ["team", "event"]), _said(teams.select(F.col("id").alias("team")).join(sides, "team", "left_anti"), "team has no fixture", ["team"])]


def squad_legality(squads: DataFrame, budget: int = 1000, size: int = 15, club_cap: int = 3, wants: tuple[tuple[str, int], ...] = (("GK", 2), ("DEF", 5), ("MID", 5), ("FWD", 3))) -> DataFrame:
    """Squads (squad_id, position, club, cost, is_xi) that break size, positions, budget, club cap, XI size or its one keeper."""
    clubs = squads.groupBy("squad_id", "club").agg(F.count(F.lit(1)).alias("n")).groupBy("squad_id").agg(F.max("n").alias("club_max"))
    own = squads.groupBy("squad_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), *[F.count_if(F.col("position") == p).alias(p) for p, _ in wants], F.count_if("is_xi").alias("xi"), F.count_if(F.col("is_xi") & (F.col("position") == "GK")).alias("xi_gk"))
    rules = {"size": F.col("n") == size, "budget": F.col("cost") <= budget, "club cap": F.col("club_max") <= club_cap, "XI size": F.col("xi") == 11, "XI keepers": F.col("xi_gk") == 1} | {f"count of {p}": F.col(p) == n for p, n in wants}
    both = own.join(clubs, "squad_id")
    long = both.select("squad_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), ok.alias("ok")) for r, ok in rules.items()])).alias("x")).where(~F.coalesce(F.col("x.ok"), F.lit(False)))
    return _said(long, "illegal squad", ["squad_id"], F.col("x.rule"))


def plan_sanity(plans: DataFrame) -> DataFrame:
    """Plans (plan_id, squad, xi, bench, sold, bought: arrays; captain, vice, bank) that contradict themselves."""
    rules = {
        "squad size": F.size(F.array_distinct("squad")) == 15,
        "XI size": F.size(F.array_distinct("xi")) == 11,
        "bank": F.col("bank") >= 0,
        "captain in XI": F.array_contains("xi", F.col("captain")),
        "vice is another starter": F.array_contains("xi", F.col("vice")) & (F.col("vice") != F.col("captain")),
        "transfers balance": F.size("sold") == F.size("bought"),
        "bench is the rest": (F.size(F.array_except(F.array_except("squad", "xi"), "bench")) == 0) & (F.size(F.array_except("bench", F.array_except("squad", "xi"))) == 0),
    }
    long = plans.select("plan_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), ok.alias("ok")) for r, ok in rules.items()])).alias("x")).where(~F.coalesce(F.col("x.ok"), F.lit(False)))
    return _said(long, "insane plan", ["plan_id"], F.col("x.rule"))


# Names and marks that must not be published.
PRIVATE_NAMES = ("entry_id", "email", "password", "token", "cookie", "session", "bank_account", "api_key", "authorization")
CREDENTIAL_MARK = r"(?i)(bearer\s+[a-z0-9._-]{16,}|-----begin [a-z ]*private key-----|\bAKIA[0-9A-Z]{16}\b|password\s*[=:]|token\s*[=:])"


def public_record(records: DataFrame, key: Sequence[str], board: DataFrame | None = None) -> list[DataFrame]:
    """Published records: no private names, no credentials, known statuses; row count and event agree with the board."""
    if bad := [c for c in records.columns if c.lower() in PRIVATE_NAMES]:
        raise CheckFailed(f"private columns in a public record: {', '.join(bad)}")
    texts = [f.name for f in records.schema.fields if isinstance(f.dataType, T.StringType)]
    out = [_said(records.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(CREDENTIAL_MARK), F.lit(False)) for c in texts])), "credential in a public record", key)] if texts else []
    if "status" in records.columns:
        out.append(_said(records.where(~F.coalesce(F.col("status").isin("final", "review", "live", "pending"), F.lit(False))), "status is not explicit", key, F.col("status")))
    if board is not None and "forecast_rows" in records.columns:
        told = board.agg(F.count(F.lit(1)).alias("__n"), F.count_distinct("event").alias("__events"), F.max("event").alias("__event"))
        both = records.crossJoin(F.broadcast(told))  # one row on the right
        out.append(_said(both.where((F.col("forecast_rows") != F.col("__n")) | (F.col("__events") != 1) | (F.col("event") != F.col("__event"))), "record and board differ", key))
    return out


def score_inputs(df: DataFrame, forecast: str, actual: str, baseline: str) -> None:
    """Score only the column asked for: another forecast column never stands in."""
    require_columns(df, [forecast, actual, baseline], "score input")


def unique_names(saved: DataFrame, registry: DataFrame, name: str = "name", registry_name: str = "web_name") -> tuple[DataFrame, list[DataFrame]]:
    """Saved names with their one element, ignoring case, and violations for absent and ambiguous names."""
    own = registry.withColumn("__key", F.lower(registry_name))
    both = saved.withColumn("__key", F.lower(name)).join(own, "__key", "left")
    n = F.count("id").over(Window.partitionBy("__key", name))
    told = both.withColumn("__n", n)
    return told.where("__n = 1").drop("__key", "__n"), [_said(told.where("__n = 0"), "name is unknown", [name]), _said(told.where("__n > 1").select(name).distinct(), "name is ambiguous", [name])]
