"""Scalar expressions. Missing is NULL; text that is no number becomes NULL, never an error."""

from __future__ import annotations

import unicodedata

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label thresholds, unavailable status codes, position codes, keeper codes of opponent statistics.
DEFENDER_HITS, OUTFIELD_HITS = 10, 12
UNAVAILABLE = ("i", "s", "u", "n")
POSITIONS = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}
KEEPERS = ("GK", "GKP")
# Projected minutes and the share of players who then play.
PLAY_KNOTS = ((0.0, 0.0), (10.0, 0.28), (22.0, 0.53), (38.0, 0.73), (52.0, 0.84), (65.0, 0.88), (75.0, 0.93), (82.0, 0.94), (88.0, 0.97))
# Points for one unit of each statistic.
PPR_WEIGHTS = {"passing_yards": 1 / 25, "passing_tds": 4.0, "interceptions": -2.0, "rushing_yards": 1 / 10, "rushing_tds": 6.0, "receptions": 1.0, "receiving_yards": 1 / 10, "receiving_tds": 6.0, "fumbles_lost": -2.0}
#: Letters of the Latin blocks, and of the ligatures, whose compatibility decomposition has a plain form.
_PLAIN = {c: p for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]) if (p := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode())}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Text or number as a double; what can't be read, and NaN, is NULL."""
    d = col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def finite(c: Column | str) -> Column:
    """True where a value is present and neither NaN nor infinite."""
    c = col(c)
    return F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))


def clip(c: Column | str, low: float, high: float) -> Column:
    """NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns as numbers; `GW` and `round` fill each other where one is absent or empty."""
    df = df.withColumns({c: number(c) for c in columns if c in df.columns})
    if "GW" in df.columns and "round" in df.columns:
        return df.withColumns({"GW": F.coalesce("GW", "round"), "round": F.coalesce("round", "GW")})
    if "round" in df.columns:
        return df.withColumn("GW", F.col("round"))
    return df.withColumn("round", F.col("GW")) if "GW" in df.columns else df


def label_count(position: Column | str, actions: Column | str, recoveries: Column | str) -> Column:
    """Defensive actions that count: midfielders' and forwards' include recoveries; keepers have none."""
    p, a = F.upper(col(position)), col(actions).cast("double")
    return F.when(p == "GK", None).when(p.isin("MID", "FWD"), a + F.coalesce(col(recoveries).cast("double"), F.lit(0.0))).otherwise(a)


def label_hit(position: Column | str, count: Column | str) -> Column:
    """1.0 if the count reaches the position's threshold; 0.0 for keepers; NULL for unknown counts and positions."""
    p, c = F.upper(col(position)), col(count)
    return F.when(p == "GK", 0.0).when(p == "DEF", (c >= DEFENDER_HITS).cast("double")).when(p.isin("MID", "FWD"), (c >= OUTFIELD_HITS).cast("double"))


def played(minutes: Column | str) -> Column:
    return F.coalesce(col(minutes), F.lit(0)) > 0


def fixture_difficulty(was_home: Column | str, home: Column | str, away: Column | str, home_uses: str = "away") -> Column:
    """The panel's rule takes the other side's column (`home_uses='away'`), the live board's its own (`'home'`)."""
    a, b = (away, home) if home_uses == "away" else (home, away)
    return F.when(col(was_home), col(a)).otherwise(col(b))


def gated(points: Column | str, minutes: Column | str) -> Column:
    """Points in proportion to the minutes expected."""
    return col(points) * clip(col(minutes) / 90.0, 0.0, 1.0)


def availability(status: Column | str, chance: Column | str) -> Column:
    """Share of the forecast that stands: the chance to play; none if out by status without a chance."""
    c = F.coalesce(col(chance).cast("double"), F.lit(100.0))
    out = col(status).isin(*UNAVAILABLE) & (F.coalesce(col(chance).cast("double"), F.lit(0.0)) == 0)
    return F.when(F.coalesce(out, F.lit(False)), 0.0).otherwise(clip(c / 100.0, 0.0, 1.0))


def eligible(status: Column | str, chance: Column | str) -> Column:
    return F.coalesce(col(status) == "a", F.lit(False)) | ~col(chance).eqNullSafe(F.lit(0))


def flagged(status: Column | str, chance: Column | str) -> Column:
    return F.coalesce(col(status).isin(*UNAVAILABLE), F.lit(False)) | F.coalesce(col(chance) < 75, F.lit(False))


def interpolate(x: Column | str, knots: tuple[tuple[float, float], ...]) -> Column:
    """Piecewise-linear through the knots, ends clamped, without a join."""
    x = col(x)
    out = F.when(x <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(knots[-1][1]))


def play_probability(minutes: Column | str, chance: Column | str, knots: tuple[tuple[float, float], ...] = PLAY_KNOTS) -> Column:
    """Chance of playing from projected minutes, at most the published chance; below 0.05 none."""
    p = F.least(interpolate(F.coalesce(col(minutes), F.lit(0.0)), knots), F.coalesce(col(chance) / 100.0, F.lit(1.0)))
    return F.when(p < 0.05, 0.0).otherwise(p)


def blended_minutes(raw: Column, status: Column, prior_starts: Column, prior_games: Column, starts_l1: Column, prior_minutes: Column) -> Column:
    """Regular starters are lifted to their usual minutes."""
    raw = clip(raw, 0.0, 90.0)
    regular = (status == "a") & (prior_starts / F.nullif(prior_games, F.lit(0)) >= 0.6) & (starts_l1 >= 0.5) & (prior_minutes >= 60)
    return F.when(F.coalesce(regular, F.lit(False)), F.greatest(raw, F.least(prior_minutes, F.lit(90.0)))).otherwise(raw)


def minutes_lift(blended: Column, raw: Column) -> Column:
    return F.coalesce(clip(blended / F.nullif(raw, F.lit(0.0)), 0.5, 2.0), F.lit(1.0))


def published(points: Column, minutes: Column, hit: Column, scale: Column, position: Column) -> dict[str, Column]:
    """The board's columns: heads scaled by availability, keepers without a label, the final score with two points a hit."""
    m, p = minutes * scale, points * scale
    h = F.when(position == "GK", 0.0).otherwise(hit * scale)
    d = gated(p, m)
    return {"pred_minutes": m, "pred_points": p, "pred_defcon": h, "pred_points_decomposed": d, "e_points_final": d + 2 * h}


def interval_columns(low: Column, high: Column, shift_low: float, shift_high: float, lift: Column, scale: Column, minutes: Column, hit: Column) -> dict[str, Column]:
    """Shifted quantiles with low <= high, lifted and scaled, and the upper score."""
    a = low + shift_low
    b = F.greatest(high + shift_high, a)
    a, b = a * lift * scale, b * lift * scale
    return {"pred_points_p10": a, "pred_points_p90": b, "e_points_p90": gated(b, minutes) + 2 * F.coalesce(hit, F.lit(0.0))}


def weighted_points(weights: dict[str, float] = PPR_WEIGHTS) -> Column:
    """Weighted sum, NULL if any statistic is; six decimals, halves to even."""
    return F.bround(reduce(lambda a, b: a + b, [F.col(c).cast("double") * w for c, w in weights.items()]), 6)


def utc(text: Column | str) -> Column:
    """A timestamp of text that carries Z or an offset; anything else is NULL."""
    t = col(text)
    return F.when(t.rlike(r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(t))


def previous_season(season: Column | str) -> Column:
    """`2024-25` gives `2023-24`; NULL unless the two years follow each other."""
    s = col(season)
    y = F.substring(s, 1, 4).try_cast("int")
    good = s.rlike(r"^[0-9]{4}-[0-9]{2}$") & (F.substring(s, 6, 2).try_cast("int") == F.pmod(y + 1, F.lit(100)))
    return F.when(good, F.format_string("%04d-%02d", y - 1, F.pmod(y, F.lit(100))))


def clip_probability(p: Column | str) -> Column:
    return clip(p, 1e-6, 1 - 1e-6)


def zero_filled(df: DataFrame, features: list[str]) -> DataFrame:
    """Scoring features: absent ones are 0.0, empty ones 0; so are all `prior_` columns."""
    have = set(df.columns)
    df = df.withColumns({c: F.lit(0.0) for c in features if c not in have})
    fill = [c for c, t in df.dtypes if (c in features or c.startswith("prior_")) and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return df.na.fill(0, subset=fill) if fill else df


def feature_names(df: DataFrame, banned: set[str], static: set[str], suffixes: tuple[str, ...] = ("_l1", "_r3", "_r5")) -> list[str]:
    """Numeric columns that are allowed: not banned, and static or a lag by suffix; sorted."""
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in banned and (f.name in static or f.name.endswith(suffixes)))


def position_name(code: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv])
    return F.try_element_at(names, col(code).cast("int"))


def event_status(finished: Column | str, checked: Column | str, current: Column | str) -> Column:
    """final, review or live; NULL for events that have not begun."""
    f = F.coalesce(col(finished), F.lit(False))
    return F.when(f & F.coalesce(col(checked), F.lit(False)), "final").when(f, "review").when(F.coalesce(col(current), F.lit(False)), "live")


def verification(finished: Column | str, checked: Column | str) -> Column:
    return F.when(F.coalesce(col(finished) & col(checked), F.lit(False)), "verified").otherwise("provisional")


def rescaled(calibrated: Column, scale: Column, position: Column) -> Column:
    """A calibrated probability times availability; keepers and players without any have none."""
    return F.when((position == "GK") | (scale == 0), 0.0).otherwise(calibrated * scale)


def unscaled(p: Column, scale: Column) -> Column:
    """What goes into the calibrator: the probability before availability."""
    return p / F.nullif(scale, F.lit(0.0))


def slug(name: Column | str) -> Column:
    """Plain lower-case letters and digits, joined by hyphens; letters without a plain form go."""
    single = {c: p for c, p in _PLAIN.items() if len(p) == 1}
    plain = F.translate(col(name), "".join(single), "".join(single.values()))
    for c, p in _PLAIN.items():
        if len(p) > 1:
            plain = F.replace(plain, F.lit(c), F.lit(p))
    plain = F.lower(F.regexp_replace(plain, r"[^\x00-\x7F]+", ""))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def free_transfers(limit: Column | str, made: Column | str, chip: Column | str) -> Column:
    """Transfers left; NULL (a violation) for missing or negative fields or with an active chip."""
    a, b = col(limit), col(made)
    return F.when((a >= 0) & (b >= 0) & col(chip).isNull(), F.greatest(F.lit(0), a - b))


def absolute_error(actual: Column | str, forecast: Column | str) -> Column:
    return F.abs(col(actual) - col(forecast))


def squared_error(actual: Column | str, forecast: Column | str) -> Column:
    return (col(actual) - col(forecast)) * (col(actual) - col(forecast))


def pinball(actual: Column | str, forecast: Column | str, alpha: float) -> Column:
    d = col(actual) - col(forecast)
    return F.greatest(alpha * d, (alpha - 1) * d)


def fixture_text(was_home: Column | str, opponent: Column | str) -> Column:
    return F.concat(F.when(col(was_home), "vs ").otherwise("@ "), col(opponent))


def edge(baseline: Column | str, model: Column | str) -> Column:
    return col(baseline) - col(model)


def captain_label(picks: Column | str) -> Column:
    """Name of the captain in an array of picks (web_name, is_captain, multiplier); a dash if there is none."""
    own = F.filter(col(picks), lambda p: p["is_captain"])
    first = F.try_element_at(own, F.lit(1))
    return F.when(first.isNull(), "-").otherwise(F.concat(first["web_name"], F.when(first["multiplier"] == 3, " (TC)").otherwise("")))
