"""Line-ups of many squads at once. Rows are (squad_id, id, position, points, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fewest and most starters by position, and the size of a line-up.
BOUNDS = {"GK": (1, 1), "DEF": (3, 5), "MID": (2, 5), "FWD": (1, 3)}
SIZE = 11


def best_xi(squads: DataFrame) -> DataFrame:
    """Rows with `is_xi`: the legal line-up of most points, ties by id.

    The bounds nest, so greedy is exact: each position's fewest best are in, and the free places go to the best of the rest
    within each position's most. Two windows on the squad serve it, however many squads there are.
    """
    p = F.col("position")
    rank = F.row_number().over(Window.partitionBy("squad_id", "position").orderBy(F.desc("points"), "id"))
    low, high = F.lit(0), F.lit(0)
    for name, (a, b) in BOUNDS.items():
        low, high = F.when(p == name, a).otherwise(low), F.when(p == name, b).otherwise(high)
    own = squads.withColumns({"__rank": rank, "__low": low, "__high": high})
    own = own.withColumns({"__forced": F.col("__rank") <= F.col("__low"), "__free": (F.col("__rank") > F.col("__low")) & (F.col("__rank") <= F.col("__high"))})
    place = F.row_number().over(Window.partitionBy("squad_id").orderBy(F.desc("__free"), F.desc("points"), "id"))
    spare = SIZE - sum(a for a, _ in BOUNDS.values())
    own = own.withColumn("is_xi", F.col("__forced") | (F.col("__free") & (place <= spare)))
    return own.drop("__rank", "__low", "__high", "__forced", "__free")


def xi_summary(lined: DataFrame) -> DataFrame:
    """Starters and their counts by position, and whether the line-up is legal."""
    xi = F.col("is_xi")
    own = lined.groupBy("squad_id").agg(F.count_if(xi).alias("n_xi"), F.sum(F.when(xi, F.col("points"))).alias("xi_points"), *[F.count_if(xi & (F.col("position") == p)).alias(f"n_{p.lower()}") for p in BOUNDS])
    legal = F.col("n_xi") == SIZE
    for p, (a, b) in BOUNDS.items():
        legal = legal & F.col(f"n_{p.lower()}").between(a, b)
    return own.withColumn("is_legal", legal)


def fit_xi(squads: DataFrame, flagged: str = "flagged") -> tuple[DataFrame, DataFrame]:
    """The best line-up without flagged players, and the squads that have none."""
    lined = best_xi(squads.where(~F.coalesce(F.col(flagged), F.lit(False))))
    ids = squads.select("squad_id").distinct()
    bad = ids.join(xi_summary(lined).where("is_legal"), "squad_id", "left_anti")
    return lined.join(bad, "squad_id", "left_anti"), bad


def bench(lined: DataFrame) -> DataFrame:
    """The rest in order: keeper first, others by points."""
    order = Window.partitionBy("squad_id").orderBy(F.when(F.col("position") == "GK", 0).otherwise(1), F.desc("points"), "id")
    return lined.where(~F.col("is_xi")).withColumn("bench_place", F.row_number().over(order))


def captains(lined: DataFrame) -> DataFrame:
    """Rows of the best and second-best starter, as `role`."""
    rank = F.row_number().over(Window.partitionBy("squad_id").orderBy(F.desc("points"), "id"))
    return lined.where("is_xi").withColumn("__rank", rank).where("__rank <= 2").withColumn("role", F.when(F.col("__rank") == 1, "captain").otherwise("vice")).drop("__rank")


def xi_value(lined: DataFrame) -> DataFrame:
    """Points of the line-up with the captain's twice: what holding the squad is worth."""
    own = F.when(F.col("is_xi"), F.col("points"))
    return lined.groupBy("squad_id").agg((F.sum(own) + F.max(own)).alias("xi_value"))


def squad_totals(lined: DataFrame) -> DataFrame:
    """Cost, points, counts by position, clubs and the largest club of each squad."""
    clubs = lined.groupBy("squad_id", "club").agg(F.count(F.lit(1)).alias("n")).groupBy("squad_id").agg(F.count(F.lit(1)).alias("clubs"), F.max("n").alias("club_max"))
    own = lined.groupBy("squad_id").agg(F.sum("cost").alias("cost"), F.sum("points").alias("points"), F.sum(F.when(F.col("is_xi"), F.col("points"))).alias("xi_points"), *[F.count_if(F.col("position") == p).alias(f"n_{p.lower()}") for p in BOUNDS])
    return own.join(clubs, "squad_id")


def shop(market: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """What a price buys: (position, level, goods) holds, for every price that occurs at a position, each club's ``depth`` best players up to that price, best first; and the prices (position, levels).

    A row has at most clubs x ``depth`` players; there are as many rows as whole prices by position, however many players the market has.
    """
    price = F.col("cost").cast("int")
    rank = F.row_number().over(Window.partitionBy("position", "club", "__price").orderBy(F.desc("points"), "id"))
    own = market.where(~F.coalesce(F.col("flagged"), F.lit(False))).withColumn("__price", price).withColumn("__rank", rank).where(F.col("__rank") <= depth)
    good = F.struct((-F.col("points")).alias("order"), F.col("id").alias("in_id"), F.col("club").alias("in_club"), F.col("points").alias("in_points"), F.col("__price").alias("price"))
    clubs = own.groupBy("position", "club").agg(F.collect_list(good).alias("goods"))  # at most prices x depth
    levels = own.groupBy("position").agg(F.sort_array(F.collect_set("__price")).alias("levels"))  # whole prices
    each = clubs.join(levels, "position").select("position", F.explode("levels").alias("level"), "goods")
    best = F.slice(F.sort_array(F.filter("goods", lambda g: g["price"] <= F.col("level"))), 1, depth)
    return each.select("position", "level", best.alias("goods")).groupBy("position", "level").agg(F.sort_array(F.flatten(F.collect_list("goods"))).alias("goods")), levels


def one_transfer(squads: DataFrame, market: DataFrame, bank: DataFrame, hit: float = 0.0, best: int = 5, club_cap: int = 3) -> DataFrame:
    """The best single transfers of every squad, those that gain: squad_id, out_id, in_id, value, gain, rank.

    ``market`` is (id, position, club, cost, points, flagged), of whole prices. Each player sold meets one row of ``shop``: what the squad
    can pay buys there. Of a club the ``best`` + 15 first are enough, since a squad owns 15 at most. A transfer gains only if the buy
    starts, and then gains more the more points the buy has; so of the buys for one player only the ``best`` first by points,
    then id, are valued.
    """
    goods, levels = shop(market, best + 15)
    whole = squads.groupBy("squad_id").agg(F.collect_list(F.struct("id", "position", "club", "points")).alias("team"))  # 15 rows
    limit = F.col("cost").cast("int") + F.col("bank").cast("int")
    asks = squads.join(bank, "squad_id").join(whole, "squad_id").join(levels, "position").select("squad_id", F.col("id").alias("out_id"), "position", "team", F.array_max(F.filter("levels", lambda x: x <= limit)).alias("level"))
    rest = F.filter("team", lambda t: t["id"] != F.col("out_id"))
    own = asks.where("level is not null").withColumn("rest", rest)
    full = F.filter(F.array_distinct(F.transform("rest", lambda t: t["club"])), lambda c: F.size(F.filter("rest", lambda t: t["club"] == c)) >= club_cap)
    own = own.select("squad_id", "out_id", "position", "level", "rest", full.alias("full"), F.transform("team", lambda t: t["id"]).alias("owned"))
    buys = F.slice(F.filter("goods", lambda g: ~F.array_contains("owned", g["in_id"]) & ~F.array_contains("full", g["in_club"])), 1, best)
    kept = own.join(goods, ["position", "level"]).select("squad_id", "out_id", "position", "rest", F.inline(buys))
    new = F.concat("rest", F.array(F.struct(F.col("in_id").alias("id"), "position", F.col("in_club").alias("club"), F.col("in_points").alias("points"))))
    valued = kept.withColumn("value", _xi_of(new)).join(xi_value(best_xi(squads)), "squad_id").withColumn("gain", F.round(F.col("value") - F.col("xi_value") - hit, 9)).where("gain > 0")
    order = Window.partitionBy("squad_id").orderBy(F.desc("gain"), "out_id", "in_id")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("squad_id", "out_id", "in_id", "value", "gain", "rank")


def _xi_of(team):
    """Value of the best line-up of an array of players, captain twice: the greedy rule inside one row."""
    points = lambda p: F.transform(F.sort_array(F.transform(F.filter(team, lambda t: t["position"] == p), lambda t: t["points"]), asc=False), lambda x: x)
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    forced, free, tops = F.lit(0.0), [], []
    for p, (low, high) in BOUNDS.items():
        own = points(p)
        forced = forced + add(F.slice(own, 1, low))
        free.append(F.slice(own, low + 1, high - low) if high > low else F.slice(own, 1, 0))
        tops.append(F.try_element_at(own, F.lit(1)))
    spare = SIZE - sum(a for a, _ in BOUNDS.values())
    return forced + add(F.slice(F.sort_array(F.flatten(F.array(*free)), asc=False), 1, spare)) + F.greatest(*tops)
