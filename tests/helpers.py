"""Small frames for the golden cases."""

ROW = {"season": "2024-25", "GW": 1, "player_code": "p", "fixture": 1, "kickoff_time": "2024-08-01 12:00:00", "position": "MID", "minutes": 90, "total_points": 2, "team": "A", "was_home": True, "expected_goals": 0.0, "expected_assists": 0.0, "started": 1.0, "defcon_hit": 0.0, "expected_goals_conceded": 1.0}


def rows(spark, *changes):
    """Fixture rows: the default row with changes."""
    from pyspark.sql import functions as F

    made = [ROW | c for c in changes]
    names = list(made[0])
    kinds = {"GW": "int", "fixture": "int", "minutes": "double", "total_points": "double", "was_home": "boolean", "expected_goals": "double", "expected_assists": "double", "started": "double", "defcon_hit": "double", "expected_goals_conceded": "double"}
    values = [tuple(float(r[n]) if kinds.get(n) == "double" and r[n] is not None else r[n] for n in names) for r in made]
    return spark.createDataFrame(values, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)).withColumn("kickoff_time", F.to_timestamp("kickoff_time"))


def event(gw, fixture, **more):
    return {"GW": gw, "fixture": fixture, "kickoff_time": f"2024-{8 + (gw - 1) // 28:02d}-{(gw - 1) % 28 + 1:02d} {fixture % 24:02d}:00:00"} | more


def raises(rule, violations):
    """The rule's violations exist."""
    return any(rule in r["rule"] for v in (violations if isinstance(violations, list) else [violations]) for r in v.collect())
