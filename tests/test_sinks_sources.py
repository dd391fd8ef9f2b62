import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtura.operators import checks, sinks
from fixtura.sources import seasons, snapshots

from .helpers import event, rows


def test_export_and_its_verification(spark, tmp_path):
    panel = rows(spark, event(1, 1), event(2, 2), event(1, 1, season="2025-26"), event(1, 1, season="2019-20"))
    path = str(tmp_path)
    sinks.export_splits(panel, path, n_features=3)
    back = sinks.read_export(spark, path)
    assert back.count() == 3 and back.columns == panel.columns
    panel.where("season = '2025-26'").withColumn("minutes", F.lit(1.0)).write.mode("overwrite").parquet(f"{path}/validation")
    with pytest.raises(checks.CheckFailed, match="content of validation differs"):
        sinks.read_export(spark, path)
    panel.where("season = '2025-26'").drop("minutes").write.mode("overwrite").parquet(f"{path}/validation")
    with pytest.raises(checks.CheckFailed, match="columns of validation differ"):
        sinks.read_export(spark, path)


def test_content_hash_ignores_order_and_partitions(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    one, two = sinks.content_hash(df).first(), sinks.content_hash(df.repartition(7).orderBy(F.desc("id"))).first()
    assert one == two and sinks.content_hash(df.withColumn("x", F.col("x") + (F.col("id") == 5).cast("int"))).first() != one
    text = lambda d: sinks.canonical_hash(d, ["id", "x"], ["id"]).first()
    small = lambda d: sinks.canonical_hash(d, ["id", "x"], ["id"], part_rows=20).first()  # noqa: E731  (many parts, several levels)
    assert small(df) == small(df.repartition(3)) and small(df)["rows"] == 1000 and small(df) != small(df.where("id <> 7"))
    assert sinks.canonical_hash(df.where("false"), ["id", "x"], ["id"]).first()["rows"] == 0
    assert text(df) == text(df.repartition(5)) and text(df)["rows"] == 1000 and text(df) != text(df.where("id > 0"))


def test_board_is_frozen_after_its_deadline(spark, tmp_path):
    board = spark.createDataFrame([(1, 5.0)], "id int, e_points_final double")
    early, late, deadline = (dt.datetime(2025, 9, d) for d in (1, 3, 2))
    path = f"{tmp_path}/boards"
    read = lambda: [tuple(r) for r in sinks.read_table(spark, sinks.board_path(path, "2025-26", 3)).collect()]
    assert sinks.write_board(board, path, "2025-26", 3, deadline, late) and read() == [(1, 5.0)]
    assert sinks.write_board(board.withColumn("e_points_final", F.lit(6.0)), path, "2025-26", 3, deadline, early) and read() == [(1, 6.0)]
    assert not sinks.write_board(board, path, "2025-26", 3, deadline, late) and read() == [(1, 6.0)]


def test_predictions_need_unique_keys(spark, tmp_path):
    df = rows(spark, event(1, 1), event(1, 1))
    with pytest.raises(checks.CheckFailed, match="a key occurs more than once"):
        sinks.write_predictions(df, f"{tmp_path}/p", ["season", "minutes"])
    with pytest.raises(checks.CheckFailed, match="missing required columns: nope"):
        sinks.write_predictions(df, f"{tmp_path}/p", ["nope"])
    sinks.write_predictions(df.dropDuplicates(), f"{tmp_path}/p", ["fixture", "season"])
    assert spark.read.parquet(f"{tmp_path}/p").columns == ["fixture", "season"]


def test_upsert_is_idempotent(spark, tmp_path):
    path, new = f"{tmp_path}/scores", spark.createDataFrame([("s", 2, 1.0), ("s", 1, 2.0)], "season string, gw int, mae double")
    get = lambda: [(r["gw"], r["mae"]) for r in sinks.read_table(spark, path).orderBy("gw").collect()]
    sinks.upsert(new, path)
    again = spark.createDataFrame([("s", 2, 9.0)], "season string, gw int, mae double")
    for _ in range(2):
        sinks.upsert(again, path)
        assert get() == [(1, 2.0), (2, 9.0)]


def test_panel_and_manifest(spark, tmp_path):
    df = rows(spark, event(1, 1))
    sinks.write_panel(df, str(tmp_path), ["a", "b"])
    assert spark.read.parquet(f"{tmp_path}/panel").count() == 1 and spark.read.parquet(f"{tmp_path}/features").count() == 2
    (tmp_path / "in.csv").write_text("x\n")
    m = {(r["kind"], r["name"]): r["rows"] for r in sinks.evidence_manifest(spark, [f"{tmp_path}/in.csv"], {"panel": df}, "frozen").collect()}
    assert m == {("input", "in.csv"): 2, ("artifact", "panel"): 1}


def test_season_files(spark, tmp_path):
    for season, head, row in (("2023-24", "element,round,minutes,name", "1,3,90,\"A, b\""), ("2024-25", "name,minutes,element,GW,extra", "C,x,2,4,7")):
        d = tmp_path / season
        d.mkdir()
        (d / "merged_gw.csv").write_text(f"{head}\n{row}\n")
        (d / "players_raw.csv").write_text("id,code,web_name,penalties_order,junk\n1,77,X,2,z\n")
        (d / "fixtures.csv").write_text("id,event,team_h,team_a\n5,,1,2\n")
        (d / "teams.csv").write_text("id,name,short_name,strength\n1,Aa,A,3\n")
    got = {r["season"]: (r["GW"], r["minutes"], r["name"], r["extra"]) for r in seasons.all_seasons(spark, str(tmp_path), ["2023-24", "2024-25"], ["minutes", "round", "GW", "element"]).collect()}
    assert got == {"2023-24": (3, 90, "A, b", None), "2024-25": (4, None, "C", "7")}
    p = seasons.season_players(spark, str(tmp_path), "2023-24").first()
    assert (p["element"], p["penalties_order"], p["season"]) == (1, 2, "2023-24") and "junk" not in p.asDict()
    assert seasons.season_fixtures(spark, str(tmp_path), "2023-24").first()["event"] is None
    assert seasons.season_teams(spark, str(tmp_path), "2023-24").columns == ["id", "name", "short_name", "season"]


def test_boards_and_actuals(spark, tmp_path):
    import os

    for i, name in enumerate(["gw3_a.csv", "gw3_b.csv", "gw12.csv"]):
        (tmp_path / name).write_text(f"id,e\n{i},1\n")
        os.utime(tmp_path / name, (1_700_000_000 + (9 if name == "gw3_a.csv" else i),) * 2)
    found = seasons.boards(spark, str(tmp_path))
    assert seasons.select_board(found, 3).first()["board_file"] == "gw3_b.csv" and seasons.select_board(found).first()["board_file"] == "gw3_a.csv"
    (tmp_path / "act").mkdir()
    (tmp_path / "act" / "a.csv").write_text("id,total_points\n1,5\n2,x\n")
    assert {r["id"]: r["total_points"] for r in seasons.actuals(spark, f"{tmp_path}/act/a.csv").collect()} == {1: 5, 2: None}
    with pytest.raises(checks.CheckFailed, match="minutes"):
        seasons.actuals(spark, f"{tmp_path}/act/a.csv", ["id", "minutes"])


def test_snapshot_documents(spark, tmp_path):
    (tmp_path / "live.json").write_text('{"elements": [{"id": 4, "stats": {"total_points": 9, "minutes": 80, "bps": 1}}]}')
    (tmp_path / "entry.json").write_text('{"current": [{"event": 1, "points": 50}], "past": []}')
    (tmp_path / "picks.json").write_text('{"picks": [{"element": 4, "position": 1, "multiplier": 2, "is_captain": true, "is_vice_captain": false}]}')
    assert tuple(snapshots.event_live(spark, f"{tmp_path}/live.json").first()) == (4, 9, 80)
    assert snapshots.entry_history(spark, f"{tmp_path}/entry.json").first()["points"] == 50
    assert snapshots.picks(spark, f"{tmp_path}/picks.json").first()["slot"] == 1


def test_readers_survive_a_write_that_stops_anywhere(spark, tmp_path, monkeypatch):
    path, schema = f"{tmp_path}/scores", "season string, gw int, mae double"
    get = lambda: sorted((r["gw"], r["mae"]) for r in sinks.read_table(spark, path).collect())
    sinks.upsert(spark.createDataFrame([("s", 1, 1.0)], schema), path)
    held = sinks.read_table(spark, path)  # a reader that began before
    real = sinks.commit

    def stops(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "commit", stops)  # the data is written, the commit never comes
    with pytest.raises(KeyboardInterrupt):
        sinks.upsert(spark.createDataFrame([("s", 1, 9.0)], schema), path)
    assert get() == [(1, 1.0)]
    monkeypatch.setattr(sinks, "commit", real)
    sinks.upsert(spark.createDataFrame([("s", 1, 2.0)], schema), path)
    assert get() == [(1, 2.0)] and held.first()["mae"] == 1.0
    assert len(sinks.versions(spark, path)) == 2 and len(sinks.cleaned(spark, path, keep=1)) == 1 and get() == [(1, 2.0)]


def test_no_update_of_two_writers_is_lost(spark, tmp_path, monkeypatch):
    path, schema = f"{tmp_path}/scores", "season string, gw int, mae double"
    sinks.upsert(spark.createDataFrame([("s", 1, 1.0)], schema), path)
    real, other = sinks.commit, [True]

    def late(spark_, path_, folder, after):
        if other.pop() if other else False:  # another writer is faster once
            monkeypatch.setattr(sinks, "commit", real)
            sinks.upsert(spark.createDataFrame([("s", 2, 2.0)], schema), path)
        real(spark_, path_, folder, after)

    monkeypatch.setattr(sinks, "commit", late)
    sinks.upsert(spark.createDataFrame([("s", 3, 3.0)], schema), path)
    assert sorted((r["gw"], r["mae"]) for r in sinks.read_table(spark, path).collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    with pytest.raises(sinks.Conflict):
        sinks.replace(spark.createDataFrame([("s", 4, 4.0)], schema), path, after=1)
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("piece,split", [(1 << 23, "128m"), (100, "1k")])
def test_files_are_hashed_in_pieces(spark, tmp_path, piece, split):
    """Files above the piece's size and above a split's, with and without a last newline, with bytes that are no text."""
    import hashlib

    made = {"a.txt": b"x\n" * 5000, "b.bin": bytes(range(256)) * 40, "c.txt": b"", "d.txt": b"\n", "e.txt": b"no end", "f.txt": b"\r\nline\r\n\n\n", "g.txt": b"\n" * 3000 + b"z"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r["name"]: (r["bytes"], r["sha256"]) for r in snapshots.file_hashes(spark, [str(tmp_path)], piece).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {name: (len(c), hashlib.sha256(c).hexdigest()) for name, c in made.items()}
