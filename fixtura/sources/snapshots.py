"""Landed JSON documents of the live service, each turned into flat tables by explicit schemas."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEAMS = "array<struct<id:int,name:string,short_name:string>>"
EVENTS = "array<struct<id:int,deadline_time:string,finished:boolean,data_checked:boolean,is_current:boolean,is_next:boolean,average_entry_score:int>>"
ELEMENTS = "array<struct<id:int,code:long,element_type:int,team:int,minutes:int,starts:int,total_points:int,now_cost:int,web_name:string,first_name:string,second_name:string,status:string,chance_of_playing_next_round:double,news:string,selected_by_percent:string,ep_next:string>>"
FIXTURES = "id int, event int, kickoff_time string, finished boolean, finished_provisional boolean, team_h int, team_a int, team_h_difficulty int, team_a_difficulty int"
HISTORY = "array<struct<element:int,fixture:int,round:int,kickoff_time:string,minutes:int,starts:int,total_points:int,was_home:boolean,expected_goals_conceded:string,clearances_blocks_interceptions:int,recoveries:int>>"
MANIFEST = "format_version int, season string, captured_at_utc string, source string, bootstrap_source string, fixtures_source string, bootstrap_sha256 string, fixtures_sha256 string, history_sha256 string, covered_element_ids array<int>, history_rows_by_element map<string,int>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def bootstrap(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, teams and events."""
    whole = _json(spark, path, f"elements {ELEMENTS}, teams {TEAMS}, events {EVENTS}")
    return tuple(whole.select(F.inline(c)) for c in ("elements", "teams", "events"))


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, FIXTURES)


def player_histories(spark: SparkSession, folder: str) -> DataFrame:
    """One file a player, named by element or in a folder `element=`: its rows with `file_element`, whether or not they say the same element."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(f"history {HISTORY}").json(folder)
    at = F.regexp_extract(F.regexp_extract("_metadata.file_path", r"(element=[0-9]+/)?[^/]+$", 0), r"([0-9]+)", 1).try_cast("int")
    return raw.select(at.alias("file_element"), F.inline_outer("history"))


def event_live(spark: SparkSession, path: str) -> DataFrame:
    """(id, total_points, minutes) of one event."""
    return _json(spark, path, "elements array<struct<id:int,stats:struct<total_points:int,minutes:int>>>").select(F.inline("elements")).select("id", "stats.total_points", "stats.minutes")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, MANIFEST)


def covered(manifest_: DataFrame) -> DataFrame:
    return manifest_.select(F.explode("covered_element_ids").alias("element"))


def declared_rows(manifest_: DataFrame) -> DataFrame:
    return manifest_.select(F.explode("history_rows_by_element").alias("key", "n")).select(F.col("key").try_cast("int").alias("element"), "n")


PIECE = 8 << 20


def file_hashes(spark: SparkSession, paths: list[str], piece: int = PIECE, by: str = r"([^/]+)$") -> DataFrame:
    """(name, bytes, sha256) of each file, of any size; the name is what ``by`` catches in the path.

    Files are read in splits, as lines of raw bytes, and packed into pieces of about ``piece`` bytes; a file's pieces stream in order through the task that
    hashes it, so no row and no task ever holds a file. What bounds memory is one line. An empty file has the hash of nothing.
    """
    raw = spark.read.option("lineSep", "\n").text(paths)
    lines = raw.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, seq = None, [], 0, 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, seq, b"\n".join(held)), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["path", "size", "start", "seq", "piece"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for path, total, start, value in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if now is not None and (now != (path, total, start) or size >= piece):
                        yield told()
                        held, size, seq = [], 0, seq + 1
                    now = (path, total, start)
                    held.append(value)
                    size += len(value) + 1
        if now is not None:
            yield told()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, 0

        def told() -> pa.RecordBatch:
            if done < now[1]:
                sha.update(b"\n")  # the file ends with one
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([sha.hexdigest()])], names=["path", "bytes", "sha256"])

        for batch in batches:
            for at in range(batch.num_rows):
                path, total, part = (batch.column(c)[at].as_py() for c in ("path", "size", "piece"))
                if now != (path, total):
                    if now is not None:
                        yield told()
                    now, sha, done = (path, total), hashlib.sha256(), 0
                else:
                    sha.update(b"\n")
                    done += 1
                sha.update(part)
                done += len(part)
        if now is not None:
            yield told()

    parts = lines.mapInArrow(pack, "path string, size long, start long, seq long, piece binary").repartition("path").sortWithinPartitions("path", "start", "seq")
    found = parts.mapInArrow(hashed, "path string, bytes long, sha256 string")
    every = spark.createDataFrame([(f,) for f in raw.inputFiles()], "path string")  # the reader's own listing
    name, nothing = F.regexp_extract("path", by, 1), hashlib.sha256().hexdigest()
    told = every.select(name.alias("name")).distinct().join(found.select(name.alias("name"), "bytes", "sha256"), "name", "left")
    return told.select("name", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("sha256", F.lit(nothing)).alias("sha256"))


def entry_history(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, "current array<struct<event:int,points:int,total_points:int,overall_rank:long,bank:int,value:int,event_transfers:int>>").select(F.inline("current"))


def picks(spark: SparkSession, path: str) -> DataFrame:
    """The slots of an entry's picks."""
    return _json(spark, path, "picks array<struct<element:int,position:int,multiplier:int,is_captain:boolean,is_vice_captain:boolean>>").select(F.inline("picks")).withColumnRenamed("position", "slot")
