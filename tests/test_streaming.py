from pyspark.sql import functions as F

from fixtura.operators.sinks import read_table
from fixtura.streaming.scores import admitted, score_stream


def test_scores_are_upserted_from_a_stream(spark, tmp_path):
    schema = "season string, GW int, total_points double, model double, baseline double, minutes int, observed string"
    land = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = admitted(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "observed", F.lit("2025-09-30"))
        score_stream(stream, f"{tmp_path}/scores", f"{tmp_path}/check", "total_points", "model", "baseline").awaitTermination()
        return {r["gw"]: (r["mae_model"], r["mae_baseline"], r["n"]) for r in read_table(spark, f"{tmp_path}/scores").collect()}

    land([("s", 1, 4.0, 3.0, 2.0, 90, "2025-09-01"), ("s", 1, 9.0, 0.0, 0.0, 90, "2025-10-01"), ("s", 2, 1.0, 1.0, 0.0, 0, "2025-09-02")])
    assert run() == {1: (1, 2, 1), 2: (0, 1, 1)}
    land([("s", 2, 5.0, 1.0, 0.0, 90, "2025-09-03")])
    assert run() == {1: (1, 2, 1), 2: (4, 5, 1)} and run() == {1: (1, 2, 1), 2: (4, 5, 1)}
