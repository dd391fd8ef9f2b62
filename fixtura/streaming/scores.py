"""Late results as a stream: records after the cutoff are refused, scores are upserted by key.

The reference's loop is weekly batches; a landing folder of results is the same loop with a file source. The sink is the batch
upsert, so a micro-batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fixtura.operators.metrics import weekly
from fixtura.operators.sinks import upsert


def admitted(stream: DataFrame, observed: str, cutoff: Column) -> DataFrame:
    """Records observed at a known time up to the cutoff; works on streams and tables alike."""
    return stream.where(F.coalesce(F.col(observed) <= cutoff, F.lit(False)))


def score_stream(stream: DataFrame, path: str, checkpoint: str, actual: str, model: str, baseline: str) -> StreamingQuery:
    """Weekly scores of the events in each micro-batch, upserted into the table at ``path``; an event's rows must come together."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(weekly(batch, actual, model, baseline).withColumnRenamed("GW", "gw"), path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
