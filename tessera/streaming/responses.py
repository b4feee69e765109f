"""Responses that keep arriving: parsed as a stream, each micro-batch by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.tables import materialize
from tessera.operators.parse import checked_responses, split_checked

RESPONSE_DDL = "case_id STRING, source STRING, model_name STRING, agent_id STRING, text STRING"


def follow(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse new response files of ``path`` once each into ``out``/graphs and ``out``/rejects.

    The checkpoint remembers which files are done, so a restart goes on where it stopped. A batch that is
    repeated after a failure rewrites its own folder.
    """

    def step(batch: DataFrame, number: int) -> None:
        good, bad = split_checked(materialize(checked_responses(batch)))
        good.write.mode("overwrite").parquet(f"{out}/graphs/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")

    stream = spark.readStream.schema(RESPONSE_DDL).json(path)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
