"""Running a stream to its present end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from siltstone.sources.scratch import shared_folder


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through a checkpointed query: appended rows, or in complete mode the last state."""
    top = f"{shared_folder(stream.sparkSession)}/siltstone-stream-{uuid.uuid4().hex}"
    rows = f"{top}/rows"

    def put(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(rows)
        else:
            batch.write.mode("overwrite").parquet(f"{rows}/batch={batch_id}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    found = stream.sparkSession.read.schema(stream.schema).parquet(rows)
    return found.drop("batch") if mode != "complete" else found
