"""Structured Streaming: each micro-batch becomes a level-of-detail file of its own.

The layout holds for each file by itself, so batches need no common state; a batch that
is run again overwrites its own file, so each batch lands once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodestrata.plans.convert import Options, convert
from lodestrata.sources.shared import removed, written


def convert_stream(stream: DataFrame, folder: str, geo: dict, options: Options = Options()) -> DataStreamWriter:
    """A writer for a stream of rows (fid or none, columns...); start() it with a checkpoint location and a trigger."""

    def one(batch: DataFrame, number: int) -> None:
        rows = batch if "fid" in batch.columns else batch.withColumn("fid", F.monotonically_increasing_id())
        rows = written(rows, "batch")  # ids must not change between the passes of one batch, whatever executors are lost
        try:
            if not rows.isEmpty():
                convert(rows, f"{folder.rstrip('/')}/batch-{number:08d}.parquet", geo, options)
        finally:
            removed(rows)

    return stream.writeStream.foreachBatch(one)
