"""A change log applied to an index as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestar.options import CHANGES
from lodestar.plans.engine import Engine


def change_log(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of changes from Parquet files (seq, op, id, embedding, payload)."""
    reader = spark.readStream.schema(CHANGES)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


def start(engine: Engine, name: str, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Applies every micro-batch once: in a batch the largest seq of an id holds, and later batches override earlier ones.

    The manifest keeps the last batch applied, so a batch that is run again after a failure changes nothing. Changes
    of one id must come in the order of seq from batch to batch; seq, not arrival, orders them within one.
    """

    def run(batch: DataFrame, number: int) -> None:
        engine.apply(name, batch, f"{checkpoint}#{number}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
