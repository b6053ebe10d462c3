"""Sinks for rows as they arrive: batches that can be replayed, and many sources that end apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def batch_writer(path: str, source: str = "all") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch into a folder of its own number, so one that is replayed after a failure replaces itself and adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/source={source}/batch={number}")

    return write


def record_stream(rows: DataFrame, path: str, checkpoint: str, source: str = "all", once: bool = False) -> StreamingQuery:
    """Starts a query that records a stream's rows as lines of JSON. once: reads what is there and ends."""
    writer = rows.writeStream.queryName(f"record-{source}").foreachBatch(batch_writer(path, source)).option("checkpointLocation", f"{checkpoint}/{source}")
    return (writer.trigger(availableNow=True) if once else writer).start()


def merge_streams(sources: dict[str, DataFrame], path: str, checkpoint: str, once: bool = False) -> dict[str, StreamingQuery]:
    """Records streams of the same columns into one table, a query for each, so that one which fails ends alone and goes on from its own checkpoint
    when it is started again."""
    return {name: record_stream(rows, path, checkpoint, name, once) for name, rows in sources.items()}


def failures(queries: dict[str, StreamingQuery]) -> dict[str, str]:
    """Waits until all queries have ended; what those that failed say."""
    out = {}
    for name, query in queries.items():
        try:
            query.awaitTermination()
        except StreamingQueryException as failed:
            out[name] = str(failed)
    return out


def recorded(spark: SparkSession, path: str, schema) -> DataFrame:
    """All recorded rows, with their source and batch."""
    return spark.read.schema(schema).option("basePath", path).json(f"{path}/source=*/batch=*")
