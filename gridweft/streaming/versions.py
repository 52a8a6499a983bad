"""A stream of model versions, each compared with the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridweft.operators.access import Grid
from gridweft.operators.diff import diff_status
from gridweft.sources import rdfxml
from gridweft.storage import delete, stored


def watch(spark: SparkSession, contents: DataFrame, checkpoint: str, on_diff: Callable[[int, DataFrame], None], current: Grid | None = None) -> StreamingQuery:
    """Run ``on_diff(batch, differences)`` for every batch of a stream of (model, part, content) against the batch before.

    The first batch is compared with ``current``, or with no models. A batch holds whole models. The version of a batch
    is a folder named by its number below ``checkpoint``, which a stream that starts again finds there; a batch that is
    run again writes its own anew. Versions that no later batch needs are deleted.
    """
    folder = f"{checkpoint.rstrip('/')}/versions"

    def compare(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        closed = stored(rdfxml.closed(rdfxml.tags(batch)), "version-tags")
        objects = rdfxml.objects(closed)
        objects.write.mode("overwrite").parquet(f"{folder}/{number}/objects")
        rdfxml.triples(closed, objects).write.mode("overwrite").parquet(f"{folder}/{number}/triples")
        version = lambda n: Grid(*(session.read.parquet(f"{folder}/{n}/{t}") for t in ("objects", "triples")))
        new = version(number)
        old = version(number - 1) if number else current or Grid(new.objects.where("false"), new.triples.where("false"))
        on_diff(number, diff_status(old, new))
        delete(session, f"{folder}/{number - 2}")

    return contents.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
