"""Ingestion of documents that keep arriving: the batch pipeline on each micro-batch, into a store.

Cleaning, classification and chunking need no state between documents.  A batch that is delivered
twice, after a failure, adds nothing, as chunk ids are hashes and the store drops known ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clean import Cleaner
from ..operators.index import postings
from ..plans import pipeline
from ..sources.store import TableStore


def cleaned(stream: DataFrame, cleaner: Cleaner = Cleaner.prose()) -> DataFrame:
    """A stream of documents with clean content and a domain."""
    return pipeline.with_domain(stream.withColumn("content", cleaner.clean(F.col("content"))))


def index(stream: DataFrame, store: TableStore, checkpoint: str, index_path: str | None = None, available_now: bool = True, max_size: int = 1000, overlap: int = 100) -> StreamingQuery:
    """Run the pipeline on a stream (document_id, source_type, source, content); postings go beside the chunks."""

    def batch(df: DataFrame, epoch: int) -> None:
        chunks = pipeline.indexed(pipeline.run(df, max_size, overlap))
        store.append(chunks)
        if index_path:  # one folder for each batch: a repeated one is overwritten
            postings(chunks).write.mode("overwrite").parquet(f"{index_path}/batch={epoch}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
