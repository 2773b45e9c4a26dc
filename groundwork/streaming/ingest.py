"""Continuous counterparts: new files of documents are cleaned, scored and stored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from groundwork.operators import paragraphs


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(folder)


def stored_paragraphs(documents: DataFrame, path: str, checkpoint: str, rules: paragraphs.Rules = paragraphs.Rules()) -> StreamingQuery:
    """Kept paragraphs of a stream of documents, stored once each: the checkpoint says what is done, also after a failure.

    Each micro-batch overwrites its own folder, so a batch that runs again leaves no second copy.
    """

    def store(batch: DataFrame, number: int) -> None:
        paragraphs.kept(paragraphs.scored(paragraphs.split(batch), rules), rules).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
