"""The incremental project round inside Structured Streaming.

The reference keeps no stream; a folder of arriving document versions can still
drive the same chapter comparison, one micro-batch per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.project import changed_chapters
from ..operators.segments import chapter_groups
from ..sources.documents import structure


def changed_chapters_stream(docs: DataFrame, state_path: str, output_path: str, checkpoint: str, model: str):
    """Starts the query: every micro-batch of documents is compared with the stored chapters.

    ``docs`` is a streaming table (doc_id, text); a batch holds whole documents.
    Each batch writes its own folder, so a repeated batch rewrites the same one.
    """

    def compare(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = chapter_groups(structure(batch)).select("doc_id", "chapter_id", "hash")
        known = spark.read.schema("doc_id long, chapter_id string, hash string, model string").parquet(state_path)
        touched = known.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        changed_chapters(current, touched, model).write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
