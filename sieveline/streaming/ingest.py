"""Streaming twin of sync: new files reach the store micro-batch by micro-batch, each as one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import checksum, document_id
from ..plans.store import Store
from ..plans.sync import Options, sync


def stream_documents(store: Store, source: DataFrame, checkpoint: str, options: Options | None = None, source_type: str = "stream"):
    """source: a streaming (source_id, title, content). Runs what is available, then stops. A repeated batch finds its documents unchanged."""
    o = options or Options()
    o.prune = False  # a micro-batch is never the whole source

    def put(batch: DataFrame, _: int) -> None:
        now = F.current_timestamp()
        rows = batch.dropDuplicates(["source_id"]).select(document_id(F.lit(source_type), F.col("source_id")).alias("id"), F.lit(source_type).alias("source_type"), "source_id", "title", "content", F.concat(F.lit("stream:"), "source_id").alias("uri"), F.lit("{}").alias("metadata"), F.lit(None).cast("string").alias("file_type"), checksum(F.col("title"), F.col("content")).alias("checksum"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("error"))
        sync(store, rows, source_type, o).count()

    query = source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
