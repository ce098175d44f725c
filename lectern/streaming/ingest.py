"""Documents that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lectern.operators.corpus import Corpus


def ingest(corpus: Corpus, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Feed a stream of (name, and text, bytes of a PDF or base64) into a collection. Each micro-batch is one change: documents of a name replace the
    added one of that name, the greatest text in a batch wins, and the index is rebuilt once per batch.

    Documents that the collection refuses are kept as they came with the reason, why, in a Parquet table beside the
    checkpoint, ``{checkpoint}-refused``, one partition per batch; a batch that is repeated replaces its own."""
    refused = checkpoint.rstrip("/") + "-refused"

    def take(batch: DataFrame, number: int) -> None:
        corpus.add_all(batch, f"{refused}/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
