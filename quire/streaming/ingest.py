"""De-duplicated ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.text import content_hash


def fresh_documents(arrivals: DataFrame, known_hashes: DataFrame, *, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Arriving documents that are neither known nor repeated within the watermark.

    State holds one hash per document for the length of the watermark; older copies are
    caught by the stored hashes.
    """
    rows = arrivals.withColumn("hash", content_hash("text"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(["hash"])
    else:
        rows = rows.dropDuplicates(["hash"])
    return rows.join(known_hashes.select("hash").distinct(), "hash", "left_anti")
