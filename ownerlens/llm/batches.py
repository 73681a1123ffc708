"""Size of the record batches that texts travel in between Spark and its Python workers."""
from __future__ import annotations

from pyspark.sql import DataFrame

#: A worker holds a batch, its strings and its results at once, and an executor has a worker per core.
BATCH_BYTES = 8 * 2**20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``; its session's batches are held to ``BATCH_BYTES``, however long the texts are (one row at least)."""
    conf = docs.sparkSession.conf
    held = str(conf.get(_SETTING)).lower().rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(_SETTING, str(BATCH_BYTES))
    return docs
