"""Tables in the shared folder, and joins with key sets of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.shared import materialise, shared_dir

__all__ = ["BROADCAST_KEYS", "materialise", "semi_by_key", "shared_dir", "short_batches"]

#: At most this many 64-bit keys (16 MB) are sent to every executor; beyond it a shuffle join is used.
BROADCAST_KEYS = 1_000_000


def semi_by_key(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """rows whose key is among the n_keys distinct keys: broadcast up to BROADCAST_KEYS, else a shuffle join."""
    return rows.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, key, "left_semi")


def short_batches(docs: DataFrame) -> DataFrame:
    """docs, in a session that hands rows to Python workers by the thousand: texts are long, and Spark's 10,000 rows of them at
    once take memory in the JVM and in the worker. A number that the user has set, be it Spark's own, stays; else the option stays set in the session."""
    conf, option = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if option not in conf.getAll:
        conf.set(option, "1000")
    return docs
