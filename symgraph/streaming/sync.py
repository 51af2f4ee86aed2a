"""Sync as a stream: arriving file versions are synced batch by batch.

A batch's files are what changed; deletions arrive as rows too, as absence can't. There is
no event time to watch: state is the store, keyed by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symgraph.operators.enrich import Embedder, Enricher
from symgraph.plans.store import Store
from symgraph.plans.sync import sync

ARRIVALS = "path string, content string, deleted boolean, arrived bigint"


def read_arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def start_sync(arrivals: DataFrame, store_root: str, project: str, branch: str, checkpoint: str, enricher: Enricher | None = None, embedder: Embedder | None = None) -> StreamingQuery:
    """Sync everything that has arrived, then stop; run again, it goes on from there.

    A batch that is tried again finds its symbols clean and publishes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("content", "deleted"), "arrived").alias("_v")).select("path", "_v.*").persist()
        try:
            files = last.where(~F.coalesce("deleted", F.lit(False))).select("path", "content")
            gone = last.where(F.coalesce("deleted", F.lit(False))).select(F.col("path").alias("file"))
            sync(Store(batch.sparkSession, store_root), project, branch, files, gone, enricher, embedder, complete=False)
        finally:
            last.unpersist()

    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
