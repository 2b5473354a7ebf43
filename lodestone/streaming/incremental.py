"""Our extension: re-indexing changed files as a stream, into a versioned catalog.

New versions of files arrive as rows (file_path, file, ext, text, ord, version); a row
whose text is null says that the file is gone. Each micro-batch is one commit, so
readers see all of it or nothing, and a batch that is run again is not committed twice.
Files are told apart by path, like-named ones in different folders included; rows without
a column file_path have it from ord, which holds its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.parse import last_wins
from lodestone.plans.store import settled
from lodestone.plans.versions import VersionedCatalog


def index_stream(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Commits a stream of file versions to the catalog at ``path``. Of a batch's versions of a file the newest counts, of equal ones the last by ``ord``."""

    def write(batch: DataFrame, epoch: int) -> None:
        if "file_path" not in batch.columns:
            batch = batch.withColumn("file_path", F.array_join("ord", "/"))
        newest = settled(last_wins(batch.withColumn("at", F.struct("version", "ord")), "file_path", "at"))
        there = newest.where(F.col("text").isNotNull())
        VersionedCatalog(batch.sparkSession, path).commit(there, newest.where(F.col("text").isNull()).select("file_path"), checkpoint, epoch)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_functions(spark: SparkSession, path: str) -> DataFrame:
    """Functions of the newest indexed version of each file."""
    return VersionedCatalog(spark, path).relation("functions")
