"""Incremental ingestion of a landing folder with Structured Streaming.

The batch loop of the web backend becomes a file stream with
``trigger(availableNow=True)``: each micro-batch numbers its rows by file
position, renames columns with the stored mappings (a select on the wide rows),
runs the sales ingestion (look-ups are joins) and writes every row, good or
rejected, with its ``reject_reason`` into one keyed table, one part a landed
file. A row with surplus fields or broken text is such a reject too.

An epoch is published by one manifest beside its rows: rows that a killed epoch
left are in no manifest and no reader sees them; an epoch that was published but
not yet in the checkpoint is skipped when it is replayed; a file that is read
again under another checkpoint replaces exactly its own part, also when none of
its rows is good any more.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import ingest as ig
from larder.operators.keyed_store import KeyedTable
from larder.operators.mapping import map_columns
from larder.session import shuffles_dropped
from larder.sources.csv import BYTES, checked_fields, raw_schema, with_file_position


_CARRIED = ("_file", "_parse")  # columns that ride through the mapping beside the extras
FILE_ROWS = 100_000  # rows of a landed file that one task writes
BATCH_BYTES = 1 << 30  # landed bytes of a micro-batch (a larger file is a batch of its own); all files are read, batch after batch


def _process(batch: DataFrame, header: list[str], mappings: list, products: DataFrame, warehouses: DataFrame,
             stores: DataFrame, target: str, default_warehouse: str | None, load: str) -> None:
    # The batch is parsed twice (positions, split sizes) and held nowhere: a copy of it would fill the executors' memory.
    table = KeyedTable(batch.sparkSession, target)
    numbered = with_file_position(batch.select(*checked_fields(batch, header), "_metadata")).drop("_metadata")
    files = numbered.select(F.col("source_file").alias("_file"), F.col("reject_reason").alias("_parse"), "source_row_number", *header)
    rows = ig.conform(map_columns(files, mappings), "", "sales", _CARRIED)
    # The file's path becomes the dataset's key.
    path = F.col("_file")
    keyed = rows.withColumn("dataset_id", F.concat(F.regexp_extract(path, r"([^/]*?)(\.csv)?$", 1), F.lit("-"),
                                                   F.substring(F.sha2(path, 256), 1, 16)))
    done = ig.ingest_sales(keyed, products, warehouses, stores, default_warehouse, earlier="_parse")
    # A look-up deals rows by its key, so every task would write a file into every part: ranges of a landed file go to one task each.
    done = done.repartition("dataset_id", F.floor(F.col("source_row_number") / FILE_ROWS))
    with shuffles_dropped(batch.sparkSession):
        table.replace(done, F.col("dataset_id"), load)


def stream_ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, header: list[str],
                  mappings: list, products: DataFrame, warehouses: DataFrame, stores: DataFrame,
                  default_warehouse: str | None = None, max_files_per_trigger: int | None = None, max_bytes_per_trigger: int = BATCH_BYTES) -> None:
    """Run the landing-folder stream to completion (all files available now), in micro-batches of bounded files or bytes.

    ``mappings``: the stored mapping rows of this upload layout. The table at
    ``target`` (read it with ``ingested``) holds every row; ``good`` and ``rejects`` are its two filters.
    """
    reader = spark.readStream.schema(raw_schema(header)).option("header", True).option("encoding", BYTES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    src = reader.csv(landing).select("*", "_metadata")
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def each(batch: DataFrame, epoch: int) -> None:
        _process(batch, header, mappings, products, warehouses, stores, target, default_warehouse, f"{run}-{epoch}")

    q = (src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All rows of the published epochs."""
    return KeyedTable(spark, target).read()


def good(table: DataFrame) -> DataFrame:
    return table.where("reject_reason is null").drop("reject_reason")


def rejects(table: DataFrame) -> DataFrame:
    return table.where("reject_reason is not null")
