"""Files as a stream: every row is a whole file, so file boundaries are keys and hold no state."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import is_folder, new_path


def stream_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of every archive, gathered from a stream over a table of documents.

    The table is one Parquet file or a folder of them; without rows it gives
    none. The stream runs until its input is read. Each micro-batch appends its
    partial sums to a table in the shared folder under its batch number, so a
    batch that is repeated replaces its own; the result adds them up.
    """
    out, state = new_path(spark, "sums"), new_path(spark, "state")
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema)
    if is_folder(spark, path):
        rows = rows.parquet(path)
    else:  # a stream reads folders: of the one that the file lies in, this name alone
        folder, _, name = path.rpartition("/")
        rows = rows.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}])", r"\\\1", name)).parquet(folder)
    sizes = rows.select(F.col("source").alias("archive"), F.octet_length("text").cast("long").alias("bytes"))

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("archive").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    put(spark.createDataFrame([], sizes.schema), -1)  # a table without files makes no batch
    sizes.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema("archive string, n_files long, bytes long").parquet(f"{out}/batch=*")
    return done.groupBy("archive").agg(F.sum("n_files").alias("n_files"), F.sum("bytes").alias("bytes"))
