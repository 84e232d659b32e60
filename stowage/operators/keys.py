"""Keys, readers and their last uses as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import running_sum


def expand_uses(files: DataFrame) -> DataFrame:
    """One row for every file, key and reader, from array columns keys and readers."""
    return files.withColumn("key", F.explode("keys")).withColumn("reader", F.explode("readers")).drop("keys", "readers")


def last_use(uses: DataFrame) -> DataFrame:
    """The last file that a reader's key opens."""
    return uses.groupBy("archive", "reader", "key").agg(F.max("idx").alias("last_idx"))


def active(held: DataFrame, idx: int) -> DataFrame:
    """Keys that are still in use at file ``idx``."""
    return held.where(F.col("last_idx") >= idx)


def count_usable(entries: DataFrame, held: DataFrame) -> DataFrame:
    """For each entry the number of keys of its archive and kind whose last use is not before it.

    Counted from a histogram of last uses and their running sums from the
    last index down, in blocks, so an archive's entries and keys are never
    paired, and an archive of any share of the rows is spread over tasks.
    """
    marks = held.groupBy("archive", "kind", F.col("last_idx").alias("idx")).agg(F.count(F.lit(1)).alias("ends"))
    both = entries.select("archive", "kind", "idx", F.lit(0).cast("long").alias("ends"), F.lit(True).alias("entry")).unionByName(marks.withColumn("entry", F.lit(False)))
    down = both.withColumn("_down", -F.col("idx")).withColumn("_group", F.struct("archive", "kind"))
    counted = running_sum(down, "_group", "_down", F.col("ends"), "n_keys", ties=(F.col("entry"),))
    return counted.where("entry AND n_keys > 0").select("archive", "kind", "idx", "n_keys")


def packet_sizes(held: DataFrame) -> DataFrame:
    """Packets of an archive and their bytes: per reader a list of keys of 41 bytes and what seals it."""
    return held.groupBy("archive", "reader").agg((F.count(F.lit(1)) * 41 + 4 + 32 + 12 + 16).alias("bytes")).groupBy("archive").agg(F.count(F.lit(1)).alias("n_packets"), F.sum("bytes").alias("bytes"))
