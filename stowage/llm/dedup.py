"""Exact duplicates by sorting content.

Normalised texts are dealt to partitions by sampled splitters over (leading
characters, hash, bucket) and sorted there, which puts equal texts next to one
another; runs are then formed by comparing neighbours in full. The splitters
hold a short prefix and a hash and never the text, so what the driver samples
does not grow with document length.

Skew: a text with more copies than ``hot_rows`` is dealt over ``buckets``
runs, and the heads of those runs are compared in full in a second step. At
most four such texts per shuffle partition can exist, so their table is
bounded and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .common import LOWER, UPPER, ascii_lower, table

PREFIX_CHARS = 24


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", carry: bool = False, buckets: int = 256, hot_rows: int | None = None) -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z.

    Returns one row per input row: ``id_col, keep_id, group_size, kept,
    text_sha256``, after all input columns if ``carry`` (input columns of
    those names are replaced). ``keep`` says whether the largest or the
    smallest id of a group stays.

    A null text equals an empty one; texts of any length are compared whole. A null id is never preferred; a group
    of null ids alone has a null ``keep_id`` and still keeps one row.
    Of repeated rows with the id that stays, exactly one is kept. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    order = F.desc_nulls_last if keep == "max" else F.asc_nulls_last
    added = ("keep_id", "group_size", "kept", "text_sha256")
    passed = [c for c in docs.columns if c not in added] if carry else [id_col]
    rows = docs.select(*[F.col(c) for c in passed if c != text_col], F.coalesce(F.col(text_col), F.lit("")).alias("_x7_text"), *([F.col(text_col).isNull().alias("_x7_null")] if carry else []))
    norm = ascii_lower(F.col("_x7_text"))
    keyed = rows.withColumn("_x7_h", F.xxhash64(norm)).withColumn("_x7_p", F.substring(norm, 1, PREFIX_CHARS))

    if hot_rows is None:
        hot_rows = max(1000, docs.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counts = rows.select(F.xxhash64(norm).alias("_x7_h")).groupBy("_x7_h").count()
    hot = materialise(counts.where(F.col("count") > hot_rows).select("_x7_h", F.lit(True).alias("_x7_hot")), "hot")
    any_hot = not hot.isEmpty()
    if any_hot:
        keyed = keyed.join(F.broadcast(hot), "_x7_h", "left")
        dealt = F.pmod(F.xxhash64(F.col(id_col), F.spark_partition_id()), F.lit(buckets))
        keyed = keyed.withColumn("_x7_b", F.when(F.col("_x7_hot"), dealt).otherwise(F.lit(0).cast("long")))
    # Without hot texts there is no bucket: a constant would not be part of the partitioning, and the runs would be dealt out again.
    dealt_by = ["_x7_p", "_x7_h", *(["_x7_b"] if any_hot else [])]
    ranged = keyed.repartitionByRange(*dealt_by).withColumn("_x7_norm", norm)
    run = Window.partitionBy(*dealt_by, "_x7_norm").orderBy(order(id_col))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        ranged.withColumn("_x7_n", F.row_number().over(run))
        .withColumn("keep_id", F.first(id_col).over(whole))
        .withColumn("group_size", F.count(F.lit(1)).over(whole))
        .withColumn("text_sha256", F.sha2("_x7_norm", 256))
    )
    kept = F.col("_x7_n") == 1
    if any_hot:
        runs = runs.withColumn("_x7_head", F.when(F.col("_x7_hot") & kept, F.col("_x7_norm"))).drop("_x7_norm", "_x7_p", "_x7_hot")
        runs = materialise(runs if carry else runs.drop("_x7_text"), "runs")
        first = F.max if keep == "max" else F.min
        merged = (
            runs.where(F.col("_x7_head").isNotNull())
            .groupBy("_x7_head", "_x7_h", "text_sha256")
            .agg(first("keep_id").alias("_x7_keep"), F.sum("group_size").alias("_x7_size"), F.max_by("_x7_b", F.struct(F.col("keep_id").isNotNull(), F.col("keep_id") if keep == "max" else -F.col("keep_id"), "_x7_b")).alias("_x7_win"))
            .drop("_x7_head")
        )
        runs = runs.join(F.broadcast(merged), ["_x7_h", "text_sha256"], "left")
        kept = kept & (F.col("_x7_win").isNull() | (F.col("_x7_win") == F.col("_x7_b")))
        runs = runs.withColumn("keep_id", F.when(F.col("_x7_win").isNull(), F.col("keep_id")).otherwise(F.col("_x7_keep"))).withColumn("group_size", F.coalesce("_x7_size", "group_size"))
    text = F.when(~F.col("_x7_null"), F.col("_x7_text")).alias(text_col) if carry else None
    return runs.select(*[text if c == text_col else F.col(c) for c in passed], "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
