"""The archive catalogue: entries of archives, and what is derived from them row by row.

An entry is a file, a directory or a symlink of an archive. Catalogue queries
never touch payloads beyond their length, so scans read the columns they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one archive that a task orders at once.
BLOCK = 1 << 16
#: Key policies: which parts of an entry are encrypted, and with what.
POLICIES = ("none", "same", "data_only", "individual")
DEFAULT_MODE, DEFAULT_UID, DEFAULT_GID = 0o644, 1000, 1000


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str, block: int = BLOCK, ties: tuple[Column, ...] = (), levels: int = 1) -> DataFrame:
    """Add the inclusive running sum of ``value`` by ``order`` (a whole number) within ``key``.

    Works on blocks, so that a key with any share of the rows is spread over
    tasks: sums inside blocks of consecutive ``order`` values, and sums of
    whole blocks, which with more ``levels`` are summed in blocks again. One
    level will do for orders below the square of ``block``; see
    :func:`levels_of`. Rows of a null key are a group of their own, rows of a
    null order come first; equal orders go by ``ties``.
    """
    cut = F.floor(F.col(order) / block)
    parts = df.withColumn("_block", cut).withColumn("_value", value)
    inner = Window.partitionBy(key, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = parts.groupBy(key, F.col("_block").alias("_at")).agg(F.sum("_value").alias("_total"))
    if levels > 1:
        sums = running_sum(totals, key, "_at", F.col("_total"), "_upto", block, levels=levels - 1)
    else:
        outer = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = totals.withColumn("_upto", F.sum("_total").over(outer))
    bases = sums.select(F.col(key).alias("_key"), F.col("_at").alias("_of"), (F.col("_upto") - F.col("_total")).alias("_base"))
    summed = parts.withColumn("_inner", F.sum("_value").over(inner))
    return summed.join(bases, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of"))).drop("_key", "_of").withColumn(name, (F.col("_base") + F.col("_inner")).cast("long")).drop("_block", "_value", "_inner", "_base")


def levels_of(df: DataFrame, order: str, block: int = BLOCK) -> int:
    """Levels of :func:`running_sum` with which no window holds more than ``block`` different orders, however sparse these are."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    span, levels = (high or 0) - (low or 0), 1
    while span >= block ** (levels + 1):
        levels += 1
    return levels


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: one archive for each source, ``path`` = source/doc_id.txt, the text as payload."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("source").alias("archive"),
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("lang"),
        F.octet_length("text").cast("long").alias("raw_size"),
        F.col("text"),
    )


def assign_index(files: DataFrame, key: str = "archive", order: str = "id") -> DataFrame:
    """Add ``idx``, counted from 0 within each archive. Files of equal or no id are told apart by a hash of the row, so that every evaluation counts alike."""
    return running_sum(files, key, order, F.lit(1).cast("long"), "_n", ties=(F.xxhash64(*files.columns),), levels=levels_of(files, order)).withColumn("idx", F.col("_n") - 1).drop("_n")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_path(path: Column) -> Column:
    """The path without leading slashes."""
    return F.ltrim(path, F.lit("/"))


def file_info(uid: Column, gid: Column, mode: Column, mtime: Column) -> Column:
    """The ownership record, present when any of its fields is."""
    return F.when(F.coalesce(uid, gid, mode, mtime).isNotNull(), F.struct(uid.alias("uid"), gid.alias("gid"), mode.alias("mode"), mtime.alias("mtime")))


def expected_hash(digest: Column, size: int) -> Column:
    """A digest given in hexadecimal as bytes; an error for any other length or an odd one."""
    ok = digest.rlike(f"^[0-9A-Fa-f]{{{2 * size}}}$")
    return F.when(digest.isNull(), F.lit(None).cast("binary")).when(ok, F.unhex(digest)).otherwise(F.raise_error(F.concat(F.lit("not a digest: "), digest)).cast("binary"))


def key_policy(data_key: Column, meta_key: Column) -> Column:
    """The policy that a pair of optional keys stands for. A metadata key alone is used for both."""
    same = data_key.isNull() | (data_key == meta_key)
    return F.when(F.coalesce(data_key, meta_key).isNull(), F.lit("none")).when(meta_key.isNull(), F.lit("data_only")).when(same, F.lit("same")).otherwise(F.lit("individual"))


def record_encrypted(policy: Column) -> Column:
    """Whether a policy encrypts the table-of-contents entry itself."""
    return policy.isin("same", "individual")


def policy_keys(policy: Column, data_key: Column, meta_key: Column) -> Column:
    """The distinct keys that a policy uses."""
    none = F.array().cast("array<string>")
    return F.when(policy == "none", none).when(policy == "individual", F.array(data_key, meta_key)).otherwise(F.array(F.coalesce(data_key, meta_key)))


def resolve_links(files: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symlinks with the file their target names, and those whose target does not exist.

    ``files`` has archive, path, idx; ``links`` archive, path, target.
    """
    targets = files.select("archive", F.col("path").alias("target"), F.col("idx").alias("target_idx"))
    return links.join(targets, ["archive", "target"]), links.join(targets, ["archive", "target"], "left_anti")


def verify_digests(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Join computed digests to entries by archive and idx; a digest that is not the expected one is an error."""
    joined = files.join(digests, ["archive", "idx"])
    same = F.col("expected_sha256").isNull() | (F.col("expected_sha256") == F.col("sha256"))
    return joined.withColumn("sha256", F.when(same, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("digest of entry "), F.col("idx").cast("string"), F.lit(" differs")))))


def attach_sizes(files: DataFrame, results: DataFrame) -> DataFrame:
    """Join compression results by archive and idx; a raw size other than announced is an error."""
    joined = files.join(results.withColumnRenamed("raw_size", "seen_size"), ["archive", "idx"])
    wrong = F.raise_error(F.concat(F.lit("size of entry "), F.col("idx").cast("string"), F.lit(" differs"))).cast("long")
    return joined.withColumn("raw_size", F.when(F.col("raw_size") == F.col("seen_size"), F.col("raw_size")).otherwise(wrong)).drop("seen_size")
