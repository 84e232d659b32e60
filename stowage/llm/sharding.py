"""Shards by extendible hashing.

The directory is indexed by leading bits of a row hash. Every bucket starts
whole, and only a bucket over the byte limit is split on its next bit. The
splits are found from a histogram over the first ``D`` bits, summed up the
tree level by level, so documents are read once for the histogram and once
for the assignment, however deep the directory gets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import broadcast_if_small, materialise
from .common import ROW_KEY_SQL, hash_bits, row_key, table

BITS = 60
LIMIT = 64 << 20


def shard_documents(docs: DataFrame, limit_bytes: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", first_bits: int | None = None, step_bits: int = 12, most_broadcast: int = 200_000) -> DataFrame:
    """Assign every row to a shard of at most ``limit_bytes`` bytes of text.

    Returns ``id_col, n_bytes, shard, depth, oversize``: ``shard`` is the
    bucket's bit string ('' for an undivided table), ``depth`` its length.
    The hash covers id and text, so a repeated or null id is not a hot key.
    Only rows equal in id and text share a hash to the last bit; when such
    rows, or a single document, exceed the limit alone, their shard cannot be
    divided and is marked ``oversize``. Null texts count as zero bytes, a
    very long text by its whole length. Other columns are left out, whatever
    their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), hash_bits(row_key(id_col, text_col), BITS).alias("_x1_h"))
    total = docs.select(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    bits = first_bits or min(BITS, max(1, math.ceil(math.log2(max(1, total / limit_bytes))) + 6))

    leaves, todo, below = None, sized, 0
    while True:
        cell = F.shiftright(F.col("_x1_h"), BITS - bits).alias("_x1_cell")
        cells = todo.groupBy(cell).agg(F.sum("n_bytes").alias("_x1_b"), F.min("_x1_h").alias("_x1_lo"), F.max("_x1_h").alias("_x1_hi"))
        cells = materialise(cells, f"cells{bits}")
        up = F.expr(f"explode(sequence({below}, {bits}))")
        tree = cells.select("_x1_cell", "_x1_b", "_x1_lo", "_x1_hi", up.alias("_x1_d")).withColumn("_x1_p", F.expr(f"shiftright(_x1_cell, {bits} - _x1_d)"))
        sums = tree.groupBy("_x1_d", "_x1_p").agg(F.sum("_x1_b").alias("_x1_sum"), F.min("_x1_lo").alias("_x1_min"), F.max("_x1_hi").alias("_x1_max"))
        # A bucket ends the descent when it fits or when its rows share one hash.
        ends = sums.where((F.col("_x1_sum") <= limit_bytes) | (F.col("_x1_min") == F.col("_x1_max")))
        found = (
            tree.select("_x1_cell", "_x1_d", "_x1_p")
            .join(ends, ["_x1_d", "_x1_p"])
            .groupBy("_x1_cell")
            .agg(F.min(F.struct("_x1_d", "_x1_p", (F.col("_x1_sum") > limit_bytes).alias("_x1_over"))).alias("_x1_leaf"))
            .select(F.lit(bits).alias("_x1_bits"), "_x1_cell", "_x1_leaf.*")
        )
        leaves = materialise(found if leaves is None else leaves.unionByName(found), f"leaves{bits}")
        rest = cells.join(leaves.where(F.col("_x1_bits") == bits), "_x1_cell", "left_anti").select("_x1_cell")
        if bits >= BITS or rest.isEmpty():
            break
        todo = todo.withColumn("_x1_cell", cell).join(broadcast_if_small(rest, most_broadcast), "_x1_cell", "left_semi").drop("_x1_cell")
        below, bits = bits + 1, min(BITS, bits + step_bits)

    levels = sorted(r[0] for r in leaves.select("_x1_bits").distinct().collect())
    out, leaves = None, broadcast_if_small(leaves, most_broadcast)
    keyed = sized.withColumn("_x1_at", F.explode(F.array(*[F.struct(F.lit(b).alias("_x1_bits"), F.shiftright(F.col("_x1_h"), BITS - b).alias("_x1_cell")) for b in levels]))) if levels else sized.withColumn("_x1_at", F.struct(F.lit(0).alias("_x1_bits"), F.col("_x1_h").alias("_x1_cell")))
    out = keyed.select(id_col, "n_bytes", "_x1_at.*").join(leaves, ["_x1_bits", "_x1_cell"])
    name = F.when(F.col("_x1_d") == 0, F.lit("")).otherwise(F.expr("lpad(bin(_x1_p), _x1_d, '0')"))
    return out.select(id_col, "n_bytes", name.alias("shard"), F.col("_x1_d").cast("int").alias("depth"), F.col("_x1_over").alias("oversize"))


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each shard to a folder ``shard=b<bits>`` below ``path``; a task holds one shard or several, each within the limit."""
    names = shard_documents(docs, limit_bytes, id_col, text_col).select(F.col(id_col).alias("_x1_id"), F.concat(F.lit("b"), "shard").alias("shard")).distinct()
    joined = docs.join(names, docs[id_col].eqNullSafe(names["_x1_id"])).drop("_x1_id")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH h AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  ('0x' || substr(md5({ROW_KEY_SQL}), 1, 15))::BIGINT AS h FROM documents),
t AS (SELECT d, h >> CAST(60 - d AS BIGINT) AS p, sum(n_bytes) AS b FROM h, (SELECT CAST(range AS BIGINT) AS d FROM range(0, 25)) GROUP BY 1, 2),
leaf AS (SELECT t.d, t.p FROM t LEFT JOIN t u ON u.d = t.d - 1 AND u.p = t.p >> 1
         WHERE t.b <= {LIMIT} AND (t.d = 0 OR u.b > {LIMIT}))
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(p), 60, '0'), CAST(d AS INTEGER)) END AS shard, CAST(d AS INTEGER) AS depth, false AS oversize
FROM h JOIN leaf ON h >> CAST(60 - d AS BIGINT) = p
"""
