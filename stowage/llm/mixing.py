"""Mixing sources to target weights by Poisson replication.

Every source has a repetition rate: its target share of the output volume over
its volume in the input. A document is repeated as often as a Poisson variable
with that mean says, where the variable is the inverse distribution function
at a uniform number hashed from seed and row. No draw depends on partitioning
or on other rows, so a rerun after a lost executor repeats it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .common import ROW_KEY_SQL, hash_bits, row_key, table

SEED = 20240601
#: Rates above this are drawn as a sum of parts, each at most this large.
PART = 32.0


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per source: ``source, volume, rate``. Without ``weights`` all sources get equal shares; a source that is not in ``weights`` gets none. Volume is bytes of text, and a source without any has rate 0."""
    vol = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0)).alias("volume"))
    if weights is None:
        vol = vol.withColumn("_x5_w", F.lit(1.0))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        vol = vol.withColumn("_x5_w", F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0))
    vol = materialise(vol, "volumes")
    share = vol.where("volume > 0").agg(F.sum("volume"), F.sum("_x5_w")).first()
    total, weight = float(share[0] or 0), float(share[1] or 0)
    rate = F.when(F.col("volume") > 0, F.lit(epochs * total / weight if weight else 0.0) * F.col("_x5_w") / F.col("volume")).otherwise(F.lit(0.0))
    return vol.select("source", "volume", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_broadcast: int = 20_000) -> DataFrame:
    """Repeat and drop documents so that sources reach their target shares, in a globally shuffled order.

    Returns the columns of ``docs`` with ``mix_copy`` (from 1) and
    ``mix_key``, by which the rows are sorted across partitions (input
    columns of those names are replaced). A null source is a source of its
    own; null texts have no volume; a very long text counts by its whole
    length; a null id still draws from its text. Rows equal in id and text
    draw alike. An empty table gives an empty result.

    The rate of a source has no bound: one that is far smaller than its share
    is repeated as often as that takes. Lower ``epochs`` or the source's weight
    where that is not wanted.
    """
    columns = [c for c in docs.columns if c not in ("mix_copy", "mix_key")]
    rates = source_rates(docs, weights, epochs, source_col, text_col)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    last = F.ceil(F.col("_x5_l") + 12 * F.sqrt("_x5_l") + 40).cast("int")
    step = lambda a, j: F.struct((a["p"] * F.col("_x5_l") / j).alias("p"), F.concat(a["cdf"], F.array(a["cdf"][F.size(a["cdf"]) - 1] + a["p"] * F.col("_x5_l") / j)).alias("cdf"))
    zero = F.struct(F.exp(-F.col("_x5_l")).alias("p"), F.array(F.exp(-F.col("_x5_l"))).alias("cdf"))
    rates = (
        rates.withColumn("_x5_parts", parts)
        .withColumn("_x5_l", F.col("rate") / F.col("_x5_parts"))
        .select(F.col("source").alias("_x5_source"), "_x5_parts", F.aggregate(F.sequence(F.lit(1), last), zero, step)["cdf"].alias("_x5_cdf"))
    )
    rates = materialise(rates, "rates")
    rows = docs.select(*columns, row_key(id_col, text_col).alias("_x5_row"))
    match = F.col(source_col).eqNullSafe(F.col("_x5_source"))
    if rates.count() <= most_broadcast:
        drawn = rows.join(F.broadcast(rates), match)
    else:  # too many sources to broadcast: a hot one is dealt over 64 keys
        drawn = rows.withColumn("_x5_salt", F.pmod(F.xxhash64("_x5_row"), F.lit(64))).join(rates.withColumn("_x5_salt2", F.explode(F.sequence(F.lit(0), F.lit(63)))), match & (F.col("_x5_salt") == F.col("_x5_salt2")))
    uniform = lambda j: hash_bits(F.concat(F.lit(f"{seed}:"), j.cast("string"), F.lit(":"), F.col("_x5_row")), 52) / F.lit(float(2**52))
    below = lambda u: F.size(F.filter("_x5_cdf", lambda c: c <= u))
    one = F.transform(F.array(uniform(F.lit(1))), below)[0]
    several = F.aggregate(F.sequence(F.lit(1), F.col("_x5_parts")), F.lit(0), lambda a, j: a + F.transform(F.array(uniform(j)), below)[0])
    count = F.when(F.col("_x5_parts") == 1, one).otherwise(several)
    copies = drawn.withColumn("_x5_n", count).where("_x5_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("_x5_n"))))
    keyed = copies.withColumn("mix_key", hash_bits(F.concat(F.lit(f"{seed}:order:"), F.col("mix_copy").cast("string"), F.lit(":"), F.col("_x5_row")), 60))
    # Equal rows have equal keys; their place of origin keeps them divisible.
    keyed = keyed.withColumn("_x5_tie", F.monotonically_increasing_id())
    return keyed.select(*columns, "mix_copy", "mix_key", "_x5_tie").orderBy("mix_key", "_x5_tie").drop("_x5_tie")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH d AS (SELECT *, {ROW_KEY_SQL} AS k FROM documents),
v AS (SELECT source AS s, CAST(sum(strlen(text)) AS DOUBLE) AS volume FROM documents GROUP BY source),
r AS (SELECT s, (SELECT sum(volume) FROM v) / (SELECT count(*) FROM v) * 1.0 / volume AS l FROM v),
f AS (SELECT s, j, sum(exp(-l + j * ln(l) - lf)) OVER (PARTITION BY s ORDER BY j) AS cdf
      FROM r, (SELECT j, sum(ln(CASE WHEN j = 0 THEN 1 ELSE j END)) OVER (ORDER BY j) AS lf FROM (SELECT CAST(range AS DOUBLE) AS j FROM range(0, 120)))),
u AS (SELECT d.*, ('0x' || substr(md5('{SEED}:1:' || k), 1, 13))::BIGINT / 4503599627370496.0 AS x FROM d),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.k, count(*) AS n FROM u JOIN f ON u.source = f.s AND f.cdf <= u.x GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS mix_copy, ('0x' || substr(md5('{SEED}:order:' || CAST(c AS VARCHAR) || ':' || k), 1, 15))::BIGINT AS mix_key
FROM n JOIN (SELECT range AS c FROM range(1, 200)) ON c <= n
"""
