"""Column expressions that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the fast built-in; others a code point table."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(id_col: str, text_col: str) -> Column:
    """Identity of a row: its id and a digest of its text, so that one repeated or missing id is not one key."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


#: The same in SQL.
ROW_KEY_SQL = "coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))"


def hash_bits(text: Column, bits: int) -> Column:
    """The first ``bits`` bits (a multiple of 4, at most 60) of the MD5 of ``text`` as a long."""
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def words_of(text: Column) -> Column:
    """The runs of characters other than space and \\t-\\r, as an array; null counts as no words.

    Single-character separators keep the split off the regular expression engine.
    """
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body)[0]
