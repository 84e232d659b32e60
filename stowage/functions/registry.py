"""Digests and codecs as SQL functions of a session."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import codecs, crypto


def _map(function):
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else function(bytes(x)))

    return run


def digest(name: pd.Series, data: pd.Series) -> pd.Series:
    """Any digest of hashlib by its name, in hexadecimal."""
    return pd.Series([None if n is None or x is None else hashlib.new(n, bytes(x)).hexdigest() for n, x in zip(name, data, strict=True)], dtype=object)


def _keyed(function):
    def run(key: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or x is None else function(bytes(k), bytes(x)) for k, x in zip(key, data, strict=True)], dtype=object)

    return run


def register(spark: SparkSession) -> None:
    """Register ``digest(name, data)``, ``zstd(data)``, ``unzstd(data)``, ``seal(key, data)`` and ``unseal(key, data)``; null gives null, a key that does not fit too."""
    spark.udf.register("digest", F.pandas_udf(digest, "string"))
    spark.udf.register("zstd", F.pandas_udf(_map(codecs.zstd_pack), "binary"))
    spark.udf.register("unzstd", F.pandas_udf(_map(codecs.zstd_unpack), "binary"))
    spark.udf.register("seal", F.pandas_udf(_keyed(crypto.encrypt), "binary").asNondeterministic())
    spark.udf.register("unseal", F.pandas_udf(_keyed(lambda key, x: crypto.decrypt([key], x)), "binary"))
