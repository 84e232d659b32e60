"""Tables read as streams."""

from pyspark.sql import functions as F

from stowage.queries import QUERIES
from stowage.streaming.files import stream_sizes


def sizes(df):
    return {r["archive"]: (r["n_files"], r["bytes"]) for r in df.collect()}


def test_documents_in_a_folder(spark, sf_dir, tmp_path):
    """A table of one file and the same one as a folder of several, with other tables and files beside it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["source"]: (r["n"], r["b"]) for r in docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}
    assert sizes(QUERIES["stream_size"](spark, sf_dir)) == want
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(7).write.parquet(f"{tmp_path}/labels.parquet")
    assert sizes(QUERIES["stream_size"](spark, str(tmp_path))) == want


def test_one_file_among_others(spark, sf_dir, tmp_path):
    """Names that look like patterns, or have no ending, stand for one file only."""
    data = open(f"{sf_dir}/documents.parquet", "rb").read()
    for name in ("doc{a,b}", "doca", "docb", "x.parquet"):
        (tmp_path / name).write_bytes(data)
    want = sizes(QUERIES["stream_size"](spark, sf_dir))
    assert sizes(stream_sizes(spark, f"{tmp_path}/x.parquet")) == sizes(stream_sizes(spark, f"{tmp_path}/doca")) == want


def test_no_rows(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert sizes(QUERIES["stream_size"](spark, str(tmp_path))) == {}
