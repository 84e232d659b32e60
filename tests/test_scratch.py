"""Tables in the shared folder."""

import os
from types import SimpleNamespace

import pytest

from stowage.plans import scratch


def test_tables_are_written_read_and_deleted(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    out = scratch.materialise(df, "numbers")
    assert out.dtypes == df.dtypes and out.count() == 10
    folder = os.path.dirname(out._scratch_path.removeprefix("file://"))
    assert os.path.isdir(folder)
    scratch.discard(out)
    assert not os.path.exists(folder)
    scratch.discard(df)
    scratch.discard(None)


def test_the_sessions_folder_is_used():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "store://shared/" if key == "spark.checkpoint.dir" else default), sparkContext=SimpleNamespace(applicationId="app"))
    assert scratch.shared_dir(session) == "store://shared"
    assert scratch.new_path(session, "x").startswith("store://shared/stowage-")


def test_broadcast_needs_a_small_table(spark):
    df = spark.range(10)
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString() or "UnresolvedHint" in x._jdf.queryExecution().logical().toString()
    assert hinted(scratch.broadcast_if_small(df, 10)) and not hinted(scratch.broadcast_if_small(df, 9))


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.shared_dir(Session)


def test_tables_are_deleted_at_the_end(spark):
    df = scratch.materialise(spark.range(3), "x")
    assert df.count() == 3
    home = df._scratch_path.rpartition("/")[0].rpartition("/")[0].removeprefix("file://")
    assert os.path.isdir(home)
    scratch.clean(spark)
    assert not os.path.exists(home)
