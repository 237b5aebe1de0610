from types import SimpleNamespace

import pytest

from orebed.session import new_workspace, shared_root


def session(master, folder=None):
    """As much of a session as choosing a folder looks at."""
    conf = SimpleNamespace(get=lambda key, default=None: folder or default)
    context = SimpleNamespace(master=master, applicationId="app-" + master[:5])
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_cluster_names_the_folder():
    spark = session("spark://host:7077", "s3a://bucket/scratch/")
    assert shared_root(spark) == "s3a://bucket/scratch"
    assert new_workspace(spark, "sums").startswith("s3a://bucket/scratch/orebed/app-spark/sums-")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(session("yarn"))


def test_local_session_has_one_folder():
    spark = session("local[2]")
    assert shared_root(spark) == shared_root(spark)
