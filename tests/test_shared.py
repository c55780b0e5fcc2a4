import pytest

from cyclewise import shared


class Context:
    def __init__(self, master):
        self.master, self.applicationId = master, f"app-{master}"


class Session:
    def __init__(self, master, configured=None):
        self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": configured}


def test_the_named_folder_is_used():
    assert shared.shared_dir(Session("yarn", "s3a://lake/tmp/")) == "s3a://lake/tmp"


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session("spark://head:7077"))


def test_a_local_session_keeps_its_own_folder():
    session = Session("local[2]")
    assert shared.shared_dir(session) == shared.shared_dir(session)


def test_settled_rows_are_read_from_the_folder(spark):
    df = spark.range(5).selectExpr("id", "id * 2 AS twice")
    kept = shared.settle(df, "numbers")
    assert kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())
    assert all(shared.shared_dir(spark) in f for f in kept.inputFiles())
