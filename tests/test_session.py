"""Shared folder and runtime settings."""

from eventclime.session import prepare, scratch_path, shared_dir


def test_shared_dir_comes_from_the_session(spark):
    conf = spark.conf.get("spark.checkpoint.dir", None)
    d = shared_dir(spark)
    if conf:
        assert d == conf.rstrip("/")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_scratch_paths_are_fresh_and_under_the_shared_dir(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b
    assert a.startswith(shared_dir(spark) + "/eventclime-scratch/x-")


def test_prepare_sets_utc_and_adaptive_execution(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    prepare(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_a_cluster_without_a_shared_folder_is_an_error():
    import pytest

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
