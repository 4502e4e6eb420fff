import pytest

from matchloom.sources.staging import shared_dir, stage


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class _Session:
    def __init__(self, **conf):
        self.conf = _Conf(conf)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session(**{"spark.master": "yarn"}))
    with pytest.raises(ValueError):
        shared_dir(_Session(**{"spark.master": "local-cluster[2,1,1024]"}))
    assert shared_dir(_Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    assert shared_dir(_Session(**{"spark.master": "local[4]"}))


def test_staged_tables_lie_there(spark):
    staged = stage(spark.range(10), "numbers")
    assert staged.count() == 10
    assert all(f.startswith(spark.conf.get("spark.checkpoint.dir")) for f in staged.inputFiles())
