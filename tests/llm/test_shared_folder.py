"""Without a shared folder only a local master may take a temporary one."""

import pytest

pytest.importorskip("limen.llm")

from limen.llm import common  # noqa: E402


class Unset:
    def get(self, key, default=None):
        return default

    def set(self, key, value):
        self.kept = key, value


class Session:
    def __init__(self, master):
        self.conf, self.sparkContext = Unset(), self
        self.master = master

    def getConf(self):  # noqa: N802  named as Spark's
        return self.conf

    def setCheckpointDir(self, path):  # noqa: N802
        self.path = path


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_needs_one(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(master))


def test_a_local_master_takes_a_temporary_one():
    s = Session("local[4]")
    assert common.shared_dir(s) == s.path.rstrip("/") and s.conf.kept == ("spark.checkpoint.dir", s.path)
