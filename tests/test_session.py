"""Checkpoint-folder rules: never a machine-local folder off local mode."""
import pytest

from epicohort.session import cluster_conf, ensure_checkpoint_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _SC:
    def __init__(self, master, current=None):
        self.master, self.current, self.set_to = master, current, None

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.set_to = path


class _Spark:
    def __init__(self, master, conf_value=None, current=None):
        self.sparkContext = _SC(master, current)
        self.conf = _Conf(conf_value)


def test_refuses_local_folder_on_cluster():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Spark("yarn"))


def test_uses_configured_shared_folder():
    s = _Spark("yarn", conf_value="hdfs:///shared/ckpt")
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.set_to == "hdfs:///shared/ckpt"


def test_local_mode_gets_scratch_folder():
    s = _Spark("local[2]")
    path = ensure_checkpoint_dir(s)
    assert path and s.sparkContext.set_to == path


def test_cluster_conf_enables_aqe_skew_handling():
    c = cluster_conf()
    assert c["spark.sql.adaptive.enabled"] == "true" and c["spark.sql.adaptive.skewJoin.enabled"] == "true"
