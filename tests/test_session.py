"""Scratch-location rules: the cluster's spark.checkpoint.dir, never a local
folder on a cluster."""

import pytest

from styleframe import session


class _Conf(dict):
    def get(self, k, d=None):
        return dict.get(self, k, d)


class _SC:
    def __init__(self, master, ckpt=None, conf_dir=None):
        self.master, self._ckpt, self.applicationId = master, ckpt, f"app-{master}-{conf_dir}"
        self._conf = _Conf({"spark.checkpoint.dir": conf_dir} if conf_dir else {})

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self._ckpt

    def setCheckpointDir(self, d):
        self._ckpt = d


class _Spark:
    def __init__(self, sc):
        self.sparkContext = sc


def test_cluster_without_checkpoint_dir_fails():
    with pytest.raises(RuntimeError):
        session.scratch_root(_Spark(_SC("yarn")))


def test_cluster_dir_is_used():
    sc = _SC("yarn", conf_dir="hdfs://shared/ckpt/")
    assert session.scratch_root(_Spark(sc)) == "hdfs://shared/ckpt"
    assert sc.getCheckpointDir() == "hdfs://shared/ckpt/"


def test_local_without_dir_gets_a_scratch_folder(tmp_path):
    sc = _SC("local[2]")
    root = session.scratch_root(_Spark(sc))
    assert root and sc.getCheckpointDir().startswith(root)
