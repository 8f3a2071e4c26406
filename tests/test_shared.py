import os

import pytest
from pyspark.sql import functions as F

from brimfold.operators.components import components
from brimfold.plans import shared


class Session:
    """A session of a given master without a shared folder."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, *_):
        return None

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, folder):
        self.folder = folder


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,4,6144]", "k8s://https://host"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(shared.NoSharedFolder):
        shared.shared_dir(Session(master))


def test_one_process_gets_a_folder_that_clean_up_removes(monkeypatch):
    monkeypatch.setattr(shared, "_own_folders", [])
    monkeypatch.setattr(shared, "_written", {})
    folder = shared.shared_dir(Session("local[4]")).removeprefix("file://")
    assert os.path.isdir(folder)
    shared.clean_up()
    assert not os.path.exists(folder)


def test_a_discarded_table_leaves_nothing(spark):
    made = shared.materialize(spark.range(3), "few")
    path = made._brimfold_path.removeprefix("file:").replace("//", "/")
    assert os.path.isdir(path)
    shared.discard(made)
    assert not os.path.exists(path)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (None, 1), (8, 9)], "a bigint, b bigint")
    assert {tuple(r) for r in components(edges, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}
    assert components(edges.where(F.lit(False)), "a", "b").count() == 0
