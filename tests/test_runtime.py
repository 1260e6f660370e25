from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from cairn import runtime as R


def test_no_folder_of_one_machine_on_a_cluster():
    sc = SimpleNamespace(master="local-cluster[3,2,1000]", getCheckpointDir=lambda: None)
    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        R.shared_dir(SimpleNamespace(conf=conf, sparkContext=sc))
    sc.master = "spark://host:7077"
    with pytest.raises(ValueError):
        R.shared_dir(SimpleNamespace(conf=conf, sparkContext=sc))


def test_scratch_deletes_what_was_cut_inside(spark):
    with R.scratch(spark):
        df = R.cut(spark.range(3), "t")
        at = [f.removeprefix("file://").removeprefix("file:") for f in df.inputFiles()]
        assert df.count() == 3 and all(map(os.path.exists, at))
    assert at and not any(map(os.path.exists, at))
