"""Where written tables go."""

import pytest

from tessera.errors import EngineError
from tessera.sources import scratch


class Session:
    def __init__(self, **settings):
        self.conf = {name.replace("_", "."): value for name, value in settings.items()}


def test_a_cluster_needs_a_shared_folder():
    assert scratch.shared_dir(Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host", ""):
        with pytest.raises(EngineError):
            scratch.shared_dir(Session(spark_master=master))
    assert scratch.shared_dir(Session(spark_master="local[8]")).startswith("file:///")
    paths = {scratch.new_path(Session(spark_master="local"), "t") for _ in range(3)}
    assert len(paths) == 3
