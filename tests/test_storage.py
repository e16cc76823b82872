from types import SimpleNamespace

import pytest

from arborseed.storage import shared_dir


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://host"])
def test_a_cluster_needs_a_shared_folder(master):
    asked = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(asked)
    asked.conf = SimpleNamespace(get=lambda *a: "hdfs://x/y")
    assert shared_dir(asked) == "hdfs://x/y"
