"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from millrace import session


def fake(master="local[8]", conf=None, held=None):
    option = SimpleNamespace(isDefined=lambda: held is not None, get=lambda: held)
    context = SimpleNamespace(
        master=master,
        getConf=lambda: {},
        _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)),
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf or default))


def test_named_folder_comes_first():
    assert session.shared_dir(fake("spark://x", "hdfs://a/b/", "hdfs://other")) == "hdfs://a/b"


def test_folder_of_the_context_is_used_and_kept():
    assert session.shared_dir(fake("yarn", None, "hdfs://ctx/1")) == "hdfs://ctx/1"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_no_machine_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(fake(master))


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]", "local[4,2]"])
def test_a_temporary_folder_serves_one_machine(master):
    spark = fake(master)
    assert session.shared_dir(spark) == session.shared_dir(spark)
