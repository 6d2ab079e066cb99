from types import SimpleNamespace

import pytest

from ledgerloom.session import SETTINGS, scratch_dir


def _session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: folder if name == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_settings_are_in_force(spark):
    for name, value in SETTINGS.items():
        assert spark.conf.get(name) == value


def test_scratch_lies_in_the_shared_folder():
    first = scratch_dir(_session("spark://host:7077", "s3://shared/"), "model")
    assert first.startswith("s3://shared/model-")
    assert first != scratch_dir(_session("spark://host:7077", "s3://shared/"), "model")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError):
        scratch_dir(_session("yarn"), "model")


def test_only_one_process_may_use_a_local_folder(tmp_path):
    assert scratch_dir(_session("local[2]"), "model", str(tmp_path)).startswith(f"{tmp_path}/model-")
    for master in ("local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            scratch_dir(_session(master), "model", str(tmp_path))
    with pytest.raises(ValueError):
        scratch_dir(_session("local[2]"), "model")
