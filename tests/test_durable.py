"""The shared folder on a session that names none, and the life of intermediates."""

import os
import subprocess
import sys

import pytest

from kmerloom import durable

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

STOCK = """
import sys
sys.path.insert(0, {root!r})
from kmerloom.session import local_session
from kmerloom import durable
spark = local_session(2, "1g", 2)
assert not spark.conf.get("spark.checkpoint.dir", None)
df = durable.materialise(spark.range(5), "x")
assert df.count() == 5 and durable.shared_dir(spark) == durable.shared_dir(spark)
print("good")
"""


def test_stock_session_without_a_folder(tmp_path):
    """An empty configuration folder: nothing sets spark.checkpoint.dir."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", STOCK.format(root=ROOT)], env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("good"), run.stderr[-2000:]


class FakeConf:
    def get(self, key, default=None):
        return default


class FakeSession:
    conf = FakeConf()

    class sparkContext:
        master = "spark://host:7077"
        applicationId = "a"


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_dir(FakeSession())


def test_intermediates_end_with_their_block(spark):
    with durable.intermediates(spark):
        kept = durable.materialise(spark.range(3), "x")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
