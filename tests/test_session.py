import pytest

from inkprobe import session


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    """Only what the folder rules read."""

    def __init__(self, master="local[2]", named=None):
        self.conf, self.sparkContext = _Conf(), _Context(master)
        if named:
            self.conf["spark.checkpoint.dir"] = named


def test_missing_shared_folder_raises():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session())


def test_local_session_may_name_its_own_folder():
    s = _Session()
    session.name_local_folder(s, "/some/place")
    assert session.shared_dir(s) == "/some/place"


def test_cluster_without_a_folder_raises_and_a_named_one_stays():
    with pytest.raises(RuntimeError):
        session.name_local_folder(_Session("spark://host:7077"), "/some/place")
    s = _Session("spark://host:7077", "hdfs:///shared/")
    session.name_local_folder(s, "/some/place")
    assert session.shared_dir(s) == "hdfs:///shared"


def test_run_folder_lies_below_the_run_and_is_removed(spark):
    table = session.materialize(spark.range(3).toDF("x"), "t")
    assert table.count() == 3 and session.run_root(spark) in table.inputFiles()[0]


PLAIN = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
rows = e.entry(spark).count()
print("ROWS", rows, e.queries()["g6_auc"](spark, "/root/testdata/sf0.001").count())
"""


def test_plain_session_runs_the_flagship_query_and_running_totals():
    """A session that names neither partitions nor a folder, as a user's first one."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", PLAIN], cwd=root, capture_output=True, text=True, timeout=600)
    said = [line for line in ran.stdout.splitlines() if line.startswith("ROWS")]
    assert said and all(int(n) > 0 for n in said[0].split()[1:]), ran.stderr[-2000:]
