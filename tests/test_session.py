"""Session helpers, and the repository without its corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

from lexweave import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

ALONE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert names and set(e.oracle_sql()) <= names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, pipeline):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "tests", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    assert not (tmp_path / "repo" / "lexweave" / "llm").exists()
    done = subprocess.run([sys.executable, "-B", "-c", ALONE], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-2000:]


def test_materialized_tables_are_released(spark):
    kept = session.materialize(spark.range(5).toDF("x"), "t")
    folder = kept.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert kept.count() == 5 and os.path.isdir(folder)
    session.release(spark)
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())
