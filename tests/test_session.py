import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from ledgerscope import session


def fake(master, configured):
    settings = {} if configured is None else {"spark.checkpoint.dir": configured}

    def fixed(*_):
        raise AssertionError("a running session's folder cannot be set")

    conf = SimpleNamespace(get=settings.get, set=fixed)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_shared_folder_is_taken_from_the_session():
    assert session.work_dir(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.scratch_path(fake("yarn", "hdfs:///shared"), "pairs").startswith("hdfs:///shared/ledgerscope/app/pairs-")


def test_a_cluster_never_uses_a_local_folder():
    with pytest.raises(ValueError):
        session.work_dir(fake("yarn", None))


def test_a_local_run_keeps_its_own_folder():
    spark = fake("local[2]", None)
    assert session.work_dir(spark) == session.work_dir(spark)


def test_intermediate_tables_are_files(spark):
    df = session.materialize(spark.range(5).withColumnRenamed("id", "n"), "numbers")
    assert df.count() == 5 and df.inputFiles()
    assert "numbers-" in df.inputFiles()[0] and spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]


def test_a_real_local_session_without_settings(tmp_path):
    code = (
        "from ledgerscope.session import build_session, materialize\n"
        "spark = build_session('plain', 'local[1]', **{'spark.ui.enabled': 'false'})\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "one, two = (materialize(spark.range(n), 'n') for n in (3, 4))\n"
        "assert one.count() == 3 and two.count() == 4\n"
        "assert one.inputFiles()[0].split('/ledgerscope/')[0] == two.inputFiles()[0].split('/ledgerscope/')[0]\n"
        "spark.stop()\n"
    )
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
