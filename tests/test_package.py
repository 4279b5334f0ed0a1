"""The package runs from any folder, and without the training-data folder."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=280)


def test_python_workers_find_the_package_from_another_folder(tmp_path):
    code = (f"import sys; sys.path.insert(0, {REPO!r}); import __spark_entry__ as e\n"
            "from pyspark.sql import SparkSession\n"
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
            ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "print('ROWS', e.entry(spark).count())")
    done = _run(code, tmp_path)
    assert "ROWS 7500" in done.stdout, done.stderr[-2000:]


def test_entry_without_the_llm_folder(tmp_path):
    code = ("import importlib.util as u\nreal = u.find_spec\n"
            "u.find_spec = lambda n, *a: None if n == 'cadenza.llm' else real(n, *a)\n"
            f"import sys; sys.path.insert(0, {REPO!r}); import __spark_entry__ as e\n"
            "assert not any(m.startswith('cadenza.llm') for m in sys.modules)\n"
            "print('QUERIES', len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))")
    done = _run(code, tmp_path)
    assert "QUERIES 67 65 False" in done.stdout, done.stderr[-2000:]


def test_checkpoint_folder_is_not_machine_local_on_a_cluster():
    import pytest

    from cadenza.session import checkpoint_root

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="shared folder"):
        checkpoint_root(Session())
