"""The package reaches workers from any directory; a broken training-data import is not hidden."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str, cwd, **env):
    e = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | env
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env=e, capture_output=True, text=True, timeout=300)


def test_python_functions_run_from_another_directory(tmp_path):
    base = "/root/testdata/sf0.001"
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.queries()["cross_ref_extract"](spark, {base!r}).count())
"""
    got = run(code, tmp_path)
    assert "ROWS" in got.stdout, got.stderr[-2000:]


def test_broken_import_is_raised(tmp_path):
    (tmp_path / "xxhash.py").write_text("import a_module_that_does_not_exist\n")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {ROOT!r}]\nimport __spark_entry__ as e\nprint(len(e.queries()))"
    if os.path.isdir(os.path.join(ROOT, "reqloom", "llm")):
        assert "a_module_that_does_not_exist" in run(code, tmp_path).stderr


def test_no_temporary_folder_on_a_cluster():
    import pytest

    from reqloom.sources.tables import shared_dir

    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class S:
                        @staticmethod
                        def getCheckpointDir():
                            class O:
                                isDefined = staticmethod(lambda: False)

                            return O

                    return S

    with pytest.raises(RuntimeError):
        shared_dir(Unset)


def test_written_tables_can_be_dropped(spark):
    from reqloom.sources.tables import Scratch, drop_written

    drop_written(spark)
    x = Scratch(spark)
    assert x.save(spark.range(5)).count() == 5 and os.path.isdir(x.root.removeprefix("file:"))
    assert drop_written(spark) == 1 and not os.path.isdir(x.root.removeprefix("file:")) and drop_written(spark) == 0
