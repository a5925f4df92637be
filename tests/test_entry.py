"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) == 10
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline_stays", [False, True])
def test_import_without_the_optional_folders(tmp_path, pipeline_stays):
    shutil.copytree(f"{ROOT}/pixelmill", tmp_path / "pixelmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if pipeline_stays and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert found.returncode == 0, found.stderr
    many, sql = map(int, found.stdout.split()[-2:])
    assert many == sql > 100  # each query of the raster engine has SQL
