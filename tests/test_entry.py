"""The entry works without the optional subpackage, whether or not the pipeline that needs it is left in place."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'run_statistics' in e.queries())"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_without_the_optional_subpackage(tmp_path, pipeline_stays):
    shutil.copytree(os.path.join(ROOT, "cargofile"), tmp_path / "cargofile", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = ["__spark_entry__.py"] + (["corpus_pipeline.py"] if pipeline_stays else [])
    for name in (n for n in names if os.path.exists(os.path.join(ROOT, n))):
        shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    out = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    count, with_sql, flagship = out.stdout.split()
    assert int(count) >= 63 and int(with_sql) >= 60 and flagship == "True"
