import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from grove.plans import catalogue
from tests.compare import compare, duck

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, con, name):
    assert compare(spark, con, catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_the_rest_works_without_the_optional_part(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    if "corpus_pipeline.py" not in gone:
        (tmp_path / "repo" / "grove" / "llm" / "__pycache__").mkdir(parents=True)  # what deleting sources may leave
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout
    assert said.split() == [str(len(catalogue.queries())), "False"]
    for path in (ROOT / "grove").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path


def test_a_missing_library_of_the_optional_part_is_told_and_the_rest_works():
    if not (ROOT / "grove" / "llm").exists():
        pytest.skip("no optional part")
    run = "import sys, warnings; sys.modules['zstandard'] = None; warnings.simplefilter('error'); "
    said = subprocess.run([sys.executable, "-c", run + "import __spark_entry__"], cwd=ROOT, capture_output=True, text=True)
    assert "zstandard" in said.stderr and said.returncode
    said = subprocess.run([sys.executable, "-c", run.replace("'error'", "'ignore'") + "import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalogue.queries()))]
