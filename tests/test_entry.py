import os
import shutil
import subprocess
import sys

import __spark_entry__ as entries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship_has_rows(spark):
    assert entries.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entries.oracle_sql()) <= set(entries.queries())


def test_imports_without_the_text_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[1:] == ["False", "False"] and int(said.stdout.split()[0]) > 100


def test_python_functions_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from loomwright.session import build_session
s = build_session('elsewhere', 'local[2]', 2)
print('rows', e.queries()['budget_admission'](s, '/root/testdata/sf0.001').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env=env)
    assert "rows 200" in said.stdout, said.stderr[-2000:]
