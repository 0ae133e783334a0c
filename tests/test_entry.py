"""The registry, and that the library stands without the training-data package."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_belongs_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 110


def test_stands_without_the_training_package(tmp_path):
    shutil.copytree(f"{ROOT}/kgspark", tmp_path / "kgspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'g02_orders_with_customers' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_a_missing_dependency_is_an_error(tmp_path):
    """Only the package and the pipeline may be gone; without xxhash the import fails."""
    code = "import sys; sys.modules['xxhash'] = None\ntry:\n import __spark_entry__\nexcept ImportError as e:\n assert e.name == 'xxhash'\nelse:\n import importlib.util as u; assert u.find_spec('kgspark.llm') is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})


def test_nothing_else_imports_the_training_package():
    for folder, _, files in os.walk(f"{ROOT}/kgspark"):
        if "llm" not in folder:
            for name in files:
                if name.endswith(".py"):
                    assert not re.search(r"kgspark\.llm|corpus_pipeline", open(f"{folder}/{name}").read()), name


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
