import pytest

import __spark_entry__
from tallyframe import queries as engine
from tests.conftest import SF, assert_same_rows


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert_same_rows(engine.QUERIES[name](spark, SF), duck, engine.ORACLE_SQL[name])


def test_queries_without_sql_run(spark):
    for name in engine.QUERIES.keys() - engine.ORACLE_SQL.keys():
        assert engine.QUERIES[name](spark, SF).count() > 0


def test_entry_contract(spark):
    assert __spark_entry__.entry(spark).columns
    assert engine.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_entry_imports_without_the_llm_folders(tmp_path):
    """The driver deletes corpus_pipeline.py and the llm folders; the other queries stay."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "tallyframe", tmp_path / "tallyframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q, len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
