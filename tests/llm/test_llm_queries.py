"""Every query of this package with SQL against that SQL."""

import pytest
from oracle_check import DATA, compare, duck

from groundloom.llm.queries import ORACLES, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name]) is None


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_entry_without_this_package():
    """The driver entry works where the package is missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['groundloom.llm'] = None\nimport __spark_entry__ as e; assert 'pack_context' in e.queries() and 'pipeline' not in e.queries()"
    code = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name in ('corpus_pipeline', 'groundloom.llm'):\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())\n" + code.split("\n", 1)[1]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
