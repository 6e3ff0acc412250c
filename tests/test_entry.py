import subprocess
import sys

CODE = """
import sys, importlib.abc
class Absent(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ("casewright.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert "r3_bm25_search" in e.queries() and "pipeline" not in e.queries() and set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_works_without_the_training_package():
    subprocess.run([sys.executable, "-c", CODE], check=True, cwd=__file__.rsplit("/", 2)[0])
