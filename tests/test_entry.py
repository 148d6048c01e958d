import subprocess
import sys

from paths import ROOT


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10


def test_sql_is_of_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 50


def test_the_subpackage_is_optional():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("fitspark.llm", "corpus_pipeline")):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), any(n.startswith("op") or n == "pipeline" for n in e.queries()))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, any_left = done.stdout.split()
    assert int(n) >= 50 and any_left == "False"


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "fitspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "fitspark.llm" not in path.read_text(), path
