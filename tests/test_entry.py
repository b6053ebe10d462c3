import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("signalmill.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(k.startswith("op") for k in e.queries()))
"""


def test_the_rest_stands_without_the_corpus_part():
    out = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and int(out[1]) > 40 and out[2] == "False"


def test_every_sql_has_a_query():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(set(s) <= set(q), len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert out[0] == "True"
