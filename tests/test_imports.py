"""The library imports and registers its queries without the optional corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("lynceus.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
assert len(entry.queries()) > 100 and "pipeline" not in entry.queries()
assert not [n for n in sys.modules if n.startswith("lynceus.llm")]
"""


def test_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for path in ROOT.glob("lynceus/**/*.py"):
        if "llm" not in path.parts:
            assert "lynceus.llm" not in path.read_text(), path


def test_no_session_is_needed_to_import():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=ROOT, check=True)
