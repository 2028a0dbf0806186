"""The entry without the subpackage of pipeline operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDDEN = """
import importlib.abc, importlib.util, sys

class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("cellcast.llm"):
            raise ModuleNotFoundError(name=name)

found = importlib.util.find_spec
importlib.util.find_spec = lambda n, p=None: None if n in HIDDEN else found(n, p)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry

names = set(entry.queries()) | set(entry.oracle_sql())
assert len(names) > 200 and "pipeline" not in names and not any(n.startswith("op") for n in names)
"""


def test_entry_without_the_llm_folders():
    for hidden in ({"cellcast.llm"}, {"cellcast.llm", "corpus_pipeline"}):
        code = f"HIDDEN = {hidden!r}\n{HIDDEN}"
        done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
