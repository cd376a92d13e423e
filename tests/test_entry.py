"""The driver's entry: queries of the tape stand without the llm subpackage and without the packages that only it needs."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import importlib.abc, sys, warnings
class Hidden(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {root!r})
with warnings.catch_warnings(record=True) as seen:
    warnings.simplefilter("always")
    import __spark_entry__ as e
    names, sql = set(e.queries()), set(e.oracle_sql())
print(len(names), len([n for n in names if n.startswith("op")]), sql <= names, "bars" in names, any("no llm" in str(w.message) for w in seen))
"""


def run(hidden):
    out = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden, root=ROOT)], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_without_a_package_that_llm_needs():
    n, ops, sql, bars, warned = run("regex")
    there = os.path.exists(os.path.join(ROOT, "tapeworks", "llm", "registry.py"))  # the subpackage may be taken away
    assert (ops, sql, bars, warned) == ("0", "True", "True", str(there)) and int(n) > 70


def test_a_fault_of_the_library_itself_is_not_hidden():
    out = subprocess.run([sys.executable, "-c", HIDE.format(hidden="tapeworks", root=ROOT)], capture_output=True, text=True)
    assert out.returncode
