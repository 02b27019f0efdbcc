"""The driver's entry imports whether or not the text subpackage can."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys
for name in {names!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
print(len(entry.queries()), sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"))
"""


def imported(*names: str) -> str:
    run = subprocess.run([sys.executable, "-c", BLOCKED.format(names=names)], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    return run.stdout


def test_without_the_text_subpackage():
    count, names = imported("ratewell.llm").split(" ", 1)
    assert int(count) > 80 and names.strip() == "[]"


def test_without_a_library_of_the_text_subpackage():
    count, names = imported("xxhash").split(" ", 1)
    assert int(count) > 80 and names.strip() == "[]"


def test_without_the_pipeline():
    assert "pipeline" not in imported("corpus_pipeline")
