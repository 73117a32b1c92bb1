"""The driver's contract: what it imports needs no session, and every SQL has its query."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_needs_no_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100; print(len(q))"], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
