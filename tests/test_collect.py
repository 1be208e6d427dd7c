"""The whole suite is collected in one run: no two test modules or helpers share a name."""

import os
import subprocess
import sys

TESTS = os.path.dirname(os.path.abspath(__file__))


def test_everything_is_collected():
    run = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", TESTS],
                         capture_output=True, text=True, cwd=os.path.dirname(TESTS), timeout=300)
    assert run.returncode == 0, run.stdout[-3000:] + run.stderr[-3000:]
    found = run.stdout
    assert all(f"tests/{m}.py::" in found for m in ("test_oracle", "test_plans", "test_streams", "test_session"))
