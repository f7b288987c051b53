"""The package must not have to be importable where the tasks run."""

import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[1])
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pulsewide.session import local_session
spark = local_session("4")
for name in ("c1_pearson", "c2_spearman", "c2_spearman_by_join", "x3_importance"):
    assert entry.queries()[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_jobs_run_from_another_folder(sf, tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=REPO, sf=sf)],
        cwd=tmp_path, capture_output=True, text=True, timeout=600,
    )
    assert "all ran" in done.stdout, done.stderr[-3000:]
