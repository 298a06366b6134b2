"""Python tasks must run where the package cannot be imported."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from rankflow.plans.methods import method
from rankflow.session import local_session
spark = local_session(2, **{{"spark.sql.shuffle.partitions": "2"}})
df = spark.range(5000).selectExpr("id % 3 AS g", "id + 1.5D AS v")
for name in ("req", "udds", "moments"):
    assert sorted(r.n for r in method(name).run(df, "v", ["g"]).collect()) == [1666, 1667, 1667]
print("shipped")
"""


def test_tasks_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, timeout=240,
                          capture_output=True, text=True)
    assert "shipped" in done.stdout, done.stderr[-3000:]
