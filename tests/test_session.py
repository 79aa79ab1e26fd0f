import os
import subprocess
import sys

from anchorline.session import cut, release

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_release_deletes_what_cut_wrote(spark):
    df = cut(spark.range(10))
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 10
    release(df)
    assert not os.path.exists(path)
    release(spark.range(3))


def test_workers_need_no_package(tmp_path):
    """The repository is on the driver's path only, as where executors don't have the package installed."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from anchorline.session import build_session
from anchorline.plans import evaluate
spark = build_session("local[1]", 1)
print(evaluate.generate(spark.createDataFrame([("a",)], "prompt string"), lambda: lambda texts: [t * 2 for t in texts]).first().response)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("aa"), done.stderr[-2000:]
