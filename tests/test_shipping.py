"""Executors do not have the package: functions sent to tasks have to carry their code."""

import os
import subprocess
import sys

from pyspark import cloudpickle

from graphrecon.operators import compare


def test_task_code_needs_no_package(tmp_path):
    (tmp_path / "code").write_bytes(cloudpickle.dumps(compare._dense))
    program = (
        "import pickle, sys, pandas as pd\n"
        "f = pickle.load(open('code', 'rb'))\n"
        "print(f(pd.Series([[{'bin': 1, 'cnt': 2.0}]]), 3).round(3).tolist())\n"
        "assert 'graphrecon' not in sys.modules\n"
    )
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", program], cwd=tmp_path, env=clean, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "[[0.0, 1.0, 0.0]]"
