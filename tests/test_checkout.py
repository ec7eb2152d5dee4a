"""The library without its training-data folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROBE = """
import __spark_entry__ as entry
from packetloom.plans.oracles import ORACLES
from packetloom.plans.queries import REGISTRY
from packetloom.session import local_session

assert entry.queries().keys() == REGISTRY.keys(), entry.queries().keys() ^ REGISTRY.keys()
assert entry.oracle_sql() == ORACLES
spark = local_session("2", 2)
print("rows", entry.entry(spark).count())
"""


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_runs_without_the_training_data_folders(tmp_path, pipeline_stays):
    copy = tmp_path / "copy"
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline_stays else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=left_out)
    run = subprocess.run(
        [sys.executable, "-c", PROBE], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300
    )
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout.split("rows")[-1]) > 0
