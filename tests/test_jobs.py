"""The command line from generator to curve, on logs the jobs leave themselves."""

import os
import subprocess
import sys

import pytest

from runwise.__main__ import main
from runwise.sources import read_config_logs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def submit(*args):
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "runwise", *args], capture_output=True, text=True, timeout=300, env=env)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_whole_loop(spark, tmp_path):
    path = {name: str(tmp_path / name) for name in ("people", "out", "events", "configs", "points")}
    os.mkdir(path["events"])
    main(["generate", "--rows", "300", "--format", "csv", "--output", path["people"]])
    out = submit(
        "--event-log-dir", path["events"], "--params", "spark.sql.shuffle.partitions=3;spark.ui.enabled=false",
        "workload", "--format", "csv", "--input", path["people"], "--output", path["out"],
        "--config-log-dir", path["configs"],
    )
    assert "another_surname" in out
    record = read_config_logs(spark, path["configs"]).first().record
    assert record["total_num_rows"] == "300" and record["spark.sql.shuffle.partitions"] == "3"
    assert spark.read.parquet(path["out"]).count() > 300
    main(["analyze", "--event-logs", path["events"], "--config-logs", path["configs"], "--points", path["points"]])
    point = spark.read.parquet(path["points"]).first()
    assert point.rows == 300.0 and point.mem > 0
    main(["trials", "--event-logs", path["events"], "--config-logs", path["configs"]])


def test_profile(spark, sf_dir, capsys):
    main(["profile", "--input", sf_dir])
    assert "total_serialized_size" in capsys.readouterr().out


def test_format_is_checked(capsys):
    with pytest.raises(SystemExit):
        main(["workload", "--format", "orc", "--input", "x"])
