"""Intermediate tables: where they lie, what becomes of them, and the session's settings meanwhile."""

import os
import subprocess
import sys
import threading
import time
import types

import pytest

from recordloom.sources import stored as s


def test_tables_are_read_back_and_forgotten(spark):
    table = s.stored(spark.range(10), "some")
    path = table.stored_at.removeprefix("file://")
    assert table.count() == 10 and os.path.isdir(path)
    s.forget(table)
    assert not os.path.isdir(path)


def test_several_threads_share_one_setting(spark):
    before = spark.conf.get(s.CLEAN_UP)
    made = []
    work = [threading.Thread(target=lambda k=k: made.append(s.stored(spark.range(k), f"t{k}").count())) for k in range(1, 6)]
    [w.start() for w in work]
    [w.join() for w in work]
    assert sorted(made) == [1, 2, 3, 4, 5] and spark.conf.get(s.CLEAN_UP) == before


def test_a_local_warehouse_is_no_shared_folder_on_a_cluster():
    def session(master, **conf):
        names = {s.WAREHOUSE_DIR: "file:/tmp/w"} | conf
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: names.get(k, d)), sparkContext=types.SimpleNamespace(master=master))

    assert s.shared_dir(session("local[4]")) == "file:/tmp/w"
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            s.shared_dir(session(master))
        assert s.shared_dir(session(master, **{s.CHECKPOINT_DIR: "hdfs://x/y/"})) == "hdfs://x/y"
        assert s.shared_dir(session(master, **{s.WAREHOUSE_DIR: "hdfs://x/w"})) == "hdfs://x/w"


def test_what_stays_behind_goes_with_the_driver(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from recordloom.sources.stored import stored
from pyspark.sql import functions as F
print("PATH", stored(spark.range(3), "kept").stored_at)
try:
    stored(spark.range(3).select(F.raise_error(F.lit("no"))), "failed")
except Exception:
    print("FAILED")
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=os.environ)
    assert "PATH" in done.stdout and "FAILED" in done.stdout, done.stderr[-2000:]
    left = tmp_path / "recordloom"
    for _ in range(100):
        if not os.path.isdir(left) or not os.listdir(left):
            return
        time.sleep(0.2)
    raise AssertionError(os.listdir(left))
