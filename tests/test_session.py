"""build_session under a submitted configuration (a fresh JVM): the
submitter's master and shuffle partitions win, unset engine settings are
filled in."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from paraspark.session import build_session
s = build_session(shuffle_partitions=12)
print("RESULT", s.sparkContext.master, s.conf.get("spark.sql.shuffle.partitions"),
      s.conf.get("spark.sql.adaptive.skewJoin.enabled"), s.conf.get("spark.ui.enabled"))
s.stop()
"""


def test_submitted_settings_win():
    env = dict(os.environ, PYSPARK_SUBMIT_ARGS="--master local[2] --conf spark.sql.shuffle.partitions=333 pyspark-shell")
    out = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    assert line[0].split()[1:] == ["local[2]", "333", "true", "false"]


def test_cluster_without_checkpoint_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from paraspark.session import ensure_checkpoint_dir

    def session(master, conf):
        sc = SimpleNamespace(master=master, dir=None)
        sc.getCheckpointDir = lambda: sc.dir
        sc.setCheckpointDir = lambda d: setattr(sc, "dir", d)
        sc.getConf = lambda: SimpleNamespace(get=lambda key, default=None: conf.get(key, default))
        return SimpleNamespace(sparkContext=sc)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(session(master, {}))
        assert ensure_checkpoint_dir(session(master, {"spark.checkpoint.dir": "hdfs:///ckpt"})) == "hdfs:///ckpt"
    assert ensure_checkpoint_dir(session("local[4]", {}))
