"""Where intermediates go, and when they are removed."""

import os
from types import SimpleNamespace

import pytest

from paymatch.plans import runtime


def session(master, path=None):
    conf = SimpleNamespace(get=lambda key, default=None: path)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(session("spark://host:7077"))
    assert runtime.shared_dir(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert os.path.isdir(runtime.shared_dir(session("local[2]")))


def test_staged_tables_go_once_nothing_reads_them(spark):
    before = set(runtime.staged())
    one, two = runtime.stage(spark.range(3)), runtime.stage(spark.range(4))
    paths = [p for p in runtime.staged() if p not in before]
    runtime.forget(spark, paths, but=one.where("id > 0"))
    assert [os.path.isdir(p) for p in paths] == [True, False] and one.count() == 3
    runtime.forget(spark, paths)
    assert not set(runtime.staged()) & set(paths) and two.columns == ["id"]


def test_released_tables_are_gone_and_others_stay(spark):
    from paymatch.plans import runtime

    a, b = runtime.stage(spark.range(5)), runtime.stage(spark.range(3))
    before = len(runtime.staged())
    runtime.release(a, a, spark.range(2))
    assert len(runtime.staged()) == before - 1 and b.count() == 3


def test_broadcasts_go_by_measured_size_not_by_compressed_files(spark):
    s = spark.newSession()
    rows = s.range(400_000).selectExpr("concat('C', id % 3) as company_id", "concat('PO-', lpad(cast(id as string), 7, '0')) as po_number",
                                       *[f"repeat('{c}', 200) as note_{c}" for c in "abcdefgh"])
    small = "1048576"  # bytes; the two columns hold some 20 MB, their share of the compressed files is below
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    big, keys = runtime.stage(rows), ["company_id", "po_number"]
    tiny = runtime.stage(s.createDataFrame([("C0", True)], "company_id string, has_import boolean"))
    plan = lambda right, on: s.read.parquet(*big.inputFiles()).join(right, on)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(big.select(*keys), keys)
    runtime.broadcast_by_measured_size(s)
    runtime.broadcast_by_measured_size(s)
    assert "BroadcastHashJoin" not in plan(big.select(*keys), keys)
    assert "BroadcastHashJoin" in plan(tiny, "company_id")
    assert s.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == small


def test_a_session_with_its_own_limits_keeps_them(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    runtime.broadcast_by_measured_size(s)
    assert s.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    runtime.broadcast_by_measured_size(s)
    assert int(s.conf.get("spark.sql.autoBroadcastJoinThreshold")) == 256 * 1024 // runtime.ESTIMATE_FACTOR


def test_the_driver_collects_its_garbage_after_steps_but_not_after_each(spark, monkeypatch):
    calls = []
    context = SimpleNamespace(applicationId="a")
    fake = SimpleNamespace(sparkContext=context, _jvm=SimpleNamespace(System=SimpleNamespace(gc=lambda: calls.append(1))))
    monkeypatch.setattr(runtime.time, "monotonic", lambda: 100.0)
    assert runtime.collect_garbage(fake) and not runtime.collect_garbage(fake)
    monkeypatch.setattr(runtime.time, "monotonic", lambda: 100.0 + runtime.COLLECT_EVERY)
    assert runtime.collect_garbage(fake) and len(calls) == 2
    asked = []
    monkeypatch.setattr(runtime, "collect_garbage", lambda session: asked.append(session))
    runtime.release(runtime.stage(spark.range(2)))
    assert len(asked) == 1
