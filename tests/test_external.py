"""The external formats: pages, errors, and batches that are written once."""

import json
import os

import pytest

from provark.sources import external


def test_graph_pages(spark, tmp_path):
    external.register(spark)
    edges = [{"src": f"a{i}", "dst": f"b{i}", "kind": "CALLS", "confidence": i / 10} for i in range(10)]
    for p in range(3):
        (tmp_path / f"edges-{p}.jsonl").write_text("\n".join(json.dumps(e) for e in edges[p::3]) + "\n\n")
    (tmp_path / "nodes-0.jsonl").write_text('{"uid": "a0", "name": null, "extra": 1}\n')
    read = lambda **o: spark.read.format("provider_graph").option("path", str(tmp_path)).options(**o).load()
    assert read(rows=2).rdd.getNumPartitions() == 3
    assert sorted(r.src for r in read(rows=2).collect()) == sorted(e["src"] for e in edges)
    assert [tuple(r) for r in read(table="nodes").collect()] == [("a0", None, None)]
    (tmp_path / "edges-9.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        read().collect()
    with pytest.raises(Exception, match="no page of edges"):
        spark.read.format("provider_graph").option("path", str(tmp_path / "..")).load().collect()


def test_matching_rows(spark, tmp_path):
    external.register(spark)
    edges = [{"src": f"a{i}", "dst": f"b{i % 4}", "kind": "CALLS" if i % 3 else "IMPORTS", "confidence": None} for i in range(60)]
    for p in range(3):
        (tmp_path / f"edges-{p}.jsonl").write_text("\n".join(json.dumps(e) for e in edges[p::3]))
    want = {e["src"] for e in edges if e["kind"] == "CALLS" and e["dst"] == "b1"}
    assert {r.src for r in external.matching(spark, str(tmp_path), kind="CALLS", dst="b1").collect()} == want
    some = external.matching(spark, str(tmp_path), limit=7, kind="CALLS").collect()
    assert len(some) == 7 and {r.kind for r in some} == {"CALLS"}
    assert external.matching(spark, str(tmp_path), kind="NONE").count() == 0
    assert external.matching(spark, str(tmp_path), confidence=None).count() == 60
    for wrong, told in (({"colour": "red"}, "no field colour"), ({"limit": 0}, "at least 1"), ({"table": "nodes"}, "no page of nodes")):
        with pytest.raises(Exception, match=told):
            external.matching(spark, str(tmp_path), **wrong).collect()


def test_batches_are_committed_once(tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(external.LOGGED)
    w = external.LogWriter(str(tmp_path), schema)
    rows = [("r", i, "log", "{}") for i in range(20_000)]
    count = lambda: sum(b.num_rows for p in external.LogReader(str(tmp_path)).partitions() for b in external.LogReader(str(tmp_path)).read(p))
    lost = w.write(iter(rows))  # a task that failed behind its file
    assert count() == 0
    w.commit([w.write(iter(rows)), w.write(iter([])), None], 0)
    assert count() == 20_000
    w.commit([w.write(iter(rows))], 0)  # the batch is run again
    assert count() == 20_000 and len(os.listdir(tmp_path / "parts")) == 2
    w.abort([w.write(iter(rows))], 1)
    w.commit([w.write(iter(rows[:5]))], 1)
    assert count() == 20_005 and lost.file in os.listdir(tmp_path / "parts")


def test_stream_into_the_log(spark, tmp_path):
    external.register(spark)
    for part in range(3):
        spark.range(part * 100, part * 100 + 100).selectExpr("'r' run_id", "id seq", "'log' t", "'{}' payload").write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(external.LOGGED).parquet(f"{tmp_path}/in")
        source.writeStream.format("event_log").option("path", f"{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.format("event_log").option("path", f"{tmp_path}/log").load()
    assert sorted(r.seq for r in back.collect()) == list(range(300))
