"""Serving, reports with single results, and shard counts in waves."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from pathloom import engine, serve, sinks
from pathloom.operators import dedup, labels
from pathloom.sources import readers
from test_core import FIVE, table


@pytest.fixture(scope="module")
def service(spark):
    return serve.Service(spark, engine.create("exact").rebuild(table(spark, FIVE)))


@pytest.fixture(scope="module")
def client(service):
    http = serve.server(service, 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield serve.Client(f"http://127.0.0.1:{http.server_port}/")
    http.shutdown()


def test_answers_and_errors(service):
    ask = lambda path, body, method="POST": service.answer(method, path, body if isinstance(body, bytes) else json.dumps(body).encode())
    status, found = ask("/api/search", {"embedding": [1, 0, 0, 0], "k": 2})
    assert status == 200 and [r["id"] for r in found] == ["a1", "a2"] and set(found[0]) <= set(serve.RESULT)
    assert [r["id"] for r in ask("/api/search/by-trajectory", {"trajectoryId": "a1", "k": 1})[1]] == ["a2"]
    assert ask("/api/search/by-trajectory", {"trajectoryId": "nobody"}) == (400, {"error": "unknown trajectoryId: nobody"})
    assert ask("/api/search/by-trajectory", {}) == (400, {"error": "trajectoryId is required"})
    assert ask("/search", {"embedding": [1, 0]})[0] == 400 and ask("/search", {"embedding": [1, 0, 0, 0], "k": 101})[0] == 400
    assert ask("/search", {}) == (400, {"error": "embedding is required"}) and ask("/search", b"")[0] == 400 and ask("/search", b"{")[0] == 400 and ask("/search", b"[]")[0] == 400
    assert ask("/search", b"", "GET") == (405, {"error": "method not allowed"}) and ask("/nowhere", {}) == (404, {"error": "not found"})
    assert ask("/deduplicate", {"threshold": 2})[0] == 400
    assert serve.Service(service.spark, engine.create("exact")).answer("GET", "/stats", b"")[0] == 500


def test_client(client):
    assert client.health()["status"] == "ok" and client.stats() == {"trajectoryCount": 5, "vectorDimension": 4, "backend": "exact"}
    assert [r["id"] for r in client.search(embedding=[0, 1, 0, 0], k=1)] == ["b"]
    got = client.search_batch([{"embedding": [1, 0, 0, 0], "k": 2, "success": True}, {"embedding": [0, 0, 1, 0], "k": 1}, {"embedding": [1, 0, 0, 0], "app": "none"}])
    assert [[r["id"] for r in one] for one in got] == [["a1", "a2"], ["c"], []] and client.search_batch([]) == []
    assert [g["memberIds"] for g in client.find_duplicate_groups(0.995, 4)] == [["a1", "a2"]]
    with pytest.raises(OSError, match="HTTP 400"):
        client.search(embedding=[1])
    with pytest.raises(OSError, match="two attempts"):
        serve.Client("http://127.0.0.1:9").stats()


def test_rebuild_over_http(spark):
    service = serve.Service(spark, engine.create("exact"))
    rows = [{"id": "x", "instruction": "do", "platform": "mobile", "app": "shop", "success": True, "actions": [], "embedding": [1, 0], "source": "s", "sourceId": "x", "imageCount": 0}]
    assert service.answer("POST", "/rebuild", json.dumps({"trajectories": rows}).encode()) == (200, {"trajectoryCount": 1, "vectorDimension": 2, "backend": "exact"})


def test_evaluation_report(spark):
    df = table(spark, FIVE)
    members = spark.createDataFrame([("g", 0, "a1"), ("g", 1, "a2"), ("h", 2, "b"), ("h", 3, "c")], "label string, ordinal long, id string")
    negatives = spark.createDataFrame([("a1", "b")], "leftId string, rightId string")
    got = labels.report({"retrieval": members, "duplicates": members, "negatives": negatives}, df, 1, 0.9).first()
    lowest = got.lowestRecallQueries
    assert [r.recall for r in lowest] == [0, 0, 1, 1] and [r.queryId for r in lowest] == ["b", "c", "a1", "a2"]
    assert [(x.id, x.instruction) for x in lowest[2].results] == [("a2", "do a2")] and lowest[2].label == "g"
    assert [(e.errorType, e.leftId, e.rightId, e.leftInstruction) for e in got.errors] == [("false-negative", "b", "c", "do b")]
    assert len(got.thresholdSweep) == 40 and got.thresholdSweep[0].threshold == pytest.approx(0.6)


def test_first_groups(spark):
    groups = spark.createDataFrame([(f"g{i:02d}", [f"g{i:02d}", "z"], 1.0) for i in range(12)], "canonical_id string, member_ids array<string>, mean_cos float")
    assert [g.canonical_id for g in dedup.first_groups(groups).first().first_groups] == [f"g{i:02d}" for i in range(10)]
    assert dedup.first_groups(groups.limit(0)).first().first_groups == []


def test_attempts(spark, tmp_path):
    tried = []

    def job():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("not yet")
        return 7

    assert readers.attempt(job, wait=0) == 7 and len(tried) == 3
    with pytest.raises(RuntimeError, match="3 attempts"):
        readers.attempt(lambda: 1 / 0, wait=0)
    for i in range(5):
        spark.createDataFrame([(f"m{i}{j}", "x") for j in range(3)], "messages string, metadata string").coalesce(1).write.parquet(str(tmp_path / f"{i}.parquet"))
    files = [str(next((tmp_path / f"{i}.parquet").glob("part-*"))) for i in range(5)]
    for workers in (1, 2, 16):
        got = readers.read_shards(spark, files, 7, workers).orderBy("row_idx")
        assert [r.messages for r in got.collect()] == [f"m{i}{j}" for i in range(3) for j in range(3)][:7]
    with pytest.raises(ValueError):
        readers.read_shards(spark, files, 7, 17)


def test_pretty_replaces_at_once(spark, tmp_path):
    path = tmp_path / "t.json"
    for n in (3, 2):
        sinks.write_pretty(table(spark, FIVE[:n]), str(path))
        assert len(json.loads(path.read_text())) == n and not (tmp_path / "t.json.tmp").exists()
    sinks.write_trajectories(table(spark, FIVE), str(tmp_path / "t.parquet"))
    assert sinks.stored_bytes(spark, str(tmp_path / "t.parquet")) >= sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("part-*")) > 0
    assert table(spark, FIVE).where(F.col("success")).count() == 4
