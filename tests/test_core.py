"""Operators over trajectories, on small tables of our own."""

import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom import engine, sinks
from pathloom.functions import hashing, vectors, wordpiece
from pathloom.operators import ann, components, dedup, inject, knn, labels, metrics, recovery, report, sampling
from pathloom.schema import TRAJECTORY, normalise, validate, violations
from pathloom.sources import paged, parse, readers
from pathloom.streaming import imports


def table(spark, rows):
    """rows: (id, vector) or (id, vector, success) or (id, vector, success, actions)."""
    full = [(r[0], f"do {r[0]}", "mobile", "shop", r[2] if len(r) > 2 else True, r[3] if len(r) > 3 else [], [float(x) for x in r[1]], "local", r[0], 0) for r in rows]
    return spark.createDataFrame(full, TRAJECTORY)


FIVE = [("a1", [1, 0, 0, 0]), ("a2", [0.999, 0.01, 0, 0]), ("a3", [0.998, 0.02, 0, 0], False), ("b", [0, 1, 0, 0]), ("c", [0, 0, 1, 0])]


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_cosine_triples(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 3.0]), ([1.0, 1.0], [-2.0, -2.0]), ([0.0, 0.0], [1.0, 1.0])], "l array<float>, r array<float>")
    got = [r[0] for r in rows.select(vectors.cosine(F.col("l"), F.col("r"))).collect()]
    assert got == pytest.approx([1, 0, -1, 0], abs=1e-6)
    assert rows.select(vectors.score(vectors.cosine(F.col("l"), F.col("r")))).first()[0] == pytest.approx(1)


def test_normalise_vector(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(vectors.normalise(F.col("v")).alias("v"))
    assert [r.v for r in rows.collect()] == [pytest.approx([0.6, 0.8]), [1.0, 0.0]]


def fnv(text):
    h = 14695981039346656037
    data = text.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 1099511628211) % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_fnv_forms_agree(spark):
    texts = ["", "a", "instruction:tap", "größe", "emoji \U0001f600"]
    assert hashing.fnv1a64(texts).tolist() == [fnv(t) for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(hashing.fnv1a64_native(F.col("t"))).collect()] == [fnv(t) for t in texts]


def test_hash_embedding_relates(spark):
    rows = spark.createDataFrame([(1, "set an alarm for seven", ["open clock"]), (2, "set the alarm for eight", ["open clock"]), (3, "buy red shoes", ["open shop"]), (4, None, [])], "id long, instruction string, actions array<string>").withColumn("app", F.lit(None).cast("string"))
    v = {r.id: np.array(r.embedding) for r in hashing.hash_embedding(rows, 256).collect()}
    assert v[1] @ v[2] > v[1] @ v[3]
    assert np.linalg.norm(v[1]) == pytest.approx(1, abs=1e-6) and v[4][0] == 1
    with pytest.raises(ValueError):
        hashing.hash_embedding(rows, 16)


def test_search_filters_and_best_hit(spark):
    df = table(spark, FIVE)
    assert ids(knn.search(df, [1, 0, 0, 0], 1, success=True)) == ["a1"]
    assert ids(knn.search(df, [1, 0, 0, 0], 3, " ", "shop", False)) == ["a3"]
    assert ids(knn.search(df, [1, 0, 0, 0], 3, "desktop")) == []
    assert ids(knn.search_by_id(df, "a1", 2)) == ["a2", "a3"]
    with pytest.raises(KeyError):
        knn.search_by_id(df, "zz")
    for k in (0, 101):
        with pytest.raises(ValueError):
            knn.search(df, [1, 0, 0, 0], k)
    for bad in ([0, 0, 0, 0], [float("nan"), 0, 0, 0]):
        with pytest.raises(ValueError):
            knn.search(df, bad)
    with pytest.raises(ValueError):
        knn.check_vector([1.0, 2.0], 4)


def brute(rows, k):
    out = []
    for qi, qv in rows:
        cos = sorted((-np.float32(np.dot(qv, v) / np.linalg.norm(qv) / np.linalg.norm(v)), i) for i, v in rows)
        out += [(qi, i) for _, i in cos[:k]]
    return set(out)


@pytest.mark.parametrize("block", [4, 512])
def test_knn_join_is_exact(spark, block):
    rng = np.random.default_rng(1)
    rows = [(f"r{i:02d}", rng.normal(size=8)) for i in range(40)]
    df = table(spark, rows)
    got = knn.knn_join(df.select(F.col("id").alias("qid"), "embedding"), df.select("id", "embedding"), (), 5, block)
    assert {(r.qid, r.id) for r in got.collect()} == brute([(i, v.astype(np.float32).astype(float)) for i, v in rows], 5)


def test_knn_ties_and_truncation(spark):
    df = table(spark, [(f"t{i}", [1, 0]) for i in range(6)])
    got = knn.knn_join(df.select(F.col("id").alias("qid"), "embedding"), df.select("id", "embedding"), (), 3)
    assert {tuple(sorted(r.l)) for r in got.groupBy("qid").agg(F.collect_list("id").alias("l")).collect()} == {("t0", "t1", "t2")}
    assert ids(knn.neighbours(df.where("id = 't5'"), df, 3).orderBy("rank")) == ["t0", "t1", "t2"]  # self is the fourth at best and cut by k


def test_batch_search_mixes_filters(spark):
    df = table(spark, FIVE)
    asked = spark.createDataFrame([("q1", [1.0, 0.0, 0.0, 0.0], 2, None, " ", None), ("q2", [1.0, 0.0, 0.0, 0.0], 1, "mobile", "shop", False)], "qid string, embedding array<float>, k int, platform string, app string, success boolean")
    got = sorted((r.qid, r.rank, r.id) for r in knn.search_batch(asked, df).collect())
    assert got == [("q1", 1, "a1"), ("q1", 2, "a2"), ("q2", 1, "a3")]


def test_dedup_groups(spark):
    got = dedup.duplicate_groups(table(spark, FIVE), 0.995, 4).collect()
    assert [(r.canonical_id, r.member_ids) for r in got] == [("a1", ["a1", "a2"])] and got[0].mean_cos >= 0.995
    stats = dedup.group_stats(dedup.duplicate_members(table(spark, FIVE), 0.995, 4)).first()
    assert (stats.groups, stats.members, stats.largest) == (1, 2, 2)
    for t, k in ((1.5, 4), (0.5, 1), (0.5, 101)):
        with pytest.raises(ValueError):
            dedup.duplicate_groups(table(spark, FIVE), t, k)


def test_chain_group_means_all_pairs(spark):
    at = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    got = dedup.duplicate_groups(table(spark, [("a", at(0)), ("b", at(20)), ("c", at(40)), ("z", at(180))]), 0.9, 4).collect()
    assert [r.member_ids for r in got] == [["a", "b", "c"]]
    assert got[0].mean_cos == pytest.approx((2 * math.cos(math.radians(20)) + math.cos(math.radians(40))) / 3, abs=1e-5)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500), (None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.id: r.root for r in got.collect()} == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_metrics_precision_of_k_and_empty(spark):
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "qid string, id string, rank int")
    relevant = spark.createDataFrame([("q", "y"), ("q", "z"), ("p", "x")], "qid string, id string")
    got = {r.qid: r for r in metrics.retrieval_per_query(ranked, relevant, 5).collect()}
    assert (got["q"].hits, got["q"].recall, got["q"].precision, got["q"].first_rank, got["q"].rr) == (1, 0.5, 0.2, 2, 0.5)
    assert (got["p"].recall, got["p"].first_rank, got["p"].rr) == (0, 0, 0)
    none = metrics.retrieval_summary(metrics.retrieval_per_query(ranked, relevant, 5).limit(0)).first()
    assert (none.queries, none.recall, none.mrr) == (0, 0, 0)


def test_sweep_prefers_highest_threshold(spark):
    scored = spark.createDataFrame([("a", "b", True, 0.995), ("a", "c", False, 0.1)], "left_id string, right_id string, duplicate boolean, cos float")
    best = metrics.calibrated(metrics.confusion(scored, metrics.sweep_thresholds(spark))).first()
    assert best.threshold == pytest.approx(0.99) and best.f1 == 1


def test_nearest_rank(spark):
    for n in (0, 1, 7, 20):
        rows = spark.createDataFrame([(i,) for i in range(1, n + 1)], "x long")
        got = metrics.nearest_rank(rows, "x").first()
        assert (got.p50, got.p95) == ((math.ceil(0.5 * n), math.ceil(0.95 * n)) if n else (0, 0))


def test_truncation_rule(spark):
    df = table(spark, [(f"n{n}", [1, 0], True, [str(i) for i in range(n)]) for n in (2, 3, 4, 5, 6, 10)])
    both, pairs = inject.inject(df, 5)
    assert {r.id: len(r.actions) for r in both.where("not success").collect()} == {"n3-failed-truncated": 2, "n4-failed-truncated": 2, "n5-failed-truncated": 3, "n6-failed-truncated": 4, "n10-failed-truncated": 6}
    assert {r.originalActionCount - r.remainingActionCount for r in pairs.collect()} == {1, 2, 4}
    with pytest.raises(ValueError):
        inject.parents_of(df, 5, spark.createDataFrame([("g", "n2")], "label string, id string"))


def test_recovery_excludes_parent(spark):
    df = table(spark, [("p", [1, 0]), ("alt", [0.9, 0.1]), ("far", [0, 1])]).unionByName(table(spark, [("f", [1, 0.01], False)]).withColumn("sourceId", F.lit("p")))
    pairs = spark.createDataFrame([("f", "p", ["alt"])], "failureId string, successfulId string, alternativeSuccessfulIds array<string>")
    assert recovery.problems(df, pairs).count() == 0
    got = recovery.recovery_summary(recovery.recovery_per_failure(df, pairs, 2), 2).first()
    assert (got.parent_recall_1, got.hit_rate, got.mrr) == (1, 1, 1)
    wrong = spark.createDataFrame([("p", "f", []), ("x", "p", [])], "failureId string, successfulId string, alternativeSuccessfulIds array<string>")
    assert {r.rule for r in recovery.problems(df, wrong).collect()} == {"failure succeeded", "parent failed", "wrong parent", "missing failure"}
    hard = recovery.hardest(recovery.recovery_per_failure(df, pairs, 2)).collect()
    assert [r.failureId for r in hard] == ["f"]


def label_tables(spark):
    groups = [("g1", 0, "w"), ("g1", 1, "x"), ("g2", 2, "y"), ("g2", 3, "z")]
    g = spark.createDataFrame(groups, "label string, ordinal long, id string")
    return {"retrieval": g, "duplicates": g, "negatives": spark.createDataFrame([("w", "z")], "leftId string, rightId string")}


def test_evaluation_end_to_end(spark):
    df = table(spark, [("w", [1, 0]), ("x", [0.99, 0.1]), ("y", [0, 1]), ("z", [0.1, 0.99])])
    got = labels.evaluate(label_tables(spark), df, 1, 0.8).first()
    assert (got.retrieval.hit_rate, got.retrieval.mrr, got.calibrated.f1) == (1, 1, 1)
    assert (got.deduplication.tp, got.deduplication.fp, got.deduplication.tn) == (2, 0, 5)
    assert labels.lowest_recall(labels.retrieval(label_tables(spark), df, 1)).count() == 4
    assert labels.worst_errors(labels.scored_pairs(label_tables(spark), df), 0.999).count() == 2
    with pytest.raises(ValueError, match="unknown id"):
        labels.evaluate(label_tables(spark), df.where("id <> 'w'"))


def test_label_files(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"name": "n", "version": "1", "retrievalGroups": [{"label": "g", "rationale": "r", "memberIds": ["b", "a"]}], "duplicateGroups": [], "negativePairs": [{"leftId": "a", "rightId": "a", "rationale": "r"}]}))
    got = readers.read_labels(spark, str(path))
    assert ids(got["retrieval"].orderBy("ordinal")) == ["b", "a"]
    bad = labels.label_problems(got, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert {r.rule for r in bad.collect()} == {"negatives: equal ids"}
    pairs = tmp_path / "pairs.json"
    pairs.write_text(json.dumps({"name": "n", "pairs": [{"failureId": "f", "successfulId": "s", "alternativeSuccessfulIds": ["x"], "failureType": "truncated", "originalActionCount": 3, "remainingActionCount": 2}]}))
    assert readers.read_failure_pairs(spark, str(pairs)).first().alternativeSuccessfulIds == ["x"]


def test_trajectory_defaults_and_violations(spark, tmp_path):
    path = tmp_path / "t.json"
    one = {"id": "a", "instruction": "go", "platform": "mobile", "app": "x", "success": True, "actions": ["tap"], "embedding": [1.0, 0.0]}
    path.write_text(json.dumps([one, one | {"id": "b", "actions": None, "source": " "}]))
    got = {r.id: r for r in readers.read_trajectories(spark, str(path)).collect()}
    assert (got["b"].source, got["b"].sourceId, got["b"].imageCount, got["b"].actions) == ("local", "b", 0, [])
    path.write_text("[]")
    with pytest.raises(ValueError):
        readers.read_trajectories(spark, str(path))
    rows = normalise(table(spark, [("a", [1, 0]), ("a", [1, 0]), (" ", [0, 0]), ("d", [1, 0, 0]), ("e", [float("nan"), 1])]))
    assert {(r.rule, r.id) for r in violations(rows, 2).collect()} == {("unique", "a"), ("id", " "), ("vector", " "), ("dimension", "d"), ("vector", "e")}
    with pytest.raises(ValueError):
        validate(rows)


def message(role, text=None, kind="text", calls=None):
    out = {"role": role, "content": [{"type": kind, "text": text}] if text is not None else []}
    return out | ({"tool_calls": [{"function": {"name": n, "arguments": {"status": s}}} for n, s in calls]} if calls else {})


CASES = [
    ([message("user", " \t"), message("user", " Go on \n"), message("assistant", "press it", "action_description", [("tap", None), ("terminate", "Success")])], "Go on", ["tap: press it"], True),
    ([message("user", "x"), message("assistant", "look", "action_description"), message("assistant", " ", "action_description", [("a", None), ("b", None)]), message("tool", None, calls=[("terminate", "failure")])], "x", ["look", "a", "b"], False),
    ([message("user", "x"), message("assistant", None, calls=[("terminate", None)])], "x", [], False),
    ([message("assistant", "y")], None, [], True),
    ([message("user", "x"), message("assistant", "  tap it\n", "action_description"), message("assistant", "\tpad ", "action_description", [("tap", None)])], "x", ["tap it", "tap: pad"], True),
]


def test_parse_rules(spark):
    rows = [(i, json.dumps(m), None) for i, (m, *_) in enumerate(CASES)] + [(9, json.dumps(CASES[0][0]), json.dumps({"platform": "desktop", "others": {"id": "X_Android_Control_1", "source": "s"}}))]
    got = {r.sourceId: r for r in parse.parse_rows(spark.createDataFrame(rows, "row_idx long, messages string, metadata string")).collect()}
    for i, (_, instruction, actions, ok) in enumerate(CASES):
        r = got[f"aguvis-row-{i}"]
        assert (r.instruction, r.actions, r.success, r.platform, r.app) == (instruction, actions, ok, "mobile", "mobile-gui")
    r = got["X_Android_Control_1"]
    assert (r.platform, r.app, r.source) == ("desktop", "android-control", "s")


def test_image_counts(spark):
    lists = [[("image", None), ("image", None)], [("image", 4), ("image", None)], [("text", 7)]]
    schema = "m array<struct<role:string,content:array<struct<type:string,text:string,index:int>>>>"
    rows = spark.createDataFrame([([("user", [(k, None, i) for k, i in x])],) for x in lists], schema)
    assert [r[0] for r in rows.select(parse.image_count(F.col("m"))).collect()] == [2, 5, 0]


def test_rows_file_and_shards(spark, tmp_path):
    rows = [{"row_idx": i, "row": {"messages": json.dumps([message("user", f"task {i}")]), "metadata": "{}", "images": [{}] * i}} for i in range(3)]
    (tmp_path / "rows.json").write_text(json.dumps({"rows": rows}))
    raw = readers.read_rows_file(spark, str(tmp_path / "rows.json"), 2)
    got = readers.trajectories_of(raw, 32).orderBy("id").collect()
    assert [(r.instruction, r.imageCount, len(r.embedding)) for r in got] == [("task 0", 0, 32), ("task 1", 1, 32)]
    with pytest.raises(ValueError):
        readers.read_rows_file(spark, str(tmp_path / "rows.json"), 4)
    for k in (1, 0):
        part = spark.createDataFrame([(json.dumps([message("user", f"{k}{i}")]), "{}") for i in range(5)], "messages string, metadata string").coalesce(1)
        part.toPandas().to_parquet(tmp_path / f"main-train-{k}.parquet")
    files = readers.list_shards(spark, str(tmp_path), "main", "train")
    assert [f[-9] for f in files] == ["0", "1"] and readers.list_shards(spark, str(tmp_path), "main", "test") == []
    got = readers.read_shards(spark, files, 7).orderBy("row_idx").collect()
    assert [(r.row_idx, json.loads(r.messages)[0]["content"][0]["text"]) for r in got] == [(i, f"{i // 5}{i % 5}") for i in range(7)]


def test_page_faults_halve_and_wait():
    slept, asked = [], []

    def once(options, offset, length):
        asked.append((offset, length))
        if len(asked) == 1:
            raise paged.urllib.error.HTTPError("u", 429, "slow", None, None)
        if length > 2:
            raise ValueError("too many")
        return [(i,) for i in range(offset, offset + length)]

    assert paged.fetch({}, 10, 7, once, slept.append) == [(i,) for i in range(10, 17)] and slept == [paged.WAIT]
    with pytest.raises(ValueError):
        paged.fetch({}, 0, 4, lambda *a: (_ for _ in ()).throw(ValueError("no")), slept.append)
    assert [(p.offset, p.length) for p in paged.pages(5, 250)] == [(5, 100), (105, 100), (205, 50)]


@pytest.fixture
def service():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            at, n = int(q["offset"]), int(q["length"])
            if at <= 130 < at + n and n > 10:
                self.send_error(500)
                return
            body = json.dumps({"rows": [{"row_idx": i, "row": {"messages": json.dumps([message("user", f"t{i}")]), "metadata": "{}", "images": []}} for i in range(at, at + n)]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rows"
    server.shutdown()


def test_paged_source_and_resumable_stream(spark, service, tmp_path):
    paged.register(spark)
    got = spark.read.format("pathloom_rows").options(url=service, limit=210, offset=5).load()
    assert sorted(r.row_idx for r in got.collect()) == list(range(5, 215))
    out, mark = str(tmp_path / "rows"), str(tmp_path / "mark")
    assert imports.import_rows(spark, out, mark, url=service, limit=60, checkpointRows=25).count() == 60
    done = imports.import_rows(spark, out, mark, url=service, limit=90, checkpointRows=25)
    assert sorted(r.row_idx for r in done.collect()) == list(range(90))


def test_wordpiece(spark, tmp_path):
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "set", "alarm", "play", "##ing", "!", "日"]
    (tmp_path / "vocab.txt").write_text("\n".join(words), encoding="utf-8")
    vocabulary = readers.read_vocabulary(spark, str(tmp_path / "vocab.txt"))
    assert vocabulary == {w: i for i, w in enumerate(words)}
    w = wordpiece.WordPiece(vocabulary, 16)
    ids_, mask, kinds = w.encode("Sét​ alarm playing!日unknown")
    assert ids_ == [2, 4, 5, 6, 7, 8, 9, 1, 3] and mask == [1] * 9 and kinds == [0] * 9
    assert len(wordpiece.WordPiece(vocabulary, 8).encode("set " * 50)[0]) == 8 and w.encode(None)[0] == [2, 3]
    assert wordpiece.basic_tokens("a\tb c+d e-f $5\u00a0x.") == ["ab", "c+d", "e", "-", "f", "$5\u00a0x", "."]
    assert wordpiece.model_path("m/", "arm64") == "m/model_qint8_arm64.onnx"
    (tmp_path / "file.bin").write_bytes(b"abc")
    assert wordpiece.file_sha256(spark, str(tmp_path / "file.bin")) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert w.pieces("s" * 101) == ["[UNK]"]
    with pytest.raises(ValueError):
        wordpiece.WordPiece({"a": 0})
    got = wordpiece.encoded(spark.createDataFrame([("set alarm",), (None,)], "t string"), "t", w)
    assert [r.input_ids for r in got.collect()] == [[2, 4, 5, 3], [2, 3]]
    assert wordpiece.padded([[1], [1, 2]]).tolist() == [[1, 0], [1, 2]]
    assert wordpiece.pooled(np.array([[[3.0, 0], [0, 4.0], [9, 9]]]), np.array([[1, 1, 0]])) == pytest.approx(np.array([[0.6, 0.8]]))
    assert len(wordpiece.embed_with(table(spark, FIVE), "instruction", wordpiece.HashModel(64)).first().embedding) == 64


@pytest.mark.parametrize("name", ["exact", "ivf"])
def test_engine(spark, tmp_path, name):
    e = engine.create(name, folder=str(tmp_path / "index"))
    with pytest.raises(RuntimeError):
        e.search([1, 0, 0, 0])
    e.rebuild(table(spark, FIVE)).rebuild(table(spark, FIVE[:4]))
    assert ids(e.search([1, 0, 0, 0], 1)) == ["a1"] and ids(e.search_by_id("a1", 1)) == ["a2"]
    assert [r.member_ids for r in e.find_duplicate_groups(0.995, 4).collect()] == [["a1", "a2"]]
    assert tuple(e.stats().first()) == (4, 4, name)
    with pytest.raises(ValueError):
        e.search([1, 0])
    again = engine.create(name, folder=str(tmp_path / "index")).open(spark)
    assert tuple(again.stats().first()) == (4, 4, name) and again.health()["status"] == "ok" and sum(r.n for r in again.filter_counts().collect()) == 4
    assert ids(again.rebuild(table(spark, FIVE[:2])).search([1, 0, 0, 0], 1)) == ["a1"] and again._last(spark) == 3
    with pytest.raises(ValueError):
        engine.create("cuda")


def test_approximate_recall(spark):
    rng = np.random.default_rng(2)
    df = table(spark, [(f"r{i:03d}", rng.normal(size=16)) for i in range(300)]).select("id", "embedding")
    asked = df.where("id < 'r030'").withColumnRenamed("id", "qid")
    got = metrics.ann_accuracy(knn.knn_join(asked, df, (), 5), ann.approximate_neighbours(ann.build(df), asked, df, 5)).first()
    assert got.recall >= 0.9 and got.top1 == 1


def test_samples(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(100)], "id string")
    got = {r.ordinal: int(r.id) for r in sampling.even_sample(df, 7).collect()}
    assert got == {i: i * 100 // 7 for i in range(7)}
    assert ids(sampling.seeded_sample(df, 5)) == ids(sampling.seeded_sample(df.repartition(3), 5))
    with pytest.raises(ValueError):
        sampling.even_sample(df, 101)


def test_sinks(spark, tmp_path):
    df = table(spark, FIVE)
    sinks.write_pretty(df, str(tmp_path / "t.json"))
    assert [r["id"] for r in json.loads((tmp_path / "t.json").read_text())] == [r[0] for r in FIVE]
    sinks.write_trajectories(df, str(tmp_path / "t.parquet"))
    assert readers.read_trajectories(spark, str(tmp_path / "t.parquet")).count() == 5
    sinks.write_report(report.dataset_report(df), str(tmp_path / "report"))
    got = spark.read.json(str(tmp_path / "report")).first()
    assert (got.trajectories, got.dimension, got.successes) == (5, 4, 4)
    _, pairs = inject.inject(table(spark, [("n", [1], True, ["a", "b", "c"])]), 1)
    assert sinks.pair_set(pairs, "n", "1", "p").first().pairs[0].failureId == "n-failed-truncated"
    assert sinks.import_summary(df).first().n == 5
    counts = {(r.field, r.value): r.n for r in report.counts_by(df, "app", "success").collect()}
    assert counts == {("app", "shop"): 5, ("success", "true"): 4, ("success", "false"): 1}


def test_filter_reaches_the_scan(spark, tmp_path):
    table(spark, FIVE).write.parquet(str(tmp_path / "t"))
    plan = knn.matching(spark.read.parquet(str(tmp_path / "t")), "mobile", None, True).select("id")._jdf.queryExecution().toString()
    assert "EqualTo(platform,mobile)" in plan and "ReadSchema: struct<id:string,platform:string,success:boolean>" in plan


def test_entry_without_training_data_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/pathloom", tmp_path / "pathloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q01_search_topk' in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def _plain_search(rows, k, keys=lambda r: (), least=-2.0):
    """{(qid, id, rank)} by plain loops; rows are (id, vector, ...)."""
    out = set()
    for q in rows:
        length = lambda v: np.sqrt(np.cumsum(np.float64(np.float32(v)) ** 2)[-1])
        cos = lambda r: np.float32(np.cumsum(np.float64(np.float32(q[1])) * np.float32(r[1]))[-1] / (length(q[1]) * length(r[1])))
        near = sorted((-cos(r), r[0]) for r in rows if keys(r) == keys(q))
        out |= {(q[0], i, n + 1) for n, (c, i) in enumerate(near[:k]) if -c >= np.float32(least)}
    return out


@pytest.mark.parametrize("block", [8, 64])
def test_knn_join_over_many_blocks_with_copies_and_keys(spark, block):
    rng = np.random.default_rng(5)
    rows = [(f"r{i:03d}", rng.normal(size=6).tolist(), "big" if i % 4 else f"g{i % 20}") for i in range(240)]
    rows += [(f"c{i:03d}", rows[1][1], "big") for i in range(30)] + [(f"s{i}", (np.float32(rows[2][1]) * np.float32(2.0**e)).tolist(), "big") for i, e in enumerate((-60, 60, 1))]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, app string")
    for keys, by, least in (((), lambda r: (), None), (("app",), lambda r: r[2], None), (("app",), lambda r: r[2], 0.9)):
        found = knn.knn_join(df.withColumnRenamed("id", "qid"), df, keys, 5, block, least=least).collect()
        assert {(r.qid, r.id, r.rank) for r in found} == _plain_search(rows, 5, by, -2.0 if least is None else least) and len({(r.qid, r.id) for r in found}) == len(found)


def test_knn_join_moves_each_row_once_or_so(spark):
    """What is shuffled and kept does not grow with the number of pairs of blocks."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"r{i:04d}", x) for i, x in enumerate(rng.normal(size=(1600, 64)).tolist())], "id string, embedding array<float>")
    found = knn.knn_join(df.withColumnRenamed("id", "qid"), df, (), 2, 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan
    below = plan[plan.index("CartesianProduct") :]
    assert "Exchange" not in below and "Sort" not in below and found.count() == 3200


def test_approximate_search_keeps_a_query_one_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = {f"r{i:03d}": rng.normal(size=8).astype(np.float32) for i in range(200)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "id string, embedding array<float>")
    model = ann.build(df)
    seen, join = [], ann.knn_join
    monkeypatch.setattr(ann, "knn_join", lambda q, c, *a, **b: seen.append(q) or join(q, c, *a, **b))
    got = ann.approximate_neighbours(model, df.withColumnRenamed("id", "qid"), None, 4, 0.5)
    unit = lambda v: v / np.linalg.norm(v)
    cells = {i: np.argsort([-(v @ c) for c in model.centres], kind="stable") for i, v in rows.items()}
    n = round(0.5 * len(model.centres))
    want = {(q, i) for q, v in rows.items() for i in sorted((i for i in rows if cells[i][0] in cells[q][:n]), key=lambda i: (-np.float32(unit(v.astype(float)) @ unit(rows[i].astype(float))), i))[:4]}
    assert {(r.qid, r.id) for r in got.collect()} == want and seen[0].count() == len(rows)


def test_label_pairs_by_blocks(spark, monkeypatch):
    """Counts and cosines of all pairs over several blocks, with tied ordinals, null labels, a zero vector, cosines on thresholds."""
    monkeypatch.setattr(metrics, "label_pairs", None)  # the pairs are not made one by one
    rng = np.random.default_rng(8)
    vecs = [rng.integers(-2, 3, size=4).astype(float).tolist() for _ in range(700)]
    vecs[3] = [0.0] * 4
    rows = [(None if i % 50 == 49 else f"l{i % 3}", i // 2 if i < 40 else i, f"r{i:03d}") for i in range(700)]
    groups, df = spark.createDataFrame(rows, "label string, ordinal int, id string"), spark.createDataFrame([(r[2], v) for r, v in zip(rows, vecs)], "id string, embedding array<float>")
    x = np.array(vecs)
    size = np.sqrt((x * x).sum(axis=1))
    cos = np.float32((x @ x.T) / np.where(np.outer(size, size) == 0, 1, np.outer(size, size)))
    want = {(a[2], b[2]): (None if a[0] is None or b[0] is None else a[0] == b[0], cos[i, j]) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[1] < b[1]}
    got = metrics.label_scored(groups, df).collect()
    assert len(got) == len(want) and {(r.left_id, r.right_id): (r.duplicate, pytest.approx(r.cos, abs=1e-6)) for r in got} == want
    for steps in ([-2.0, -1.0, 0.0, 0.5, 1.0, 1.5], [0.2]):
        table_ = spark.createDataFrame([(t,) for t in steps], "threshold float")
        at = {r.threshold: r for r in metrics.label_confusion(groups, df, table_).collect()}
        assert at == {r.threshold: r for r in metrics.confusion(spark.createDataFrame(got), table_).collect()} and len(at) == len(steps)
    for run in (lambda: metrics.label_scored(groups, df.where("id <> 'r005'")).count(), lambda: metrics.label_confusion(groups, df.where("id <> 'r005'"), table_).count()):
        with pytest.raises(Exception, match="no vector"):
            run()
    assert metrics.label_scored(groups.limit(1), df).count() == 0 and metrics.label_confusion(groups.limit(0), df, table_).count() in (0, 1)


def test_pairs_of_tokens_are_not_made_as_strings(spark, monkeypatch):
    rng = random.Random(4)
    words = ["tap", "größe", "x_y", "İzmir", "\U0001f600z", "9", "a" * 300]
    rows = [(" ".join(rng.choices(words, k=60)), rng.choice([None, "app é", "x"]), [" ".join(rng.choices(words, k=9)) for _ in range(i % 3)]) for i in range(30)] + [(None, None, None), ("one", None, [])]
    want = [hashing.sums(*hashing.features(text, actions, app), 64) for text, app, actions in rows]
    made, plain = [], hashing.fnv1a64
    monkeypatch.setattr(hashing, "fnv1a64", lambda texts: made.extend(texts) or plain(texts))
    assert (hashing.batch_sums(rows, 64) == np.array(want)).all() and (hashing.batch_sums([], 64).shape) == (0, 64)
    assert len(made) < 20
