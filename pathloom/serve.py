"""JSON over HTTP around an ``Engine``: routes, errors as status codes, and a client for them.

400: a request that does not make sense; 404: no such path; 405: a path asked by the wrong method; 500: anything else.
The Spark session does the work; a request holds no more than ``MAX_BATCH`` queries or returns ``MAX_GROUPS`` groups.
"""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.engine import MAX_BATCH, Engine
from pathloom.operators import knn
from pathloom.schema import TRAJECTORY

MAX_GROUPS = 100_000
RESULT = ("id", "instruction", "platform", "app", "success", "actions", "source", "sourceId", "imageCount", "score")


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]  # k rows of each query at most


class Service:
    """What each route does, from the request's object to the response's."""

    def __init__(self, spark: SparkSession, engine: Engine):
        self.spark, self.engine, self.lock = spark, engine, threading.Lock()
        self.routes: dict[str, tuple[str, Callable]] = {
            "/health": ("GET", lambda _: engine.health()),
            "/stats": ("GET", lambda _: self.stats()),
            "/rebuild": ("POST", self.rebuild),
            "/search": ("POST", self.search),
            "/search/batch": ("POST", self.search_batch),
            "/search/by-trajectory": ("POST", self.search_by_id),
            "/deduplicate": ("POST", self.deduplicate),
        }
        self.routes |= {f"/api{path}": route for path, route in self.routes.items()}

    def stats(self) -> dict:
        row = self.engine.stats().first()
        return {"trajectoryCount": row["count"], "vectorDimension": row["dimension"] or 0, "backend": row["strategy"]}

    def rebuild(self, body: dict) -> dict:
        def value(t: dict, name: str):
            v = t.get(name)
            return [float(x) for x in v] if name == "embedding" and v is not None else v

        rows = [tuple(value(t, f.name) for f in TRAJECTORY.fields) for t in body["trajectories"]]
        with self.lock:
            self.engine.rebuild(self.spark.createDataFrame(rows, TRAJECTORY))
            return self.stats()

    def search(self, body: dict) -> list[dict]:
        found = self.engine.search(body["embedding"], _k(body), body.get("platform"), body.get("app"), body.get("success"))
        return _rows(found.orderBy("rank").select(*RESULT))

    def search_by_id(self, body: dict) -> list[dict]:
        wanted = body.get("trajectoryId")
        if not isinstance(wanted, str) or not wanted.strip():
            raise ValueError("trajectoryId is required")
        try:
            found = self.engine.search_by_id(wanted, _k(body), body.get("success"))
        except KeyError:
            raise ValueError(f"unknown trajectoryId: {wanted}") from None
        return _rows(found.orderBy("rank").select(*RESULT))

    def search_batch(self, body: dict) -> list[list[dict]]:
        requests = body["requests"]
        if not requests:
            return []
        if len(requests) > MAX_BATCH:
            raise ValueError(f"over {MAX_BATCH} queries")
        rows = [(str(i), knn.check_vector(r["embedding"], self.engine.dimension), knn.check_k(_k(r)), r.get("platform"), r.get("app"), r.get("success")) for i, r in enumerate(requests)]
        asked = self.spark.createDataFrame(rows, "qid string, embedding array<float>, k int, platform string, app string, success boolean")
        found = self.engine.search_batch(asked)
        details = self.engine.corpus.drop("embedding")
        full = found.join(details, "id").withColumn("score", knn.score(F.col("cos"))).orderBy(F.col("qid").cast("int"), "rank")
        out: list[list[dict]] = [[] for _ in requests]
        for r in _rows(full.select("qid", *RESULT)):
            out[int(r.pop("qid"))].append(r)
        return out

    def deduplicate(self, body: dict) -> list[dict]:
        threshold, candidates = body.get("threshold"), body.get("candidateK")
        groups = self.engine.find_duplicate_groups(0.985 if threshold is None else threshold, 10 if candidates is None else candidates)
        shape = groups.select(F.col("canonical_id").alias("canonicalId"), F.col("member_ids").alias("memberIds"), F.col("mean_cos").alias("meanCosineSimilarity"))
        rows = shape.orderBy("canonicalId").limit(MAX_GROUPS + 1).toJSON().collect()
        if len(rows) > MAX_GROUPS:
            raise RuntimeError(f"over {MAX_GROUPS} groups: use find_duplicate_groups")
        return [json.loads(r) for r in rows]

    def answer(self, method: str, path: str, body: bytes) -> tuple[int, object]:
        """Status and response object."""
        if path not in self.routes:
            return 404, {"error": "not found"}
        wanted, action = self.routes[path]
        if method != wanted:
            return 405, {"error": "method not allowed"}
        try:
            if method == "POST" and not body:
                raise ValueError("request body is required")
            request = json.loads(body) if method == "POST" else {}
            if not isinstance(request, dict):
                raise ValueError("an object is required")
            return 200, action(request)
        except KeyError as e:
            return 400, {"error": f"{e.args[0]} is required"}
        except (ValueError, TypeError) as e:
            return 400, {"error": str(e)}
        except Exception as e:
            return 500, {"error": "internal server error", "detail": str(e) or type(e).__name__}


def _k(body: dict) -> int:
    return 5 if body.get("k") is None else body["k"]


def server(service: Service, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is not started yet; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            status, out = service.answer(self.command, self.path.partition("?")[0], self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _do

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


class Client:
    """The same calls from elsewhere. A failure of the transport is tried once more; an HTTP error is not."""

    def __init__(self, url: str):
        self.url = url.rstrip("/")

    def _call(self, path: str, body: dict | None, seconds: float):
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        failure = None
        for _ in range(2):
            try:
                with urllib.request.urlopen(request, timeout=seconds) as response:
                    return json.load(response)
            except urllib.error.HTTPError as e:
                raise OSError(f"HTTP {e.code}: {e.read().decode(errors='replace')}") from e
            except OSError as e:
                failure = e
        raise OSError(f"no answer from {path} in two attempts") from failure

    def health(self) -> dict:
        return self._call("/health", None, 30)

    def stats(self) -> dict:
        return self._call("/stats", None, 30)

    def rebuild(self, trajectories: list[dict]) -> dict:
        return self._call("/rebuild", {"trajectories": trajectories}, 600)

    def search(self, **request) -> list[dict]:
        return self._call("/search", request, 30)

    def search_batch(self, requests: list[dict]) -> list[list[dict]]:
        return self._call("/search/batch", {"requests": requests}, 300) if requests else []

    def find_duplicate_groups(self, threshold: float | None = None, candidates: int | None = None) -> list[dict]:
        return self._call("/deduplicate", {"threshold": threshold, "candidateK": candidates}, 300)
