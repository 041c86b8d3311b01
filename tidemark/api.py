"""A thin HTTP front: events in, slates and metrics out. One driver serves it; slates of many users are a batch job."""

from __future__ import annotations

import json
import threading
import time
import urllib.parse
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tidemark import schemas as S
from tidemark.operators import drift, features as fe, ingest as ing, latency, ranking as rk
from tidemark.runtime import Runtime
from tidemark.store import Store

LARGEST, MOST = 1_000_000, 1000
PAGE = "<!doctype html><meta charset=utf-8><title>tidemark</title><h1>tidemark</h1><p>See /api/overview, /api/recommendations?user_id=, /api/model, /api/drift, /metrics.</p>"


class Counters:
    """Counts by mode and reason, and a histogram of latencies: of fixed size, however many requests come."""

    def __init__(self):
        self.lock = threading.Lock()
        self.modes: dict[str, int] = {}
        self.reasons: dict[str, int] = {}
        self.buckets = [0] * (len(S.LATENCY_BUCKETS) + 1)
        self.total = 0.0

    def observe(self, mode: str, reason: str | None, seconds: float) -> None:
        with self.lock:
            self.modes[mode] = self.modes.get(mode, 0) + 1
            if reason:
                self.reasons[reason] = self.reasons.get(reason, 0) + 1
            for i, bound in enumerate((*S.LATENCY_BUCKETS, float("inf"))):
                self.buckets[i] += seconds <= bound
            self.total += seconds

    def render(self) -> str:
        with self.lock:
            return latency.render(self.modes, self.reasons, list(zip((*S.LATENCY_BUCKETS, float("inf")), self.buckets, strict=True)), self.total)


class Service:
    """What the HTTP handler does, without HTTP."""

    def __init__(self, store: Store, runtime: Runtime | None = None):
        self.store, self.runtime, self.counters = store, runtime, Counters()
        self.writing = threading.Lock()

    def recommend(self, user: str, as_of: float | None = None, k: int = S.SLATE) -> dict:
        began = time.perf_counter()
        request = self.store.spark.createDataFrame([(uuid.uuid4().hex, user, time.time() if as_of is None else as_of)], "request_id string, user_id string, as_of double")
        items, events = self.store.items(), self.store.events()
        if self.runtime:
            slates, decisions = self.runtime.recommend(request, events, items, k)
            verdict = decisions.first()
            mode, version, reason = verdict.mode, verdict.model_version, verdict.fallback_reason
        else:
            slates, (mode, version, reason) = rk.recommend(request, events, items, k), ("heuristic", None, "no model configured")
        slates = slates.cache()
        rows = slates.orderBy("position").collect()
        with self.writing:
            self.store.record_exposures(rk.exposures(slates, version))
        slates.unpersist()
        self.counters.observe(mode, reason, time.perf_counter() - began)
        titles = ("item_id", "title", "genres", "score", "retrieval_score", "rank_score", "reasons", "position")
        first = rows[0] if rows else None
        known = fe.user_features(request, events, items).first()
        return {
            "request_id": known.request_id,
            "features": {k: known[k] for k in ("user_id", "as_of", "genre_affinity", "recent_items", "event_count")},
            "assignment": {k: first[k] for k in ("experiment", "variant", "bucket")} if first else None,
            "serving": {"mode": mode, "model_version": version, "fallback_reason": reason, "candidate_count": len(rows)},
            "recommendations": [{k: round(r[k], 4) if k.endswith("score") else r[k] for k in titles} for r in rows],
        }

    def ingest(self, body: bytes) -> tuple[int, dict]:
        if not 1 <= len(body) <= LARGEST:
            return 413, {"error": "body must be between 1 byte and 1 MB"}
        try:
            found = json.loads(body)["events"]
            if not isinstance(found, list) or not 1 <= len(found) <= MOST or not all(isinstance(x, dict) for x in found):
                return 400, {"error": f"events must contain 1 to {MOST} records"}
        except (ValueError, KeyError, TypeError) as e:
            return 400, {"error": f"bad request: {e}"}
        names = S.EVENT_COLUMNS
        raw = self.store.spark.createDataFrame([tuple(None if x.get(c) is None else str(x[c]) for c in names) for x in found], ", ".join(f"{c} string" for c in names))
        good, bad = ing.validate(raw)
        if reasons := bad.select("reason").limit(1).collect():
            return 400, {"error": reasons[0].reason}
        try:
            with self.writing:
                counts = self.store.ingest(good)
        except ing.ConflictError as e:
            return 409, {"error": str(e)}
        return 200, {"accepted": counts.accepted, "duplicates": counts.duplicates}

    def model(self) -> dict:
        return self.runtime.status() if self.runtime else {"ready": False, "error": "no model configured"}

    def get(self, path: str, query: dict[str, list[str]]) -> tuple[int, dict | str]:
        if path == "/api/recommendations":
            return 200, self.recommend(query.get("user_id", ["ada"])[0])
        if path == "/api/overview":
            return 200, {"stats": self.store.stats(), "model": self.model(), "timestamp": time.time(), "status": "healthy"}
        if path == "/api/model":
            status = self.model()
            return 200 if status["ready"] else 503, status
        if path == "/api/drift":
            if not self.runtime or not self.runtime.bundle:
                return 503, {"status": "unavailable", "error": "no model configured"}
            return 200, drift.detect(self.store.events(), self.runtime.bundle.items, version=self.runtime.version)
        if path == "/healthz":
            return 200, {"status": "ok"}
        if path == "/metrics":
            return 200, self.counters.render()
        if path == "/":
            return 200, PAGE
        return 404, {"error": "not found"}


def server(service: Service, host: str = "127.0.0.1", port: int = 8787) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def send(self, status: int, body: dict | str) -> None:
            text = body if isinstance(body, str) else json.dumps(body, separators=(",", ":"))
            kind = "application/json" if not isinstance(body, str) else "text/html; charset=utf-8" if body.startswith("<") else "text/plain; version=0.0.4; charset=utf-8"
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            at = urllib.parse.urlparse(self.path)
            self.send(*service.get(at.path, urllib.parse.parse_qs(at.query)))

        def do_POST(self):  # noqa: N802
            if self.path != "/api/events":
                return self.send(404, {"error": "not found"})
            size = int(self.headers.get("Content-Length") or 0)
            return self.send(*service.ingest(self.rfile.read(size) if 0 < size <= LARGEST else b"" if size < 1 else b" " * (LARGEST + 1)))

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
