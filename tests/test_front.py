import json
import threading
import urllib.error
import urllib.request

import pytest

from tidemark import api, cli, demo, schemas as S
from tidemark.operators import latency
from tidemark.sources import contracts, files
from tidemark.store import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    demo.seed(s)
    return s


def test_store(spark, store):
    again = demo.seed(store)
    assert (again["accepted"], again["duplicates"]) == (0, 168)
    assert store.stats() == {"items": 24, "events": 168, "users": 4, "exposures": store.exposures().count()}
    assert sorted(r.source_offset for r in store.log().collect()) == list(range(1, 169))


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from tidemark.sources import tables

    assert tables.is_local("local[4]") and tables.is_local("local") and not tables.is_local("local-cluster[2,1,1024]") and not tables.is_local("yarn")

    class Fake:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://x", "_jsc": type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isEmpty": lambda s: True})()})()})()})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Fake())


def test_numbers_follow_the_order(spark):
    from tidemark.store import numbered

    rows = spark.createDataFrame([((7919 * k) % 1000, f"e{k}") for k in range(1000)], "t long, n string").repartition(7)
    got = numbered(rows, ["t"], "place", 10).collect()
    assert sorted((r.t, r.place) for r in got) == [(t, t + 11) for t in range(1000)]
    assert numbered(rows.limit(0), ["t"], "place").collect() == []


def test_http(store):
    web = api.server(api.Service(store), port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_address[1]}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data=body), timeout=120) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    status, text = call("/api/recommendations?user_id=ada")
    got = json.loads(text)
    assert status == 200 and len(got["recommendations"]) == 12 and got["serving"]["mode"] == "heuristic"
    assert got["features"]["event_count"] == 42 and store.exposures().count() == 12
    assert call("/healthz")[0] == 200 and call("/api/model")[0] == 503 and call("/api/drift")[0] == 503 and call("/nowhere")[0] == 404
    assert "tidemark" in call("/")[1]
    metrics = call("/metrics")[1]
    assert 'tidemark_recommendation_requests_total{mode="heuristic"} 1' in metrics and 'le="+Inf"} 1' in metrics
    event = {"event_id": "h1", "user_id": "ada", "item_id": "title-01", "action": "like", "timestamp": 5}
    post = lambda **x: call("/api/events", json.dumps({"events": [event | x]}).encode())
    assert post() == (200, '{"accepted":1,"duplicates":0}') and post() == (200, '{"accepted":0,"duplicates":1}')
    assert post(action="skip")[0] == 409 and post(action="jump")[0] == 400 and call("/api/events", b"{")[0] == 400 and call("/api/events", b'{"events":[]}')[0] == 400
    assert call("/api/events", b" " * 1_000_001)[0] == 413
    web.shutdown()


def test_contract():
    schema = contracts.wire_schema()
    assert set(schema["properties"]) == {f.name for f in S.WIRE} and schema["additionalProperties"] is False
    assert schema["required"] == S.WIRE_REQUIRED and len(schema["required"]) == 7


def test_latency(spark):
    rows = spark.createDataFrame([(x / 1000,) for x in (1, 5, 7, 20, 999, 1500)], "latency_seconds double")
    found = [(r.le, r["count"]) for r in latency.histogram(rows).collect()]
    assert found == [(0.005, 2), (0.01, 3), (0.025, 4), (0.05, 4), (0.1, 4), (0.25, 4), (0.5, 4), (1.0, 5), (float("inf"), 6)]
    text = latency.render({"b": 1, "a": 2}, {'x "y" \\': 1}, found, 2.5)
    assert text.index('mode="a"') < text.index('mode="b"') and 'reason="x \\"y\\" \\\\"' in text
    for n in (1, 2, 5, 100):
        values = [float(k * 7 % n) for k in range(n)]
        got = latency.nearest_rank(spark.createDataFrame([(x,) for x in values], "v double"), "v").first()
        ordered = sorted(values)
        assert (got.p50, got.p95, got.p99, got.max) == tuple(ordered[round((n - 1) * p)] for p in (0.5, 0.95, 0.99, 1))


def test_command_line(spark, tmp_path, capsys):
    def run(*args):
        return cli.main(["--store", f"{tmp_path}/store", *args], spark)

    assert run("demo")["accepted"] == 168
    assert run("ml-demo", "--users", "40")["accepted"] == 40 * 24
    lake = ["--lake", f"{tmp_path}/lake", "--watermark-minutes", "100000"]
    assert run("pipeline", "--batch-size", "2000", *lake)["silver_events"] == 168 + 40 * 24
    assert run("repair-late", *lake)["repaired"] == 0 and run("verify-pipeline", *lake)["verified"]
    assert run("train", "--output", f"{tmp_path}/model", "--dimensions", "4", "--epochs", "4")["model_version"]
    version = files.read_json(spark, f"{tmp_path}/model/manifest.json")["model_version"]
    assert files.read_json(spark, f"{tmp_path}/store/runs/ranker-{version}.json")["tags"]["model_version"] == version
    registry = ["--registry", f"{tmp_path}/registry"]
    staged = run("register-model", "--model", f"{tmp_path}/model", *registry)
    assert run("registry-status", *registry)["registered_versions"] == 1 and staged["model_version"]
    assert run("detect-drift", "--model", f"{tmp_path}/model")["observed_events"] == 168 + 40 * 24
    assert run("analyze-experiment")["status"] == "insufficient_data"
    assert run("benchmark-serving", "--model", f"{tmp_path}/model", "--requests", "50")["requests"] == 50
    ann = run("benchmark-ann", "--items", "500", "--queries", "5", "--dimensions", "8", "--neighbors", "5")
    assert 0 <= ann["recall_at_k"] <= 1
    names = {a for x in cli.parser()._subparsers._group_actions for a in x.choices}
    assert len(names) == 15 and "serve" in names
    assert S.SLATE == 12
