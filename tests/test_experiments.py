from tidemark import schemas as S
from tidemark.operators import experiments as ex

T = 1_000_000.0
COLUMNS = "request_id string, user_id string, item_id string, position int, experiment string, variant string, timestamp double"


def shown(spark, rows):
    return spark.createDataFrame([(r, u, i, 1, "ranker-v1", v, t) for r, u, i, v, t in rows], COLUMNS)


def test_readout(spark):
    x = shown(spark, [("r1", "a", "i", "control", T), ("r2", "b", "i", "control", T), ("r3", "c", "i", "challenger", T), ("r4", "d", "i", "challenger", T)])
    e = spark.createDataFrame([("1", "a", "i", "like", T + 10, 1.0), ("2", "c", "i", "complete", T + 10, 1.0), ("3", "d", "i", "like", T + 20, 1.0), ("4", "b", "other", "like", T + 5, 1.0)], S.EVENTS)
    got = ex.analyze(x, e, T + 86_401, window_days=1)
    assert got["status"] == "ready" and got["mature_requests"] == 4
    assert got["variants"]["control"]["conversion_rate"] == 0.5 and got["variants"]["challenger"]["conversion_rate"] == 1.0
    assert got["comparison"]["absolute_lift"] > 0 and got["cuped_theta"] == 0.0
    assert got["comparison"]["sequential_guardrail"] == "continue" and not got["comparison"]["minimum_sample_reached"]


def test_immature_requests(spark):
    x = shown(spark, [("r1", "a", "i", "control", T)])
    assert ex.analyze(x, spark.createDataFrame([], S.EVENTS), T + 60)["status"] == "insufficient_data"


def test_ends_of_the_windows(spark):
    day = 86_400.0
    x = shown(spark, [(f"r{k}", f"u{k}", "i", "control", T) for k in range(6)])
    times = [T, T + 0.5, T + day, T + day + 0.5, T - day, T - day - 0.5]
    e = spark.createDataFrame([(str(k), f"u{k}", "i", "like", t, 1.0) for k, t in enumerate(times)], S.EVENTS)
    rows = {r.request_id: (r.outcome, r.pre_period) for r in ex.observations(x, e, T + 10 * day, 1).collect()}
    assert rows == {"r0": (0, 0), "r1": (1, 0), "r2": (1, 0), "r3": (0, 0), "r4": (0, 1), "r5": (0, 0)}
    assert ex.mature_requests(x, T + day, 1).count() == 6 and ex.mature_requests(x, T + day - 1, 1).count() == 0


def test_single_request_arm(spark):
    x = shown(spark, [("r1", "a", "i", "control", T)])
    got = ex.analyze(x, spark.createDataFrame([], S.EVENTS), T + 10 * 86_400)
    assert got["variants"]["control"]["standard_error"] == 0 and got["comparison"] is None
