"""Distributed row numbers and trailing frames against pandas, with one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from notemill.operators import observability as ob
from notemill.operators import ordering as od


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(5)
    n = 3000
    keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    seconds = rng.integers(0, 20_000, n)
    seconds[: n // 3] = 7777  # a third of the rows in one instant
    return pd.DataFrame({"key": keys, "ts": pd.to_datetime(seconds, unit="s"), "id": np.arange(n),
                         "value": np.round(rng.exponential(50, n), 2)})


@pytest.fixture(scope="module")
def frame(spark, events):
    return spark.createDataFrame(events).repartition(7)


def test_index_is_the_sorted_position(frame, events):
    got = od.distributed_index(frame, ["key", "ts", "id"]).select("id", "pos").toPandas().set_index("id")["pos"]
    want = events.sort_values(["key", "ts", "id"])["id"].tolist()
    assert [got[i] for i in want] == list(range(len(events)))


def test_hashed_row_number(frame, events):
    keyed = frame.select("key", "id", F.md5(F.col("id").cast("string")).alias("h"))
    out = od.hashed_row_number(keyed, "key", "h", "id", "rn", total="n", prefix_chars=1).toPandas()
    out = out.sort_values(["key", "h"])
    assert (out["rn"] == out.groupby("key").cumcount() + 1).all()
    assert (out["n"] == out.groupby("key")["id"].transform("count")).all()


def test_trailing_average(frame, events):
    out = od.trailing_rows_average(frame, "key", ["ts", "id"], "value", 10, "m", chunk_rows=37).toPandas()
    ordered = events.sort_values(["key", "ts", "id"])
    want = ordered.groupby("key")["value"].rolling(10, min_periods=1).mean().reset_index(level=0, drop=True)
    ordered["m"] = want
    both = out[["id", "m"]].merge(ordered[["id", "m"]], on="id")
    assert len(both) == len(events) and np.allclose(both["m_x"], both["m_y"])


@pytest.mark.parametrize("slices", [1, 4, 60])
def test_trailing_count(frame, events, slices):
    out = od.trailing_time_count(frame, "key", "ts", 600, "c", slices=slices).toPandas().set_index("id")["c"]
    assert len(out) == len(events)
    for _, group in events.groupby("key"):
        t = group["ts"].astype("int64").to_numpy() // 10 ** 9 if str(group["ts"].dtype).endswith("[ns]") else (
            group["ts"].astype("datetime64[s]").astype("int64").to_numpy())
        s = np.sort(t)
        want = np.searchsorted(s, t, "right") - np.searchsorted(s, t - 600, "left")
        assert (out[group["id"]].to_numpy() == want).all()


def test_exact_percentiles(frame, events):
    got = {r["key"]: r for r in ob.latency_summary(frame, "key", "value").collect()}
    for key, group in events.groupby("key"):
        s = sorted(group["value"])
        assert got[key]["median_time"] == s[len(s) // 2]
        assert got[key]["p95_time"] == s[int(len(s) * 0.95)]
        assert got[key]["p99_time"] == s[int(len(s) * 0.99)]
        assert got[key]["total_processed"] == len(s)


def test_round_robin(frame):
    counts = od.round_robin(frame, ["id"], ["x", "y", "z"], "d").groupBy("d").count().collect()
    assert sorted(r["count"] for r in counts) == [1000, 1000, 1000]
