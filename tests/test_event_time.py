"""Event-time states: late events, retries by timers, and files in any order."""

import datetime
import random

from pyspark.sql import functions as F

from quern import scratch
from quern.operators import crawl as K
from quern.streaming import event_time as E

HOUR = 3_600_000_000
START = datetime.datetime(2024, 1, 1)
KIND = "user_id long, ts timestamp, event_id long, happened string"


def test_replay():
    events = [(0, 1, "error"), (7 * HOUR, 2, "fetched"), (7 * HOUR, 1, "nothing")]
    assert E.replay(K.PENDING, None, events, 8 * HOUR, 6 * HOUR) == (K.DOWNLOADED, None)  # pending again before it was fetched
    assert E.replay(K.PENDING, None, events, 8 * HOUR, 9 * HOUR) == (K.FAILED, 0)
    assert E.replay(K.FAILED, 0, [], 6 * HOUR, 6 * HOUR) == (K.PENDING, None) and E.replay(K.FAILED, 0, [], 6 * HOUR - 1, 6 * HOUR) == (K.FAILED, 0)
    assert E.replay(K.PENDING, None, [(5, 2, "text"), (5, 1, "fetched")], 9, HOUR) == (K.EXTRACTED, None)  # ties by id


def stream(spark, rows, parts, tmp):
    folder = f"{tmp}/{len(parts)}-{random.random()}"
    for part in parts:
        spark.createDataFrame([rows[i] for i in part], KIND).coalesce(1).write.mode("append").parquet(folder)
    tick = [(E.TICK, START + datetime.timedelta(days=400), -1, "")]
    spark.createDataFrame(tick, KIND).write.mode("append").parquet(folder)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)


def test_files_in_any_order_give_the_same_states(spark, tmp_path):
    rnd = random.Random(8)
    happened = ["fetched", "text", "no text", "error", "retry", "again", "other"]
    rows = [(u, START + datetime.timedelta(minutes=rnd.randrange(3000)), i, rnd.choice(happened)) for i, u in enumerate(rnd.choices([1, 2, 3, None], k=160))]
    rows += [(4, START, 900, "error")]  # nothing more: only its timer acts
    want = {}
    for u in {r[0] for r in rows}:
        mine = [(int((ts - START).total_seconds()) * 1_000_000, i, h) for k, ts, i, h in rows if k == u]
        want[u] = (E.replay(K.PENDING, None, mine, 400 * 24 * HOUR, 6 * HOUR)[0], len(mine))
    assert want[4] == (K.PENDING, 1)
    order = sorted(range(len(rows)), key=lambda i: rows[i][1])
    jumbled = rnd.sample(order, len(order))
    for places in (order, jumbled):
        parts = [places[k::1][: len(places) // 3] if k == 0 else places[k * (len(places) // 3) : (k + 1) * (len(places) // 3) if k < 2 else None] for k in range(3)]
        got = E.states_by_time(spark, stream(spark, rows, parts, tmp_path), "3 days", 6).collect()
        assert {r["user_id"]: (r["state"], r["n"]) for r in got} == want


def test_what_is_later_than_the_delay_is_left_out(spark, tmp_path):
    rows = [(1, START, 1, "fetched"), (1, START + datetime.timedelta(days=9), 2, "other"), (2, START + datetime.timedelta(days=9), 3, "other"), (1, START + datetime.timedelta(hours=1), 4, "text")]
    got = E.states_by_time(spark, stream(spark, rows, [[0], [1, 2], [3]], tmp_path), "2 hours", 6).collect()
    assert {r["user_id"]: (r["state"], r["n"]) for r in got} == {1: (K.DOWNLOADED, 2), 2: (K.PENDING, 1)}


def test_arrivals(spark, tmp_path):
    df = spark.range(50).select((F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), F.col("id").alias("event_id"), F.lit("fetched").alias("happened"))
    path = scratch.folder(spark, "arrivals-test")
    E.write_out_of_order(df, path, 600)
    back = spark.read.parquet(path)
    assert back.count() == 51 and back.where(f"user_id = {E.TICK}").count() == 1
    E.write_out_of_order(df.limit(0), f"{path}-none", 600)
