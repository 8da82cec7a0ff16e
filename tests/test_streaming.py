import datetime as dt

from graphloom.streaming import logs

SCHEMA = "assertion_id long, event_id long, to_state string, ts timestamp_ntz"
T = [dt.datetime(2024, 1, 1, h) for h in range(20)]


def stream(spark, tmp_path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")


def test_replay_in_order_of_time(spark, tmp_path):
    rows = [(1, 2, "verified", T[2]), (1, 1, "candidate", T[1]), (2, 3, "approved", T[1]), (1, 4, "approved", T[3])]
    got = {r["event_id"]: (r["from_state"], r["error"]) for r in logs.run_to_table(logs.replay(stream(spark, tmp_path, [rows])), "append").collect()}
    assert got == {1: (None, None), 2: ("candidate", None), 3: (None, "no_start"), 4: ("verified", "illegal_transition")}


def test_repeated_events_count_once(spark, tmp_path):
    rows = [(1, 1, "candidate", T[1]), (1, 1, "candidate", T[1]), (1, 2, "verified", T[2])]
    assert logs.run_to_table(logs.once(stream(spark, tmp_path, [rows, rows]), "event_id", "1 day"), "append").count() == 2


def test_windows(spark, tmp_path):
    rows = [(1, i, "candidate", T[i % 3]) for i in range(9)]
    got = logs.run_to_table(logs.counts(stream(spark, tmp_path, [rows]), "2 hours", "1 day", ["to_state"]), "complete").collect()
    assert sorted(r["n"] for r in got) == [3, 6]
