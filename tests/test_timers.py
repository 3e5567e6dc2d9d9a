from __future__ import annotations

import random
from datetime import datetime, timedelta

from skein.streaming import timers as E

START = datetime(2024, 1, 1)


def run(stream, folder):
    """All that is there now, on top of what an earlier run has done."""
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
    q.awaitTermination()


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_merged():
    assert E.merged([(5, 5, 1, 1.0), (0, 0, 1, 2.0), (3, 3, 1, 0.5), (20, 22, 2, 1.0)], 4) == [(0, 5, 3, 3.5), (20, 22, 2, 1.0)] and E.merged([], 3) == []


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(1)
    schema = "user string, ts timestamp, value double"
    rows = sorted((START + timedelta(minutes=rng.randint(0, 3000)), rng.choice("ab"), float(rng.randint(0, 9))) for _ in range(150))
    rows.append((START + timedelta(days=30), "z", 1.0))  # moves the watermark past all of them
    for name, cuts in (("once", [0, 151]), ("twice", [0, 60, 110, 151])):
        folder = f"{tmp_path}/{name}"
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = rows[a:b]
            rng.shuffle(part)
            write(spark, folder, [(u, t, v) for t, u, v in part], schema)
            run(E.sessions(spark.readStream.schema(schema).parquet(f"{folder}/in"), "user", 1800, "10 minutes"), folder)
    got = {name: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}/out").collect())) for name in ("once", "twice")}
    want = []
    for user in "ab":
        spans = E.merged([(round((t - START).total_seconds() * 1e6), round((t - START).total_seconds() * 1e6), 1, v) for t, u, v in rows if u == user], 1_800_000_000)
        want += [(user, START + timedelta(microseconds=s), START + timedelta(microseconds=e), n, total) for s, e, n, total in spans]
    assert got["once"] == got["twice"] == sorted(want) and len(want) > 20
