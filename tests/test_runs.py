import datetime as dt
import random

from fitspark.streaming.runs import closed_runs

SCHEMA = "run_id string, seq long, ts timestamp, tokens long, error string, ends boolean"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def entry(run, seq, minutes, ends=False, error=None, tokens=10):
    return (run, seq, at(minutes), tokens, error, ends)


#: Files as they arrive: out of order, repeated, late, with a run that stalls, one that ends and begins anew, and one that stays open.
ARRIVING = [
    [entry("a", 2, 3), entry("a", 1, 1, error="x"), entry("b", 1, 2), entry("c", 1, 0), (None, 1, at(1), 1, None, False), ("n", None, at(1), 1, None, False), ("n", 1, None, 1, None, False)],
    [entry("a", 2, 3), entry("a", 3, 5, ends=True), entry("b", 2, 4, tokens=None), entry("tick", 1, 20)],
    [entry("a", 4, 21), entry("c", 2, 19), entry("tick", 2, 60)],
    [entry("c", 3, 5), entry("open", 1, 400), entry("tick", 3, 401)],
]


def test_a_stream_closes_runs_as_its_batch_twin_does(spark, tmp_path):
    where = tmp_path / "in"
    for i, rows in enumerate(ARRIVING):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(where / f"f{i}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(where))
        q = closed_runs(files, gap_seconds=600, late="5 minutes").writeStream.format("memory").queryName("closed_runs_test").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        got = sorted(map(tuple, spark.table("closed_runs_test").collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    # The late entry of c is dropped; what the watermark has not passed is not closed.
    taken = [r for rows in ARRIVING for r in rows if r[:2] != ("c", 3)]
    batch = sorted(map(tuple, closed_runs(spark.createDataFrame(taken, SCHEMA), gap_seconds=600).collect()))
    passed = int((at(401 - 5) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert got == [r for r in batch if (r[2] if r[3] == "done" else r[2] + 600_000) < passed]
    assert [(r[0], r[3], r[4], r[5], r[6]) for r in got] == [("a", "done", 3, 30, 1), ("a", "stalled", 1, 10, 0), ("b", "stalled", 2, 10, 0), ("c", "stalled", 1, 10, 0), ("c", "stalled", 1, 10, 0), ("tick", "stalled", 1, 10, 0), ("tick", "stalled", 1, 10, 0)]


def test_the_batch_twin_equals_a_plain_fold(spark):
    r = random.Random(4)
    rows = [entry(r.choice("abc"), i, r.randrange(300) * 2, ends=r.random() < 0.1, error=r.choice([None, "e"])) for i in range(200)]
    want = []
    for run in "abc":
        now = None
        for _, seq, ts, tokens, error, ends in sorted((x for x in rows if x[0] == run), key=lambda x: (x[2], x[1])):
            ms = int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
            if now and ms - now[2] >= 600_000:
                want.append((*now[:3], "stalled", *now[3:]))
                now = None
            now = (run, now[1] if now else ms, ms, (now[3] if now else 0) + 1, (now[4] if now else 0) + tokens, (now[5] if now else 0) + (error is not None))
            if ends:
                want.append((*now[:3], "done", *now[3:]))
                now = None
        if now:
            want.append((*now[:3], "stalled", *now[3:]))
    df = spark.createDataFrame(rows + rows[:50], SCHEMA)
    assert sorted(map(tuple, closed_runs(df, gap_seconds=600).collect())) == sorted(want)
    assert closed_runs(df.limit(0), gap_seconds=600).count() == 0
