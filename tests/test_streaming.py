import datetime as dt
import random

from pyspark.sql import functions as F

from lodestrata.streaming import ingest

ZERO = dt.datetime(2024, 1, 1)
POLICY = ingest.RetryPolicy(most=3, wait=60, lease=300)


def _run(spark, folder, batches, policy=POLICY):
    """The actions of batches of (url, kind, second), one file each, and how many each batch wrote."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(u, k, ZERO + dt.timedelta(seconds=s)) for u, k, s in rows], "url string, kind string, ts timestamp").coalesce(1)
        df.write.parquet(str(folder / "in" / f"b{i:03d}"))
    events = spark.readStream.schema("url string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
    actions = ingest.retry_stream(events, policy)
    split = lambda batch: (batch.filter("action <> 'dead'"), batch.filter("action = 'dead'"))
    for _ in range(2):  # a second start finds nothing new, and writes nothing twice
        ingest.split_sink(actions, split, str(folder / "good"), str(folder / "dead"), str(folder / "cp")).awaitTermination(300)
    shape = "url string, attempt int, action string, at timestamp, batch int"
    rows = spark.read.schema(shape).parquet(str(folder / "good")).unionByName(spark.read.schema(shape).parquet(str(folder / "dead"))).collect()
    return sorted((r.url, int((r["at"] - ZERO).total_seconds()), r.attempt, r.action) for r in rows)


def test_retries_over_time(spark, tmp_path):
    batches = [
        [("fine", "new", 0), ("slow", "new", 0), ("bad", "new", 0), ("bad", "new", 1), ("stray", "ok", 0)],
        [("fine", "ok", 10), ("bad", "failed", 10), ("clock", "ok", 30)],
        [("clock", "ok", 71)],
        [("bad", "failed", 80), ("clock", "ok", 90)],
        [("clock", "ok", 201)],
        [("bad", "failed", 210), ("bad", "ok", 220), ("clock", "ok", 230)],
        [("clock", "ok", 361)],
        [("slow", "ok", 370), ("clock", "ok", 400)],
        [("clock", "ok", 9000)],
    ]
    assert _run(spark, tmp_path, batches) == [
        ("bad", 0, 1, "try"), ("bad", 70, 2, "try"), ("bad", 200, 3, "try"), ("bad", 210, 3, "dead"),
        ("fine", 0, 1, "try"), ("fine", 10, 1, "done"),
        ("slow", 0, 1, "try"), ("slow", 360, 2, "try"), ("slow", 370, 2, "done"),
    ]


def test_silence_ends_as_a_dead_letter(spark, tmp_path):
    assert _run(spark, tmp_path, [[("a", "new", 0)], [("clock", "ok", 100_000)], [("clock", "ok", 100_001)]]) == [
        ("a", 0, 1, "try"), ("a", 360, 2, "try"), ("a", 780, 3, "try"), ("a", 1080, 3, "dead"),
    ]


def _plain(rows, policy):
    """The same by one clock over all events."""
    out = []
    for url in {r[0] for r in rows}:
        tries = ingest._Tries(policy)
        for _, kind, at in sorted((r for r in rows if r[0] == url), key=lambda r: (r[2], r[1])):
            tries.hear(kind, at * 1000)
        tries.until(10**12)
        out += [(url, at // 1000, n, action) for n, action, at in tries.out]
    return sorted(out)


def test_batches_do_not_matter(spark, tmp_path):
    rng = random.Random(31)
    policy = ingest.RetryPolicy(most=3, wait=5, lease=20)
    rows = [(f"u{rng.randrange(12)}", rng.choice(["new", "ok", "failed", "failed"]), s) for s in range(150)] + [("clock", "ok", 5000)]
    cut = sorted(rng.sample(range(1, 150), 5))
    batches = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])] + [[("clock", "ok", 5001)]]
    want = _plain(rows, policy)
    assert _run(spark, tmp_path, batches, policy) == want and {"dead", "done"} <= {x[3] for x in want}


def test_windows_and_late_rows(spark):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("b", "2024-01-01 01:00:00", 4.0)]
    df = spark.createDataFrame(rows, "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r.event_type, r.window.start.hour, r.n, r.value) for r in ingest.activity(df).collect())
    assert got == [("a", 0, 2, 3.0), ("b", 1, 1, 4.0)]
