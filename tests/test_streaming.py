import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tarkash.operators import learning
from tarkash.streaming import selections as s

SCHEMA = "user string, ts timestamp, seq long, kind string, roman string, text string, type string, composition string"
START = datetime(2024, 1, 1)


def event(user, ms, seq, kind, text, composition="k#0:1", roman="ka", kind_of="table"):
    return (user, START + timedelta(milliseconds=ms), seq, kind, roman, text, kind_of, composition)


def random_events(n, seed):
    rng, rows, ms = random.Random(seed), [], 0
    for i in range(n):
        ms += rng.choice([0, 500, 1000, 2000, 2001])
        kind = rng.choice(["select", "commit", "key", "commit", "select"])
        text = rng.choice(["Escape", "a", "BackSpace", "b"]) if kind == "key" else rng.choice(["ક", "ખ", "ક", "ka"])
        rows.append(event(rng.choice("uv"), ms, i, kind, text, rng.choice(["k#0:1", "k#0:1", "m#0:1", ""]), rng.choice(["ka", "kha"])))
    return rows


def run(stream, mode, name, spark, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


def test_confirmation_rules(spark):
    rows = [
        event("a", 0, 0, "select", "ક"), event("a", 2000, 1, "commit", "ક"),
        event("b", 0, 0, "select", "ક"), event("b", 2001, 1, "commit", "ક"),
        event("c", 0, 0, "select", "ક"), event("c", 1, 1, "key", "Escape"), event("c", 2, 2, "commit", "ક"),
        event("d", 0, 0, "select", "ક"), event("d", 1, 1, "key", "x", "other"), event("d", 2, 2, "commit", "ક"),
        event("e", 0, 0, "select", "ક"), event("e", 1, 1, "key", "x"), event("e", 2, 2, "commit", "ક"),
        event("f", 0, 0, "select", "ક", kind_of="prefix"), event("f", 1, 1, "commit", "ક"),
        event("g", 0, 0, "select", "ક"), event("g", 1, 1, "commit", "ખ"), event("g", 2, 2, "commit", "ક"),
        event(None, 0, 0, "select", "ક"), event("h", 0, 0, "select", None, None, None, None), event("h", 1, 1, "commit", None),
    ]
    got = s.confirmed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.user, r.roman, r.native) for r in got) == [("a", "ka", "ક"), ("e", "ka", "ક")]


def test_stream_equals_batch(spark, tmp_path):
    rows = random_events(400, 2)
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = s.confirmed(spark.createDataFrame(rows, SCHEMA))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = run(s.confirm_stream(events), "append", "confirmed", spark, tmp_path)
    assert len(stream) > 5 and sorted(map(tuple, stream)) == sorted(map(tuple, batch.collect()))
    times = batch.dropDuplicates(["roman", "ts"])
    times.repartition(1).write.parquet(str(tmp_path / "sel"))
    learnt = run(s.learn_stream(spark.readStream.schema(s.CONFIRMED).parquet(str(tmp_path / "sel"))), "update", "learnt", spark, tmp_path)
    wanted = learning.preferred(spark.read.parquet(str(tmp_path / "sel")), "roman", "native", "ts", "native").collect()
    assert {(r.roman, r.preferred) for r in learnt if r.preferred} == {(r.roman, r.preferred) for r in wanted}


def test_picked_marks_and_commits(spark):
    rows = spark.createDataFrame([(1, 0, 6), (2, 7, 8), (7, 0, 9), (3, 6, 8), (None, 0, 1)], "n int, at int, size int")
    assert [r[0] for r in rows.select(s.picked(F.col("n"), F.col("at"), F.col("size"))).collect()] == [0, 7, None, None, None]
    keys = spark.createDataFrame([(k,) for k in ["period", "Shift+question", "Control+period", " ", "space", ",", "a", "", None]], "k string")
    assert [r[0] for r in keys.select(s.mark(F.col("k"))).collect()] == [".", "?", None, " ", " ", ",", None, None, None]
    typed = spark.createDataFrame([("u", 1, "period", "ક"), ("u", 2, "period", None), ("u", 3, "a", "ક")], "user string, ts int, key string, candidate string")
    assert sorted((r.ts, r.place, r.text) for r in s.commits(typed).collect()) == [(1, 0, "ક"), (1, 1, ".")]


def test_stores(spark):
    old = '{"version":1,"choices":{"Ka1":{"ક":{"count":300,"last_used":5},"x":null},"1":{"ક":{"count":1}}}}'
    new = '{"version":2,"choices":{"kha":{"preferred_native":"ખ","natives":{"ખ":{"explicit_count":2,"last_used":7,"count":4}}},"ga":{"preferred_native":"ગ"}}}'
    rows = learning.parse(spark.createDataFrame([(old,), (new,), ("{bad",), (None,), ("",)], "t string"), "t").collect()
    assert sorted(tuple(r) for r in rows if r.native) == [("ka", "ક", 0, 5, 255, None), ("kha", "ખ", 2, 7, 4, "ખ")]
    assert [(r.roman, r.preferred) for r in rows if not r.native] == [("ga", "ગ")]
    kept = spark.createDataFrame([("a", 3), ("b", 1), ("b", 5), ("c", 3)], "k string, t int")
    assert sorted(tuple(r) for r in learning.compact(kept, "k", "t", 2).collect()) == [("a", 3), ("b", 1), ("b", 5)]
