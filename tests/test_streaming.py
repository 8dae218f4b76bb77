"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from lorekeep.operators import timeline as T
from lorekeep.operators.ledger import trust_fold
from lorekeep.plans import bindings as B
from lorekeep.plans.ledger_queries import with_delta
from lorekeep.streaming import log as S

DDL = "id bigint, us bigint, ts timestamp, source_id bigint, channel int, directedness double"


def source(spark, sf, tmp_path, parts=3):
    """The log in event order, written as several files that a stream reads one by one."""
    log = B.log(spark, sf).select("id", "us", "ts", "source_id", "channel", "directedness")
    cuts = log.approxQuantile("us", [i / parts for i in range(1, parts)], 0)
    bounds = [-1, *cuts, 1 << 62]
    for a, b in zip(bounds, bounds[1:], strict=False):
        log.where((F.col("us") > a) & (F.col("us") <= b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return log, str(tmp_path / "in")


def run(stream, tmp_path, name):
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_stream_reads_each_row_once_and_throttles_like_the_batch(spark, sf, tmp_path):
    log, path = source(spark, sf, tmp_path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STORE)
    stream = S.stream_turns(spark, path, DDL)
    assert run(stream.select("id"), tmp_path, "rows").count() == log.count()
    kept = run(S.throttle(stream, ["source_id"], 86400), tmp_path, "kept")
    want = T.throttle(log, ["source_id"], 86400)
    assert {r.id for r in kept.collect()} == {r.id for r in want.collect()}


def test_sessions_and_duplicates(spark, sf, tmp_path):
    log, path = source(spark, sf, tmp_path)
    stream = S.stream_turns(spark, path, DDL)
    done = run(S.session_windows(stream, "6 hours"), tmp_path, "sessions")
    batch = {(r.source_id, r.first, r.n) for r in S.session_windows(log, "6 hours").collect()}
    got = {(r.source_id, r.first, r.n) for r in done.collect()}
    assert got and got <= batch
    once = S.spawn_once(stream.select("ts", F.col("source_id").alias("source"), F.col("channel").alias("trigger"), F.lit("x").alias("action")))
    assert run(once, tmp_path, "once").count() >= log.select("source_id", "channel").distinct().count()


def test_refold_of_a_batch(spark, sf, tmp_path):
    rows = with_delta(spark, sf).select("stakeholder", "us", "id", "delta")
    seen = {}
    for k in range(2):
        S.trust_refold(rows.where(F.col("id") % 2 == k), k, str(tmp_path / "trail"), lambda df: seen.update({r.stakeholder: r.trust for r in df.collect()}))
    want = {r.stakeholder: r.trust for r in trust_fold(rows).collect()}
    assert {k: round(v, 6) for k, v in seen.items()} == {k: round(v, 6) for k, v in want.items()}


def feed(spark, batches):
    """A stream that gets one list of rows (key, us, id) a batch."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("key string, us bigint, id bigint")
    return schema, [spark.createDataFrame(b, schema).coalesce(1) for b in batches]


def drive(spark, tmp_path, batches, make):
    """Rows that each batch adds, in turn, and how many rows of state there are after it."""
    schema, frames = feed(spark, batches)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STORE)
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    frames[0].limit(0).write.parquet(path)
    seen, added, states = set(), [], []
    for frame in frames:
        frame.write.mode("append").parquet(path)
        stream = make(spark.readStream.schema(schema).parquet(path).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "0 seconds"))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        now = {tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()}
        added.append(sorted(now - seen, key=repr))
        seen |= now
    return added, states


def at(seconds):
    return int(seconds * T.SECOND)


def test_digest_flushes_at_the_cap_and_at_the_end_of_a_session(spark, tmp_path):
    batches = [
        [("a", at(10), 1), ("a", at(11), 2), ("a", at(12), 3), ("b", at(12), 4)],
        [("a", at(13), 5), ("a", at(14), 6), ("b", at(13), 7), ("c", at(14), 8)],  # a's chapter of three is full
        [("c", at(500), 9)],  # the sessions of a and b are over
        [("a", at(600), 10), ("a", at(601), 11), ("d", at(900), 12)],
        [("d", at(2000), 13)],
    ]
    added, _ = drive(spark, tmp_path, batches, lambda df: S.digest(df, cap=3, seconds=100))
    assert added[0] == [(1, "a", "post", None), (4, "b", "post", None)]
    assert added[1] == [(2, "a", "buffer", 0), (3, "a", "buffer", 0), (5, "a", "buffer", 0), (8, "c", "post", None)]
    assert set(added[2]) | set(added[3]) | set(added[4]) == {(6, "a", "buffer", 1), (7, "b", "buffer", 0), (9, "c", "buffer", 0), (10, "a", "buffer", 2), (11, "a", "buffer", 2), (12, "d", "post", None)}
    assert {(6, "a", "buffer", 1), (7, "b", "buffer", 0)} <= set(added[2])  # by the timer: a and b sent nothing
    rows = spark.createDataFrame([(k, us, us, i) for b in batches for k, us, i in b], "key string, us long, created long, id long")
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("us", "id")
    rows = rows.withColumn("new", (F.col("us") - F.lag("us").over(w) > at(100)).cast("int")).withColumn("session", F.sum(F.coalesce("new", F.lit(0))).over(w))
    want = {(r.id, r.key, r.role, r.chapter) for r in T.digest(rows, cap=3).collect()}
    assert want - {x for b in added for x in b} == {(13, "d", "buffer", 0)}  # d's last session is still open


def test_throttle_forgets_keys_whose_wait_is_over(spark, tmp_path):
    batches = [[(f"k{i}", at(i + 1), i) for i in range(20)], [("k1", at(5), 100), ("k2", at(60), 101)], [("z", at(500), 102)], [("k3", at(501), 103), ("z", at(502), 104)]]
    added, states = drive(spark, tmp_path, batches, lambda df: S.throttle(df, ["key"], 50))
    every = spark.createDataFrame([r for b in batches for r in b], "key string, us long, id long")
    kept = {x[2] for b in added for x in b}
    assert kept == {r.id for r in T.throttle(every, ["key"], 50).collect()}
    assert states[2] < states[0]


def test_session_states_and_what_silence_becomes(spark, tmp_path):
    day = 86400
    batches = [
        [("a", at(10), 1), ("a", at(400), 2), ("b", at(20), 3)],
        [("a", at(700), 4), ("a", at(701), 5), ("c", at(705), 6)],  # b is silent
        [("a", at(1400), 7), ("z", at(5000), 8)],  # a is tired from 1010 on
        [("b", at(day + 5), 9), ("b", at(day + 1200), 10), ("z", at(2 * day), 11)],
    ]
    make = lambda df: S.session_state(df.select(F.col("key").alias("user_id"), "us", F.col("id").alias("event_id"), "ts"), 1000, 60, 500)
    added, _ = drive(spark, tmp_path, batches, make)
    rows = [x for b in added for x in b]
    events = spark.createDataFrame([r for b in batches for r in b], "user_id string, us long, event_id long")
    want = {tuple(r) for r in T.session_state(events, 1000, 60, 500).collect()}
    assert {(u, i, s) for u, _, i, s in rows if i is not None} == want
    assert {"sleeping", "wondering", "thinking"} == {s for _, _, s in want}
    silent = {(u, us - 1, s) for u, us, i, s in rows if i is None}
    assert {("b", at(520), "wondering"), ("b", at(1020), "sleeping"), ("a", at(1460), "sleeping"), ("c", at(1205), "wondering"), ("c", at(1705), "sleeping")} <= silent
    assert not any(u == "a" and s == "wondering" for u, _, s in silent)
