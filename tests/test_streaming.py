import socket
import threading
import time

from pyspark.sql import Row, functions as F

from tidemark.functions.policies import Policy
from tidemark.operators import filters, relay, rules
from tidemark.operators.store import ArchiveTable
from tidemark.streaming import ingest, recovery, sources

NOW = 1_700_000_000


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return df.sparkSession.table(name)


def test_store_and_relay_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(f"app.a 1 {NOW}\napp.a 2 {NOW + 1}\nbad line\napp.b. 3 {NOW}\napp.c 4 {NOW}\n")
    archive, sent, audited = ArchiveTable(spark, str(tmp_path / "archive"), Policy.parse("60s:24h")), [], []
    sinks = relay.Sinks()
    sinks.register("kinesis", lambda df, rest: sent.append((rest, df.count())))
    each = ingest.store_and_relay(archive, lambda: NOW, relay.parse_routes("app=kinesis:x"), sinks, audit=lambda df: audited.append(df.count()), block=["c$"])
    q = ingest.line_files(spark, str(tmp_path / "in")).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {(r.name, r.val) for r in archive.read().collect()} == {("app.a", 2.0)} and sent == [("x", 2)] and audited == [4]


def test_repeats_in_a_stream_match_the_batch_filter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = [("a", 60), ("a", 90), ("a", 120), ("b", 30), ("a", 60), ("b", 60), ("a", 61)]
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text("".join(f"{n} {i} {t}\n" for i, (n, t) in enumerate(texts) if i // 4 == k))
        time.sleep(0.05)
    rows = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(tmp_path / "in"))
    from tidemark.sources.lines import parse_lines

    points = parse_lines(rows).select("name", "val", "ts", F.col("val").cast("long").alias("seq"))
    out = run(ingest.drop_repeated(points, ttl_minutes=None), "repeats", tmp_path)
    batch = filters.drop_repeated(spark.createDataFrame([(n, float(i), t, i) for i, (n, t) in enumerate(texts)], "name string, val double, ts long, seq long"))
    assert sorted(r.seq for r in out.collect()) == sorted(r.seq for r in batch.collect()) == [0, 2, 4, 5]


def test_slots_close_behind_the_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.txt").write_text("m.a 1 60\nm.b 2 61\nm.a 5 120\n")
    (tmp_path / "in" / "1.txt").write_text("m.a 7 100000\n")
    points = ingest.line_files(spark, str(tmp_path / "in"), max_files=1)
    out = run(ingest.slots(points, rules.parse_rules("all (60) = sum m.*")), "slots", tmp_path)
    assert sorted((r.name, r.val, r.ts) for r in out.collect())[:2] == [("all", 3.0, 60), ("all", 5.0, 120)]


def test_latency_slots_in_a_stream_match_the_batch(spark, tmp_path):
    rows = [("ramp.x", float(k), 600 + 7 * k, 600 + 7 * k + k * k % 9) for k in range(30)] + [("ramp.x", 1.0, 100_000, 100_000)]
    schema = "name string, val double, ts long, arrival long"
    for part in (rows[:-1], rows[-1:]):  # the second file moves the watermark on
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    own = rules.parse_rules("slow (60) c = latency ramp.x\nlevel.max (60) = custom1 ramp.x")
    out = run(ingest.slots(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), own), "latency", tmp_path)
    batch = rules.aggregate(spark.createDataFrame(rows, schema), rules.match_rules(spark.createDataFrame([("ramp.x",)], "name string"), own))
    key = lambda df: sorted((r.name, r.ts, round(r.val, 9)) for r in df.filter("ts < 90000").collect())
    assert key(out) == key(batch) and {r.name for r in out.collect()} == {"slow.min", "slow.max", "slow.mean", "slow.count", "level.max"}


def test_live_path_drops_repeats_and_ruled_out_points(spark, tmp_path):
    archive, held = ArchiveTable(spark, str(tmp_path / "archive"), Policy.parse("60s:24h")), [[]]
    each = ingest.store_and_relay(archive, lambda: NOW, aggregation=lambda: held[0], precision=60)
    t = NOW - NOW % 60
    batch = spark.createDataFrame([("a.x", 1.0, t, 1, t + 5), ("a.x", 2.0, t + 1, 2, t + 5), ("b.x", 3.0, t, 3, t + 5), ("b.y", 4.0, t - 600, 4, t + 5)], "name string, val double, ts long, seq long, arrival long")
    each(batch, 0)
    assert sorted((r.name, r.val) for r in archive.read().collect()) == [("a.x", 1.0), ("b.x", 3.0), ("b.y", 4.0)]
    held[0] = rules.parse_rules("all (60) drop = sum b.*")  # the rules are read again with every batch
    each(batch.withColumn("val", F.col("val") * 10), 1)
    assert sorted((r.name, r.val) for r in archive.read().collect()) == [("a.x", 10.0), ("b.x", 3.0), ("b.y", 40.0)]


def test_closed_slots_go_to_store_and_relay_as_they_are(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t = NOW - NOW % 60
    (tmp_path / "in" / "a.txt").write_text("".join(f"web.h{k % 3}.hits {k} {t + k}\n" for k in range(90)) + f"web.h1.hits 5 {t + 6000}\n")
    points = ingest.line_files(spark, str(tmp_path / "in"))
    aggregation = rules.parse_rules("all.<what> (60) = sum web.*.<what>")
    archive, sent, sinks = ArchiveTable(spark, str(tmp_path / "archive"), Policy.parse("60s:24h")), [], relay.Sinks()
    sinks.register("kinesis", lambda df, rest: sent.extend((r.name, r.val, r.ts) for r in df.collect()))
    each = ingest.store_slots(archive, lambda: t + 6000, relay.parse_routes("all=kinesis:x"), sinks)
    q = ingest.slots(points, aggregation).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    expected = [("all.hits", float(sum(range(60))), t), ("all.hits", float(sum(range(60, 90))), t + 60)]
    assert sorted((r.name, r.val, r.ts) for r in archive.read().collect()) == expected == sorted(sent)


def test_records_from_a_sink_to_a_stream(spark, tmp_path):
    p = spark.createDataFrame([(f"r.n{k % 7}", k + 0.5, NOW + k, k) for k in range(40)], "name string, val double, ts long, seq long")
    sinks = relay.Sinks(most=3, clock=lambda: NOW + 9)
    for part in (p.filter("seq < 25"), p.filter("seq >= 25").drop("seq")):
        sinks.write(part, f"records:{tmp_path / 'records'}")
    out = run(ingest.record_files(spark, str(tmp_path / "records"), max_files=1), "records", tmp_path).collect()
    assert sorted((r.name, r.val, r.ts) for r in out) == sorted((r.name, r.val, r.ts) for r in p.collect())
    assert {r.arrival for r in out} == {NOW + 9}


def test_a_sender_deals_pieces_over_addresses_and_skips_a_dead_one(tmp_path):
    got, servers = [], []
    for _ in range(2):
        s = socket.create_server(("127.0.0.1", 0))
        servers.append(s)

    def serve(s):
        conn, _ = s.accept()
        with conn:
            while data := conn.recv(1 << 16):
                got.append(data)

    threads = [threading.Thread(target=serve, args=(s,)) for s in servers]
    for t in threads:
        t.start()
    with socket.create_server(("127.0.0.1", 0)) as gone:
        dead = gone.getsockname()
    lines = [f"s.n{k} {k} 60" for k in range(50)]
    relay._sender([dead, *(s.getsockname() for s in servers)], most=100)(iter(Row(value=x) for x in lines))
    for t in threads:
        t.join(30)
    for s in servers:
        s.close()
    assert sorted(b"".join(got).decode().split("\n")) == sorted([*lines, ""]) and len(got) >= 2


def test_gaps(spark, tmp_path):
    table = recovery.GapTable(spark, str(tmp_path / "gaps.json"))
    check = recovery.Checkpoint(spark, str(tmp_path / "checkpoint"))
    assert check.read(1_000_000) == 700_000
    check.write(123_456)
    assert check.read(0) == 120_000
    first = recovery.register_gap(table, 120_000, 600_000)
    second = recovery.register_gap(table, 120_000, 900_000)
    assert (first.start_ms, first.end_ms, second.start_ms) == (120_000, 720_000, 720_000)
    points = spark.createDataFrame([("a", float(t), t, 1000 * t + 7, k) for k, t in enumerate((60, 120, 180, 720, 721, 1080, 1200))], "name string, val double, ts long, arrival_ms long, seq long")
    seen = []

    def process(df, gap):
        seen.append([r.ts for r in df.collect()])
        return gap.end_ms

    assert recovery.recover(table, points, process) == 2 and table.gaps() == []
    assert seen == [[120, 180, 720], [720, 721]]


def test_replay_stops_at_the_first_later_record(spark):
    rows = [("a", 1.0, t, a, k, r) for k, (t, a, r) in enumerate([(60, 1, 1), (120, 2, 2), (600, 3, 3), (180, 4, 4)])]
    points = spark.createDataFrame(rows, "name string, val double, ts long, arrival_ms long, seq long, record long")
    assert [r.ts for r in recovery.replay(points, recovery.Gap(60_000, 240_000)).collect()] == [60, 120]


def test_datagrams(spark, tmp_path):
    spark.dataSource.register(sources.UdpLines)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    df = spark.readStream.format("udp_lines").option("port", port).option("wait", "1").load()
    q = df.writeStream.format("memory").queryName("udp").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("udp").count() < 2:
            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
                s.sendto(b"a 1 60\nb 2 60", ("127.0.0.1", port))
            time.sleep(0.3)
    finally:
        q.stop()
    assert {"a 1 60", "b 2 60"} <= {r.value for r in spark.table("udp").collect()}


def test_generator_and_followers(spark):
    p = sources.generated_points(spark, 10, 3, NOW)
    assert p.count() == 30 and p.select("name").distinct().count() == 10

    class Query:
        stopped = False

        def stop(self):
            self.stopped = True

    streams = sources.Streams(lambda name: Query())
    assert streams.follow("a\nb") == ({"a", "b"}, set())
    gone = streams.running["a"]
    assert streams.follow("b\n#a") == (set(), {"a"}) and gone.stopped
