import gzip
import io
import json
import tarfile

from pyspark.sql import functions as F

from skerry.sources import logs, sinks
from skerry.streaming import jobs


def test_dump_statement():
    line = r"INSERT INTO `messages` VALUES ('I',1,1.5,'it\'s','a''b',NULL,'x, (y)','n\nl',-3),('W',2);"
    assert list(logs.dump_rows(line)) == [["I", 1, 1.5, "it's", "a'b", None, "x, (y)", "n\nl", -3], ["W", 2]]


def test_read_dump_skips_other_widths(spark, tmp_path):
    row = "('I',1,1700000000.5,'epn1','r',7,'u','s','f','d','p',500,0,3,'src','hello (world), it\\'s')"
    (tmp_path / "d.sql.gz").write_bytes(gzip.compress(f"-- dump\nINSERT INTO `m` VALUES {row},('I',2),{row};\nINSERT INTO `m` VALUES {row};\n".encode()))
    got = logs.read_dump(spark, str(tmp_path / "d.sql.gz")).collect()
    assert len(got) == 3 and got[0].message == "hello (world), it's" and got[0].run == 500 and got[0].timestamp == 1700000000.5


def test_tar_members(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, text in (("x/dds_2024-01-01.1.log", "one\ntwo\nthree"), ("x/dds_2024-01-02.1.log", "no"), ("x/t_out.log", "out"), ("x/t_err.log", "err"), ("x/u_out.log", "late"), ("x/readme", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    got = logs.read_tar(spark, str(tmp_path / "a.tar.gz"), files=2, lines=2).collect()
    assert [(r.member, r.number, r.line) for r in got] == [("x/dds_2024-01-01.1.log", 0, "one"), ("x/dds_2024-01-01.1.log", 1, "two"), ("x/t_out.log", 0, "out"), ("x/t_err.log", 0, "err")]


def test_listing_json_csv_and_missing_tables(spark, tmp_path):
    (tmp_path / "big").write_bytes(b"x" * 2000)
    (tmp_path / "small").write_bytes(b"x")
    assert [r.length for r in logs.listing(spark, str(tmp_path)).collect()] == [2000]
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("broken",), ('{"a": 1, "z": 2}',)], "value string")
    parsed = logs.json_lines(lines, "a int, b string").collect()
    assert (parsed[0].a, parsed[0].b, parsed[1].a, parsed[1]._corrupt_record) == (1, "x", None, "broken")
    assert logs.strict_fields(lines, ["a", "b"]).count() == 1
    (tmp_path / "s.csv").write_text("t,x\n1,2.5\n2,oops\n")
    assert [r.x for r in logs.read_csv(spark, str(tmp_path / "s.csv"), ["t", "x"]).collect()] == [2.5, 0.0]
    assert logs.read_or_empty(spark, str(tmp_path / "nowhere"), "a int").count() == 0


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        sinks.upsert(one, path, ["k"])
    sinks.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.retain(spark, path, F.col("k") > 1)
    assert spark.read.parquet(path).count() == 2
    assert sinks.migrate(spark, path, str(tmp_path / "u")) == 2
    sinks.purge(spark, str(tmp_path), ["t"])
    assert not sinks.exists(spark, path)


def test_upsert_by_partition_and_dropping_old_ones(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(1, "2024-01-01", "a"), (2, "2024-01-02", "b")], "k int, date string, v string")
    sinks.upsert(rows, path, ["k"], "date")
    sinks.upsert(spark.createDataFrame([(2, "2024-01-02", "c")], "k int, date string, v string"), path, ["k"], "date")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    assert sinks.drop_old_partitions(spark, path, "date", "2024-01-02") == ["date=2024-01-01"]


def test_create_only_and_webhooks(spark, tmp_path):
    path = str(tmp_path / "r")
    one = spark.createDataFrame([("v1", 1)], "version string, t long")
    assert sinks.create_only(one, path, "version", "t") and not sinks.create_only(one, path, "version", "t")
    assert sinks.create_only(spark.createDataFrame([("v2", 2)], "version string, t long"), path, "version", "t")
    group = json.dumps({"status": "firing", "receiver": "r", "groupKey": "g", "alerts": [{"labels": {"alertname": "data-loss", "b": "1"}}]})
    rows = [(group, 1000), (group, 2000), (group, 61_000), (json.dumps({"monitor_name": "m", "signal_ids": "a, b,a"}), 5)]
    got = sinks.webhook_rows(spark.createDataFrame(rows, "body string, received_ms long")).orderBy("record_kind", "received_ms").collect()
    assert [(r.record_kind, r.alertname, r.alert_count, r.signal_ids) for r in got] == [("action", "m", 0, ["a", "b"]), ("group", "data-loss", 1, []), ("group", "data-loss", 1, [])]


EVENTS = "collector_ms long, family string, origin_host string, node string, severity_norm string, enter_system_lag_ms long, ingest_lag_ms long"


def test_stream_rollup_counts_late_rows(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda ms, host: (ms, "local", host, "n1", "info", 1, 2)
    each = jobs.rollup_each(root, 600_000)

    def feed(*rows):
        spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(source)
        jobs.run_once(spark.readStream.schema(EVENTS).parquet(source), each, str(tmp_path / "check"), "append")

    feed(row(1000, "a"), row(700_000, "a"))
    feed(row(2000, "a"))  # late, in a bucket that was rolled before
    got = sinks.committed(spark, root).where("entity_kind = 'host'").orderBy("ts").collect()
    assert [(r.ts, r.doc_count) for r in got] == [(0, 2), (600_000, 1)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """Batch 0 runs twice, and batch 1, which brings silence, twice as well: counts, imputed rows and markers stay."""
    root, minutes = str(tmp_path / "out"), 60_000
    each = jobs.rollup_each(root, 10 * minutes)
    first = spark.createDataFrame([(minutes * k, "local", "ab"[k % 2], "n1", "info", 1, 2) for k in range(10)], EVENTS)
    second = spark.createDataFrame([(minutes * k, "local", "a", "n1", "info", 1, 2) for k in range(10, 20)], EVENTS)
    for number, batch in ((0, first), (0, first), (1, second), (1, second)):
        each(batch, number)
    got = sorted((r.ts, r.entity, r.doc_count, r.imputed) for r in sinks.committed(spark, root).where("entity_kind = 'host'").collect())
    assert got == [(0, "a", 5, False), (0, "b", 5, False), (600_000, "a", 10, False), (600_000, "b", 0, True)]
    assert spark.read.parquet(f"{root}/events").count() == 20


def test_upsert_keeps_the_latest_and_touches_its_partitions(spark, tmp_path):
    import os

    path = str(tmp_path / "p")
    sinks.upsert(spark.createDataFrame([(1, 1, 5, "old"), (1, 1, 9, "new"), (2, 2, 1, "x")], "k int, part int, at int, v string"), path, ["k"], "part", "at")
    before = {f: os.path.getmtime(f"{path}/part=2/{f}") for f in os.listdir(f"{path}/part=2")}
    sinks.upsert(spark.createDataFrame([(1, 1, 10, "newer")], "k int, part int, at int, v string"), path, ["k"], "part", "at")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "newer"), (2, "x")]
    assert before == {f: os.path.getmtime(f"{path}/part=2/{f}") for f in os.listdir(f"{path}/part=2")}


def test_a_crash_between_renames_is_mended(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.upsert(rows, path, ["k"])
    os.rename(path, f"{path}.old")
    sinks.upsert(spark.createDataFrame([(2, "b")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b")]


def test_a_tail_reads_what_is_appended(spark, tmp_path):
    """Lines come once each, an unfinished one only when it ends, and a file that was replaced from its start; a restart goes on."""
    from skerry.sources import tail

    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_bytes("één\ntwo\nthr".encode())
    seen = []

    def start():
        rows = tail.lines(spark, str(tmp_path / "*.log"))
        return rows.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: seen.extend((r.file.rpartition("/")[2], r.at, r.line) for r in df.collect())).start()

    def settled(query):
        query.processAllAvailable()
        got = sorted(seen)
        seen.clear()
        return got

    query = start()
    assert settled(query) == [("a.log", 0, "één"), ("a.log", 6, "two")]
    with a.open("ab") as f:
        f.write(b"ee\n")
    b.write_bytes(b"x\n")
    assert settled(query) == [("a.log", 10, "three"), ("b.log", 0, "x")]
    query.stop()
    with a.open("ab") as f:
        f.write(b"four\n")
    query = start()
    assert settled(query) == [("a.log", 16, "four")]
    b.write_bytes(b"")
    assert settled(query) == []
    b.write_bytes(b"y\n")
    assert settled(query) == [("b.log", 0, "y")]
    query.stop()


def test_open_episodes_are_sent_again(spark, tmp_path):
    import time

    row = ("g", "data-loss", "warn", "logs", "collector", "n1", "none", "fleet", "i", "i.1", 3, "OPEN", "firing", 1000, None)
    schema = "group_id string, alertname string, severity string, cluster_id string, entity_kind string, entity_id string, collector_id string, scope_label string, incident_id string, episode_id string, member_count long, episode_state string, state string, opened_at long, resolved_at long"
    sent = []
    query = jobs.resend_open(lambda: spark.createDataFrame([row, (*row[:12], "resolved", 1000, 2000)], schema), lambda df: sent.append([(r.episode_id, r.annotations["member_count"], r.endsAt) for r in df.collect()]), spark, str(tmp_path / "c"), "1 second")
    until = time.time() + 60
    while len(sent) < 2 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert len(sent) >= 2 and sent[0] == sent[1] == [("i.1", "3", None)]


def test_a_roster_is_published_once(spark, tmp_path):
    import pytest

    path = str(tmp_path / "roster")
    hosts = spark.createDataFrame([("h1", "n1"), ("h2", "n2")], "origin_host string, collector_id string")
    collectors = spark.createDataFrame([("n1",), ("n2",), (None,)], "collector_id string")
    first = sinks.publish_roster(hosts, collectors, path, 10)
    assert first and sinks.publish_roster(hosts.union(hosts), collectors, path, 20) is None
    second = sinks.publish_roster(hosts.where("origin_host = 'h1'"), collectors, path, 30)
    assert second != first and sinks.publish_roster(hosts, collectors, path, 40) == first
    with pytest.raises(ValueError):
        sinks.publish_roster(hosts, collectors.where("collector_id = 'n1'"), path, 50)
    with pytest.raises(ValueError):
        sinks.publish_roster(hosts, collectors.where("false"), path, 50)


def test_lines_from_a_socket(spark, tmp_path):
    import socket
    import threading

    server = socket.create_server(("localhost", 0))

    def serve():
        at, _ = server.accept()
        at.sendall(b'{"a": 1}\nbroken\n')
        gate.wait(60)
        at.close()

    gate = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    got = []
    parsed = logs.json_lines(logs.socket_lines(spark, "localhost", server.getsockname()[1]), "a int")
    query = parsed.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: got.extend((r.a, r._corrupt_record) for r in df.collect())).start()
    import time

    until = time.time() + 60
    while len(got) < 2 and time.time() < until:
        time.sleep(0.2)
    gate.set()
    query.stop()
    assert sorted(got, key=str) == [(1, None), (None, "broken")]


def test_stream_windows_and_duplicates(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS ts, id % 2 AS k, id FROM range(60)").write.parquet(source)
    stream = jobs.event_stream(spark, source)
    got = []
    jobs.run_once(jobs.tumbling(stream, "ts", "10 minutes", "2 minutes", ["k"], F.count("*").alias("n")), lambda b, _: got.extend(b.collect()), str(tmp_path / "c1"))
    assert sorted((r.k, r.n) for r in got)[:2] == [(0, 5), (0, 5)] and sum(r.n for r in got) == 60
    seen = []
    jobs.run_once(jobs.deduplicated(stream, "ts", ["k"]), lambda b, _: seen.extend(b.collect()), str(tmp_path / "c2"), "append")
    assert len(seen) == 2


def test_stream_lifecycle(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("i", f"r{w}", "firing" if g > 0.5 else "evidence", w, g, 3) for w, g in ((10_000, 0.9), (70_000, 0.0), (130_000, 0.0), (190_000, 0.0), (250_000, 0.8))]
    schema = "incident_id string, source_id string, state string, window_ms long, grade double, healthy_required int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    got = []
    jobs.run_once(jobs.detector_lifecycle(spark.readStream.schema(schema).parquet(source), None), lambda b, _: got.extend(b.collect()), str(tmp_path / "c"))
    assert sorted((r.opened_at, r.episode_state) for r in got) == [(10_000, "RESOLVED"), (250_000, "OPEN")]


def test_heartbeat_watch_reports_keys_that_never_spoke(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("n1", 1000)], "collector_id string, ms long").write.parquet(source)
    got = []
    jobs.heartbeat_watch(spark.readStream.schema("collector_id string, ms long").parquet(source), "collector_id", "ms", spark.createDataFrame([("n1",), ("n2",)], "collector_id string"), lambda: 2000, 5000, lambda df: got.extend(df.collect()), str(tmp_path / "c"))
    assert sorted((r.collector_id, r.missing, r.age_ms) for r in got) == [("n1", 0, 1000), ("n2", 1, None)]
