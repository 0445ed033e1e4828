"""The log as a stream, pushed frames, and recovery."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rowtide.options import Options
from rowtide.plans import modes
from rowtide.sources import sinks, wire
from rowtide.sources.events import read_log
from rowtide.sources.writer import INT, Log, column, i4, table
from rowtide.streaming import recovery as r
from rowtide.streaming.frames import decode_frames
from rowtide.streaming.jobs import live_windows, replicate, start
from rowtide.streaming.relay import FolderTransport, Relay, TransportError, follow, where_to_start

T0 = 1_700_000_000


def log_of(n, first=0, commit_last=True, crc=False):
    log = Log(crc=crc)
    for k in range(first, first + n):
        log.begin(T0 + k)
        log.map(1, "d", "t", [INT], T0 + k)
        log.rows(30, 1, [[i4(k)]], T0 + k)
        if commit_last or k < first + n - 1:
            log.xid(T0 + k)
    return log


def options(tmp_path, **more):
    (tmp_path / "schema.json").write_text(json.dumps({"version": 1, "tables": [table("d", "t", [column("id")], ("id",))]}))
    return Options(binlog_dir=str(tmp_path / "logs"), start_file="mysql-bin.000001", stop_file="mysql-bin.000009", schema_file=str(tmp_path / "schema.json"), output_dir=str(tmp_path / "out"), **more)


def written(spark, tmp_path):
    lines = [x for f in sorted((tmp_path / "out").glob("*.sql")) for x in f.read_text().splitlines()]
    assert lines.count("SET NAMES utf8mb4;") == len(list((tmp_path / "out").glob("*.sql")))
    return sorted(int(x.split("(")[-1].rstrip(");")) for x in lines if x.startswith("INSERT"))


@pytest.mark.parametrize("crc", [False, True])
def test_stream_equals_batch_and_resumes(spark, tmp_path, crc):
    o = options(tmp_path)
    whole, part = log_of(6, crc=crc), log_of(4, commit_last=False, crc=crc)
    part.save(tmp_path / "logs")
    run = lambda: start(spark, o, str(tmp_path / "check"), available_now=True, maxBytesPerTrigger="200").awaitTermination(120)
    run()
    assert written(spark, tmp_path) == [0, 1, 2]  # the open transaction waits
    whole.save(tmp_path / "logs")
    log_of(2, first=6, crc=crc).save(tmp_path / "logs", "mysql-bin.000002")
    run()
    assert written(spark, tmp_path) == list(range(8))
    batch = [x["sql"] for x in modes.to_sql(spark, o).collect()]
    assert [int(x.split("(")[-1].rstrip(");")) for x in batch] == list(range(8))


def test_killed_streams_give_the_same_bytes(spark, tmp_path):
    """Batches of a few events; behind some of them the output has bytes of a batch that was never whole."""
    o = options(tmp_path, add_extra_info=True)
    run = lambda: start(spark, o, str(tmp_path / "check"), available_now=True, maxBytesPerTrigger="150").awaitTermination(120)
    for n in (2, 5, 9):
        log_of(n, crc=True).save(tmp_path / "logs")
        run()
        with (tmp_path / "out" / "to_sql.1.sql").open("a") as f:
            f.write("INSERT INTO half of a ba")
        state = json.loads((tmp_path / "check-output.json").read_text())
        assert state["written_files"] == ["to_sql.1.sql"] and state["file"] == "mysql-bin.000001"
    log_of(3, first=9).save(tmp_path / "logs", "mysql-bin.000002")
    run()
    whole = options(tmp_path, add_extra_info=True)
    modes.run_sql(spark, replace(whole, output_dir=str(tmp_path / "once")))
    for name in ("to_sql.1.sql", "to_sql.2.sql"):
        text = (tmp_path / "out" / name).read_text()
        assert text == (tmp_path / "once" / name).read_text() and text.count("INSERT") == (9 if "1" in name else 3)
    state = json.loads((tmp_path / "check-output.json").read_text())
    appender = sinks.Appender(str(tmp_path / "out"), str(tmp_path / "check-output.json"))
    appender.append(spark.createDataFrame([], "file string, file_ord int, pos long, row_no int, trx_id long, info string, sql string, binlog string, end_pos long, ts long"), state["batch"])
    assert json.loads((tmp_path / "check-output.json").read_text()) == state  # a batch that is whole isn't written again


@pytest.mark.parametrize("undo", [False, True])
def test_parts_are_the_text_of_the_file(spark, tmp_path, undo):
    log_of(7, crc=True).save(tmp_path / "logs")
    log_of(4, first=20).save(tmp_path / "logs", "mysql-bin.000002")
    o = options(tmp_path, add_extra_info=True, **({"work": "flashback"} if undo else {}))
    modes.run_sql(spark, o)
    sinks.write_parts(modes.rendered(spark, o).where("sql is not null"), str(tmp_path / "parts"), undo=undo, info=True)
    for f in (tmp_path / "out").glob("*.sql"):
        parts = sorted((tmp_path / "parts" / f"file={f.name}").glob("part-*.txt"))
        assert "".join(p.read_text() for p in parts) == f.read_text()


class Flaky(FolderTransport):
    """Fails after so many frames each time, and sends heartbeats between."""

    def __init__(self, folder, lives):
        super().__init__(folder)
        self.lives, self.asked = list(lives), []

    def frames(self, name, pos):
        self.asked.append((name, pos))
        left = self.lives.pop(0) if self.lives else None
        for frame in super().frames(name, pos):
            if left == 0:
                raise TransportError("connection reset by peer")
            left = None if left is None else left - 1
            yield frame
            yield wire.HEADER.pack(T0, wire.HEARTBEAT, 1, wire.HEADER_SIZE + 1, 0, 0) + b"x"


def test_a_server_is_followed(spark, tmp_path):
    log_of(6, crc=True).save(tmp_path / "server")
    log_of(3, first=6).save(tmp_path / "server", "mysql-bin.000002")
    base = options(tmp_path)
    o = replace(base, work="repl", server_id=7, add_extra_info=True, start_file="mysql-bin.000001", stop_file=None)
    waits = []
    transport = Flaky(str(tmp_path / "server"), [9, 0, 12, 5])
    logs = str(tmp_path / "relay")
    assert follow(transport, logs, ("mysql-bin.000001", 4), sleep=waits.append) == "ended"
    for name in ("mysql-bin.000001", "mysql-bin.000002"):
        assert (tmp_path / "relay" / name).read_bytes() == (tmp_path / "server" / name).read_bytes()
    assert len(transport.asked) == 5 and len(waits) == 4 and all(w > 0 for w in waits)
    assert replicate(spark, o, FolderTransport(str(tmp_path / "server")), str(tmp_path / "state"), available_now=True) == "ended"
    assert written(spark, tmp_path) == list(range(9))
    log_of(9, crc=True).save(tmp_path / "server")  # more than before: the relay goes on behind its last event
    (tmp_path / "server" / "mysql-bin.000002").unlink()
    (tmp_path / "state" / "relay" / "mysql-bin.000002").unlink()
    assert Relay(str(tmp_path / "state" / "relay")).last()[0] == "mysql-bin.000001"
    # terminal failures and failures in a row end it
    class Purged(FolderTransport):
        def frames(self, name, pos):
            raise TransportError("Could not find first log file name in binary log index file", 1236)

    with pytest.raises(TransportError, match="purged"):
        follow(Purged(str(tmp_path / "server")), logs, ("mysql-bin.000001", 4), sleep=waits.append)
    with pytest.raises(TransportError, match="disconnect"):
        follow(Flaky(str(tmp_path / "server"), [0] * 9), str(tmp_path / "none"), ("mysql-bin.000001", 4), sleep=waits.append)


def test_a_live_server_is_followed_until_it_ends(spark, tmp_path):
    log_of(5).save(tmp_path / "server")
    o = replace(options(tmp_path), work="repl", server_id=7, start_file="mysql-bin.000001", stop_file=None)
    assert replicate(spark, o, FolderTransport(str(tmp_path / "server")), str(tmp_path / "state")) == "ended"
    assert written(spark, tmp_path) == list(range(5))


def test_where_a_server_is_asked_first(tmp_path):
    for n in (1, 2, 3):
        log_of(3, first=100 * n).save(tmp_path / "server", f"mysql-bin.{n:06d}")
    t = FolderTransport(str(tmp_path / "server"))
    base = Options(work="repl", binlog_dir="x", schema_file="s", server_id=1, output_dir="o")
    from datetime import UTC, datetime

    at = lambda k: replace(base, start_datetime=datetime.fromtimestamp(T0 + k, UTC).strftime("%Y-%m-%d %H:%M:%S"))
    assert where_to_start(t, None, at(250)) == ("mysql-bin.000002", 4) and where_to_start(t, None, at(5)) == ("mysql-bin.000001", 4)
    assert where_to_start(t, None, base) == t.end() == ("mysql-bin.000003", (tmp_path / "server" / "mysql-bin.000003").stat().st_size)
    assert where_to_start(t, None, replace(base, start_file="mysql-bin.000002", start_pos=124)) == ("mysql-bin.000002", 124)
    assert where_to_start(t, r.Checkpoint("mysql-bin.000001", 99, ""), at(250)) == ("mysql-bin.000001", 99)


def test_windows_in_state(spark, tmp_path):
    rows = [(i, "b.1", "row" if i % 3 else "tick", T0 + i, 10 * i, 10 * i + 10, "d", f"t{i % 2}", ("insert", "update", "delete")[i % 3], 1) for i in range(20)]
    schema = "seq long, binlog string, kind string, ts long, start_pos long, end_pos long, db string, tb string, op string, rows long"
    for n, part in enumerate((rows[:9], rows[9:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in" / "*"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = live_windows(feed, 5).writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("windows").agg(F.sum("updates"), F.sum("deletes"), F.count("*")).first()
    from rowtide.operators.stats import window_counts

    batch = window_counts(spark.createDataFrame(rows, schema).withColumn("segment", F.lit(0).cast("long")), 5)
    closed = batch.where(F.col("win") < batch.agg(F.max("win")).first()[0]).agg(F.sum("updates"), F.sum("deletes"), F.count("*")).first()
    assert tuple(got) == tuple(closed)


def frames_of(log):
    at, out = 4, []
    while at < len(log.data):
        size = wire.parse_header(log.data[at : at + 19]).size
        out.append((log.data[at : at + size], None))
        at += size
    return out


def test_pushed_frames_equal_the_file(tmp_path):
    import io

    log = log_of(3, crc=True)
    rotate = Log()
    rotate.data = b""
    rotate.rotate("mysql-bin.000007", 0)
    hint = rotate.data[:13] + b"\0\0\0\0" + rotate.data[17:]
    heartbeat = Log()
    heartbeat.data = b""
    heartbeat.event(27, T0, b"x")
    pushed = [(hint, None), *frames_of(log)[:4], (heartbeat.data, None), *frames_of(log)[4:]]
    got = list(decode_frames(pushed, "first"))
    want = list(read_log(io.BytesIO(log.data), "mysql-bin.000007", 0, decode_bounds()))
    assert [(e.binlog, e.kind, e.start_pos, e.end_pos, e.trx) for e in got] == [(e.binlog, e.kind, e.start_pos, e.end_pos, e.trx) for e in want]
    with pytest.raises(wire.LogError):
        list(decode_frames([(log.data[4:40], None)], "x"))


def decode_bounds():
    from rowtide.sources.events import Bounds

    return Bounds()


def test_checkpoints(tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "to_sql.1.sql").write_text("x")
    (out / "to_sql.9.sql").write_text("x")
    cp = r.Checkpoint("b.000001", 99, "2023", ("to_sql.1.sql",))
    r.write_checkpoint(cp, str(tmp_path / "cp"))
    assert r.read_checkpoint(str(tmp_path / "cp"), str(out)) == (cp, ["to_sql.9.sql"])
    (out / "to_sql.1.sql").unlink()
    with pytest.raises(r.CheckpointError, match="missing"):
        r.read_checkpoint(str(tmp_path / "cp"), str(out))
    r.write_checkpoint(r.Checkpoint("../x", 4, ""), str(tmp_path / "cp"))
    with pytest.raises(r.CheckpointError):
        r.read_checkpoint(str(tmp_path / "cp"), str(out))


def test_where_streams_start():
    cp = r.Checkpoint("f", 7, "")
    assert r.locate(cp, "g", 4, 5) == ("checkpoint", ("f", 7)) and r.locate(None, "g", 4, 5) == ("datetime", 5)
    assert r.locate(None, "g", 9, None) == ("position", ("g", 9)) and r.locate(None, "", 4, None) == ("now", None)
    starts = [10, None, 20, 30, None]
    for want in range(5, 40):
        fit = [i for i, s in enumerate(starts) if s is not None and s <= want]
        assert r.bisect_file(5, want, lambda i: starts[i]) == (fit[-1] if fit else 0)
    assert r.bisect_file(0, 1, lambda i: None) is None


def test_failures():
    assert r.classify(1236, "Could not find first log file name") == ("terminal", "purged") and r.classify(1045, "Access denied") == ("terminal", "auth")
    assert r.classify(None, "connection reset by peer") == ("retry", "disconnect") and r.classify(None, "odd") == ("retry", "other")
    assert [r.backoff_seconds(k, 0.5) for k in range(7)] == [1, 2, 4, 8, 16, 30, 30]
    assert r.backoff_seconds(0, 0) == 0.75 and r.backoff_seconds(9, 1) == 37.5
    t = r.FailureTracker()
    assert [t.observe(1) for _ in range(3)] == [False, False, True]
    t = r.FailureTracker()
    assert [t.observe(s) for s in (1, 1, 100, 1, 1)] == [False, False, False, False, True]
