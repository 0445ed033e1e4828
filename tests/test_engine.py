"""The change-log engine against known bytes and known reports."""

import datetime
import json
import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowtide.cli import main
from rowtide.cli import options as cli_options
from rowtide.operators import filters
from rowtide.operators.stats import closing
from rowtide.options import OptionError, Options
from rowtide.plans import modes
from rowtide.sources import cells, wire
from rowtide.sources.catalog import catalog_frame, dump, frame_of, index_keys, norm_type, read_catalog, tables_of
from rowtide.sources.events import Bounds, boundaries, name_key
from rowtide.sources.files import list_logs, next_name
from rowtide.sources.writer import INT, Log, column, i4, s1, table, varchar
from rowtide.sources.writer import decimal as pack_decimal

T0 = 1_700_000_000


def schema_file(root, *tables):
    path = root / "schema.json"
    path.write_text(json.dumps({"version": 1, "tables": list(tables)}))
    return str(path)


DAY = 1_650_000_000  # 2022-04-15 05:20:00
BINS, MOVES = [INT, INT], [INT, varchar(12), INT]


def depot_tables():
    return [table("depot", "bins", [column("bin_no"), column("fill")], ("bin_no",)), table("depot", "moves", [column("move_id"), column("note", "varchar"), column("qty")], ("move_id",))]


@pytest.fixture
def forward(tmp_path):
    """Three transactions of a depot: bins refilled and a move noted; moves taken back; a bin closed and another opened."""
    log, at = Log(), {}

    def change(name, kind, tid, images, ts, **k):
        tb, layout = {301: ("bins", BINS), 302: ("moves", MOVES)}[tid]
        start = log.map(tid, "depot", tb, layout, ts)[0]
        at[name] = (ts, tb, start, log.rows(kind, tid, images, ts, **k)[1])

    log.begin(DAY, "depot")
    change("refill", 31, 301, [[i4(11), i4(0)], [i4(11), i4(40)], [i4(12), i4(5)], [i4(12), i4(9)]], DAY)
    change("note", 30, 302, [[i4(900), s1("in"), i4(44)]], DAY + 2)
    log.xid(DAY + 2)
    log.begin(DAY + 30, "depot")
    change("back", 32, 302, [[i4(898), None, i4(-3)], [i4(899), s1("it's"), i4(7)]], DAY + 30)
    log.xid(DAY + 31)
    log.begin(DAY + 60, "depot")
    change("close", 32, 301, [[i4(7), i4(0)]], DAY + 60)
    change("open", 30, 301, [[i4(13), i4(0)], [i4(14), None], [i4(15), i4(2)]], DAY + 61)
    log.xid(DAY + 61)
    o = Options(binlog_dir=log.save(tmp_path / "logs"), start_file="mysql-bin.000001", schema_file=schema_file(tmp_path, *depot_tables()), output_dir=str(tmp_path / "out"), add_extra_info=True)
    return o, at, tmp_path


FORWARD = {
    "refill": ["UPDATE `depot`.`bins` SET `fill`=40 WHERE `bin_no`=11;", "UPDATE `depot`.`bins` SET `fill`=9 WHERE `bin_no`=12;"],
    "note": ["INSERT INTO `depot`.`moves` (`move_id`,`note`,`qty`) VALUES (900,'in',44);"],
    "back": ["DELETE FROM `depot`.`moves` WHERE `move_id`=898;", "DELETE FROM `depot`.`moves` WHERE `move_id`=899;"],
    "close": ["DELETE FROM `depot`.`bins` WHERE `bin_no`=7;"],
    "open": [f"INSERT INTO `depot`.`bins` (`bin_no`,`fill`) VALUES ({v});" for v in ("13,0", "14,NULL", "15,2")],
}


def clock(ts):
    return datetime.datetime.fromtimestamp(ts, datetime.UTC).strftime("%Y-%m-%d_%H:%M:%S")


def forward_text(at):
    """A line about each event, its statements below it, under the one header."""
    lines = ["SET NAMES utf8mb4;"]
    for name, (ts, tb, start, stop) in at.items():
        lines += [f"# datetime={clock(ts)} database=depot table={tb} binlog=mysql-bin.000001 startpos={start} stoppos={stop}", *FORWARD[name]]
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("split", [0, 100])
def test_forward_bytes(spark, forward, split):
    from dataclasses import replace

    o, at, root = forward
    done = modes.run_sql(spark, replace(o, split_bytes=split))
    assert (done.events, done.statements, done.errors, done.files) == (5, 9, 0, 1)
    assert (root / "out" / "to_sql.1.sql").read_text() == forward_text(at)
    with pytest.raises(FileExistsError, match="refusing to overwrite"):
        modes.run_sql(spark, o)


def test_options_of_forward(spark, forward):
    from dataclasses import replace

    o, _, root = forward
    got = lambda **k: [r["sql"] for r in modes.to_sql(spark, replace(o, **k)).collect()]
    assert got(no_db_prefix=True, dml=("delete",), table="bins") == ["DELETE FROM `bins` WHERE `bin_no`=7;"]
    assert got(full_columns=True, table=("depot.moves",), dml="delete") == ["DELETE FROM `depot`.`moves` WHERE `move_id`=898 AND `note` IS NULL AND `qty`=-3;", "DELETE FROM `depot`.`moves` WHERE `move_id`=899 AND `note`='it\\'s' AND `qty`=7;"]
    assert got(insert_batch=2, table=("bins",), dml="insert") == ["INSERT INTO `depot`.`bins` (`bin_no`,`fill`) VALUES (13,0),(14,NULL);", "INSERT INTO `depot`.`bins` (`bin_no`,`fill`) VALUES (15,2);"]
    assert got(ignore_primary_key_for_insert=True, dml="insert", ignore_table="bins") == ["INSERT INTO `depot`.`moves` (`note`,`qty`) VALUES ('in',44);"]
    assert got(ignore_db="depot") == [] and got(stop_datetime="2022-04-15 05:20:30") == FORWARD["refill"] + FORWARD["note"]
    assert got(start_datetime="2022-04-15 05:21:00") == FORWARD["close"] + FORWARD["open"]
    per = replace(o, file_per_table=True, output_dir=str(root / "per"), add_extra_info=False)
    assert modes.run_sql(spark, per).files == 2
    assert (root / "per" / "to_sql.depot.bins.1.sql").read_text() == "\n".join(["SET NAMES utf8mb4;", *FORWARD["refill"], *FORWARD["close"], *FORWARD["open"]]) + "\n"


def undo_fixture(tmp_path, ddl=False, unknown=False):
    """Two transactions of the depot with checksums; between them a statement that can't be undone, in the second a table without a schema."""
    log = Log(crc=True)
    log.begin(DAY + 10, "depot")
    log.map(302, "depot", "moves", MOVES, DAY + 10)
    log.rows(32, 302, [[i4(77), s1("x"), i4(1)], [i4(78), s1(""), i4(2)]], DAY + 10)
    log.map(301, "depot", "bins", BINS, DAY + 11)
    log.rows(30, 301, [[i4(20), i4(6)]], DAY + 11)
    log.xid(DAY + 11)
    if ddl:
        log.query("depot", "DROP TABLE spare", DAY + 20)
    log.begin(DAY + 40, "depot")
    if unknown:
        log.map(303, "depot", "carts", BINS, DAY + 40)
        log.rows(32, 303, [[i4(1), i4(1)]], DAY + 40)
    log.map(301, "depot", "bins", BINS, DAY + 41)
    log.rows(31, 301, [[i4(20), i4(6)], [i4(20), i4(0)], [i4(21), None], [i4(22), i4(8)]], DAY + 41)
    log.xid(DAY + 41)
    return {"work": "flashback", "binlog_dir": log.save(tmp_path / "logs"), "start_file": "mysql-bin.000001", "schema_file": schema_file(tmp_path, *depot_tables()), "output_dir": str(tmp_path / "out")}


#: By transaction, last first, and within it rows last first: updates go back, inserts go, deletes come again.
UNDONE = [
    ["UPDATE `depot`.`bins` SET `bin_no`=21,`fill`=NULL WHERE `bin_no`=22;", "UPDATE `depot`.`bins` SET `fill`=6 WHERE `bin_no`=20;"],
    ["DELETE FROM `depot`.`bins` WHERE `bin_no`=20;", "INSERT INTO `depot`.`moves` (`move_id`,`note`,`qty`) VALUES (78,'',2);", "INSERT INTO `depot`.`moves` (`move_id`,`note`,`qty`) VALUES (77,'x',1);"],
]


def test_undo_bytes(spark, tmp_path):
    o = Options(**undo_fixture(tmp_path, ddl=True), report_file=str(tmp_path / "skipped.jsonl"))
    done = modes.run_sql(spark, o)
    assert (done.events, done.statements, done.errors, done.files) == (3, 5, 0, 1)
    want = ["SET NAMES utf8mb4;", *(line for trx in UNDONE for line in ("commit;", "begin;", *trx)), "commit;"]
    assert (tmp_path / "out" / "flashback.1.sql").read_text() == "\n".join(want) + "\n"
    (line,) = (tmp_path / "skipped.jsonl").read_text().splitlines()
    assert json.loads(line)["sql"] == "DROP TABLE spare" and json.loads(line)["timestamp"] == clock(DAY + 20)


def test_undo_stops_or_warns(spark, tmp_path):
    o = undo_fixture(tmp_path, unknown=True)
    with pytest.raises(RuntimeError, match="no schema for `depot`.`carts`"):
        modes.run_sql(spark, Options(**o))
    assert not (tmp_path / "out").exists()
    done = modes.run_sql(spark, Options(**o, on_error="skip-bad-event", keep_trx=False))
    assert done.errors == 1
    lines = (tmp_path / "out" / "flashback.1.sql").read_text().splitlines()
    assert lines[1] == "-- WARNING: skipped 1 events, positions in stderr" and lines[2:] == [x for trx in UNDONE for x in trx]


@pytest.fixture
def busy(tmp_path):
    """Two logs of a depot: rows outside transactions, a long transaction, one that is rolled back, a large one, and rows of a table without a schema. Places by name."""
    logs, at = [Log(crc=True), Log(crc=True)], {}
    known = {301: ("bins", BINS), 302: ("moves", MOVES), 309: ("lost", [INT])}

    def change(name, n, kind, tid, images, ts):
        start = logs[n].map(tid, "depot", *known[tid], ts)[0]
        at[name] = (start, logs[n].rows(kind, tid, images, ts)[1])

    change("loose", 0, 32, 301, [[i4(1), i4(0)], [i4(2), i4(0)]], DAY)
    at["slow"] = logs[0].begin(DAY + 1, "depot")
    change("slow moves", 0, 30, 302, [[i4(1), s1("m"), i4(1)]], DAY + 3)
    change("slow bins", 0, 31, 301, [[i4(1), i4(0)], [i4(1), i4(1)]], DAY + 8)
    at["slow end"] = logs[0].xid(DAY + 9)
    change("lost", 0, 30, 309, [[i4(1)]], DAY + 10)
    at["undone"] = logs[1].begin(DAY + 20, "depot")
    change("undone bins", 1, 30, 301, [[i4(k), i4(k)] for k in range(30, 34)], DAY + 21)
    at["undone end"] = logs[1].query("depot", "ROLLBACK", DAY + 21)
    logs[1].begin(DAY + 22, "depot")
    change("small", 1, 30, 302, [[i4(2), s1("n"), None]], DAY + 23)
    logs[1].xid(DAY + 23)
    for n, log in enumerate(logs):
        log.save(tmp_path / "logs", f"mysql-bin.{n + 1:06d}")
    o = Options(work="stats", binlog_dir=str(tmp_path / "logs"), start_file="mysql-bin.000001", stop_file="mysql-bin.000002", schema_file=schema_file(tmp_path, *depot_tables()), output_dir=str(tmp_path / "out"), print_interval=6, big_trx_rows=4, long_trx_seconds=6, stats_json=True)
    return o, at


def report_line(*cells, widths=(17, 19, 19, 10, 10, 8, 8, 8, 15, 20)):
    return " ".join(str(c).ljust(w) for c, w in zip(cells, widths, strict=True)) + "\n"


def test_statistics_reports(spark, busy):
    o, at = busy
    done = modes.run_stats(spark, o)
    one, two = "mysql-bin.000001", "mysql-bin.000002"
    status = [
        report_line("binlog", "starttime", "stoptime", "startpos", "stoppos", "inserts", "updates", "deletes", "database", "table"),
        # the event that passes the clock, at 8 s, still counts in its window
        report_line(one, clock(DAY), clock(DAY + 8), at["loose"][0], at["slow bins"][1], 0, 1, 2, "depot", "bins"),
        report_line(one, clock(DAY + 3), clock(DAY + 3), *at["slow moves"], 1, 0, 0, "depot", "moves"),
        report_line(two, clock(DAY + 21), clock(DAY + 21), *at["undone bins"], 4, 0, 0, "depot", "bins"),
        report_line(two, clock(DAY + 23), clock(DAY + 23), *at["small"], 1, 0, 0, "depot", "moves"),
        "# skipped events: 1\n",
    ]
    from pathlib import Path

    out = Path(o.output_dir)
    assert (out / "binlog_status.txt").read_text().splitlines(True) == status
    found = (out / "biglong_trx.txt").read_text().splitlines()
    head = (17, 19, 19, 10, 10, 8, 10)
    tables = "[depot.bins(inserts=0, updates=1, deletes=0) depot.moves(inserts=1, updates=0, deletes=0)]", "[depot.bins(inserts=4, updates=0, deletes=0)]"
    want = [  # times count from a run's first row, places from its BEGIN
        report_line("binlog", "starttime", "stoptime", "startpos", "stoppos", "rows", "duration", widths=head).rstrip("\n") + " tables",
        report_line(one, clock(DAY + 3), clock(DAY + 9), at["slow"][0], at["slow end"][1], 2, 6, widths=head).rstrip("\n") + " " + tables[0],
        report_line(two, clock(DAY + 21), clock(DAY + 21), at["undone"][0], at["undone end"][1], 4, 0, widths=head).rstrip("\n") + " " + tables[1],
        "# skipped events: 1",
    ]
    assert found == want
    assert str(done) == "stats done: events=11, statements rows=9, windows flushed=2, big/long trx=2, skipped=1"
    first = json.loads((out / "biglong_trx.jsonl").read_text().splitlines()[0])
    assert first["tables"] == [{"table": "depot.bins", "inserts": 0, "updates": 1, "deletes": 0}, {"table": "depot.moves", "inserts": 1, "updates": 0, "deletes": 0}]
    assert (first["startpos"], first["stoppos"], first["rows"], first["duration"]) == (at["slow"][0], at["slow end"][1], 2, 6)
    assert len((out / "binlog_status.jsonl").read_text().splitlines()) == 4


def test_statements_close_windows(spark, tmp_path):
    log = Log()
    for ts, sql in ((T0, None), (T0 + 5, "ALTER TABLE `d`.`t1` ADD COLUMN `x` INT"), (T0 + 6, None), (T0 + 11, ""), (T0 + 12, None)):
        if sql is None:
            log.map(81, "d", "t2", [INT], ts)
            log.rows(30, 81, [[i4(1)]], ts)
        else:
            log.query("d", sql, ts)
    schema = schema_file(tmp_path, table("d", "t2", [column("id")], ("id",)))
    o = Options(work="stats", binlog_dir=log.save(tmp_path / "logs"), start_file="mysql-bin.000001", schema_file=schema, output_dir=str(tmp_path / "out"), print_interval=5, big_trx_rows=1000, long_trx_seconds=3600)
    assert modes.run_stats(spark, o).windows == 3


@given(st.lists(st.integers(0, 60), max_size=60), st.integers(1, 20))
def test_window_chain(steps, interval):
    import numpy as np

    want, clock, win = [], None, 0
    for ts in steps:
        clock = ts + interval if clock is None else clock
        want.append(win)
        if ts >= clock:
            clock, win = ts + interval, win + 1
    assert closing(np.array(steps, dtype=np.int64), interval).tolist() == want


# ---- values ----


def one(kind, meta, raw, name="", unsigned=False):
    cell, at = cells.column_reader(kind, meta, name, unsigned)(raw, 0)
    assert at == len(raw)
    return cell[1] if cell[2] is None else cell[2]


@settings(max_examples=200)
@given(st.data())
def test_decimals_come_back(data):
    precision = data.draw(st.integers(1, 65))
    scale = data.draw(st.integers(0, min(30, precision)))
    whole = str(data.draw(st.integers(0, 10 ** (precision - scale) - 1))) if precision > scale else "0"
    part = "".join(data.draw(st.lists(st.sampled_from("0123456789"), min_size=scale, max_size=scale)))
    text = data.draw(st.sampled_from(["", "-"])) + whole + ("." + part if scale else "")
    assert one(cells.NEWDECIMAL, precision << 8 | scale, pack_decimal(text, precision, scale)) == text


@given(st.integers(-(2**63), 2**63 - 1))
def test_integers_come_back(v):
    for kind, width in cells.WIDTH.items():
        if -(1 << 8 * width - 1) <= v < 1 << 8 * width - 1:
            assert one(kind, 0, v.to_bytes(width, "little", signed=True)) == str(v)
        u = v % (1 << 8 * width)
        assert one(kind, 0, u.to_bytes(width, "little"), unsigned=True) == str(u)


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_doubles_come_back(x):
    text = one(cells.DOUBLE, 8, struct.pack("<d", x))
    assert float(text) == x and "e" not in text.lower() and not text.endswith(".0")
    assert float(cells.json_double(x)) == x


def test_known_values():
    assert one(cells.DOUBLE, 8, struct.pack("<d", 1e20)) == "100000000000000000000" and one(cells.DOUBLE, 8, struct.pack("<d", -12.0)) == "-12"
    assert one(cells.FLOAT, 4, struct.pack("<f", 0.1)) == "0.1" and one(cells.FLOAT, 4, struct.pack("<f", 1e10)) == "10000000000"
    assert one(cells.YEAR, 0, b"\0") == "0" and one(cells.YEAR, 0, bytes([123])) == "2023"
    assert one(cells.BIT, 1 << 8 | 1, b"\x01\x02") == "258"
    assert one(cells.DATE, 0, (2023 << 9 | 11 << 5 | 14).to_bytes(3, "little")) == "2023-11-14" and one(cells.DATE, 0, b"\0\0\0") == "0000-00-00"
    packed = ((2023 * 13 + 11) << 5 | 14) << 17 | 22 << 12 | 13 << 6 | 20
    moment = (packed + (1 << 39)).to_bytes(5, "big")
    assert one(cells.DATETIME2, 0, moment) == "2023-11-14 22:13:20"
    assert one(cells.DATETIME2, 3, moment + (1234).to_bytes(2, "big")) == "2023-11-14 22:13:20.123"
    assert one(cells.DATETIME2, 6, (1 << 39).to_bytes(5, "big") + b"\0\0\0") == "0000-00-00 00:00:00.000000"
    assert one(cells.TIMESTAMP2, 3, T0.to_bytes(4, "big") + (1230).to_bytes(2, "big")) == "2023-11-14 22:13:20.123"
    assert one(cells.TIMESTAMP2, 0, b"\0" * 4) == "1970-01-01 00:00:00"
    assert one(cells.TIME2, 0, b"\x7f\xff\xff") == "-00:00:01" and one(cells.TIME2, 0, ((838 << 12 | 59 << 6 | 59) + 0x800000).to_bytes(3, "big")) == "838:59:59"
    assert one(cells.TIME2, 2, b"\x7f\xff\xff\xf6") == "-00:00:00.10" and one(cells.TIME2, 2, b"\x80\x00\x00\x00") == "00:00:00"
    assert one(cells.TIME2, 6, (0x800000000000 - (1 << 24) - 500000).to_bytes(6, "big")) == "-00:00:01.500000"
    assert one(cells.DATETIME, 0, (20231114221320).to_bytes(8, "little")) == "2023-11-14 22:13:20" and one(cells.TIME, 0, (8385959).to_bytes(3, "little")) == "838:59:59"
    assert one(cells.VARCHAR, 300, b"\2\0ab") == "ab" and one(cells.STRING, 0xFE0A, b"\2ab") == "ab" and one(cells.VARCHAR, 9, b"\1\xff") == b"\xff"
    assert one(cells.STRING, 0xF702, b"\x2c\1") == "300" and one(cells.STRING, 0xF803, b"\1\0\2") == str(0x20001)
    assert one(cells.STRING, 0xCE2C, b"\2\0ab") == "ab"  # two bits of a length over 255 hide in the type
    assert one(cells.BLOB, 2, b"\2\0hi", "text") == "hi" and one(cells.BLOB, 1, b"\2hi", "blob") == b"hi" and one(cells.GEOMETRY, 4, b"\1\0\0\0x") == b"x"
    for kind in (0, 14, 249, 250, 251, 99):
        with pytest.raises(wire.LogError):
            cells.column_reader(kind, 0, "", False)
    with pytest.raises(wire.LogError):
        one(cells.NEWDECIMAL, 18 << 8, b"\xff" * 8)


def json_bytes(v):
    """Small-format binary JSON of plain Python values."""
    if v is None or isinstance(v, bool):
        return 4, bytes([{None: 0, True: 1, False: 2}[v]])
    if isinstance(v, int):
        return (5, struct.pack("<h", v)) if -32768 <= v < 32768 else (9, struct.pack("<q", v))
    if isinstance(v, float):
        return 11, struct.pack("<d", v)
    if isinstance(v, str):
        raw, n, size = v.encode(), len(v.encode()), b""
        while n >= 128:
            size, n = size + bytes([n & 127 | 128]), n >> 7
        return 12, size + bytes([n]) + raw
    keys = [k.encode() for k in v] if isinstance(v, dict) else []
    values = [json_bytes(x) for x in (v.values() if isinstance(v, dict) else v)]
    head = 4 + 4 * len(keys) + 3 * len(values)
    key_part, value_part, tail = b"", b"", b"".join(keys)
    at = head
    for k in keys:
        key_part += struct.pack("<HH", at, len(k))
        at += len(k)
    for kind, raw in values:
        if kind in (4, 5):
            value_part += bytes([kind]) + raw.ljust(2, b"\0")
        else:
            value_part += bytes([kind]) + struct.pack("<H", head + len(tail))
            tail += raw
    return (0 if isinstance(v, dict) else 2), struct.pack("<HH", len(values), head + len(tail)) + key_part + value_part + tail


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=200), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=8), c, max_size=4), max_leaves=12)


@given(values)
def test_json_comes_back(v):
    kind, raw = json_bytes(v)
    assert json.loads(cells.json_text(bytes([kind]) + raw)) == v


def test_json_forms():
    text = lambda v: cells.json_text(bytes([json_bytes(v)[0]]) + json_bytes(v)[1])
    assert text({"b": 12.0, "a": [None, True, "q\"\\\n\x01é<"]}) == '{"b":12.0,"a":[null,true,"q\\"\\\\\\n\\u0001é<"]}'
    assert cells.json_text(b"") == ""
    assert [cells.json_double(x) for x in (0.0, -0.0, 1e15, 123456789012345678.0, 1e-14, 1.5e-16, 0.5)] == ["0.0", "-0.0", "1e15", "1.2345678901234568e17", "0.00000000000001", "1.5e-16", "0.5"]
    packed = (((2023 * 13 + 11) << 5 | 14) << 17 | 22 << 12 | 13 << 6 | 20) << 24
    opaque = lambda kind, raw: cells.json_text(b"\x0f" + bytes([kind, len(raw)]) + raw)
    assert opaque(12, struct.pack("<q", packed)) == '"2023-11-14 22:13:20.000000"' and opaque(10, struct.pack("<q", packed)) == '"2023-11-14"'
    assert opaque(11, struct.pack("<q", 0)) == '"00:00:00.000000"' and opaque(246, b"\x04\x02" + pack_decimal("-1.25", 4, 2)) == "-1.25"
    deep = b"\x01"
    for _ in range(120):
        deep = struct.pack("<HH", 1, 7 + len(deep)) + b"\x02" + struct.pack("<H", 7) + deep
    with pytest.raises(wire.LogError):
        cells.json_text(b"\x02" + deep)


@given(st.binary(max_size=200))
def test_hostile_bytes_only_raise_log_errors(raw):
    for parse in (wire.parse_table_map, wire.parse_query, cells.json_text, wire.parse_header, lambda b: wire.parse_format(b"\0" * 19 + b)):
        try:
            parse(raw)
        except wire.LogError:
            pass


KINDS = [(1, 0, 1), (2, 0, 2), (9, 0, 3), (3, 0, 4), (8, 0, 8), (246, 10 << 8 | 3, None), (246, 18 << 8 | 9, None), (246, 5 << 8, None), (18, 0, None), (18, 3, None), (253, 90, None), (253, 900, None), (5, 8, 8), (252, 2, None), (247, 1, 1), (16, 1 << 8 | 1, 2)]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_compiled_images_are_the_plain_ones(data):
    """Any columns, nulls and operations; bytes that don't decode leave nothing behind and give the plain readers' error."""
    picked = data.draw(st.lists(st.sampled_from(KINDS), min_size=1, max_size=9))
    unsigned = data.draw(st.lists(st.booleans(), min_size=len(picked), max_size=len(picked)))

    def value(kind, meta, width):
        if width:
            return data.draw(st.binary(min_size=width, max_size=width))
        if kind == 246:
            p, s = meta >> 8, meta & 255
            digits = "".join(data.draw(st.lists(st.sampled_from("0123456789"), min_size=p, max_size=p)))
            return pack_decimal(data.draw(st.sampled_from(["", "-"])) + (digits[: p - s] or "0") + ("." + digits[p - s :] if s else ""), p, s)
        if kind == 18:
            return data.draw(st.binary(min_size=5, max_size=5)) + b"\1\2" * (meta > 0)
        raw = data.draw(st.one_of(st.text(max_size=20).map(str.encode), st.binary(max_size=20)))
        return len(raw).to_bytes(1 if kind == 253 and meta < 256 else 2, "little") + raw

    op, kind = data.draw(st.sampled_from([("insert", 30), ("update", 31), ("delete", 32)]))
    images = [[None if data.draw(st.integers(0, 5)) == 0 else value(*k) for k in picked] for _ in range(2 * data.draw(st.integers(1, 3)))]
    log = Log()
    log.layouts[5] = len(picked)
    log.rows(kind, 5, images, T0)
    body = log.data[log.data.index(b"\5\0\0\0\0\0\0\0\2\0", 100) :]
    body = body[: data.draw(st.sampled_from([len(body)] * 4 + [len(body) - 1, len(body) // 2]))]
    reader = cells.RowReader(wire.TableMap(5, "d", "t", bytes(k for k, _, _ in picked), tuple(m for _, m, _ in picked)), [("x", u) for u in unsigned])
    before, after = cells.ImageColumn(), cells.ImageColumn()
    try:
        want = [(new if op == "delete" else old, None if op == "delete" else new) for old, new in reader.rows(body, op == "update", True)]
    except wire.LogError as e:
        with pytest.raises(type(e)):
            reader.into(body, op, True, before, after)
        assert before.mark() == after.mark() == (0, 0)
        return
    assert reader.into(body, op, True, before, after) == len(want)
    assert list(zip(before.images(), after.images(), strict=True)) == want


def test_transactions_are_numbered_over_stretches_and_files(spark, tmp_path):
    want, trx = [], 0
    for n in (1, 2):
        log = Log(crc=n == 1)
        for k in range(9):
            log.begin(T0 + 10 * n)
            trx += 1
            if k % 3 == 0:
                log.query("d", "CREATE TABLE x (a INT)", T0 + 10 * n)
                trx += 1
            log.map(1, "d", "t", [INT], T0 + 10 * n)
            log.rows(30, 1, [[i4(100 * n + k)]], T0 + 10 * n)
            want.append((str(100 * n + k), trx))
            log.xid(T0 + 10 * n)
        log.save(tmp_path / "logs", f"mysql-bin.{n:06d}")
    o = {"binlog_dir": str(tmp_path / "logs"), "start_file": "mysql-bin.000001", "schema_file": schema_file(tmp_path, table("d", "t", [column("id")]))}
    for split in (0, 1, 400, 1 << 20):
        rows = modes.changes(spark, Options(**o, split_bytes=split)).orderBy("file_ord", "pos").collect()
        assert [(r["after"][0]["txt"], r["trx_id"]) for r in rows] == want
    late = modes.changes(spark, Options(**o, split_bytes=1, start_datetime=datetime.datetime.fromtimestamp(T0 + 20, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S"))).orderBy("pos").collect()
    assert [r["trx_id"] for r in late] == [t - want[8][1] for _, t in want[9:]]


# ---- the source ----


def read(spark, folder, **options):
    from rowtide.sources.binlog import register

    register(spark)
    return spark.read.format("binlog").options(path=folder, **options).load()


def test_damaged_files_end_with_an_error(spark, tmp_path):
    log = Log(crc=True)
    log.begin(T0)
    log.map(1, "d", "t", [INT], T0)
    at = len(log.data)
    log.rows(30, 1, [[i4(1)]], T0)
    log.data = log.data[:-2] + b"zz"
    folder = log.save(tmp_path / "logs")
    rows = read(spark, folder).orderBy("pos").collect()
    assert [r["kind"] for r in rows] == ["query", "error"] and rows[1]["error"].startswith("checksum_mismatch") and rows[1]["pos"] == at
    with pytest.raises(Exception, match="checksum"):
        read(spark, folder, mode="FAILFAST").collect()
    (tmp_path / "logs" / "mysql-bin.000002").write_bytes(log.data[: at + 10])
    assert read(spark, folder, startFile="mysql-bin.000002").where("kind = 'error'").first()["error"].startswith("too_short")
    (tmp_path / "logs" / "mysql-bin.000003").write_bytes(b"nope")
    with pytest.raises(Exception, match="not a binlog"):
        read(spark, folder, startFile="mysql-bin.000003").collect()


def test_large_events_by_option(spark, tmp_path):
    log = Log()
    log.begin(T0)
    log.map(1, "d", "t", [varchar(60_000)], T0)
    log.rows(30, 1, [[(50_000).to_bytes(2, "little") + b"x" * 50_000] for _ in range(90)], T0)
    log.map(1, "d", "t", [varchar(60_000)], T0)
    log.rows(30, 1, [[(1).to_bytes(2, "little") + b"y"]], T0)
    folder = log.save(tmp_path / "logs")
    kinds = lambda **o: [r["kind"] for r in read(spark, folder, **o).orderBy("pos").collect()]
    assert kinds() == ["query", "error"] and kinds(maxEventBytes=str(8 << 20)) == ["query", "rows", "rows"]


def test_long_json_takes_linear_time():
    import time

    took = []
    for n in (3000, 12000):
        items = [(12, b"\x01x")] * n
        head = 8 + 5 * n
        body = struct.pack("<II", n, head + 2 * n) + b"".join(b"\x0c" + struct.pack("<I", head + 2 * i) for i in range(n)) + b"\x01x" * n
        began = time.perf_counter()
        assert cells.json_text(b"\x03" + body) == "[" + ",".join(['"x"'] * len(items)) + "]"
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_details_of_runs_with_many_hits(spark):
    """Against sums over all rows before each hit: runs with one hit, with many, and without rows between them."""
    from rowtide.operators import stats

    rng, rows = __import__("random").Random(4), []
    for seq in range(400):
        run = seq // 130 if seq < 260 else 2 + (seq - 260) // 20
        kind = "row" if rng.random() < 0.7 else "commit"
        rows.append((seq, run, kind, "d", f"t{rng.randrange(4)}", rng.choice(["insert", "update", "delete"]), rng.randrange(1, 4)) if kind == "row" else (seq, run, kind, None, None, None, None))
    feed = spark.createDataFrame(rows, "seq long, run long, kind string, db string, tb string, op string, rows long")
    hits = feed.where("kind = 'commit' and seq % 3 != 0").select("seq", "run")
    got = {(r["seq"], r["table"]): (r["inserts"], r["updates"], r["deletes"]) for r in stats.details(feed, hits).collect()}
    want = {}
    for h in hits.collect():
        for r in rows:
            if r[2] == "row" and r[1] == h["run"] and r[0] < h["seq"]:
                own = want.setdefault((h["seq"], f"d.{r[4]}"), [0, 0, 0])
                own[["insert", "update", "delete"].index(r[5])] += r[6]
    assert got == {k: tuple(v) for k, v in want.items()}


def test_interleaved_maps(spark, tmp_path):
    log = Log()
    log.begin(T0)
    log.map(1, "d", "a", [INT], T0)
    log.map(2, "d", "b", [INT], T0)
    log.rows(30, 1, [[i4(1)]], T0)
    log.rows(30, 2, [[i4(2)]], T0)
    log.xid(T0)
    schema = json.dumps({"version": 1, "tables": [table("d", "a", [column("x")]), table("d", "b", [column("x")])]})
    folder = log.save(tmp_path / "logs")
    rows = read(spark, folder, view="changes", schemaJson=schema).where("kind = 'rows'").orderBy("pos").collect()
    assert [(r["tb"], r["after"][0]["txt"], r["error"]) for r in rows] == [("a", "1", None), ("b", "2", None)]
    strict = read(spark, folder, view="changes", schemaJson=schema, strictParity="true").where("kind = 'rows'").orderBy("pos").collect()
    assert [bool(r["error"]) for r in strict] == [True, False]


def test_minimal_images_and_no_keys(spark, tmp_path):
    log = Log()
    log.begin(T0)
    log.map(1, "d", "k", [INT, varchar(20), INT], T0)
    log.rows(31, 1, [[i4(1)], [s1("x")]], T0, present=[0], after=[1])
    log.map(2, "d", "n", [INT, varchar(20)], T0)
    log.rows(32, 2, [[i4(1), None], [None, s1("a'b\\%\\n")]], T0)
    log.rows(25, 2, [[i4(5), s1("v1")]], T0)
    log.xid(T0)
    schema = schema_file(tmp_path, table("d", "k", [column("id"), column("s", "varchar"), column("v")], ("id",)), table("d", "n", [column("a"), column("b", "varchar")]))
    o = Options(binlog_dir=log.save(tmp_path / "logs"), start_file="mysql-bin.000001", schema_file=schema)
    rows = modes.rendered(spark, o).orderBy("pos", "row_no").collect()
    assert rows[0]["sql"] is None and rows[0]["error"].startswith("missing_column")
    assert [r["sql"] for r in rows[1:]] == ["DELETE FROM `d`.`n` WHERE `a`=1 AND `b` IS NULL;", "DELETE FROM `d`.`n` WHERE `a` IS NULL AND `b`='a\\'b\\%\\\\n';", "DELETE FROM `d`.`n` WHERE `a`=5 AND `b`='v1';"]


def test_an_open_end_takes_all_later_logs(spark, tmp_path):
    for n in (1, 2, 10):
        log = Log()
        log.begin(T0 + n)
        log.map(1, "d", "t", [INT], T0 + n)
        log.rows(30, 1, [[i4(n)]], T0 + n)
        log.xid(T0 + n)
        log.save(tmp_path / "logs", f"mysql-bin.{n:06d}")
    o = {"binlog_dir": str(tmp_path / "logs"), "schema_file": schema_file(tmp_path, table("d", "t", [column("id")], ("id",)))}
    got = lambda start, **k: [r["sql"].split("(")[-1] for r in modes.to_sql(spark, Options(**o, start_file=start, **k)).collect()]
    assert got("mysql-bin.000001") == ["1);", "2);", "10);"]
    assert got("mysql-bin.000002") == ["2);", "10);"]
    assert got("mysql-bin.000001", stop_pos=10_000) == ["1);"]
    undone = [r["sql"] for r in modes.flashback(spark, Options(work="flashback", **o, start_file="mysql-bin.000001")).collect()]
    assert undone == [f"DELETE FROM `d`.`t` WHERE `id`={n};" for n in (10, 2, 1)]


def test_two_files_windows_and_rotation(spark, tmp_path):
    for n in (1, 2, 10):
        log = Log()
        log.begin(T0 + n)
        log.map(1, "d", "t", [INT], T0 + n)
        log.rows(30, 1, [[i4(n)]], T0 + n)
        log.xid(T0 + n)
        log.rotate(f"mysql-bin.{n + 1:06d}", T0 + n)
        log.save(tmp_path / "logs", f"mysql-bin.{n:06d}")
    schema = schema_file(tmp_path, table("d", "t", [column("id")], ("id",)))
    o = {"binlog_dir": str(tmp_path / "logs"), "schema_file": schema}
    got = lambda **k: [r["sql"].split("(")[-1] for r in modes.to_sql(spark, Options(**o, **k)).collect()]
    assert got(start_file="mysql-bin.000001") == ["1);", "2);", "10);"]
    assert got(start_file="mysql-bin.000001", stop_file="mysql-bin.000002") == ["1);", "2);"]
    assert got(start_file="mysql-bin.000002", stop_datetime="2023-11-14 22:14:00") == ["2);", "10);"]
    assert got(start_file="mysql-bin.000001", stop_file="mysql-bin.000002", stop_pos=200) == ["1);"]
    undone = [r["sql"] for r in modes.flashback(spark, Options(work="flashback", **o, start_file="mysql-bin.000001", stop_file="mysql-bin.000010")).collect()]
    assert undone == [f"DELETE FROM `d`.`t` WHERE `id`={n};" for n in (10, 2, 1)]
    assert [r["trx_id"] for r in modes.rendered(spark, Options(**o, start_file="mysql-bin.000001", stop_file="mysql-bin.000010")).orderBy("file_ord").collect()] == [1, 2, 3]


def test_names_and_boundaries(tmp_path):
    assert sorted(["b.10", "b.9", "b", "a.99"], key=name_key) == ["a.99", "b", "b.9", "b.10"]
    assert next_name("mysql-bin.999999") == "mysql-bin.1000000" and next_name("x") is None
    log = Log()
    for k in range(20):
        log.begin(T0)
        log.map(1, "d", "t", [INT], T0)
        log.rows(30, 1, [[i4(k)]], T0)
        log.xid(T0)
    log.save(tmp_path)
    with open(tmp_path / "mysql-bin.000001", "rb") as f:
        found = boundaries(f, 300)
    cuts = found.cuts
    assert sum(found.trx) == sum(found.run) == 20 and len(found.trx) == len(cuts) + 1
    size = 39 + 37 + 36 + 27
    assert len(cuts) > 3 and len({(c - cuts[0]) % (size - 0) for c in cuts}) <= 2
    assert list_logs(str(tmp_path), "mysql-bin.000001")[0][0] == "mysql-bin.000001"
    assert Bounds(stop=("b.10", 5)).stopped("b.9", 99, 0) is False and Bounds(stop=("b.10", 5)).stopped("b.10", 5, 0)


# ---- catalog and options ----


def test_catalog(spark, tmp_path):
    tables = [table("d", "t", [column("a")], ("a",)), table("d", "t", [column("a"), column("b")], ("b",), [("a", "zz"), ("a",)])]
    path = schema_file(tmp_path, *tables)
    (row,) = catalog_frame(spark, path).collect()
    assert (row["names"], row["pk"], row["uks"]) == (["a", "b"], [1], [[0]])
    assert frame_of(spark, tables_of(read_catalog(path))).collect() == [row]
    dump(tables, str(tmp_path / "out.json"))
    assert read_catalog(str(tmp_path / "out.json"))["tables"] == [tables[1]]
    with pytest.raises(ValueError, match="version"):
        tables_of({"version": 2, "tables": []})
    assert norm_type("BIGINT(20) UNSIGNED") == ("bigint", True) and norm_type("double unsigned") == ("double", True)
    rows = [("d", "t", 0, "PRIMARY", 2, "b", 0), ("d", "t", 0, "PRIMARY", 1, "a", 0), ("d", "t", 1, "u", 1, "c", 0), ("d", "t", 2, "x", 1, "d", 1)]
    (keys,) = index_keys(spark.createDataFrame(rows, "db string, tb string, ord int, key_name string, seq int, column_name string, non_unique int")).collect()
    assert keys["pk"] == ["a", "b"] and keys["uks"] == [["c"]]


BASE = {"binlog_dir": "x", "start_file": "b.000001", "schema_file": "s"}


@pytest.mark.parametrize(
    "bad",
    [
        {"work": "nope"}, {"start_pos": 3}, {"stop_pos": 4}, {"dml": "truncate"}, {"insert_batch": 0}, {"on_error": "stop"}, {"time_zone": "CET"},
        {"start_datetime": "2020-01-02 00:00:00", "stop_datetime": "2020-01-01 00:00:00"}, {"start_datetime": "yesterday"}, {"schema_file": None},
        {"work": "stats", "print_interval": 601}, {"work": "stats", "big_trx_rows": 0}, {"work": "stats", "long_trx_seconds": 3601}, {"work": "stats", "to_stdout": True},
        {"work": "flashback", "to_stdout": True}, {"work": "repl", "output_dir": "o"}, {"work": "repl", "server_id": 1}, {"work": "repl", "server_id": 1, "output_dir": "o", "resume_file": "r"},
    ],
)
def test_bad_options(bad):
    with pytest.raises(OptionError):
        Options(**(BASE | bad))


def test_good_options(capsys):
    o = Options(**BASE, time_zone="+08:00", start_datetime="2023-11-15 06:13:20", db="a,b")
    assert o.start_ts == T0 and o.offset == 28800 and o.db == ("a", "b") and o.on_error == "skip-bad-event"
    assert Options(**BASE, work="flashback").on_error == "stop"
    o = cli_options(["flashback", "--binlog-dir", "x", "--start-file", "b.000001", "--schema-file", "s", "--no-keep-trx"])
    assert o.work == "flashback" and not o.keep_trx
    assert main(["to-sql", "--binlog-dir", "x", "--start-file", "b.1", "--schema-file", "s", "--start-pos", "1"]) == 2
    assert "start_pos" in capsys.readouterr().err


def test_feed_filters(spark):
    rows = [("b.000001", 0, 100, 5, "rows", "insert", "d", "t"), ("b.000001", 100, 200, 9, "query", None, None, None), ("b.000001", 200, 300, 5, "rows", "delete", "e", "t"), ("b.000002", 0, 100, 6, "rows", "update", "d", "u")]
    feed = spark.createDataFrame(rows, "binlog string, pos long, end_pos long, ts long, kind string, op string, db string, tb string")
    n = lambda df: sorted((r["binlog"][-1], r["end_pos"]) for r in df.collect())
    assert n(filters.until_stop(feed, stop_ts=9)) == [("1", 100), ("2", 100)]
    assert n(filters.until_stop(feed, ("b.000001", 200))) == [("1", 100)]
    assert n(filters.from_start(feed, ("b.000001", 200))) == [("1", 200), ("1", 300), ("2", 100)]
    assert n(filters.accept(feed, db=("d",), ignore_table=("d.u",))) == [("1", 100), ("1", 200)]


def test_nan_floats_have_text():
    assert cells.plain(math.nan) == "NaN" and cells.plain(-math.inf) == "-inf"
