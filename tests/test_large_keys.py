"""Queries whose keys or numbers of files go beyond those of the smallest tables."""

from collections import Counter

import duckdb

from rowtide.operators.trx import segments
from rowtide.plans.queries import QUERIES, SQL
from rowtide.sources.binlog import BinlogSource, Stretch, shares
from rowtide.sources.writer import Log


def same_as_sql(spark, tmp_path, name, table, rows):
    """The query over this table alone (rows as DuckDB's SQL) gives what its SQL gives."""
    con = duckdb.connect()
    con.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.sql(SQL[name])
    columns = sorted(want.columns)
    got = Counter(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(columns).collect())
    assert got == Counter(con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({SQL[name]})").fetchall())
    return got


PARTS = "SELECT CAST(k AS BIGINT) AS p_partkey, 'part ' || k AS p_name, CAST(k % 50 AS INTEGER) AS p_size FROM "


def test_times_beyond_their_types(spark, tmp_path):
    """TIME ends at 838 hours, TIMESTAMP in 2106, DATETIME in 9999."""
    at = "(SELECT unnest([0, 4020, 8380, 38130, 500000, 2921340, 7200000]) + r.i AS k FROM range(20) r(i))"
    got = same_as_sql(spark, tmp_path, "x12_times_of_log", "part", PARTS + at)
    assert len(got) == 140 and max(len(r[3]) for r in got) == 20  # a year of five digits


def test_many_files_are_read_in_one_scan(spark, tmp_path):
    """Twelve files, each read in several blocks; the plan has one scan a use of the lines, however many files there are."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        same_as_sql(spark, tmp_path, "k1_file_of_log", "part", PARTS + "(SELECT range AS k FROM range(6000) WHERE range % 500 < 150)")
        plan = QUERIES["k1_file_of_log"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tasks_grow_with_bytes_not_with_cut_points():
    """14,400 logs of three stretches each, as 6 GB have them."""
    stretches = [Stretch(f"/logs/x.{i}", f"x.{i}", i, k, 4 + 20_000 * k, None, 0, 0) for i in range(14_400) for k in range(3)]
    made = shares(stretches, [20_000] * len(stretches))
    assert [s for share in made for s in share.stretches] == stretches
    assert len(made) <= 210
    assert len(shares(stretches[:3], [40 << 20] * 3)) == 3


def test_tasks_are_not_sent_all_cut_points(tmp_path):
    import pickle

    (tmp_path / "x.1").write_bytes(b"\xfebin")
    source = BinlogSource({"path": str(tmp_path), "ranges": '{"x.1": [[100], [3, 4], [2, 2]]}'})
    reader = source.reader(None)
    assert [(s.start, s.end, s.trx) for p in reader.partitions() for s in p.stretches] == [(4, 100, 0), (100, None, 3)]
    assert b"ranges" not in pickle.dumps(reader) and b"ranges" not in pickle.dumps(source)


def test_log_is_built_in_linear_time():
    """A log of a server's usual size, as o2_undo_file_of_log writes it in one file."""
    import time

    took = []
    for n in (50_000, 200_000):
        log, began = Log(), time.perf_counter()
        for _ in range(n):
            log.xid(1)
        took.append(time.perf_counter() - began)
        assert len(log.data) > n * 27
    assert took[1] < 12 * took[0] + 0.5


def test_log_goes_on_behind_what_was_taken(spark, tmp_path):
    """One log of more rows than are built at once."""
    whole, parted = Log(crc=True), Log(crc=True)
    out = b""
    for k in range(7):
        for log in (whole, parted):
            log.begin(k)
            log.xid(k)
        out += parted.take() if k % 3 == 0 else b""
    assert out + parted.take() == whole.data
    same_as_sql(spark, tmp_path, "o2_undo_file_of_log", "part", PARTS + "(SELECT range AS k FROM range(20500))")


def test_file_numbers_of_seven_digits(spark, tmp_path):
    same_as_sql(spark, tmp_path, "x21_file_number", "part", PARTS + "(SELECT unnest([0, 999990, 1234560]) + r.i AS k FROM range(20) r(i))")


def test_moments_in_years_of_five_digits(spark, tmp_path):
    rows = "SELECT unnest([0, 2900000, 2913790, 6000000, 36000000]) + r.i AS event_id FROM range(20) r(i)"
    assert any(r[0][4] != "-" for r in same_as_sql(spark, tmp_path, "x7_datetime", "events", rows))


def test_segments_go_on_over_parts(spark):
    """Runs of one name that end with a part, go on into the next, or span a whole part; no window takes the whole feed."""
    names = [["a", "a", "b"], ["b"], ["b", None], [None, "a"], ["b"]]
    rows = [(p, i, n) for p, part in enumerate(names) for i, n in enumerate(part)]
    df = segments(spark.createDataFrame(rows, "file_ord int, pos int, binlog string"))
    assert [r["segment"] for r in df.orderBy("file_ord", "pos").collect()] == [1, 1, 2, 2, 2, 3, 3, 4, 5]


def test_no_task_of_segments_takes_the_whole_feed(spark, sf_dir):
    import re

    plan = QUERIES["w6_segments"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window .*\[whole#", plan) and re.search(r"Window .*\[log#", plan)
