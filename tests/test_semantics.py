"""The fixed contract: sample, edge cases, rounding, calendar, CSV, sinks, streams, command line."""

import random
import statistics
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tallyloom import cli
from tallyloom.functions import scalar as S
from tallyloom.operators import aggregate as A
from tallyloom.operators import profile as P
from tallyloom.operators import verify as V
from tallyloom.sources import readers as R
from tallyloom.sources import sinks
from tallyloom.streaming import stats

HEADER = "unix_timestamp,channel_path,message_length,stamp_count\n"
SAMPLE = HEADER + "1798761600,team/dev/api,120,3\n1798761660,team/dev/api,80,1\n1801440000,team/dev/api,200,0\n1798761720,team/web,50,2\n1798761780,team/web,70,4\n"
SAMPLE_LINES = ["team/dev/api,2027-01=80/100.00/120/2/4", "team/dev/api,2027-02=200/200.00/200/1/0", "team/web,2027-01=50/60.00/70/2/6"]
DEEP = "/".join(["Qx7_k-Lm2p0_Zt-Yb3wE"] * 5)
#: Rows at the contract's bounds and beyond, each with the line that it makes.
EDGE = [
    # the second before a month and its first one; a leap day
    (1806537599, "bound/march-end", 7, 3), (1806537600, "bound/march-end", 31, 4), (1835438399, "bound/leap-day", 2, 1), (1798761600, "bound/first", 6, 0), (1830297599, "bound/last", 8, 0),
    # the shortest and the longest names, numbers beyond 32 bits in their sum, equal rows
    (1802131313, "z", 1, 9), (1802131314, DEEP, 54321, 12), (1811111111, "bound/wide", 3999999999, 250000000), (1811111112, "bound/wide", 98765432, 20000001),
    (1814400000, "bound/same", 33, 2), (1814400000, "bound/same", 33, 2), (1814400000, "bound/same", 33, 2),
    # means that end in exactly 5 in the third place: 2.625 and 2.875, 0.5 below an even and above an odd hundredth
    *[(1820000000, "tie/down", n, 0) for n in (3, 3, 3, 3, 3, 2, 2, 2)], *[(1820000000, "tie/up", n, 0) for n in (3, 3, 3, 3, 3, 3, 3, 2)],
    # names that look like other things; times far away
    (1825000000, "None", 4, 0), (1825000000, "inf", 4, 0), (1825000000, "_", 4, 0), (86399, "far/first-day", 4, 0), (-86401, "far/two-days-before", 4, 0), (4102444800, "far/2100", 4, 0),
]
EDGE_LINES = {
    "bound/march-end,2027-03=7/7.00/7/1/3", "bound/march-end,2027-04=31/31.00/31/1/4", "bound/leap-day,2028-02=2/2.00/2/1/1", "bound/first,2027-01=6/6.00/6/1/0", "bound/last,2027-12=8/8.00/8/1/0",
    "z,2027-02=1/1.00/1/1/9", f"{DEEP},2027-02=54321/54321.00/54321/1/12", "bound/wide,2027-05=98765432/2049382715.50/3999999999/2/270000001", "bound/same,2027-07=33/33.00/33/3/6",
    "tie/down,2027-09=2/2.62/3/8/0", "tie/up,2027-09=2/2.88/3/8/0", "None,2027-10=4/4.00/4/1/0", "inf,2027-10=4/4.00/4/1/0", "_,2027-10=4/4.00/4/1/0",
    "far/first-day,1970-01=4/4.00/4/1/0", "far/two-days-before,1969-12=4/4.00/4/1/0", "far/2100,2100-01=4/4.00/4/1/0",
}


def lines_of(messages):
    return sorted(r.value for r in A.lines(A.channel_month_stats(messages)).collect())


def write(tmp_path, text, name="in.csv"):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def test_sample_and_line_ends(spark, tmp_path):
    assert lines_of(R.read_messages(spark, write(tmp_path, SAMPLE))) == SAMPLE_LINES
    assert lines_of(R.read_messages(spark, write(tmp_path, SAMPLE.replace("\n", "\r\n").rstrip() + "\r\n\r\n", "crlf.csv"))) == SAMPLE_LINES
    assert lines_of(R.parse_fields(spark.read.text(write(tmp_path, SAMPLE, "text.csv")))) == SAMPLE_LINES


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_edge_cases_in_any_zone_and_partitioning(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(EDGE, "unix_timestamp bigint, channel_path string, message_length bigint, stamp_count bigint")
        for parts in (1, 7):
            assert set(lines_of(df.repartition(parts))) == EDGE_LINES
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rounding_is_printf(spark):
    rng = random.Random(4)
    pairs = [(6839, 40), (9, 8), (11, 8), (1, 1), (1, 3), (1, 16), (1, 40), (1, 200), (11, 200), (3, 200), (0, 7), (-1, 8), (-1, 1000), (-999, 1000), (199999, 200000), (2**62, 1), (2**62 + 12345, 3), (2**53 + 1, 2)]
    pairs += [(n, 200) for n in range(-50, 50)] + [(rng.randrange(-200, 200), rng.randrange(1, 5000)) for _ in range(5000)] + [(rng.randrange(1, 10**rng.randrange(1, 13)), rng.choice([1, 2, 4, 8, 16, 40, 80, 200, 800, 1000, 12345])) for _ in range(20_000)]
    df = spark.createDataFrame(pairs, "t bigint, n bigint")
    for r in df.select("t", "n", S.avg_printf2(F.col("t"), F.col("n")).alias("s")).collect():
        assert r.s == f"{float(r.t) / float(r.n):.2f}"


def test_calendar(spark):
    rng = random.Random(5)
    ts = [0, -1, 1798761599, 1830297600, 1835395200] + [rng.randrange(-10**10, 4 * 10**9) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in ts], "t bigint")
    for r in df.select("t", S.format_month(S.month_index(F.col("t"))).alias("m")).collect():
        assert r.m == datetime.fromtimestamp(r.t, UTC).strftime("%Y-%m").rjust(7, "0")


def test_hundreds_of_seconds_keep_the_month(spark):
    """A day has 864 hundreds of seconds, so a time without its last two digits is in the same month."""
    rng = random.Random(6)
    ts = [rng.randrange(-(10**10), 10**10) for _ in range(3000)] + [s + d for s in (1798761600, 1806537600, 0) for d in (-101, -100, -99, -1, 0, 1, 99, 100)]
    df = spark.createDataFrame([(t, t // 100 * 100) for t in ts], "t bigint, u bigint")
    assert df.where(S.month_index(F.col("t")) != S.month_index(F.col("u"))).count() == 0


def test_ranks_over_ranges(spark):
    rng = random.Random(7)
    rows = [(f"n{i}", rng.choice([1, 1, 1, 2, 3, rng.randrange(1000)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "name string, score int")
    want = {n: i + 1 for i, (n, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    for parts in (1, 10, 255):
        got = P.ranked(df, F.struct(-F.col("score"), "name"), "rank", parts)
        assert {r["name"]: r["rank"] for r in got.collect()} == want
    assert P.ranked(df.limit(0), F.struct("name"), "rank").count() == 0


def test_medians(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(6), rng.randrange(10**9)])) for _ in range(997)] + [("one", 5), ("two", 5), ("two", 8), ("none", None)]
    got = {r.label: (r["median"], r.runs) for r in P.median_by(spark.createDataFrame(rows, "l string, v bigint"), F.col("l"), F.col("v")).collect()}
    for label in ("a", "b", None, "one", "two"):
        own = [v for k, v in rows if k == label and v is not None]
        assert got.pop(label) == (statistics.median(own), len(own))
    assert not got


@pytest.mark.parametrize("bad", ["1798761600;a,1,1", "x,a,1,1", "1798761600,a,1", "1798761600,a,1,1,1"])
def test_malformed_rows_end_the_query(spark, tmp_path, bad):
    with pytest.raises(Exception):
        R.read_messages(spark, write(tmp_path, HEADER + bad + "\n")).collect()
    with pytest.raises(Exception):
        R.parse_fields(spark.read.text(write(tmp_path, HEADER + bad + "\n", "t.csv"))).collect()


def test_strict_rows(spark):
    rows = [(1798761600, "a", 1, 0), (1798761599, "a", 1, 0), (1798761600, "a//b", 1, 0), (1798761600, "a", 0, 0), (1798761600, "a", 1, -1), (1798761600, None, 1, 0)]
    df = spark.createDataFrame(rows, "unix_timestamp bigint, channel_path string, message_length bigint, stamp_count bigint")
    reasons = [r[0] for r in df.select(P.invalid_reason()).collect()]
    assert reasons == [None, "time out of range", "bad channel name", "length below 1", "negative stamps", "missing field"]
    assert P.require_valid(df.limit(1)).count() == 1
    with pytest.raises(Exception):
        P.require_valid(df).collect()


def test_strict_header(spark, tmp_path):
    with pytest.raises(Exception):
        R.read_messages(spark, write(tmp_path, SAMPLE.replace("stamp_count", "other")), strict_header=True).collect()


def test_verify(spark):
    a = spark.createDataFrame([("x\r",), ("x",), ("",), ("y",)], "value string")
    b = spark.createDataFrame([("y",), ("x",), ("x",)], "value string")
    assert V.equal(a, b).first().equal and V.diff(a, b).count() == 0
    assert [tuple(r) for r in V.diff(a, b.limit(2)).collect()] == [("expected", "x", 1)]


def test_single_file_and_cli(spark, tmp_path):
    source, target = write(tmp_path, SAMPLE), str(tmp_path / "out.txt")
    sinks.write_single_text(A.lines(A.channel_month_stats(R.read_messages(spark, source).repartition(5))), target)
    assert sorted(open(target).read().split()) == SAMPLE_LINES
    cli.run(spark, source, target)
    assert sorted(open(target).read().split()) == SAMPLE_LINES
    assert cli.bench(spark, source, target, str(tmp_path / "log"), "x", 1) > 0
    assert R.read_bench_log(spark, str(tmp_path / "log")).first().input_bytes == len(SAMPLE)
    assert cli.main(["run"]) == 2 and cli.main(["gen", str(tmp_path / "g.csv"), "1000"]) == 0
    assert R.read_messages(spark, str(tmp_path / "g.csv")).count() == 1000


def test_cli_verify_and_channels(tmp_path, spark, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda _: spark)
    a, b, c = write(tmp_path, "x\r\ny\n\n", "a.txt"), write(tmp_path, "y\nx\n", "b.txt"), write(tmp_path, "y\ny\n", "c.txt")
    assert cli.main(["verify", a, b]) == 0 and capsys.readouterr().out == ""
    assert cli.main(["verify", a, c]) == 1 and capsys.readouterr().out.splitlines() == ["expected: x x1", "actual: y x1"]
    assert cli.main(["channels", write(tmp_path, SAMPLE)]) == 0
    shown = capsys.readouterr().out
    assert "|       2|" in shown and "|          8|  1|" in shown and "|         12|  1|" in shown
    assert cli.main(["verify", a, str(tmp_path / "absent")]) == 1


def test_single_file_of_many_parts(spark, tmp_path):
    target = f"{tmp_path}/whole.txt"
    sinks.write_single_text(spark.range(5000, numPartitions=7).selectExpr("cast(id as string) AS value"), target)
    assert [int(x) for x in open(target)] == list(range(5000)) and sorted(p.name for p in tmp_path.iterdir()) == ["whole.txt"]
    sinks.write_single_text(spark.range(0).selectExpr("cast(id as string) AS value"), f"file://{target}")
    assert open(target).read() == ""


def test_json_documents(spark, tmp_path):
    board = '{"board":"b","extra":1,"ranked":[{"rank":1,"username":"u","scoreNs":"1500000000"}],"disqualified":[{"username":"v"}]}'
    got = R.read_leaderboard(spark, write(tmp_path, board, "b.json")).orderBy("username").collect()
    assert [(r.kind, r.username, r.seconds) for r in got] == [("ranked", "u", 1.5), ("disqualified", "v", None)]
    status = '{"id":"1","status":"done","public":{"verdict":"AC","scoreNs":"1"}}'
    assert R.read_status(spark, write(tmp_path, status, "s.json")).first().outcome == "AC"


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = SAMPLE.splitlines(keepends=True)
    (folder / "1.csv").write_text("".join(rows[:3]))
    q = stats.start_stats(stats.stream_messages(spark, str(folder)), "live", str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        (folder / "2.csv").write_text(HEADER + "".join(rows[3:]))
        q.processAllAvailable()
        live = sorted(tuple(r) for r in spark.table("live").collect())
        assert live == sorted(tuple(r) for r in A.finish(A.channel_month_stats(R.read_messages(spark, write(tmp_path, SAMPLE)))).collect())
    finally:
        q.stop()


def test_flagship_plan_has_one_small_shuffle(spark, sf_dir):
    plan = A.lines(A.channel_month_stats(R.messages_from_events(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "Python" not in plan


def test_coverage_and_jst(spark):
    df = spark.createDataFrame([("2026-07-18T18:49:00Z",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(S.utc_to_jst(F.col("t"))).collect()] == ["7/19 03:49", "soon", None]


def test_unpack_zstd(tmp_path):
    import zstandard

    from tallyloom.sources.compressed import unpack_zstd

    data = zstandard.compress(SAMPLE.encode()) + zstandard.compress(b"more\n")
    (tmp_path / "a.zst").write_bytes(data)
    assert unpack_zstd(str(tmp_path / "a.zst"), str(tmp_path / "a.csv")) == len(SAMPLE) + 5
    assert (tmp_path / "a.csv").read_text() == SAMPLE + "more\n"
