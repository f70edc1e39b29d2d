"""Every query of the engine by name, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalar as S
from tallyloom.operators import aggregate as A
from tallyloom.operators import profile as P
from tallyloom.operators import verify as V
from tallyloom.session import scratch
from tallyloom.sources import readers as R
from tallyloom.sources.sinks import write_single_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The same adapters in SQL: e is messages from events, l from lineitem, d from documents.
_E = """e AS (SELECT epoch_us(ts) // 1000000 AS unix_timestamp, event_type || '/u' || user_id::VARCHAR AS channel_path,
  greatest(1, floor(value * 100)::BIGINT)::BIGINT AS message_length, json_extract_string(props, '$.k')::BIGINT AS stamp_count FROM events)"""
_L = """l AS (SELECT epoch_us(l_shipdate) // 1000000 AS unix_timestamp, l_returnflag || '/' || l_linestatus || '/s' || l_suppkey::VARCHAR AS channel_path,
  l_quantity::BIGINT AS message_length, l_linenumber::BIGINT AS stamp_count FROM lineitem)"""
_MONTH = "strftime(make_timestamp(unix_timestamp * 1000000), '%Y-%m')"


def _stats(table: str) -> str:
    return f"""SELECT channel_path, {_MONTH} AS year_month, min(message_length) AS min_length,
      printf('%.2f', sum(message_length)::DOUBLE / count(*)::DOUBLE) AS average_length, max(message_length) AS max_length,
      count(*) AS message_count, sum(stamp_count)::BIGINT AS total_stamp_count FROM {table} GROUP BY 1, 2"""


_LINE = "channel_path || ',' || year_month || '=' || min_length || '/' || average_length || '/' || max_length || '/' || message_count || '/' || total_stamp_count"


def _lines(table: str) -> str:
    return f"SELECT {_LINE} AS value FROM ({_stats(table)})"


def query(sql: str) -> Callable:
    """Register a function under its name, with the SQL that says the same."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(f"WITH {_E} SELECT * FROM e")
def scan_messages(spark, sf):
    return R.messages_from_events(spark, sf)


@query(f"WITH {_L} SELECT * FROM l")
def scan_lineitem_messages(spark, sf):
    return R.messages_from_lineitem(spark, sf)


@query(f"WITH {_E} {_stats('e')}")
def flagship_stats(spark, sf):
    return A.finish(A.channel_month_stats(R.messages_from_events(spark, sf)))


@query(f"WITH {_L} {_stats('l')}")
def flagship_stats_lineitem(spark, sf):
    return A.finish(A.channel_month_stats(R.messages_from_lineitem(spark, sf)))


@query(f"WITH {_E} {_lines('e')}")
def flagship_lines(spark, sf):
    return A.lines(A.channel_month_stats(R.messages_from_events(spark, sf)))


def _as_csv(spark: SparkSession, messages: DataFrame) -> str:
    """A folder of message CSV files, as a user of the engine has them."""
    folder = scratch(spark)
    messages.write.option("header", True).csv(folder)
    return folder


@query(f"WITH {_L} SELECT * FROM l")
def scan_csv(spark, sf):
    return R.read_messages(spark, _as_csv(spark, R.messages_from_lineitem(spark, sf)))


@query(f"WITH {_L} {_lines('l')}")
def csv_lines(spark, sf):
    return A.lines(A.channel_month_stats(R.read_messages(spark, _as_csv(spark, R.messages_from_lineitem(spark, sf)))))


@query(f"WITH {_L} {_lines('l')}")
def csv_single_file(spark, sf):
    """CSV in, one text file out, read again."""
    path = f"{scratch(spark)}.txt"
    write_single_text(A.lines(A.channel_month_stats(R.read_messages(spark, _as_csv(spark, R.messages_from_lineitem(spark, sf))))), path)
    return R.read_lines(spark, path)


@query(f"WITH {_L} {_stats('l')} ORDER BY channel_path, year_month")
def flagship_sorted(spark, sf):
    return A.finish(A.channel_month_stats(R.messages_from_lineitem(spark, sf))).orderBy("channel_path", "year_month")


@query(f"WITH {_L} {_lines('l')} ORDER BY value")
def text_sorted(spark, sf):
    return A.lines(A.channel_month_stats(R.messages_from_lineitem(spark, sf))).orderBy("value")


@query("SELECT doc_id, rtrim(v, chr(13)) AS value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents) WHERE length(rtrim(v, chr(13))) > 0")
def text_lines_normalized(spark, sf):
    lines = _table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("v"))
    return lines.select("doc_id", F.rtrim(F.col("v"), F.lit("\r")).alias("value")).where(F.length("value") > 0)


@query(f"WITH {_E} SELECT * FROM e")
def parse_fields(spark, sf):
    m = R.messages_from_events(spark, sf)
    return R.parse_fields(m.select(F.concat_ws(",", *[F.col(c).cast("string") for c in m.columns]).alias("value")))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_extract(spark, sf):
    return _table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"WITH {_L} SELECT {_MONTH} AS year_month, count(*) AS n FROM l GROUP BY 1")
def month_bucket(spark, sf):
    months = R.messages_from_lineitem(spark, sf).groupBy(S.month_index(F.col("unix_timestamp")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return months.select(S.format_month(F.col("m")).alias("year_month"), "n")


@query(f"WITH {_L} SELECT unix_timestamp, {_MONTH} AS year_month FROM (SELECT DISTINCT unix_timestamp FROM l)")
def format_month(spark, sf):
    return R.messages_from_lineitem(spark, sf).select("unix_timestamp").distinct().select("unix_timestamp", S.format_month(S.month_index(F.col("unix_timestamp"))).alias("year_month"))


@query("SELECT t AS total, n AS count, printf('%.2f', t::DOUBLE / n::DOUBLE) AS average FROM (SELECT l_orderkey * 7 + l_partkey AS t, l_linenumber::BIGINT * 8 AS n FROM lineitem)")
def avg_printf2(spark, sf):
    pairs = _table(spark, sf, "lineitem").select((F.col("l_orderkey") * 7 + F.col("l_partkey")).alias("total"), (F.col("l_linenumber").cast("bigint") * 8).alias("count"))
    return pairs.select("total", "count", S.avg_printf2(F.col("total"), F.col("count")).alias("average"))


@query(f"""WITH {_E}, {_L}, m AS (SELECT * FROM e UNION ALL SELECT * FROM l)
 SELECT coalesce(CASE WHEN unix_timestamp IS NULL OR channel_path IS NULL OR message_length IS NULL OR stamp_count IS NULL THEN 'missing field'
   WHEN unix_timestamp NOT BETWEEN 820454400 AND 1704844800 THEN 'time out of range'
   WHEN NOT regexp_matches(channel_path, '{S.CHANNEL}') THEN 'bad channel name' WHEN message_length < 1 THEN 'length below 1'
   WHEN stamp_count < 0 THEN 'negative stamps' END, 'valid') AS reason, count(*) AS n FROM m GROUP BY 1""")
def validate_rows(spark, sf):
    m = R.messages_from_events(spark, sf).unionByName(R.messages_from_lineitem(spark, sf))
    return m.groupBy(F.coalesce(P.invalid_reason(820454400, 1704844800), F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type, user_id, value FROM events WHERE event_id = 42")
def point_lookup(spark, sf):
    return _table(spark, sf, "events").where("event_id = 42").select("event_id", "event_type", "user_id", "value")


@query(f"WITH {_E} SELECT count(*) FILTER (message_length > 10000) AS over, max(message_length) AS largest, count(*) AS total FROM e")
def count_over_threshold(spark, sf):
    return P.count_over(R.messages_from_events(spark, sf), 10_000)


def _single(name: str, spark_agg: Callable, sql_agg: str) -> None:
    def run(spark, sf):
        return R.messages_from_events(spark, sf).groupBy("channel_path").agg(spark_agg().alias("result"))

    QUERIES[name], ORACLE[name] = run, f"WITH {_E} SELECT channel_path, {sql_agg} AS result FROM e GROUP BY 1"


_single("agg_min", lambda: F.min("message_length"), "min(message_length)")
_single("agg_max", lambda: F.max("message_length"), "max(message_length)")
_single("agg_sum", lambda: F.sum("message_length"), "sum(message_length)::BIGINT")
_single("agg_count", lambda: F.count(F.lit(1)), "count(*)")


@query(f"WITH {_L} {_stats('l')}")
def merge_partials(spark, sf):
    m = R.messages_from_lineitem(spark, sf)
    odd = F.col("message_length") % 2 == 1
    return A.finish(A.merge_partials(A.channel_month_stats(m.where(odd)), A.channel_month_stats(m.where(~odd))))


@query(f"WITH {_L} {_stats('l')}")
def repartition_then_agg(spark, sf):
    return A.finish(A.repartition_then_agg(R.messages_from_lineitem(spark, sf)))


@query(f"""WITH {_L} SELECT channel_path, min(message_length) AS min_length, sum(message_length)::BIGINT AS total_length, max(message_length) AS max_length,
 count(*) AS message_count, sum(stamp_count)::BIGINT AS total_stamp_count FROM l GROUP BY 1""")
def channel_totals_from_months(spark, sf):
    return A.channel_totals(A.channel_month_stats(R.messages_from_lineitem(spark, sf)))


@query(f"WITH {_E} SELECT channel_path, count(*) AS n FROM e GROUP BY 1")
def channel_frequency(spark, sf):
    return P.channel_frequency(R.messages_from_events(spark, sf))


@query(f"WITH {_E} SELECT count(DISTINCT channel_path) AS channels FROM e")
def distinct_channels(spark, sf):
    return P.distinct_channels(R.messages_from_events(spark, sf))


@query(f"WITH {_E} SELECT strlen(channel_path)::INT AS name_length, count(*) AS n FROM (SELECT DISTINCT channel_path FROM e) GROUP BY 1")
def name_length_hist(spark, sf):
    return P.name_length_hist(R.messages_from_events(spark, sf))


@query(f"WITH {_L} SELECT len(string_split(channel_path, '/'))::INT AS segments, count(*) AS n FROM (SELECT DISTINCT channel_path FROM l) GROUP BY 1")
def segment_count_hist(spark, sf):
    return P.segment_count_hist(R.messages_from_lineitem(spark, sf))


@query(f"""WITH {_E}, f AS (SELECT 'message_length' AS field, message_length AS v FROM e UNION ALL SELECT 'stamp_count', stamp_count FROM e)
 SELECT field, length(v::VARCHAR)::INT AS digits, count(*) AS n FROM f GROUP BY 1, 2""")
def digit_hist(spark, sf):
    return P.digit_hist(R.messages_from_events(spark, sf))


@query(f"WITH {_L} SELECT DISTINCT channel_path FROM l ORDER BY channel_path LIMIT 10000")
def discover_keys(spark, sf):
    return P.discover_keys(R.messages_from_lineitem(spark, sf))


@query(f"WITH {_E} SELECT substr(md5(channel_path), 1, 3) AS key, count(*) AS channels FROM (SELECT DISTINCT channel_path FROM e) GROUP BY 1 HAVING count(*) >= 2")
def hash_collisions(spark, sf):
    return P.hash_collisions(R.messages_from_events(spark, sf))


@query(f"""WITH {_E}, p AS (SELECT substr(channel_path, 1, 8) AS a, right(channel_path, 8) AS z, count(*) AS n FROM (SELECT DISTINCT channel_path FROM e) GROUP BY 1, 2)
 SELECT count(DISTINCT a) AS first8, count(DISTINCT z) AS last8, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS colliding FROM p""")
def prefix_collisions(spark, sf):
    return P.prefix_collisions(R.messages_from_events(spark, sf))


@query(f"""WITH {_L}, c AS (SELECT DISTINCT channel_path FROM l), s AS (SELECT channel_path, string_split(channel_path, '/') AS x FROM c),
 p AS (SELECT unnest([array_to_string(x[1:i], '/') for i in range(1, len(x))]) AS parent FROM s)
 SELECT parent, count(*) AS children FROM p WHERE parent NOT IN (SELECT channel_path FROM c) GROUP BY 1""")
def missing_parents_anti(spark, sf):
    return P.missing_parents(R.messages_from_lineitem(spark, sf))


@query(f"""WITH {_E}, x AS (SELECT unix_timestamp // 259200 AS range, channel_path FROM e),
 p AS (SELECT range, count(*) AS rows, sum(strlen(channel_path))::BIGINT AS name_bytes, count(DISTINCT channel_path) AS channels FROM x GROUP BY 1)
 SELECT *, (max(rows) OVER () - min(rows) OVER ()) / max(rows) OVER () AS spread FROM p""")
def range_balance(spark, sf):
    return P.range_balance(R.messages_from_events(spark, sf), F.floor(F.col("unix_timestamp") / 259200))


@query(f"""WITH {_E}, c AS (SELECT channel_path, count(*) AS n FROM e GROUP BY 1),
 r AS (SELECT (row_number() OVER o)::INT AS top, (sum(n) OVER (ORDER BY n DESC, channel_path ROWS UNBOUNDED PRECEDING))::BIGINT AS rows, sum(n) OVER () AS total FROM c WINDOW o AS (ORDER BY n DESC, channel_path))
 SELECT top, rows, rows::DOUBLE / total::DOUBLE AS share FROM r WHERE top IN (16, 64, 256, 1024, 4096)""")
def topk_coverage(spark, sf):
    return P.topk_coverage(R.messages_from_events(spark, sf))


@query(f"""WITH {_E} SELECT channel_path, count(*) AS sampled, count(*) * 16::DOUBLE AS estimate FROM e
 WHERE substr(md5(concat_ws(',', unix_timestamp::VARCHAR, channel_path, message_length::VARCHAR, stamp_count::VARCHAR)), 1, 1) = '0' GROUP BY 1""")
def sampled_frequency(spark, sf):
    return P.sampled_frequency(R.messages_from_events(spark, sf))


@query(f"WITH {_E}, c AS (SELECT channel_path, count(*) AS n FROM e GROUP BY 1) SELECT channel_path, n, row_number() OVER (ORDER BY n DESC, channel_path) AS rank FROM c")
def frequency_rank(spark, sf):
    return P.frequency_rank(R.messages_from_events(spark, sf))


@query(f"WITH {_E}, c AS (SELECT channel_path, count(*) AS n FROM e GROUP BY 1) SELECT channel_path, n, row_number() OVER (ORDER BY n DESC, channel_path DESC) AS rank FROM c")
def frequency_rank_ties_falling(spark, sf):
    return P.frequency_rank(R.messages_from_events(spark, sf), ties_ascending=False)


@query(f"WITH {_E} SELECT channel_path, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, channel_path LIMIT 12")
def topk(spark, sf):
    return P.channel_frequency(R.messages_from_events(spark, sf)).orderBy(F.desc("n"), "channel_path").limit(12)


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 5")
def limit_n(spark, sf):
    return _table(spark, sf, "events").select("event_id", "event_type").orderBy("event_id").limit(5)


@query(f"""WITH {_E}, a AS ({_lines('e')}), s AS (SELECT channel_path, {_MONTH} AS year_month, message_length % 2 AS odd, min(message_length) AS lo, max(message_length) AS hi,
  sum(message_length) AS t, count(*) AS n, sum(stamp_count) AS k FROM e GROUP BY 1, 2, 3),
 m AS (SELECT channel_path, year_month, min(lo) AS min_length, printf('%.2f', sum(t)::DOUBLE / sum(n)::DOUBLE) AS average_length, max(hi) AS max_length,
  sum(n)::BIGINT AS message_count, sum(k)::BIGINT AS total_stamp_count FROM s GROUP BY 1, 2), b AS (SELECT {_LINE} AS value FROM m),
 x AS ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT count(*) = 0 AS equal, count(*) AS differing FROM x""")
def verify_equal(spark, sf):
    m = R.messages_from_events(spark, sf)
    odd = F.col("message_length") % 2 == 1
    merged = A.merge_partials(A.channel_month_stats(m.where(odd)), A.channel_month_stats(m.where(~odd)))
    return V.equal(A.lines(A.channel_month_stats(m)), A.lines(merged))


@query(f"""WITH {_E}, f AS (SELECT * FROM e WHERE stamp_count <> 7), a AS ({_lines('e')}), b AS ({_lines('f')}),
 x AS (SELECT 'expected' AS side, value FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'actual', value FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
 SELECT side, value, count(*) AS n FROM x GROUP BY 1, 2""")
def verify_diff(spark, sf):
    m = R.messages_from_events(spark, sf)
    return V.diff(A.lines(A.channel_month_stats(m)), A.lines(A.channel_month_stats(m.where("stamp_count <> 7"))))


@query(f"""WITH {_E}, f AS (SELECT * FROM e WHERE stamp_count <> 7), a AS ({_lines('e')}), b AS ({_lines('f')}),
 x AS (SELECT 'expected' AS side, value FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'actual', value FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
 SELECT side, value, count(*) AS n FROM x GROUP BY 1, 2 ORDER BY value, side LIMIT 10""")
def first_diffs(spark, sf):
    m = R.messages_from_events(spark, sf)
    return V.first_diffs(A.lines(A.channel_month_stats(m)), A.lines(A.channel_month_stats(m.where("stamp_count <> 7"))))


@query(f"WITH {_E} SELECT count(*) = 0 AS subset, count(*) AS missing FROM (SELECT DISTINCT channel_path FROM e WHERE stamp_count > 50) WHERE channel_path NOT IN (SELECT channel_path FROM e WHERE stamp_count < 20)")
def subset_test(spark, sf):
    m = R.messages_from_events(spark, sf)
    return V.subset(m.where("stamp_count > 50").select("channel_path"), m.where("stamp_count < 20").select(F.col("channel_path").alias("known")))


_BOARD = "SELECT user_id AS name, sum(floor(value * 100)::BIGINT)::BIGINT AS score FROM events WHERE event_id % 2 = {} GROUP BY 1"


@query(f"""WITH a AS ({_BOARD.format(0)}), b AS ({_BOARD.format(1)}),
 x AS (SELECT name, (row_number() OVER (ORDER BY score DESC, name))::INT AS public_rank FROM a), y AS (SELECT name, (row_number() OVER (ORDER BY score DESC, name))::INT AS private_rank FROM b)
 SELECT name, public_rank, private_rank, (public_rank - private_rank)::INT AS rank_change FROM x JOIN y USING (name)""")
def rank_change_join(spark, sf):
    e = _table(spark, sf, "events").select("event_id", F.col("user_id").alias("name"), F.floor(F.col("value") * 100).cast("bigint").alias("v"))
    board = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("name").agg(F.sum("v").alias("score"))
    return P.rank_change(board(0), board(1))


@query(f"WITH {_E} SELECT channel_path AS label, median(message_length)::DOUBLE AS median, count(*) AS runs FROM e GROUP BY 1")
def median_metric(spark, sf):
    return P.median_by(R.messages_from_events(spark, sf), F.col("channel_path"), F.col("message_length"))


@query("""WITH t AS (SELECT event_type AS label, 1 + floor(value * 100)::BIGINT AS hundredths, user_id::DOUBLE * 1000000 AS bytes FROM events)
 SELECT label, median(hundredths)::DOUBLE AS median, count(*) AS runs, max(bytes) / median(hundredths)::DOUBLE / 1e9 AS gb_per_second FROM t GROUP BY 1""")
def throughput(spark, sf):
    e = _table(spark, sf, "events")
    return P.throughput(e, F.col("event_type"), 1 + F.floor(F.col("value") * 100).cast("bigint"), F.col("user_id").cast("double") * 1000000)


@query(f"""WITH {_E}, x AS (SELECT split_part(channel_path, '/', 1) AS label, CASE WHEN stamp_count < 50 THEN 'a' ELSE 'b' END AS side, message_length AS v FROM e),
 m AS (SELECT label, median(v) FILTER (side = 'a')::DOUBLE AS a, median(v) FILTER (side = 'b')::DOUBLE AS b FROM x GROUP BY 1) SELECT *, (a / b - 1) * 100 AS delta_percent FROM m""")
def ab_delta(spark, sf):
    m = R.messages_from_events(spark, sf)
    return P.ab_delta(m, F.substring_index("channel_path", "/", 1), F.when(F.col("stamp_count") < 50, "a").otherwise("b"), F.col("message_length"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%-m/%d %H:%M') AS jst FROM events")
def utc_to_jst(spark, sf):
    iso = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _table(spark, sf, "events").select("event_id", S.utc_to_jst(iso).alias("jst"))
