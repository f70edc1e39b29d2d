import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.llm import urls as U
from tests.llm.oracle import assert_same

ODD = [None, "", "no scheme/net/", "HTTP://A.NET/x", "http://net/", "http://xnet/", "http://a.net?x=/", "http://a.example.net/en/1", "http://example.net/en", "http://Example.COM/de/#", "http://é.ORG/fr/a?b=c&d", "http://h://x.net/", "://a.org/fr/", "http://a.net\n/", "x" * 50_000, "http://a.net/" + "y/" * 20_000]


def plain(url):
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None, None
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_query_and_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = U.op3_urls(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    assert not any("Python" in line or "Arrow" in line for line in U.op3_urls(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines())
    for r in got:
        host, path, rule, verdict = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(ODD)] + [(None, ODD[3], "x"), (None, ODD[3], "x")], "page_id bigint, url string, verdict string")
    model = U.fit_url_model(rows.selectExpr("url", "page_id % 2 AS label"))
    for r in U.judge_urls(rows, model).collect():
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    empty = U.fit_url_model(rows.limit(0).selectExpr("url", "page_id AS label"))
    assert U.judge_urls(rows, empty).count() == len(ODD) + 2 and U.judge_urls(rows.limit(0), empty).count() == 0


def test_oracle_of_the_rules(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(U.op3_urls(spark, sf).select("page_id", "host", "path", "rule"), U.ORACLE_RULES, sf)


def test_scores_where_no_rule_fits(spark):
    """Urls without a rule are told apart, and a page's score does not change with the pages beside it."""
    sf = "/root/testdata/sf0.1"
    got = U.op3_urls(spark, sf).where("rule is null").agg(F.countDistinct(F.round("score", 6)), F.countDistinct("verdict"), F.min("score"), F.max("score")).first()
    assert got[0] > 10 and got[1] == 2 and got[2] < 0.3 and got[3] > 0.7


def test_suffix_held_out_whole(spark):
    """Rows of a suffix that the model has never seen."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    _, verdict = U.match_rule(U.host_of(F.col("url")), U.path_of(F.col("url")))
    labelled = pages.select("page_id", "url", (verdict == "block").cast("int").alias("label")).where("label is not null")
    model = U.fit_url_model(labelled.where("url not like '%.com/%'").select("url", "label"))
    held = U.judge_urls(labelled.where("url like '%.com/%'"), model)
    n, right = held.agg(F.count("*"), F.count_if((F.col("score") >= 0.5) == (F.col("label") == 1))).first()
    assert n > 50 and right / n > 0.9


def test_lexical_features_decide(spark):
    """Each host has one label and none is seen twice: digits, length and parameters alone tell them apart."""
    rng = random.Random(3)
    name = lambda n, kind: "".join(rng.choice(kind) for _ in range(n))
    rows = []
    for i in range(1200):
        bad = i % 3 == 0
        letters = "abcdefghijklmnopqrstuvwxyz"
        host = name(rng.randrange(6, 14), letters + "0123456789-" * 2 if bad else letters)
        path = "/".join(name(rng.randrange(3, 9), letters) for _ in range(rng.randrange(1, 6 if bad else 4)))
        rows.append((f"http://{host}.{name(4, letters)}/{path}" + ("?" + "&".join(f"{name(2, letters)}={rng.randrange(10**6)}" for _ in range(rng.randrange(4))) if bad else ""), int(bad)))
    df = spark.createDataFrame(rows, "url string, label int")
    model = U.fit_url_model(df.where("xxhash64(url) % 4 <> 0"))
    assert sum(model.importances[k] for k in ("length", "depth", "digit_ratio", "entropy", "params", "hyphens", "host_length")) > 0.9
    n, right = U.judge_urls(df.where("xxhash64(url) % 4 = 0"), model).agg(F.count("*"), F.count_if((F.col("score") >= 0.5) == (F.col("label") == 1))).first()
    assert n > 200 and right / n > 0.85


def test_columns_of_callers_stay(spark):
    rows = spark.createDataFrame([("http://a.net/", "keep1", "keep2", "keep3", "keep4")], "url string, _url string, f string, row string, s_suffix1 string")
    got = U.judge_urls(rows, U.fit_url_model(rows.limit(0).selectExpr("url", "1 AS label"))).first()
    assert got[:5] == ("http://a.net/", "keep1", "keep2", "keep3", "keep4") and got.rule == "net/"


def test_entropy(spark):
    urls = ["aab", "http://a.b/c?d=1", ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.e for r in df.select("url", U.lexical_features(F.col("url"))["entropy"].alias("e")).collect()}
    for u in urls:
        assert math.isclose(got[u], -sum(n / len(u) * math.log2(n / len(u)) for n in Counter(u).values()), abs_tol=1e-9)


def test_all_suffixes_have_rates(spark):
    """The 300 rarer hosts keep their own rates beside 300 commoner ones."""
    rows = [(f"http://c{i}.aa/x{j}", i % 2) for i in range(300) for j in range(4)] + [(f"http://r{i}.bb/x", 1) for i in range(300)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    model = U.fit_url_model(labelled)
    assert model.rates["first_part"].count() == 5
    rates = {r.s: r.rate for r in model.rates["suffix2"].collect()}
    assert len(rates) == 600
    assert {round(rates[f"r{i}.bb"], 9) for i in range(300)} == {round((1 + 10 * model.rate) / 11, 9)}
    got = model.with_features(labelled.select(F.struct("*").alias("row"), "url"))
    assert got.count() == 1500 and got.where("url like '%.bb/%'").select("f.suffix2").distinct().collect()[0][0] > model.rate
