"""URL filters: allow and block rules, then gradient-boosted trees on lexical features of the rest.

Built-in functions only: features are SQL expressions, and the fitted trees become one SQL expression.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, read


class UrlRule(NamedTuple):
    """verdict for a host and all its subdomains where the path starts with path."""

    verdict: str
    host: str
    path: str


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))
#: Bound of the labelled sample that the trees are fitted on.
SAMPLE_ROWS = 8_000
TREES, DEPTH = 20, 3
#: Share of the rows that a tree sees, and of the features that a split may use: so no feature that tells
#: the labelled rows apart by itself hides all others.
ROWS_SEEN, FEATURES_SEEN = 0.7, "onethird"
#: Folds of the suffix statistics; rows of the common rate that are added to each.
FOLDS, PRIOR = 5, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty if null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null if none fits. For a rule list of fixed size."""
    none = F.lit(None).cast("string")
    text, verdict = none, none
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):  # longer ones are asked first
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")).cast("double")


def lexical_features(url: Column) -> dict[str, Column]:
    """Numbers of the url's text. Entropy is that of its characters, in bits.

    A text of many different characters costs its length times their number; urls have few."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: (F.length(url) - F.length(F.replace(url, c))) / size)
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "hyphens": _count(host, "-"),
        "depth": _count(path, "/"),
        "digit_ratio": _count(url, "0-9") / size,
        "entropy": F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
        "params": F.when(F.contains(url, F.lit("?")), _count(F.substring_index(url, "?", -1), "&=") + 1).otherwise(0.0),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": url.startswith("https").cast("double"),
    }


def suffixes_of(url: Column) -> dict[str, Column]:
    """What statistics are kept of, each by itself: the last one, two and three labels of the host, and the
    first part of the path. No combination of host and path, which rules are made of."""
    host = host_of(url)
    return {**{f"suffix{n}": F.substring_index(host, ".", -n) for n in (1, 2, 3)}, "first_part": F.regexp_extract(path_of(url), "^/[^/]*", 0)}


def _tree_sql(node, names: list[str]) -> str:
    if node.subtreeDepth() == 0:
        return f"{node.prediction()!r}D"
    split = node.split()
    return f"CASE WHEN {names[split.featureIndex()]} <= {split.threshold()!r}D THEN {_tree_sql(node.leftChild(), names)} ELSE {_tree_sql(node.rightChild(), names)} END"


class UrlModel(NamedTuple):
    """Block rates of all suffixes (tables s, rate), and the sum of the trees as SQL over the features."""

    rates: dict[str, DataFrame]
    rate: float
    margin: str
    importances: dict[str, float]

    def with_features(self, df: DataFrame) -> DataFrame:
        """df(row, url, ...) with the struct f of the url's features. Each table of rates has a row a suffix
        and is joined from the left, so rows stay; Spark broadcasts it if its size is known to be small."""
        out = df.withColumns({f"s_{k}": c for k, c in suffixes_of(F.col("url")).items()})
        for k, rates in self.rates.items():
            out = out.join(rates.select(F.col("s").alias(f"s_{k}"), F.col("rate").alias(f"r_{k}")), f"s_{k}", "left")
        return _featured(out, df.columns, {k: F.coalesce(f"r_{k}", F.lit(self.rate)) for k in self.rates})


def _featured(out: DataFrame, columns: list[str], known: dict[str, Column]) -> DataFrame:
    return out.select(*columns, F.struct(*[c.alias(k) for k, c in lexical_features(F.col("url")).items()], *[c.alias(k) for k, c in known.items()]).alias("f"))


def fit_url_model(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """Fit on labelled(url, label): label 1 is block.

    Suffix statistics are block rates of all suffixes over all labelled rows, drawn to the common rate as if
    PRIOR more rows had it. Trees are fitted on about sample_rows rows, by a hash of the url; there, a row's
    rates are made of the other FOLDS - 1 folds of rows alone, so its own label is in none of them, and a
    suffix that only its fold has gets the common rate, like one that has never been seen. Rows with
    null url or label are skipped. With one kind of label only, that is the model.
    """
    labelled = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("url", F.lit(9)), F.lit(FOLDS)).alias("fold"))
    n, blocked = labelled.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    rate = blocked / n if n else 0.0
    drawn = lambda b, n: (b + PRIOR * rate) / (n + PRIOR)
    part = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(1_000_003)) / 1_000_003.0
    sample = labelled.where(part < sample_rows / max(n, 1)).withColumns({f"s_{k}": c for k, c in suffixes_of(F.col("url")).items()})
    rates = {}
    for name, column in suffixes_of(F.col("url")).items():
        seen = cut(labelled.groupBy(column.alias("s"), "fold").agg(F.count("label").alias("n"), F.sum("label").alias("b")))
        whole = seen.groupBy("s").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        rates[name] = cut(whole.select("s", drawn(F.col("b"), F.col("n")).alias("rate")))
        own, rest = seen.alias("own"), whole.alias("rest")
        others = own.join(rest, "s").select(F.col("s").alias(f"s_{name}"), "fold", drawn(F.col("rest.b") - F.col("own.b"), F.col("rest.n") - F.col("own.n")).alias(f"r_{name}"))
        sample = sample.join(others, [f"s_{name}", "fold"], "left")
    model = UrlModel(rates, rate, f"{2.0 * rate - 1.0!r}D", {})
    if blocked in (0, n):
        return model
    ready = cut(_featured(sample, ["label"], {k: F.col(f"r_{k}") for k in rates}).select("label", "f.*"))  # of bounded size
    columns = [c for c in ready.columns if c != "label"]
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(ready).select("features", "label").coalesce(4)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, subsamplingRate=ROWS_SEEN, featureSubsetStrategy=FEATURES_SEEN, checkpointInterval=-1).fit(vectors)
    names = [f"f.`{k}`" for k in columns]
    parts = [f"{w!r}D * ({_tree_sql(t._call_java('rootNode'), names)})" for t, w in zip(trees.trees, trees.treeWeights, strict=True)]
    return model._replace(margin=" + ".join(parts), importances=dict(zip(columns, trees.featureImportances.toArray().tolist(), strict=True)))


def judge_urls(pages: DataFrame, model: UrlModel, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """pages(url, ...) with host, path, rule, verdict and score, the trees' probability of block.

    Suffix rates are joined by suffix, the rest is a projection. A rule's verdict wins; elsewhere score >= 0.5
    is block. Null and empty urls have an empty host and path and no rule, and are judged like any other
    text. Rows are judged each by itself; columns of these five names are replaced, all others stay,
    whatever their names; an empty table gives an empty result. A text of 50,000 characters is a text like
    any other.
    """
    given = pages.drop("host", "path", "rule", "verdict", "score")
    rows = model.with_features(given.select(F.struct("*").alias("row"), F.coalesce("url", F.lit("")).alias("url")))
    rows = rows.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), (1.0 / (1.0 + F.exp(-2.0 * F.expr(model.margin)))).alias("score"))
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("row.*", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url; the trees learn from the urls that a rule labels."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    _, verdict = match_rule(host_of(F.col("url")), path_of(F.col("url")))
    model = fit_url_model(pages.select("url", (verdict == "block").cast("int").alias("label")))
    return judge_urls(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


_HOST = r"translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: host, path and rule alone; the trees' verdict is beyond SQL.
ORACLE_RULES = rf"""
WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p"""
