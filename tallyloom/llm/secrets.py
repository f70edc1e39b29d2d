"""Secret scans: one combined deterministic automaton over the bytes of every text."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.automaton import Rule, Scanner
from tallyloom.llm.common import lean, pieces, read, remembers, texts_of

#: The kinds that every report counts. {32}: matches of hex are maximal runs, so asking for the least
#: length at once is the same as dropping shorter ones.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", "[A-Za-z0-9+/_.=-]", ignore_case=True, min_tail=8),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]", min_tail=12),
    Rule("hex", "[0-9a-f]{32}", "[0-9a-f]"),
)
#: Public formats of credentials beyond the base kinds.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "[A-Za-z0-9]", min_tail=36),
    Rule("google", "AIza[A-Za-z0-9_-]", "[A-Za-z0-9_-]", min_tail=35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", "[A-Za-z0-9_-]"),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]", "[A-Za-z0-9-]", min_tail=10),
)
RULES = BASE + MORE


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once in each Python worker; the tables do not depend on the data."""
    return Scanner(rules)


remembers(__name__, scanner.cache_clear)


def spans_of(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its sorted (start, rule number, end) in code points, end exclusive."""
    data = [x.encode("utf-8", "surrogatepass") for x in texts]
    out = []
    for text, raw, spans in zip(texts, data, scanner(rules).scan(data), strict=True):
        if spans and len(raw) != len(text):
            at = lambda n, raw=raw: len(raw[:n].decode("utf-8", "surrogatepass"))
            spans = [(at(s), k, at(e)) for s, k, e in spans]
        out.append(spans)
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, secrets array<struct<kind, start, end>> of every row of docs(doc_id, text, ...).

    A map over whole texts: no shuffle. Spans are of code points, sorted by start, then rule. Null and
    empty texts give an empty array; null or repeated doc_ids and repeated rows each keep their row;
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in pieces(batches, "text"):
            found = spans_of(texts_of(batch), rules)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "secrets"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, secrets array<struct<kind:string,start:bigint,end:bigint>>")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret in text replaced by [kind]; overlapping spans become one, named by the first.

    Every row and column stays. n_chars, if there, is the length of the new text. A null text stays null.
    """

    def run(batches):
        for batch in pieces(batches, "text"):
            out = []
            for raw, text, spans in zip(batch.column("text").to_pylist(), t := texts_of(batch), spans_of(t, rules), strict=True):
                kept, at = [], 0
                for s, k, e in spans:
                    if s >= at:
                        kept += [text[at:s], f"[{rules[k].kind}]"]
                    at = max(at, e)
                out.append("".join([*kept, text[at:]]) if spans else raw)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    done = docs.mapInArrow(lean(run), docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans, for every document."""
    base = [r.kind for r in BASE]

    def digest(batches):
        for batch in batches:
            rows = [[(f"{x['kind']}:{x['start']}:{x['end']}", x["kind"]) for x in found] for found in batch.column("secrets").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [pa.array([sum(k == kind for _, k in row) for row in rows], pa.int64()) for kind in base]
                + [pa.array([hashlib.sha256(",".join(s for s, k in row if k in base).encode()).hexdigest() for row in rows]), pa.array([",".join(s for s, _ in row) for row in rows])],
                ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"],
            )

    found = find_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.mapInArrow(lean(digest), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def _oracle() -> str:
    def spans(k: int, rule: Rule) -> str:
        # base patterns as they are stated: any length first, short matches dropped afterwards
        pattern = rule.pattern.replace("{32}", "")
        tail = pattern.replace("[A-Za-z0-9+/_.=-][A-Za-z0-9+/_.=-]*", "([A-Za-z0-9+/_.=-]+)") if rule.kind == "assign" else f"()({pattern})"
        quoted = ("(?i)" * rule.ignore_case + pattern).replace("'", "''")
        least = {"assign": 8, "access": 16, "hex": 32, "github": 40, "google": 39, "slack": 15}.get(rule.kind, 1)
        return f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, a AS s, a + length(m[i]) AS e FROM (
          SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i, list_sum([length(x) for x in p[:i]]) + coalesce(list_sum([length(x) for x in m[:i - 1]]), 0) AS a
          FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS p FROM d))
          WHERE length(regexp_extract(m[i], '{("(?i)" * rule.ignore_case + tail).replace("'", "''")}', 2)) >= {least}"""

    union = " UNION ALL ".join(spans(k, r) for k, r in enumerate(RULES))
    one = "kind || ':' || s::BIGINT || ':' || e::BIGINT"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      found AS ({union}),
      told AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg({one}, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg({one}, ',' ORDER BY s, k) AS spans FROM found GROUP BY doc_id)
      SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (doc_id)"""


ORACLE_OP9 = _oracle()
