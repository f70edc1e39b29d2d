import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import secrets as S
from tests.llm.oracle import assert_same

PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def brute(text):
    return sorted((m.start(), k, m.end()) for k, r in enumerate(S.BASE) for m in PLAIN[r.kind][0].finditer(text) if len(m[PLAIN[r.kind][1]]) >= PLAIN[r.kind][2])


WORDS = st.sampled_from(["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH0123", "deadbeef" * 4, "0", "f", "x", "é", "\n", "abc+/=", "secret=", "AKIAAKIA", "-.", "ÿ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=25).map("".join), min_size=1, max_size=8))
def test_matches_re(texts):
    assert S.spans_of(texts, S.BASE) == [brute(t) for t in texts]


MORE = {
    "github": (re.compile(r"gh[pousr]_([A-Za-z0-9]+)"), 1, 36),
    "google": (re.compile(r"AIza([A-Za-z0-9_-]+)"), 1, 35),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 1),
    "pem": (re.compile(r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----"), 0, 1),
    "slack": (re.compile(r"xox[abprs]-([A-Za-z0-9-]+)"), 1, 10),
}
PARTS = st.sampled_from(["ghp_", "gho_", "ghx_", "a1" * 18, "Z" * 35, "AIza", "-" * 35, "_", "eyJ", "eyJab", ".", ".eyJ", "eyJx.eyJy.z", "-----BEGIN ", "RSA ", "EC", " ", "PRIVATE KEY-----", "-----", "xoxb-", "xox", "1234567890", "é", "\n", "x"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=20).map("".join), min_size=1, max_size=6))
def test_every_rule_matches_re(texts):
    """All rules at once: each kind's leftmost matches that don't overlap, short ones dropped."""
    for t, got in zip(texts, S.spans_of(texts, S.RULES), strict=True):
        want = brute(t)
        for k, r in enumerate(S.RULES):
            if r.kind in MORE:
                pattern, group, least = MORE[r.kind]
                want += [(m.start(), k, m.end()) for m in pattern.finditer(t) if len(m[group]) >= least]
        assert got == sorted(want)


def test_lanes_meet():
    texts = ["a" * 5000, "token=" + "deadbeef" * 1000, "", "x" * 2047 + "password: 12345678", " " * 4096 + "AKIA" + "Z" * 6000]
    assert S.spans_of(texts, S.BASE) == [brute(t) for t in texts]


def test_more_rules():
    text = "ghp_" + "a1" * 18 + " xoxb-1234567890 -----BEGIN RSA PRIVATE KEY----- AIza" + "x" * 35
    assert [S.RULES[k].kind for _, k, _ in S.spans_of([text], S.RULES)[0]] == ["github", "hex", "slack", "pem", "google"]


def test_query(spark, sf_dir):
    assert_same(S.op9_secrets(spark, sf_dir), S.ORACLE_OP9, sf_dir)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, "token=abcdefgh9", "y"), (2, "", None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, secrets string")
    assert sorted((r.doc_id or 0, len(r.secrets)) for r in S.find_secrets(docs).collect()) == [(0, 1), (1, 0), (2, 0), (2, 0)]
    assert sorted(str(r.text) for r in S.redact_secrets(docs).collect()) == ["", "", "None", "[assign]"]
    assert S.find_secrets(docs.limit(0)).count() == 0
