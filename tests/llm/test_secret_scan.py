"""Secret scans against plain regular expressions over every text, and what rules demand of their trigrams."""

import re
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import secret_scan as ss

KEYS = {
    "assign": ["password = hunter2xx", 'API_KEY:"abc/def+123"', "token=abc", "Secret='aaaaaaa", "passwd:=abcdef", "apikey abcdefg", "token=token=abcdef", "ſecret=abcdefg", "toKen: abcdefg"],
    "access": ["AKIA" + "A1" * 8, "AKIASHORT", "akia" + "a1" * 9, "AKIAAKIA" + "Z" * 12],
    "hex": ["0123456789abcdef" * 2, "0123456789abcdef0123456", "ABCDEF0123456789ABCDEF012345"],
    "github": ["ghp_" + "a" * 36, "gho_" + "b" * 20],
    "slack": ["xoxb-1234567890-abc", "xoxq-1234567890"],
    "google": ["AIza" + "x" * 35],
    "stripe": ["sk_live_" + "a1" * 10, "rk_test_" + "z" * 16, "pk_live_" + "a" * 20],
    "jwt": ["eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"],
    "private_key": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN KEY-----"],
    "url_login": ["https://user:pa55@host/x", "http://host:80/a@b"],
}


def plain(text, rules=ss.RULES):
    found = []
    for place, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text, re.ASCII | (re.IGNORECASE if rule.any_case else 0)):
            if len(m[rule.group]) >= max(rule.least, 1):
                found.append((m.start(), place, m.end()))
    return sorted(found)


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(4), []
    every = [k for some in KEYS.values() for k in some]
    for i in range(150):
        parts = ["wörd " * rng.randint(0, 9) + rng.choice(["", "𝒳", "token ", "sec ret pass word "]) for _ in range(6)]
        rows.append((i // 2 if i < 20 else i * 10 ** 12, rng.choice([" ", "", "\n"]).join(p + rng.choice(every + [""] * 10) for p in parts)))
    rows += [(None, every[0]), (None, None), (999, None), (998, ""), (997, ("token=abcdefg " * 300) + "x " * 100_000 + every[0]), (997, "clean")]
    return spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, spans string, Rules int")


def test_spans_match_plain_search(spark, docs):
    got = ss.scan_secrets(docs)
    spans = sorted((r.doc_id, r.text, [tuple(s) for s in r.spans]) for r in got.where("doc_id IS NOT NULL").collect())
    want = sorted((r.doc_id, r.text or "", plain(r.text or "")) for r in docs.where("doc_id IS NOT NULL").collect())
    assert spans == want
    assert {kind for _, _, s in want for _, kind, _ in s} == set(range(len(ss.RULES)))
    assert sorted(len(r.spans) for r in got.where("doc_id IS NULL").collect()) == [0, 1]
    assert ss.scan_secrets(docs.limit(0)).count() == 0


def test_whole_index_leads_to_the_same_rows(spark, docs):
    queries = {i: ss.trigram_query(r.pattern) for i, r in enumerate(ss.RULES) if frozenset() not in ss.trigram_query(r.pattern)}
    asked = sorted({t for q in queries.values() for a in q for t in a})
    some, whole = ss.build_index(docs, asked, block=40), ss.build_index(docs, block=40)
    pairs = [sorted((r.doc_id, sorted(r.rules)) for r in ss.candidates(index, queries).collect()) for index in (some, whole)]
    assert pairs[0] == pairs[1] and pairs[0]
    texts = {}
    for r in docs.where("doc_id IS NOT NULL AND text IS NOT NULL").collect():
        texts.setdefault(r.doc_id, []).append(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
    brute = sorted((d, rules) for d, held in texts.items() if (rules := sorted(
        i for i, q in queries.items() if any(all(any(t in text for text in held) for t in a) for a in q))))
    assert pairs[0] == brute
    assert whole.where(F.size("ids") > 40 * 3).count() == 0
    assert len({r.trigram for r in whole.select("trigram").distinct().collect()}) > len(asked)


@pytest.mark.parametrize("pattern, query", [
    ("abcd", [{"abc", "bcd"}]), ("ab", [set()]), ("ABC+", [{"abc"}]), ("(foo|bar)baz", [{"foo", "oob", "oba", "baz"}, {"bar", "arb", "rba", "baz"}]),
    ("abc(x|.*)def", [{"abc", "def"}]), ("abc|d", [set()]), ("(?:abc)?", [set()]), ("(?:abc){2,}", [{"abc", "bca", "cab"}]), ("ab?cd", [{"abc", "bcd"}, {"acd"}]),
    ("[0-9a-f]{24,}", [set()]), ("x[^a]yzw", [{"yzw"}]), (r"\bkey\d+end", [{"key", "end"}])])
def test_trigram_queries(pattern, query):
    assert ss.trigram_query(pattern) == frozenset(map(frozenset, query))


def test_queries_are_sound():
    for rule in ss.RULES:
        query = ss.trigram_query(rule.pattern)
        for key in KEYS[rule.kind]:
            if re.search(rule.pattern, key, re.ASCII | (re.IGNORECASE if rule.any_case else 0)):
                folded = re.sub("[A-Z]", lambda m: m[0].lower(), key)
                assert any(all(t in folded for t in alternative) for alternative in query)
