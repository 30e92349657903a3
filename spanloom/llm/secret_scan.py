"""Secrets in texts, by an inverted index of trigrams: rules ask for trigrams, postings are intersected, candidates verified.

Each rule's regular expression yields a Boolean query: alternatives, each a set of trigrams that every match holds.
The index has, per block of documents and trigram, the sorted ids of the documents with it. A rule whose matches need
hold no trigram has no query and scans all texts. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
import re
from re import _constants as ops
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import read_table, stored, without

#: Documents in a block of the index; strings or alternatives kept apart in the analysis of a rule.
BLOCK, WIDEST = 4096, 24


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same to Python, Java and RE2; ``group`` must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The base rules, in the order of the contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
#: Rules of this operator's own: public formats of tokens and keys.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", r"://[^/:@\x20\x09-\x0D]{1,64}:[^/:@\x20\x09-\x0D]{1,64}@"),
)
RULES = (*BASE, *EXTRA)

Query = frozenset[frozenset[str]]
EVERYTHING: Query = frozenset([frozenset()])


def _least(query: Iterable[frozenset[str]]) -> Query:
    """Alternatives without those that another one implies."""
    found = set(query)
    return frozenset(a for a in found if not any(b < a for b in found))


def _both(a: Query, b: Query) -> Query:
    return _least(x | y for x in a for y in b) if len(a) * len(b) <= WIDEST else min(a, b, key=len)


def _holds(strings: Iterable[str]) -> Query:
    """The trigrams of one of the strings."""
    return _least(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _item(op, arg) -> tuple[frozenset[str] | None, Query]:
    """All strings that a parsed item matches (None: too many to list), and else the trigrams they hold."""
    if op is ops.LITERAL:
        return frozenset([chr(arg)]), EVERYTHING
    if op is ops.IN:
        points: set[int] = set()
        for kind, value in arg:
            if kind not in (ops.LITERAL, ops.RANGE):
                return None, EVERYTHING
            points.update([value] if kind is ops.LITERAL else range(value[0], min(value[1], value[0] + WIDEST) + 1))
        return (frozenset(map(chr, points)) if len(points) <= WIDEST else None), EVERYTHING
    if op is ops.SUBPATTERN:
        return _sequence(arg[3])
    if op is ops.BRANCH:
        found = [_sequence(branch) for branch in arg[1]]
        if all(strings is not None for strings, _ in found):
            union = frozenset().union(*(strings for strings, _ in found))
            return (union, EVERYTHING) if len(union) <= WIDEST else (None, _holds(union))
        return None, _least(a for strings, query in found for a in (query if strings is None else _holds(strings)))
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and (low, high) == (0, 1) and len(strings) < WIDEST:
            return strings | {""}, EVERYTHING
        if low == 0:
            return None, EVERYTHING
        one = query if strings is None else _holds(strings)
        if strings is not None and len(strings) ** low <= WIDEST and low == high:
            several = frozenset([""])
            for _ in range(low):
                several = frozenset(a + b for a in several for b in strings)
            return several, EVERYTHING
        return None, one
    return (frozenset([""]) if op is ops.AT else None), EVERYTHING


def _unrolled(items) -> Iterator[tuple]:
    """Repeats that must occur, apart from those that may follow."""
    for op, arg in items:
        if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and 0 < arg[0] < arg[1]:
            yield op, (arg[0], arg[0], arg[2])
            yield op, (0, ops.MAXREPEAT, arg[2])
        else:
            yield op, arg


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    strings, query, whole = frozenset([""]), EVERYTHING, True
    for op, arg in _unrolled(items):
        more, needs = _item(op, arg)
        if more is not None and len(strings) * len(more) <= WIDEST:
            strings = frozenset(a + b for a in strings for b in more)
            continue
        query, whole = _both(_both(query, _holds(strings)), needs), False
        strings = frozenset([""]) if more is None else more
    return (strings, EVERYTHING) if whole else (None, _both(query, _holds(strings)))


def trigram_query(pattern: str) -> Query:
    """What every match of ``pattern`` holds, after lower-casing: one of the sets of trigrams. An empty set: no demand."""
    strings, query = _sequence(_parser.parse(re.sub("[A-Z]", lambda m: m[0].lower(), pattern)))
    return query if strings is None else _holds(strings)


def trigrams(text: Column, vocabulary: Sequence[str] | None = None) -> Column:
    """The distinct trigrams of a folded text: all, or those of ``vocabulary``."""
    if vocabulary is not None:
        return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in vocabulary]))
    def threes(letters: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(letters) - 2, F.lit(1)))
        return F.transform(starts, lambda i: F.concat(*[F.coalesce(F.get(letters, i + k), F.lit("")) for k in (-1, 0, 1)]))

    # As the argument of a function the letters are split once, not for each of them.
    three = F.get(F.transform(F.array(F.split(text, "")), threes), 0)
    return F.filter(F.array_distinct(three), lambda t: F.char_length(t) == 3)


def build_index(docs: DataFrame, vocabulary: Sequence[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The inverted index (block, trigram, ids), stored: sorted distinct doc_ids per block of documents and trigram.

    With a ``vocabulary`` it holds the postings of those trigrams only, which is all that known rules can ask for. A
    list is no longer than the ids of its block. Rows without a doc_id are not in it.
    """
    blocks = max(1, -(-docs.count() // block))
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower("text").alias("folded"))
    rows = rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), F.explode(trigrams(F.col("folded"), vocabulary)).alias("trigram"))
    return stored(rows.groupBy("block", "trigram").agg(F.sort_array(F.collect_set("doc_id")).alias("ids")), "trigram-index")


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(doc_id, rules): the documents that hold all trigrams of an alternative of a rule's query, by intersecting postings."""
    asked: dict[str, list] = {}
    for rule, query in queries.items():
        for alternative, wanted in enumerate(sorted(map(sorted, query))):
            for trigram in wanted:
                asked.setdefault(trigram, []).append(F.struct(F.lit(rule).alias("rule"), F.lit(alternative).alias("alternative"), F.lit(len(wanted)).alias("wanted")))
    if not asked:
        return index.select(F.col("ids")[0].alias("doc_id"), F.array(F.lit(0)).alias("rules")).limit(0)
    terms = F.create_map(*[c for trigram, uses in sorted(asked.items()) for c in (F.lit(trigram), F.array(*uses))])
    postings = index.where(F.col("trigram").isin(sorted(asked))).select("block", "ids", F.inline(F.element_at(terms, F.col("trigram"))))
    lists = postings.groupBy("block", "rule", "alternative", "wanted").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("wanted"))
    shortest = F.array_sort("lists", lambda a, b: F.size(a) - F.size(b))
    both = lists.select("rule", F.aggregate(shortest, shortest[0], F.array_intersect).alias("ids"))
    return both.select("rule", F.explode("ids").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def matches(text: Column, rule: Rule, place: int) -> Column:
    """Spans (start, kind, end) of a rule's matches: leftmost, not overlapping, too short ones dropped; in code points."""
    columns = [F.split(text, rule.java, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)).alias("hit")]
    if rule.group:
        columns.append(F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)).alias("part"))
    found = F.arrays_zip(*columns)
    none = F.array().cast("array<struct<start: long, kind: int, end: long>>")

    def step(state: Column, at: Column) -> Column:
        start = state["at"] + F.char_length(at["gap"])
        end = start + F.coalesce(F.char_length(at["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(place).alias("kind"), end.alias("end")))
        kept = F.when(F.char_length(at["part" if rule.group else "hit"]) >= max(rule.least, 1), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.aggregate(found, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda state: state["spans"])


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, spans) of every row; spans: array of (start, kind, end) by start, then place of the kind in ``rules``.

    A rule looks at the texts its trigrams lead to (every row without a doc_id counts as led to); a rule without
    mandatory trigrams looks at all. A doc_id on several rows leads to all of them; each is matched by its own text. NULL and
    empty texts have no spans. An empty table gives an empty result. Other columns are ignored. ``index`` may be one built
    before, if it holds the rules' trigrams.
    """
    queries = {i: trigram_query(rule.pattern) for i, rule in enumerate(rules)}
    asked = {i: query for i, query in queries.items() if frozenset() not in query}
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if index is None:
        index = build_index(docs, sorted({t for query in asked.values() for alternative in query for t in alternative}))
    led = stored(candidates(index, asked), "secret-candidates")
    rows = docs.join(led, "doc_id", "left")
    none = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    spans = []
    for i, rule in enumerate(rules):
        spans.append(matches(F.col("text"), rule, i) if i not in asked else
                     F.when(F.col("doc_id").isNull() | F.array_contains("rules", i), matches(F.col("text"), rule, i)).otherwise(none))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*spans)).alias("spans"))


def listed(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{rule.kind}") for i, rule in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _re2(rule: Rule) -> str:
    """The pattern for RE2, whose own case folding also takes letters beyond ASCII."""
    if not rule.any_case:
        return rule.pattern
    head, bracket, tail = rule.pattern.partition(")")
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head) + bracket + tail


def op12_sql(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for the same rows: every rule over every text, without an index."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    kinds = "\nUNION ALL ".join(
        f"SELECT rid, {i} AS kind, {quoted(rule.kind)} AS label, {max(rule.least, 1)} AS least, string_split_regex(text, {quoted(_re2(rule))}) AS gaps, "
        f"regexp_extract_all(text, {quoted(_re2(rule))}, 0) AS hits, regexp_extract_all(text, {quoted(_re2(rule))}, {rule.group}) AS parts FROM d"
        for i, rule in enumerate(rules))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
k AS ({kinds}),
r AS (SELECT rid, kind, label, least, i, length(gaps[i]) AS gap, length(hits[i]) AS hit, length(parts[i]) AS part
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM k)),
s AS (SELECT *, sum(gap + hit) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM r),
t AS (SELECT rid, kind, concat_ws(':', label, CAST(stop - hit AS BIGINT), CAST(stop AS BIGINT)) AS span, stop - hit AS start FROM s WHERE part >= least),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM t GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


OP12_SQL = op12_sql()
