"""Merkle manifest of a dataset: a tree per language, a tree over their roots, and a proof for every row.

A parent is one row whose children stand in ``FANOUT`` columns, spread there by conditional aggregates. Concatenating
the columns gives what the parent hashes; leaving a child's own column out gives its siblings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.skew import join_nullsafe
from spanloom.llm.common import LOWER, UPPER, read_table, stored

#: Children of a node; rows that one task of the numbering sorts.
FANOUT, ROWS_A_PART = 8, 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left: string, right: string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 of the fields: ``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, group: str, order: Sequence[str], rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """Rows with ``pos``, their place from 0 within ``group``, and ``n``, its size; NULL sorts first.

    All rows are dealt by ranges and sorted there, so a group of any size spreads over tasks; only one row per range
    and group is summed along the group. Rows equal in all of ``order`` keep the order they were read in.
    """
    parts = max(1, -(-df.count() // rows_a_part))
    sort = [F.col(c).asc_nulls_first() for c in (group, *order, "__read")]
    dealt = df.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(parts, *sort).sortWithinPartitions(*sort).drop("__read")
    dealt = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    heads = dealt.groupBy(group, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__m"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(group, "__part", "__first", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"), F.sum("__m").over(whole).alias("n"))
    joined = join_nullsafe(dealt.withColumn("__part", part), heads, [group, "__part"], "inner")
    return joined.withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before")


def _slots(child: str = "") -> list[Column]:
    return [F.col(f"c{j}{child}") for j in range(FANOUT)]


def levels(nodes: DataFrame, group: str) -> list[DataFrame]:
    """The levels above ``nodes`` (group, pos, n, own: struct with ``digest``): each parent with its children in columns c0 to c7.

    A group ends at the level where one node is left, its root.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    found: list[DataFrame] = []
    while most > 1:
        spread = [F.max(F.when(F.col("pos") % FANOUT == j, F.col("own"))).alias(f"c{j}") for j in range(FANOUT)]
        parent = (F.floor(F.col("pos") / FANOUT).cast("long").alias("pos"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"))
        up = nodes.where("n > 1").groupBy(group, *parent).agg(*spread)
        up = stored(up.withColumn("own", F.struct(F.sha2(F.concat_ws("", *_slots(".digest")), 256).alias("digest"))), "merkle-level")
        found.append(up)
        nodes, most = up, -(-most // FANOUT)
    return found


def roots(nodes: DataFrame, above: list[DataFrame], group: str) -> DataFrame:
    """(group, digest) of each group's root."""
    return reduce(DataFrame.unionByName, [level.where("n = 1").select(group, F.col("own.digest").alias("digest")) for level in (nodes, *above)])


def children(parents: DataFrame, group: str, *carried: str) -> DataFrame:
    """The children of parents with a ``path``: place, own struct, and the path that begins with their siblings."""
    slots = _slots()
    rows = [F.struct((F.col("pos") * FANOUT + j).alias("pos"), slots[j].alias("own"), F.concat(F.array(F.struct(
        F.concat_ws("", *[s["digest"] for s in slots[:j]]).alias("left"),
        F.concat_ws("", *[s["digest"] for s in slots[j + 1:]]).alias("right"))), F.col("path")).alias("path")) for j in range(FANOUT)]
    return parents.select(group, *carried, F.inline(F.array(*rows))).where(F.col("own").isNotNull())


def proofs(nodes: DataFrame, above: list[DataFrame], group: str, tops: DataFrame, *carried: str) -> DataFrame:
    """Every node (group, pos, own, path, carried columns) with the siblings on its way up, nearest first.

    ``tops`` has (group, path, carried columns) of the groups' roots. Paths are handed down from the roots, so the
    upper part of a path is worked out once for all nodes that share it.
    """
    below: DataFrame | None = None
    for level in [*reversed(above), nodes]:
        here = join_nullsafe(level.where("n = 1").select(group, "pos"), tops, [group], "inner")
        if below is not None:
            here = here.unionByName(below.select(here.columns))
        if level is nodes:
            only = join_nullsafe(nodes.where("n = 1").select(group, "pos", "own"), tops, [group], "inner")
            return only if below is None else only.unionByName(below.select(only.columns))
        below = children(join_nullsafe(level, here, [group, "pos"], "inner"), group, *carried)
    raise AssertionError("nodes are always the last level")


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """The Merkle tree of all rows and the proof of each: one row per document.

    ``tampered`` marks rows (NULL: not) whose ``text`` is replaced before their digest is folded with the original
    siblings; by default none is. Returns doc_id, lang, leaf, subroot, root, proof (the siblings, level by level),
    folded_root and verified. Leaves of a language stand by doc_id, NULL first, then by digest; rows that are equal in
    every field are leaves of their own, in the order read. A NULL language is a group of its own, before all others.
    A group of one leaf has that leaf as its subroot; one language's subroot is the root. Empty texts have length 0.
    An empty table gives an empty result. Other columns are ignored.
    """
    fields = {f: F.col(f"`{f}`") for f in FIELDS}
    leaf = leaf_digest(list(fields.values()))
    other = leaf if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(list({**fields, "text": text}.values()))).otherwise(leaf)
    rows = stored(docs.select("doc_id", "lang", leaf.alias("leaf"), other.alias("other")), "merkle-digests")
    leaves = numbered(rows, "lang", ["doc_id", "leaf"])
    leaves = stored(leaves.select("lang", "pos", "n", F.struct(F.col("leaf").alias("digest"), "doc_id", "other").alias("own")), "merkle-leaves")
    above = levels(leaves, "lang")
    subroots = stored(roots(leaves, above, "lang"), "merkle-subroots")

    langs = numbered(subroots.withColumn("all", F.lit(0)), "all", ["lang"])
    langs = stored(langs.select("all", "pos", "n", F.struct("digest", "lang").alias("own")), "merkle-languages")
    over = levels(langs, "all")
    top = roots(langs, over, "all").select("all", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    tops = proofs(langs, over, "all", top, "root").select(F.col("own.lang").alias("lang"), "path", F.col("own.digest").alias("subroot"), "root")
    tops = stored(tops, "merkle-tops")

    found = proofs(leaves, above, "lang", tops, "subroot", "root")
    fold = F.aggregate("path", F.col("own.other"), lambda digest, level: F.sha2(F.concat(level["left"], digest, level["right"]), 256))
    siblings = F.array_join(F.transform("path", lambda level: F.concat(level["left"], level["right"])), "")
    found = found.select(F.col("own.doc_id").alias("doc_id"), "lang", F.col("own.digest").alias("leaf"), "subroot", "root",
                         siblings.alias("proof"), fold.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = manifest(docs, chosen, F.translate("text", UPPER, LOWER))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string, bit by bit."""
    bits = ("list_reduce(list_concat([{0}], range(8)), lambda c, b: xor(c >> 1, 3988292384 * (c & 1)))")
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({text}) + 1), "
            f"lambda i: ascii(substr({text}, i::BIGINT, 1))::BIGINT)), lambda crc, byte: {bits.format('xor(crc, byte)')}), 4294967295)")


def _tree_sql(name: str, key: str, depth: int) -> str:
    """Views of a tree: ``{name}0`` has (key, pos, n, digest); each further level, and what each level adds to proofs."""
    ctes = []
    for k in range(depth):
        ctes.append(f"""{name}{k + 1} AS (SELECT {key}, pos // {FANOUT} AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n,
  CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE min(digest) END AS digest FROM {name}{k} GROUP BY {key}, pos // {FANOUT}, n)""")
        ctes.append(f"""{name}_s{k} AS (SELECT a.{key}, a.pos, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
  coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name}{k} a JOIN {name}{k} b ON a.{key} IS NOT DISTINCT FROM b.{key} AND a.pos // {FANOUT} = b.pos // {FANOUT} GROUP BY a.{key}, a.pos, a.n)""")
    return ",\n".join(ctes)


def _climb_sql(rows: str, name: str, key: str, depth: int) -> str:
    """Fold ``f`` and the siblings ``proof`` of ``rows``0 up a tree, a level a step, by its (key, {name}_pos)."""
    return ",\n".join(f"""{rows}{k + 1} AS (SELECT d.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || d.f || s.r) ELSE d.f END AS f,
  CASE WHEN s.n > 1 THEN d.proof || s.l || s.r ELSE d.proof END AS proof)
  FROM {rows}{k} d JOIN {name}_s{k} s ON d.{key} IS NOT DISTINCT FROM s.{key} AND d.{name}_pos // {FANOUT ** k} = s.pos)""" for k in range(depth))


def op13_sql(depth: int = 7) -> str:
    """DuckDB SQL for the same rows, for trees of no more than ``FANOUT ** depth`` leaves."""
    def leaf(text: str) -> str:
        values = [f"{f}::VARCHAR" for f in FIELDS[:-1]] + [text]
        return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode({v}))::VARCHAR || ':' || {v} END" for v in values) + ")"

    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
WITH d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS f FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS t_pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t0 AS (SELECT lang, t_pos AS pos, n, leaf AS digest FROM p),
{_tree_sql('t', 'lang', depth)},
u0 AS (SELECT 0 AS k, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest FROM t{depth}),
{_tree_sql('u', 'k', depth)},
c0 AS (SELECT doc_id, lang, leaf, t_pos, f, '' AS proof FROM p),
{_climb_sql('c', 't', 'lang', depth)},
e0 AS (SELECT c.*, u0.k, u0.pos AS u_pos, u0.digest AS subroot FROM c{depth} c JOIN u0 ON c.lang IS NOT DISTINCT FROM u0.lang),
{_climb_sql('e', 'u', 'k', depth)}
SELECT doc_id, leaf, subroot, u.digest AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u.digest AS verified FROM e{depth} e, u{depth} u"""


OP13_SQL = op13_sql()
