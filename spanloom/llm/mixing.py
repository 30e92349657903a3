"""Mix sources to target weights by systematic sampling. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import read_table, without

WEIGHTS, SHARE, CEILING = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents of one source and size are numbered inside so many parts, so that no such group meets in one task.
PARTS = 4096
RESULT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_offset(source: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on the source and the seed alone, so reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Targets of sources, from rows (source, source_size); one row per source is all that is sorted here.

    Weights go to sources in code point order, NULL last, and repeat. Targets share ``share`` of all sizes by
    weight. Where a target would pass ``ceiling`` times its source, the rest is shared anew; that ends at the
    level at which sources in order of size per weight stop being full.
    """
    every = Window.partitionBy(F.lit(0))
    ordered = sizes.withColumn("__rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ordered = ordered.withColumn("__weight", F.element_at(cycle, ((F.col("__rank") - 1) % len(weights) + 1).cast("int")))
    ordered = ordered.withColumn("__cap", F.lit(float(ceiling)) * F.col("source_size"))
    fill = every.orderBy(F.col("__cap") / F.col("__weight"), "__rank")
    before = F.coalesce(F.sum("__cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    levels = ordered.withColumn("__level", (F.lit(float(share)) * F.sum("source_size").over(every) - before) / rest)
    levels = levels.withColumn("__full", F.col("__cap") <= F.col("__level") * F.col("__weight"))
    level = F.min(F.when(~F.col("__full"), F.struct(F.col("__cap") / F.col("__weight"), "__rank", "__level"))).over(every)["__level"]
    return levels.select("source", "source_size", F.when(F.col("__full"), F.col("__cap")).otherwise(level * F.col("__weight")).alias("target"))


def systematic_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING,
                   seed: str = "mix") -> DataFrame:
    """How often each document enters the mix.

    Every document of a source expects ``target / source_size`` copies. Expected copies are summed along the
    source, longest documents first, one random offset is added, and a document is taken once per integer its
    interval crosses. Since sizes fall along the line, the words taken miss the target by one document at most.

    The running sum comes from counts per size, then per part of a size, and a row number inside the part: a hot
    source, or many documents of one size, is spread over tasks.

    Adds size, source_size, target, copies and taken to the columns of ``docs``; input columns of these names are
    dropped. NULL text has size 0, NULL source is a source of its own, and rows of equal id and size are
    interchangeable. A source without words has target 0. An empty table gives an empty one.
    """
    docs = without(docs, *RESULT)
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    part = F.coalesce(F.pmod(F.col("doc_id"), F.lit(PARTS)), F.lit(-1)).cast("long")
    sized = docs.withColumns({"size": word_count(F.col("text")), "__key": key, "__part": part})
    counts = sized.groupBy("__key", "size", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("source").alias("source"))
    by_size = counts.groupBy("__key", "size").agg(F.sum("__n").alias("__n"), F.min("source").alias("source"))
    totals = by_size.groupBy("__key").agg(F.min("source").alias("source"), F.sum(F.col("size") * F.col("__n")).alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, ceiling)
    targets = targets.select(key.alias("__key"), "source_size", "target", random_offset(F.col("source"), seed).alias("__offset"))
    longer = Window.partitionBy("__key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("__key", "size", F.coalesce(F.sum("__n").over(longer), F.lit(0)).alias("__longer"))
    earlier = Window.partitionBy("__key", "size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__key", "size", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__earlier"))
    inside = F.row_number().over(Window.partitionBy("__key", "size", "__part").orderBy("doc_id"))
    placed = (sized.withColumn("__inside", inside).join(counts, ["__key", "size", "__part"])
              .join(by_size, ["__key", "size"]).join(targets, "__key"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("__longer") + F.col("__earlier") + F.col("__inside")
    crossed = F.floor(F.col("__offset") + rate * place) - F.floor(F.col("__offset") + rate * (place - 1))
    placed = placed.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], *RESULT)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    chosen = systematic_mix(docs, **options).where("copies > 0")
    repeated = chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return systematic_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE weight *
      (SELECT arg_min(level, cap / weight) FROM levels WHERE cap > level * weight) END AS target,
    ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY size DESC, coalesce(((doc_id % 4096) + 4096) % 4096, -1), doc_id) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, (floor(shift + rate * place) - floor(shift + rate * (place - 1)))::BIGINT AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""
