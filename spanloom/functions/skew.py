"""Ordered and rank operations that survive one key holding most of the rows.

A plain ``Window.partitionBy(key)`` puts all rows of a key in one task. Here an
ordered key is cut into time chunks: rows are ordered inside ``(key, chunk)``,
and only one summary row per chunk is ordered inside ``key``. Both steps give the
same answer as the plain window, and the largest task holds one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 600
_CHUNK = "__chunk"


def time_chunk(ts: Column | str, seconds: int = CHUNK_SECONDS) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL, keeping one copy of each key (the left one)."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    test = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, test, how).drop(*[f"__r_{k}" for k in keys])


def _chunk_orders(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None):
    """Rows with their key and chunk as one struct, which is never NULL, and the windows inside a chunk and across them.

    A join on that struct finds the rows as the window inside a chunk left them: partitioned and sorted by it.
    """
    parts = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    df = df.withColumn(_CHUNK, F.struct(*parts, (time_chunk(order[0]) if chunk is None else chunk).alias("at")))
    inside = Window.partitionBy(_CHUNK).orderBy(*order)
    across = Window.partitionBy(*[f"{_CHUNK}.k{i}" for i in range(len(keys))]).orderBy(f"{_CHUNK}.at")
    return df, inside, across


def _with_chunks(local: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows with what is known of their chunk, if anything."""
    found = chunks.withColumnRenamed(_CHUNK, "__of")
    return local.join(found, local[_CHUNK] == found["__of"], "left").drop("__of")


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Column, into: str,
               include_current: bool = True, chunk: Column | None = None) -> DataFrame:
    """Last non-NULL ``payload`` at or before (or strictly before) each row of its key."""
    df, inside, across = _chunk_orders(df, keys, order, chunk)
    df = df.withColumn("__p", F.when(payload.isNotNull(), F.struct(payload.alias("v"))))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = df.withColumn("__local", F.last("__p", ignorenulls=True).over(upto))
    # One summary row per chunk, also for chunks that carry nothing themselves.
    chunks = df.groupBy(_CHUNK).agg(F.max_by("__p", F.when(F.col("__p").isNotNull(), F.struct(*order))).alias("__p"))
    carried = chunks.select(_CHUNK, F.last("__p", ignorenulls=True).over(
        across.rowsBetween(Window.unboundedPreceding, -1)).alias("__before")).where(F.col("__before").isNotNull())
    joined = _with_chunks(local, carried)
    return (joined.withColumn(into, F.coalesce("__local", "__before")["v"])
            .drop("__p", "__local", "__before", _CHUNK))


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Column, into: str,
                 chunk: Column | None = None) -> DataFrame:
    """``payload`` of the row before, NULL on the first row (payload itself may be NULL)."""
    out = carry_last(df, keys, order, F.struct(payload.alias("p")), into, include_current=False, chunk=chunk)
    return out.withColumn(into, F.col(into)["p"])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, into: str,
                  chunk: Column | None = None) -> DataFrame:
    """Sum of ``amount`` over the rows of the key up to and including this one."""
    df, inside, across = _chunk_orders(df, keys, order, chunk)
    df = df.withColumn("__a", amount)
    local = df.withColumn("__local", F.sum("__a").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    totals = df.groupBy(_CHUNK).agg(F.sum("__a").alias("__t"))
    carried = totals.select(_CHUNK, F.sum("__t").over(
        across.rowsBetween(Window.unboundedPreceding, -1)).alias("__before")).where(F.col("__before").isNotNull())
    joined = _with_chunks(local, carried)
    both = F.when(F.col("__local").isNull(), F.col("__before")).otherwise(
        F.col("__local") + F.coalesce(F.col("__before"), F.lit(0)))
    return joined.withColumn(into, both).drop("__a", "__local", "__before", _CHUNK)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str,
                chunk: Column | None = None) -> DataFrame:
    """1-based position of each row within its key."""
    return running_total(df, keys, order, F.lit(1).cast("long"), into, chunk=chunk)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: Sequence[str], into: str,
         chunk: Column | None = None) -> DataFrame:
    """Number consecutive rows of equal ``label`` within a key; one number per run."""
    df, inside, across = _chunk_orders(df, keys, order, chunk)
    here, at = F.struct(*label), F.struct(*order)
    marked = df.withColumn("__prev", F.lag(here).over(inside)).withColumn(
        "__s", F.when(F.col("__prev").isNull() | F.col("__prev").eqNullSafe(here), 0).otherwise(1).cast("long"))
    local = marked.withColumn("__local", F.sum("__s").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    summary = marked.groupBy(_CHUNK).agg(
        F.sum("__s").alias("__t"), F.min_by(here, at).alias("__f"), F.max_by(here, at).alias("__l"))
    # A chunk opens a run of its own unless it begins as the chunk before it ended.
    opened = summary.withColumn("__o", F.when(F.lag("__l").over(across).eqNullSafe(F.col("__f")), 0).otherwise(1).cast("long"))
    based = opened.select(_CHUNK, (F.sum(F.col("__t") + F.col("__o")).over(
        across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")).alias("__base"))
    joined = _with_chunks(local, based)
    return joined.withColumn(into, F.col("__base") + F.col("__local")).drop("__prev", "__s", "__local", "__base", _CHUNK)


#: Value buckets to a doubling of the value; parts a bucket is cut into, so many times over.
OCTAVE, PARTS, REFINEMENTS = 128, 4096, 2
_LEAST_OCTAVE = 1 << 20  # no double is as small as 2 ** -(_LEAST_OCTAVE / OCTAVE)


def _value_bucket(value: Column) -> Column:
    """A bucket that never decreases as the value grows; each spans about 0.5 % of the value, however small it is."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(2048.0)) * OCTAVE).cast("long") + F.lit(_LEAST_OCTAVE)
    return F.when(F.isnan(value), F.lit(2**62)).when(value == 0, F.lit(0)).when(value < 0, -size).otherwise(size)


def _part(value: Column, low: Column, high: Column) -> Column:
    """The part of [low, high] that a value lies in, of equal width each."""
    share = (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(F.when(F.isnan(share) | (share < 0), F.lit(0.0)).otherwise(F.least(F.floor(share * PARTS), F.lit(PARTS - 1))), F.lit(0.0)).cast("int")


def value_counts(df: DataFrame, keys: Sequence[str], value: Column, **sums: Column) -> DataFrame:
    """Rows per key and value, (``__k0`` ..., ``__v``, ``__n``), with further sums of the same rows; written once.

    Aggregates that can be put together from it and percentiles (``percentiles_from``) then need one scan for both.
    """
    names = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("__k0")]
    return cut_lineage(df.groupBy(*names, value.cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(name) for name, c in sums.items()]))


def rank_buckets(counts: DataFrame, names: Sequence[str], wanted: Mapping[str, float], kind: str = "cont") -> tuple[DataFrame, dict]:
    """The small value buckets that hold the wanted ranks, and each rank as a column of ``__total``.

    A bucket has ``__start`` (values before it), ``__lo`` and ``__hi`` (its least and greatest value) and ``__size``
    (distinct values). Buckets of the logarithm come first; those with a wanted rank are cut again into equal parts of
    their own observed bounds, twice. Doubles have 52 bits, so no bucket left can hold more than some three million
    values, however they lie, and hardly ever more than some dozens.
    """
    ranks = {}
    for name, p in wanted.items():  # 0-based
        if kind == "cont":
            position = F.lit(float(p)) * (F.col("__total") - 1)
            ranks[name] = (F.floor(position).cast("long"), F.ceil(position).cast("long"), position)
        else:
            nearest = F.greatest(F.ceil(F.lit(float(p)) * F.col("__total")).cast("long"), F.lit(1)) - 1
            ranks[name] = (nearest, nearest, nearest.cast("double"))
    every = {str(rank): rank for low, high, _ in ranks.values() for rank in (low, high)}.values()
    holds = reduce(lambda a, b: a | b, [(rank >= F.col("__start")) & (rank < F.col("__start") + F.col("__m")) for rank in every])
    facts = [F.sum("__n").alias("__m"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__size")]
    before = Window.unboundedPreceding, -1
    by_key = Window.partitionBy(*names)
    found = counts.groupBy(*names, "__b").agg(*facts).withColumns({
        "__start": F.coalesce(F.sum("__m").over(by_key.orderBy("__b").rowsBetween(*before)), F.lit(0)), "__total": F.sum("__m").over(by_key)}).where(holds)
    for _ in range(REFINEMENTS):
        inside = within(counts, found, names).withColumn("__part", _part(F.col("__v"), F.col("__lo"), F.col("__hi")))
        along = Window.partitionBy(*names, "__b", "__first").orderBy("__part").rowsBetween(*before)
        found = (inside.groupBy(*names, "__b", F.col("__start").alias("__first"), "__total", "__part").agg(*facts)
                 .withColumn("__start", F.col("__first") + F.coalesce(F.sum("__m").over(along), F.lit(0))).where(holds).drop("__first", "__part"))
    return found, ranks


def within(counts: DataFrame, buckets: DataFrame, names: Sequence[str]) -> DataFrame:
    """The counted values of some buckets, with what is known of the bucket."""
    joined = join_nullsafe(counts, buckets.drop("__m", "__size"), [*names, "__b"], "inner")
    return joined.where(F.col("__v").between(F.col("__lo"), F.col("__hi")))


def percentiles_from(counts: DataFrame, keys: Sequence[str], wanted: Mapping[str, float], kind: str = "cont") -> DataFrame:
    """Exact percentiles per key from ``value_counts``; see ``exact_percentiles``."""
    names = [f"__k{i}" for i in range(len(keys))] or ["__k0"]
    counts = counts.where(F.col("__v").isNotNull()).select(*names, "__v", "__n", _value_bucket(F.col("__v")).alias("__b"))
    buckets, ranks = rank_buckets(counts, names, wanted, kind)
    inside = Window.partitionBy(*names, "__start").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = within(counts, buckets, names).withColumn("__cum", F.col("__start") + F.sum("__n").over(inside))
    aggs = []
    for i, (low, high, _) in enumerate(ranks.values()):
        aggs.append(F.min(F.when(F.col("__cum") > low, F.col("__v"))).alias(f"__lo{i}"))
        aggs.append(F.min(F.when(F.col("__cum") > high, F.col("__v"))).alias(f"__hi{i}"))
    found = placed.groupBy(*names, "__total").agg(*aggs)
    out = [F.col(n).alias(k) for n, k in zip(names, keys)]
    for i, (name, (low, _, position)) in enumerate(ranks.items()):
        low_value, high_value = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        between = low_value + (high_value - low_value) * (position - low)
        out.append(F.when(low_value == high_value, low_value).otherwise(between).alias(name))
    return found.select(*out)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, wanted: Mapping[str, float],
                      kind: str = "cont") -> DataFrame:
    """Exact percentiles per key without holding a key's values in one task.

    ``cont`` interpolates between neighbours; ``disc`` is the nearest rank. Equal values are counted first, then
    value buckets are narrowed around each wanted rank, and only what is left is ordered. NULL values do not count.
    """
    names = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("__k0")]
    counts = df.select(*names, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    counts = counts.groupBy(*[F.col(f"__k{i}") for i in range(len(names))], "__v").agg(F.count(F.lit(1)).alias("__n"))
    return percentiles_from(counts, keys, wanted, kind)


def percentiles_of(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]],
                   kind: str = "cont") -> DataFrame:
    """Percentiles of several columns in one pass: ``name -> (column, p)``, one row per key."""
    columns = {str(c): c for c, _ in wanted.values()}
    place = {text: i for i, text in enumerate(columns)}
    shares = {p: f"__p{j}" for j, p in enumerate(sorted({p for _, p in wanted.values()}))}
    entries = F.array(*[F.struct(F.lit(i).alias("__m"), columns[t].cast("double").alias("__x")) for t, i in place.items()])
    found = exact_percentiles(df.select(*keys, F.inline(entries)), [*keys, "__m"], F.col("__x"), {n: p for p, n in shares.items()}, kind)
    return found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__m") == place[str(c)], F.col(shares[p]))).alias(name) for name, (c, p) in wanted.items()])


def first_rows(ordered: DataFrame, limit: int | None) -> DataFrame:
    """The head of a list for a screen; all of it without a limit."""
    return ordered if limit is None else ordered.limit(limit)


def top_value(df: DataFrame, keys: Sequence[str], value: str, into: str) -> DataFrame:
    """Most frequent value per key; the smallest value wins a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(into))


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data.

    Where it names none, a local session makes one of its own, and a cluster uses the warehouse, which must not be a
    machine-local path then.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir: executors do not share the local folder " + warehouse)
        return f"{warehouse.rstrip('/')}/intermediate"
    application = spark.sparkContext.applicationId
    if application not in _OWN_FOLDERS:
        _OWN_FOLDERS[application] = tempfile.mkdtemp(prefix="spanloom-")
    return _OWN_FOLDERS[application]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iterate to the shared folder and read it back, so a lost executor loses nothing.

    Columns are compressed, files are read in as few tasks as their size asks for, and joins know how large they are.
    """
    return written(df, f"{shared_folder(df.sparkSession)}/cut-{df.sparkSession.sparkContext.applicationId}-{uuid4().hex}")


def written(df: DataFrame, path: str) -> DataFrame:
    """Write to a folder of its own, which ``discard`` deletes again, and read back."""
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._own_folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more; other frames are left alone."""
    for frame in frames:
        if path := getattr(frame, "_own_folder", None):
            where = frame.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def one_of_each(df: DataFrame, column: str = "id") -> DataFrame:
    """Rows with one of those that share an id. Ids are counted first, so whole rows are dealt and sorted only for ids that occur again."""
    counted = df.groupBy(F.col(column).alias("__again")).agg(F.count(F.lit(1)).alias("__n"))
    again = cut_lineage(counted.where("__n > 1").select("__again"))
    if again.isEmpty():
        discard(again)
        return df
    same = df[column].eqNullSafe(again["__again"])
    return df.join(again, same, "left_anti").unionByName(df.join(again, same, "left_semi").dropDuplicates([column]))


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as each write ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP, "false")
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP, before)
