"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected equally often, target / source size times. Documents of a source are
put in order (by size, then by a hash), the expected copies are prefix-summed, one random offset per source
is added, and a document is emitted once for each whole number that its step crosses. Ordering by size keeps
the words taken near the target: neighbours in the order have about equal sizes.

Defined cases: null and blank texts have size 0 and take part; a null source is a source of its own; a
source of size 0 has target 0. Repeated rows are sampled one by one. Copies of a document never exceed
max_repeats, rounded up to a whole number. Extra columns pass through mix(); an empty table gives an empty
table. Reruns agree, since order and offsets are hashes of the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakv.llm.common import words, written

MAX_REPEATS = 3
#: Hexadecimal digits of the hash that make a source's offset in [0, 1).
DIGITS = 12


def targets(sizes: DataFrame, cycle: int = 3, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target, step from (source, source_size): one row per source.

    Weights repeat 1..cycle over the sources in code-point order, null last. Stopping at max_repeats times
    the size and resharing the excess until nothing is above ends where one level L gives every source
    min(max_repeats * size, L * weight). With sources ordered by size / weight, the stopped ones come first,
    so L follows from running sums over the table of sources, which has one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.select("source", "source_size", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("long").alias("weight"))
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    all_of = Window.partitionBy()
    s = w.select(
        "*", F.sum("source_size").over(all_of).alias("total"), F.sum("weight").over(all_of).alias("weights"),
        F.coalesce(F.sum("source_size").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("weight_before"),
    )
    rest, left = F.col("total") - max_repeats * F.col("size_before"), F.col("weights") - F.col("weight_before")
    s = s.select("*", rest.alias("rest"), left.alias("left"), (max_repeats * F.col("source_size") * left < rest * F.col("weight")).alias("stops"))
    free = F.min_by(F.struct("rest", "left"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    lvl = s.where(~F.col("stops")).agg(free.alias("level"))
    target = F.when(F.col("stops"), (max_repeats * F.col("source_size")).cast("double")).otherwise(
        (F.col("level.rest") * F.col("weight")).cast("double") / F.col("level.left").cast("double")
    )
    out = s.crossJoin(F.broadcast(lvl)).select("source", "source_size", target.alias("target"))  # one row of level
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return out.select("source", "source_size", "target", step.alias("step"))


def offset(source: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(source, F.lit("\u0001null"))), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def sizes_of(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col(text))).cast("long").alias("size"))


def mix(sized: DataFrame, tie: tuple[str, ...] = (), cycle: int = 3, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (and the tie columns) from (doc_id, source, size).

    The prefix sum has two levels, so that no source is gathered in one task: rows are dealt out by range of
    (source, size, doc_id), each part counts its sources, the counts are summed over the parts, and rows are
    numbered inside their part.
    """
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["size", "doc_id", *tie]
    # Sizes are written first: dealing out by range reads them twice, once for a sample.
    dealt = (
        written(sized.select("doc_id", "source", "size", *tie), "sizes")
        .repartitionByRange(parts, F.col("source").asc_nulls_last(), *order)
        .withColumn("part", F.spark_partition_id())
    )
    dealt = written(dealt, "mix")
    counts = dealt.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, max_repeats)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    prefix = counts.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    t, p = goal.alias("t"), prefix.alias("p")
    steps = t.join(p, F.col("t.source").eqNullSafe(F.col("p.source"))).select("t.*", "p.part", "p.before", offset(F.col("t.source")).alias("u"))
    inside = Window.partitionBy("part", "source").orderBy(*order)
    d, s = dealt.select("*", F.row_number().over(inside).alias("k")).alias("d"), steps.alias("s")
    k = F.col("d.k") + F.col("s.before")
    crossed = F.floor(k * F.col("s.step") + F.col("s.u")) - F.floor((k - 1) * F.col("s.step") + F.col("s.u"))
    return d.join(s, (F.col("d.part") == F.col("s.part")) & F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d.source", "d.size", *[f"d.{c}" for c in tie], "s.source_size", "s.target", crossed.cast("long").alias("copies")
    )


def emit(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every row as many times as the mix takes it, columns unchanged.

    Rows are known by doc_id and a hash of their columns; equal rows share out their copies.
    """
    cols = [f"`{c}`" for c in docs.columns]
    size = F.size(words(F.col(text))).cast("long").alias("size")
    keyed = docs.select(F.struct(*cols).alias("_row"), F.coalesce("doc_id", F.lit(-1)).alias("_k"), F.xxhash64(*cols).alias("_h"), F.col("source").alias("source"), size)
    sized = keyed.select("_k", "_h", F.col("_k").alias("doc_id"), "source", "size")
    taken = mix(sized, ("_k", "_h"), **options).groupBy("_k", "_h").agg(F.sum("copies").alias("_c"), F.count("*").alias("_m"))
    both = keyed.select("_row", "_k", "_h").join(taken.where("_c > 0"), ["_k", "_h"])
    i = F.row_number().over(Window.partitionBy("_k", "_h").orderBy("_m")) - 1
    own = F.floor(F.col("_c") / F.col("_m")) + F.when(i < F.col("_c") % F.col("_m"), 1).otherwise(0)
    times = both.select("_row", own.cast("int").alias("_n")).where("_n > 0")
    return times.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_n"))).alias("_one")).select("_row.*")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::BIGINT AS weight FROM s
), o AS (
  SELECT *, (sum(source_size) OVER () - {MAX_REPEATS} * coalesce(sum(source_size) OVER b, 0))::BIGINT AS rest,
    (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS lft, row_number() OVER (ORDER BY source_size / weight, source IS NULL, encode(source)) AS i
  FROM w WINDOW b AS (ORDER BY source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), p AS (SELECT *, {MAX_REPEATS} * source_size * lft < rest * weight AS stops FROM o
), l AS (SELECT arg_min(rest, i) AS rest, arg_min(lft, i) AS lft FROM p WHERE NOT stops
), t AS (
  SELECT source, source_size, CASE WHEN stops THEN ({MAX_REPEATS} * source_size)::DOUBLE ELSE (l.rest * weight)::DOUBLE / l.lft::DOUBLE END AS target FROM p, l
), k AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS step,
    ('0x' || substr(md5(coalesce(d.source, chr(1) || 'null')), 1, {DIGITS}))::BIGINT::DOUBLE / {16**DIGITS}::DOUBLE AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(k * step + u) - floor((k - 1) * step + u)))::BIGINT AS taken FROM k
"""
