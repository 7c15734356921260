"""Approximate nearest neighbours by inner product with cross-polytope hashing.

Vectors are hashed by direction within bands of length (a factor of sqrt(2) each): inside a band the largest
inner products are at nearly the smallest angles, and a long vector changes nothing for the others. In each
table three rounds of random signs and a fast Hadamard transform stand in for a random rotation, and the
nearest signed axis is the bucket; where a band's buckets would hold more than `bucket` rows, further
rotations are appended, the last one over fewer axes. Queries probe the buckets of their nearest few axes in every table, for
each number of axes that some band has, and more of them where there are more axes; a band of at most `small` vectors is one bucket that every query
probes. All rows of a probed bucket are candidates and are ranked by inner products in double precision: buckets
have no cap, large ones are dealt out in blocks. Those of a block that may be among the nearest are summed again,
component by component, so that a pair has one score wherever it meets and ties are ties. Vectors travel in the
precision that the table has. A query that meets fewer than `top` rows
is searched again among all.

Equal vectors are searched once: a group keeps its `top` + 1 smallest ids, which is all that a result with
`top` places can need, and equal queries share one search.

Recall against brute force, measured over the query set at top = 20: see README.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without vec_id. Only vectors with equally many components meet. Ties go to the smaller vec_id. Rows that
repeat vec_id and vector count once. Queries that fewer than `top` rows can meet return all of them. Extra
columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from stratakv.llm.common import discard, frees_shuffles, written

TABLES, PROBES, TOP = 20, 6, 20
#: Tables that are searched at once.
ROUND = 5
#: Rows that a bucket should hold; rows and queries of a bucket that one task ranks at once.
BUCKET, ROWS, QUERIES = 4096, 2048, 512
#: Probes grow as this power of the second hash's axes, which keeps recall (see README). Codes compared at once.
GROWTH, CODES = 0.85, 1 << 22
#: Vectors of a band of lengths that all queries meet.
SMALL = 512


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d, h = len(x), x.shape[1], 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    rng = np.random.default_rng([51, table, part])
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def _nearest(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest signed axes of each row, nearest first, and the coordinates along them."""
    both = np.concatenate([x, -x], axis=1)
    n = min(n, both.shape[1])
    at = np.argsort(-both, axis=1, kind="stable")[:, :n]
    return at, np.take_along_axis(both, at, 1)


def buckets(x: np.ndarray, table: int, axes: int, probes: int) -> np.ndarray:
    """The first `probes` buckets of each unit vector; axes: signed axes of all hashes after the first (1: none)."""
    most = 2 * x.shape[1]
    step = max(1, CODES // min(probes, most) // min(probes, most, axes))
    if len(x) > step:
        return np.concatenate([buckets(x[i : i + step], table, axes, probes) for i in range(0, len(x), step)])
    code, total = _nearest(_rotated(x, table, 0), probes)
    part = 0
    while axes > 1:
        own, part = min(axes, most), part + 1
        second, also = _nearest(_rotated(x, table, part)[:, : own // 2], probes)
        total = (total[:, :, None] + also[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * own + second[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        code, total, axes = np.take_along_axis(code, best, 1), np.take_along_axis(total, best, 1), axes // own
    return code


def _unit(vecs: np.ndarray) -> np.ndarray:
    x = vecs.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.pad(x, ((0, 0), (0, (1 << (x.shape[1] - 1).bit_length()) - x.shape[1])))


def _hashed(vectors: DataFrame, query: bool, probes: int, tables: range) -> DataFrame:
    """vectors once for each table and probe, with the bucket; axes: signed axes of a row's further hashes."""
    fields = vectors.drop("axes").select(F.lit(0).cast("long").alias("bucket"), "*").schema

    def run(batches):
        for batch in batches:
            size, second = np.asarray(pa.compute.list_value_length(batch.column("vec"))), np.asarray(batch.column("axes"))
            for dim, axes in np.unique(np.stack([size, second]), axis=1).T.tolist():
                some = batch.filter(pa.array((size == dim) & (second == axes))).select(fields.names[1:])
                x = _unit(np.asarray(some.column("vec").flatten()).reshape(-1, dim))
                near = math.ceil(probes * axes**GROWTH) if query else 1
                for t in tables:
                    code = buckets(x, t, axes, near)
                    for p in range(code.shape[1]):
                        key = ((code[:, p] * 1024 + t) * 64 + axes.bit_length()) * 100_003 + dim
                        yield pa.RecordBatch.from_arrays([pa.array(key), *some.columns], fields.names)

    return vectors.mapInArrow(run, fields)


def _bands(groups: DataFrame, bucket: int, small: int) -> DataFrame:
    """dim, band and axes of each band of lengths; axes: signed axes of all further hashes (1: none, 0: no hash either)."""
    n = groups.groupBy("dim", "band").agg(F.count("*").alias("n"))
    first = F.pow(F.lit(2.0), F.lit(1) + F.ceil(F.log2("dim"))).cast("long")
    fill = F.floor(F.floor(F.col("n") / first) / bucket)
    axes = F.when(fill > 0, F.pow(F.lit(2.0), F.length(F.bin(fill)))).otherwise(1).cast("long")
    return n.select("dim", "band", F.when(F.col("n") > small, axes).otherwise(0).alias("axes"))


def _valid(table: DataFrame) -> DataFrame:
    kind = table.schema["embedding"].dataType
    own = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    vec = F.col("embedding").cast(f"array<{own}>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    plain = F.transform("vec", lambda x: x + F.lit(0.0).cast(own))  # -0.0 is 0.0
    return rows.select("vec_id", plain.alias("vec")).select("*", F.xxhash64("vec").alias("k1"), F.xxhash64(F.reverse("vec"), F.lit(1)).alias("k2"))


def _ranked(data: DataFrame, probe: DataFrame, top: int) -> DataFrame:
    """q1, q2, k1, k2, score, low: of each block of a bucket, the `top` + 1 largest inner products of each query."""
    count = lambda df, per, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / per).cast("int").alias(name))
    data, probe = written(data, "data"), written(probe, "probes")  # hashed once, counted and met
    blocks = written(count(data, ROWS, "dn").join(count(probe, QUERIES, "qn"), "bucket"), "buckets")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = data.join(blocks, "bucket").select("bucket", F.pmod("k1", "dn").cast("int").alias("d"), spread("qn").alias("q"), "k1", "k2", "vec", "low")
    right = probe.join(blocks, "bucket").select("bucket", spread("dn").alias("d"), F.pmod("q1", "qn").cast("int").alias("q"), "q1", "q2", "vec")

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            x, y = (np.asarray(t.column("vec").combine_chunks().flatten(), float).reshape(t.num_rows, -1) for t in (a, b))
            low = np.asarray(a.column("low").combine_chunks())
            near = y @ x.T
            # Products of matrices sum in an order of their own: what is within its error of the last place is summed again.
            least = np.partition(near, max(0, len(x) - top - 1), axis=1)[:, max(0, len(x) - top - 1)]
            slack = 1e-12 * np.linalg.norm(y, axis=1) * np.linalg.norm(x, axis=1).max()
            i, j = np.nonzero(near >= (least - slack)[:, None])
            score = np.cumsum(y[i] * x[j], axis=1)[:, -1]
            o = np.lexsort((low[j], -score, i))
            o = o[np.arange(len(o)) - np.searchsorted(i[o], i[o]) <= top]
            i, j, score = i[o], j[o], score[o]
            return pa.table({"q1": b.column("q1").take(i), "q2": b.column("q2").take(i), "k1": a.column("k1").take(j), "k2": a.column("k2").take(j), "low": low[j], "score": score})
        return pa.table({k: pa.array([], pa.int64()) for k in ("q1", "q2", "k1", "k2", "low")} | {"score": pa.array([], pa.float64())})

    by = ("bucket", "d", "q")
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rank, "q1 long, q2 long, k1 long, k2 long, low long, score double")
    near = written(near.groupBy("q1", "q2", "k1", "k2").agg(F.max("score").alias("score"), F.min("low").alias("low")), "near")
    discard(data, probe, blocks)
    return near


@frees_shuffles
def search(table: DataFrame, every: int = 20, top: int = TOP, tables: int = TABLES, probes: int = PROBES, bucket: int = BUCKET, small: int = SMALL) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by `every`."""
    rows = _valid(table)
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = rows.dropDuplicates(["k1", "k2", "vec_id"]).select("*", nth.alias("nth")).where(F.col("nth") <= top + 1)
    groups = few.groupBy("k1", "k2").agg(F.any_value("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    size2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    band = F.coalesce(F.greatest(F.lit(-4000), F.least(F.lit(4000), F.floor(F.log2(size2) + 0.5))), F.lit(-4000)).cast("int")
    groups = written(groups.select("*", F.size("vec").alias("dim"), band.alias("band")), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), "vec").dropDuplicates(["query_id", "q1", "q2"])
    wanted = asked.groupBy("q1", "q2").agg(F.any_value("vec").alias("vec")).select("*", F.size("vec").alias("dim"))
    bands = written(_bands(groups, bucket, small), "bands")
    hashed = bands.where("axes > 0").select("dim", "axes").distinct()
    dealt = groups.join(bands, ["dim", "band"]).select("k1", "k2", "vec", F.col("ids")[0].alias("low"), "dim", "band", "axes")
    whole = (-1 - F.col("dim") * F.lit(8192).cast("long") - (F.col("band") + 4000)).alias("bucket")
    parts = [_ranked(dealt.where("axes = 0").select(whole, "k1", "k2", "vec", "low"), wanted.join(bands.where("axes = 0"), "dim").select(whole, "q1", "q2", "vec"), top)]
    # A few tables at a time: each brings all vectors to its buckets once.
    for t in range(0, tables, ROUND):
        some = range(t, min(tables, t + ROUND))
        data = _hashed(dealt.where("axes > 0").drop("dim", "band"), False, 1, some)
        parts.append(_ranked(data, _hashed(wanted.join(hashed, "dim").select("q1", "q2", "vec", "axes"), True, probes, some), top))
    near = reduce(DataFrame.unionByName, parts)
    near = written(near.groupBy("q1", "q2", "k1", "k2").agg(F.max("score").alias("score"), F.min("low").alias("low")), "near")
    discard(*parts)
    # Places met by each query, its own among them; where these are too few and rows were hashed, all are ranked.
    met = near.join(groups.select("k1", "k2", F.size("ids").alias("ids")), ["k1", "k2"]).groupBy("q1", "q2").agg(F.sum("ids").alias("met"))
    short = wanted.join(hashed.select("dim").distinct(), "dim").join(met, ["q1", "q2"], "left").where(F.coalesce("met", F.lit(0)) <= top)
    short = written(short.select(F.col("dim").cast("long").alias("bucket"), "q1", "q2", "vec"), "short")
    rest = groups.select(F.col("dim").cast("long").alias("bucket"), "k1", "k2", "vec", F.col("ids")[0].alias("low"))
    near = near.unionByName(_ranked(rest, short, top)).groupBy("q1", "q2", "k1", "k2").agg(F.max("score").alias("score"), F.min("low").alias("low"))
    of = Window.partitionBy("q1", "q2")
    near = near.select("*", F.row_number().over(of.orderBy(F.desc("score"), "low")).alias("n")).where(F.col("n") <= top + 1)
    ids = near.join(groups.select("k1", "k2", "ids"), ["k1", "k2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
    ids = ids.select("*", F.row_number().over(of.orderBy(F.desc("score"), "vec_id")).alias("n")).where(F.col("n") <= top + 1)
    out = asked.select("query_id", "q1", "q2").join(ids, ["q1", "q2"]).where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id")).cast("int")
    return out.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= top)
