import math

import numpy as np

from stratakv.llm import ann
from tests.helpers import SMALL

KINDS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, top=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return {q: sorted((-float(np.dot(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:top] for q, a in good if q % every == 0}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    expect = brute([(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()])
    got = found(ann.search(table))
    assert got.keys() == expect.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in expect[q]}) for q in expect)
    assert hits >= 0.9 * sum(map(len, expect.values()))
    scores = {(q, i): s for q in expect for s, i in expect[q]}
    assert all(abs(scores[q, i] - s) < 1e-12 for q in got for s, i in got[q] if (q, i) in scores)
    assert all(x == sorted(x) for x in got.values())


def test_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    some = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    some[0] = (0, [10 * x for x in some[0][1]])
    odd = [(100, None), (120, [0.0] * 8), (140, [1.0, None] + [0.0] * 6), (160, [float("nan")] * 8), (180, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (200, []), (220, [1.0, 2.0, 3.0])]
    copies = [(300 + i, some[0][1]) for i in range(40)] + [some[0]]
    rows = [*some, *odd, *copies]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], KINDS).selectExpr("*", "1 AS score", "2 AS rank", "3 AS k1")
    expect, got = brute(dict.fromkeys([(i, None if v is None else tuple(v)) for i, v in rows])), found(ann.search(table))
    assert got.keys() == {q for q in expect if expect[q]}  # a query that nothing can meet has no row
    for q in got:
        assert [s for s, _ in got[q]] == sorted(s for s, _ in got[q])
        assert not {i for _, i in got[q]} & {100, 120, 140, 160, 180, q}
    assert [i for _, i in got[0]] == [300 + i for i in range(20)]  # equal vectors, ties to the smaller id


def test_few_candidates_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [-1.0, 0.2], 0)], KINDS)
    assert {i for _, i in found(ann.search(table))[0]} <= {1, 2}
    assert ann.search(table.limit(0)).collect() == []


def test_lengths_that_differ(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16) * (1 + i % 5)], 0) for i in range(400)]
    expect, got = brute([(i, v) for i, v, _ in rows]), found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    hits = sum(len({i for _, i in got[q]} & {i for _, i in expect[q]}) for q in expect)
    assert hits >= 0.9 * sum(map(len, expect.values()))


def test_query_over_the_small_table(spark):
    from stratakv.llm.queries import op2_nearest_neighbours

    assert op2_nearest_neighbours(spark, SMALL).columns == ["query_id", "rank", "vec_id", "score"]


def recall(spark, rows, **options):
    expect, got = brute([(i, v) for i, v, _ in rows]), found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **options))
    assert all(len(got[q]) == len(expect[q]) for q in expect)
    return sum(len({i for _, i in got[q]} & {i for _, i in expect[q]}) for q in expect) / sum(map(len, expect.values()))


def test_long_vectors_do_not_hide_the_others(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for size in (np.where(np.arange(1500) == 7, 100.0, 1.0), np.exp(rng.normal(size=1500))):
        rows = [(i, (v * s).tolist(), 0) for i, (v, s) in enumerate(zip(x, size, strict=True))]
        assert recall(spark, rows, small=64) >= 0.9


def test_queries_that_hashing_leaves_short(spark):
    x = np.random.default_rng(3).normal(size=(60, 32))
    assert recall(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]) == 1
    # Two rows in nearly all buckets of a query: only a search of all rows fills its places.
    assert recall(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], small=0, tables=1, probes=1) >= 0.9


def test_recall_with_a_second_rotation(spark):
    x = np.random.default_rng(4).normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    assert recall(spark, rows, bucket=1, small=0) >= 0.9  # 11 rows a bucket: 16 axes


def test_recall_with_more_rotations(spark):
    x = np.random.default_rng(6).normal(size=(1500, 8))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    assert recall(spark, rows, bucket=1, small=0) >= 0.9  # 16 axes first, then 128 more: three rotations


def test_a_pair_has_one_score(spark):
    """Vectors of equal inner products: ties go to the smaller id, whatever block they meet in."""
    rng = np.random.default_rng(7)
    base = [float(np.float32(v)) for v in rng.normal(size=48)]
    rows = [(0, [1.0] * 48, 0)] + [(i, [base[(k * 5 + i * 0) % 48] for k in range(48)], 0) for i in (5, 3)] + [(i, [float(v) for v in rng.normal(size=48) - 9], 0) for i in range(10, 60)]
    table = spark.createDataFrame([(i, v, n) for i, v, n in rows], KINDS)
    got = found(ann.search(table))[0]
    assert [i for _, i in got[:2]] == [3, 5] and got[0][0] == got[1][0] == -float(np.cumsum(np.float64(np.float32(rows[1][1])))[-1])
