from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stratakv.llm import mixing
from tests.helpers import SMALL, rows


def goals(sizes, weights, most=3):
    """Targets by resharing the excess step by step."""
    total, goal, stopped = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        w = sum(weights[s] for s in sizes if s not in stopped)
        goal = {s: most * sizes[s] if s in stopped else rest * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in stopped and goal[s] > most * sizes[s]}
        if not over:
            return goal
        stopped |= over


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 40, "é": 300, None: 7, "": 0}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    expect = goals(sizes, weights)
    for r in found.collect():
        assert abs(r["target"] - expect[r["source"]]) < 1e-6


def test_words_taken_come_near_the_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mix(mixing.sizes_of(docs)).collect()
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in found:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]], most[r["source"]] = r["target"], max(most[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.1 * target[s] + most[s]
    assert sorted(found) == sorted(mixing.mix(mixing.sizes_of(docs)).collect())


def test_emit_repeats_rows_as_the_mix_says(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.union(docs.limit(3)).union(docs.limit(1).select(F.lit(None).cast("long"), "text", "lang", "source", "n_chars"))
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    mixed = Counter()
    for r in mixing.mix(mixing.sizes_of(docs)).collect():
        mixed[r["source"]] += r["size"] * r["copies"]
    words = out.groupBy("source").agg(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))))
    size = {s: n for s, n in rows(words)}
    assert {s: n for s, n in mixed.items() if n} == {s: n for s, n in size.items() if n}
    assert set(map(tuple, out.distinct().collect())) <= set(map(tuple, docs.collect()))
