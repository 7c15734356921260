"""Near-duplicates, substring dedup and suffix-array dedup against brute force."""

import hashlib

import numpy as np

from stratakv.llm import minhash, substring, suffix, sufsort
from stratakv.llm.anchors import spans
from stratakv.llm.common import written
from stratakv.llm.components import components, joined
from stratakv.llm.text import Family
from tests.helpers import SMALL, rows
from tests.llm import helpers as H

DOCS = "doc_id long, text string"


def edited(text, every):
    return " ".join(f"x{i}" if i % every == every - 1 else w for i, w in enumerate(text.split()))


def corpus():
    out = {}
    for i in range(40):
        out[i] = H.sentence(i, 60 + 10 * (i % 7))
    for i in range(40, 60):  # near copies of different closeness, in chains
        out[i] = edited(out[i - 20 if i > 45 else i - 40], 15 + i)
    out |= {60: out[3], 61: out[3].upper(), 62: "", 63: None, 64: "a", 65: "A", 66: "a b", 67: " a\tb\n"}
    shared = H.sentence(999, 45)
    out |= {70 + i: f"{H.sentence(100 + i, 30)} {shared} {H.sentence(200 + i, 30)}" for i in range(8)}
    out |= {80: " ".join(["again"] * 100), 81: f"{shared} {shared}", 82: H.sentence(100, 25) + " " + H.sentence(100, 25)}
    return out


def test_near_duplicates(spark):
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), DOCS)
    for n in (2, 5):
        expect = H.near_classes(docs, n)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.classes(df, n=n).collect()} == expect


def test_near_duplicates_of_the_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.classes(df, n=5).collect()} == H.near_classes(docs, 5)


def test_a_large_group_of_near_copies(spark):
    base = H.sentence(1, 150)
    docs = {i: edited(base, 60 + i % 80) for i in range(150)} | {200 + i: base for i in range(50)}
    found = minhash.classes(spark.createDataFrame(list(docs.items()), DOCS), n=5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == H.near_classes(docs, 5)


def test_rows_without_or_with_repeated_ids(spark):
    a, b = H.sentence(1, 50), H.sentence(2, 50)
    df = spark.createDataFrame([(None, a), (3, a), (5, b), (5, a), (None, H.sentence(4, 50))], DOCS)
    found = rows(minhash.classes(df, n=5), "doc_id", "component_id")
    # The row without id that equals another set joins its class; document 5 is linked by one of its texts.
    assert sorted(found, key=str) == sorted([(None, 3), (3, 3), (5, 3), (5, 5), (None, None)], key=str)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (9, 300), (300, 9)]
    found = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(200, 260)} == {7} and found[300] == 9
    stars = spark.createDataFrame(list(found.items()), "id long, component long")
    more = spark.createDataFrame([(160, 259), (400, 401), (300, 5)], "a long, b long")
    after = dict(rows(joined(stars, more)))
    assert {after[i] for i in [*range(100, 161), *range(200, 260), 7]} == {7} and after[401] == after[400] == 400
    assert after[300] == after[9] == after[5] == 5 and len(after) == len(found) + 3


def test_substring_dedup(spark):
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), DOCS).withColumn("n_words", __import__("pyspark").sql.functions.lit("x"))
    left = H.repeated_words(docs)
    got = {r["doc_id"]: r for r in substring.dedup(df).collect()}
    for i, text in docs.items():
        n = len(H.words(text))
        assert (got[i]["n_words"], got[i]["n_removed"]) == (n, n - len(left[i]))
        assert got[i]["text"] == (text if n == len(left[i]) else " ".join(left[i]))
    digest = {r["doc_id"]: r["kept_sha256"] for r in substring.dedup(df, digest=True).collect()}
    assert digest == {i: hashlib.sha256(" ".join(w).encode()).hexdigest() for i, w in left.items()}


def test_suffix_dedup(spark):
    docs = list(corpus().items()) + [(90, "é" * 300), (91, "ab" * 400), (92, H.sentence(7, 300)), (93, "z" + H.sentence(7, 300)[5:900] + "y")]
    found = suffix.dedup(spark.createDataFrame(docs, DOCS)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(rows(found)) == sorted(H.repeated_bytes(docs))


def test_suffix_dedup_of_shifted_copies(spark):
    core = H.sentence(50, 60, 4000)
    docs = [(i, H.sentence(300 + i, 20, 4000) + core[i : len(core) - 3 * i] + H.sentence(400 + i, 20, 4000)) for i in range(30)]
    docs += [(100 + i, core[40 : 240 + i]) for i in range(12)]
    found = suffix.dedup(spark.createDataFrame(docs, DOCS)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(rows(found)) == sorted(H.repeated_bytes(docs))


def test_suffix_dedup_over_many_chunks_and_parts(spark, monkeypatch):
    """The small table, cut into chunks and parts of a few kilobytes, against brute force; and nothing goes without the sort."""
    monkeypatch.setattr(sufsort, "CHUNK", 5000)
    monkeypatch.setattr(sufsort, "PART", 4000)
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(rows(suffix.dedup(df), *cols)) == sorted(H.repeated_bytes(rows(df)))
    sort = sufsort.repeats
    monkeypatch.setattr(sufsort, "repeats", lambda chunks, length: written(sort(chunks, length).limit(0), "none"))
    assert {r["n_removed"] for r in suffix.dedup(df).select("n_removed").collect()} == {0}


def test_suffix_dedup_of_little_text_over_many_parts(spark):
    """More parts than there are suffixes to tell them apart by."""
    docs = [(i, "ab" * 200) for i in range(5)] + [(9, "x" * 300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = suffix.dedup(spark.createDataFrame(docs, DOCS)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(rows(found)) == sorted(H.repeated_bytes(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_order_of_suffixes():
    """The merged order of a chunk is that of its suffixes, also where they repeat and where they overlap."""
    text = (H.sentence(1, 300, 9) + "ab" * 300 + H.sentence(1, 200, 9) + "a" * 500).encode()
    c = sufsort.Chunk(text).deepen()
    names = {k: np.arange(c.codes[k].max() + 1) for k in (3, 4, 5)}
    p = sufsort.sample(4, c.ends[5] - 243)
    p = p[p < c.n]
    at = p[sufsort.order(c.rows(names, names[5][c.codes[5]], 4, p))]
    heads = [c.raw[i : i + 243] for i in at.tolist()]
    assert heads == sorted(heads)
    assert all((p // 3**k % 3 > 0).all() for k in range(4))


def test_ranks_and_keys_of_rows():
    """Ranks through sorted numbers with their places, and through sorted places where these do not fit beside."""
    rng = np.random.default_rng(3)
    for top in (5, 2**20, 2**62):
        x = rng.integers(0, top, 1000)[rng.integers(0, 1000, 3000)]
        assert (sufsort.dense(x) == np.unique(x, return_inverse=True)[1]).all()
        assert (sufsort.sorting(x)[0] == np.argsort(x, kind="stable")).all()
        table = np.stack([x, rng.integers(0, 3, 3000), x[::-1]], axis=1)
        assert (sufsort.dense(sufsort.one_key(list(table.T))) == np.unique(table, axis=0, return_inverse=True)[1].ravel()).all()
    assert len(sufsort.dense(x[:0])) == 0


def test_spans_hold_each_window_once_and_anchors_follow_the_text():
    parts = [b"", b"ab" * 150, H.sentence(3, 90).encode(), b"short", H.sentence(3, 90).encode(), b"x" * 200]
    first, fam, length, k = np.cumsum([0, *map(len, parts)]), Family(5), 100, 20
    h = fam.of_bytes(np.frombuffer(b"".join(parts), np.uint8))
    f = spans((fam, h), (fam, h), first, length, k)
    windows = [(t, i) for t, lo, n in zip(f.text, f.lo, f.n, strict=True) for i in range(lo, lo + n)]
    assert sorted(windows) == [(t, i) for t, x in enumerate(parts) for i in range(len(x) - length + 1)]
    one, other = ([tuple(r) for r in np.stack([f.key.view(np.int64), f.h.view(np.int64), f.lo, f.n, f.at])[:, f.text == t].T.tolist()] for t in (2, 4))
    assert one == other and (f.lo + f.n - 1 <= f.at).all() and (f.at + k <= f.lo + length).all()
    grams, n = fam.grams(h, k) >> np.uint64(32), length - k + 1
    assert [f.at[i] + first[f.text[i]] for i in range(len(f.at))] == [a + int(np.argmin(grams[a : a + n])) for a in (f.lo + first[f.text]).tolist()]


def test_rows_that_share_only_an_id(spark):
    x, y = H.sentence(11, 60), H.sentence(12, 60)
    docs = [(1, x), (5, x), (5, y), (6, H.sentence(13, 50)), (6, H.sentence(13, 50)), (None, x)]
    df = spark.createDataFrame(docs, DOCS)
    found = {(r["doc_id"], r["text"]): r["n_removed"] for r in substring.dedup(df).collect()}
    assert found[5, y] == 0 and found[1, x] == 0 and found[6, docs[3][1]] == 0
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(rows(suffix.dedup(df.where("doc_id IS NOT NULL")), *cols)) == sorted(H.repeated_bytes(docs[:5]))
    assert {r["n_removed"] for r in suffix.dedup(df).where("doc_id IS NULL").collect()} == {0}
