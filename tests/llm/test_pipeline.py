"""Each stage of the pipeline on its own input against brute force."""

import sentencepiece

import corpus_pipeline
from stratakv.llm import pieces, quality
from tests.helpers import SMALL
from tests.llm import helpers as H


def table(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "substring_dedup", "mix_sources", "encode"]

    kept = stages["quality_rules"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    wanted = {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    assert sorted(r["doc_id"] for r in table(kept)) == sorted(wanted)

    texts = {r["doc_id"]: r["text"] for r in table(kept)}
    unique = stages["near_dedup"](spark, kept, SMALL)
    assert unique.columns == docs.columns
    classes = H.near_classes(texts, 5)
    assert sorted(r["doc_id"] for r in table(unique)) == sorted(i for i, (_, c) in classes.items() if c == i)

    texts = {r["doc_id"]: r["text"] for r in table(unique)}
    cut = stages["substring_dedup"](spark, unique, SMALL)
    assert cut.columns == docs.columns
    left = H.repeated_words(texts)
    for r in table(cut):
        whole = len(left[r["doc_id"]]) == len(H.words(texts[r["doc_id"]]))
        assert r["text"] == (texts[r["doc_id"]] if whole else " ".join(left[r["doc_id"]]))
        assert r["n_chars"] == len(r["text"])

    mixed = stages["mix_sources"](spark, cut, SMALL)
    assert mixed.columns == docs.columns
    assert {tuple(r.values()) for r in table(mixed)} <= {tuple(r.values()) for r in table(cut)}

    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    by_id = {r["doc_id"]: r["text"] for r in table(cut)}
    for r in table(stages["encode"](spark, mixed, SMALL)):
        assert r["round_trip"] and r["ids"] == theirs.encode(by_id[r["doc_id"]])


def test_the_whole_run_against_brute_force(spark):
    """run() from the table to token ids: which rows come out how often, and with which ids."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["doc_id"]: r for r in quality.judge(docs).collect() if r["kept"]}
    classes = H.near_classes({i: r["text"] for i, r in kept.items()}, 5)
    unique = {i: kept[i]["text"] for i, (_, c) in classes.items() if c == i}
    left = H.repeated_words(unique)
    text = {i: t if len(left[i]) == len(H.words(t)) else " ".join(left[i]) for i, t in unique.items()}
    copies = H.mixed([(i, kept[i]["source"], len(H.words(t))) for i, t in text.items()])
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in found} <= set(text)
    for r in found:
        assert r["ids"] == theirs.encode(text[r["doc_id"]]) and r["round_trip"] and r["n_chars"] == len(text[r["doc_id"]])
    # Each source's words come near its target, and copies are whole steps.
    times = {}
    for r in found:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    for source, (target, step, largest) in copies.items():
        own = [i for i in text if kept[i]["source"] == source]
        taken = sum(times.get(i, 0) * len(H.words(text[i])) for i in own)
        assert abs(taken - target) <= 2 * largest + 0.1 * target
        assert all(int(step) <= times.get(i, 0) <= int(step) + 1 for i in own)


def test_rows_that_share_only_an_id_stay(spark):
    x, y = H.sentence(1, 80), H.sentence(2, 80)
    rows = [(1, x, "en", "web", 1), (5, x, "en", "web", 1), (5, y, "en", "web", 1), (7, y + " end", "en", "web", 1), (8, H.sentence(3, 80), "en", "web", 1), (8, H.sentence(4, 80), "en", "web", 1), (None, x, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect())
    assert found == sorted((r[0], r[1]) for r in (rows[0], rows[2], rows[4], rows[5]))


def test_awkward_and_empty_tables(spark):
    docs = H.awkward(spark)
    for some in (docs, docs.limit(0)):
        at = some
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, SMALL)
            if name != "encode":
                assert out.columns == docs.columns, name
                clash = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
                assert all(r[c] == c for r in out.collect() for c in clash), name
                at = out
            else:
                out.collect()
