import io
import time

import numpy as np
import pytest
import sentencepiece

from stratakv.llm import pieces
from tests.helpers import SMALL, rows
from tests.llm.helpers import sentence


def ids_of(v, texts):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    ids, first = pieces.Codec(v).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


TEXTS = ["", " ", "a", "Hello world", "  two  blanks ", "tab\tand\nline\r\n", "naïve café 漢字 🙂👍🏽 \u0000\u0007", "x" * 300, " " * 50, "1234567890 " * 20, "ÀÉ" * 30, sentence(1, 200), " ﻿ "]


def test_ids_are_those_of_the_public_library():
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert ids_of(pieces.vocabulary(), TEXTS) == [theirs.encode(t) for t in TEXTS]


def test_any_neighbours_and_long_units_as_in_the_library():
    """Pieces side by side, runs of equal letters, and units without blanks, short and long."""
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v, rng = pieces.vocabulary(), np.random.default_rng(4)
    shown = [p.decode().replace("▁", " ") for p in v.pieces[259:]]
    texts = ["".join(shown[i] for i in rng.integers(0, len(shown), 3)) for _ in range(3000)]
    texts += ["".join(rng.choice(list("abcdeé漢 0"), int(n))) for n in rng.integers(1, 90, 500)]
    texts += [c * n for c in (" ", "a", "=", "-=", "the", "漢") for n in (1, 2, 3, 15, 16, 17, 31, 63, 64, 65, 200)]
    texts += ["".join(rng.choice(list("ABCDefgh0123+/"), n)) for n in (63, 64, 65, 5000)]
    assert ids_of(v, texts) == [theirs.encode(t) for t in texts]


def test_a_megabyte_without_a_blank():
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    unit = "".join(np.random.default_rng(5).choice(list("abcdefghijklmnopqrstuvwxyzABCDEF012345+/"), 1 << 20))
    took = []
    for text in (unit[: 1 << 18], unit):
        began = time.process_time()
        assert ids_of(pieces.vocabulary(), [text]) == [theirs.encode(text)]
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 10  # in proportion to the length, which grew four times


def test_documents_encode_as_in_the_library_and_back(spark):
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    v = pieces.vocabulary()
    found = pieces.encode(docs, v, check=True)
    texts = {r[0]: r[1] for r in docs.collect()}
    for r in found.collect():
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert r["ids"] == theirs.encode(texts[r["doc_id"]] or "")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(found, v).collect()} == {k: t or "" for k, t in texts.items()}


def test_null_ids_decode_to_an_empty_text(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(rows(pieces.decode(df, pieces.vocabulary()))) == [(1, ""), (2, "")]


@pytest.fixture(scope="module")
def unigram():
    """A vocabulary stated here, with scores that make segmentations compete."""
    own = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "bca", "é"]
    scores = [-3.0, -2.0, -2.1, -2.3, -3.5, -3.9, -5.7, -4.2, -5.9, -4.05, -5.0, -5.1, -4.0]
    return pieces.Vocabulary(pieces.UNIGRAM, [b"<unk>", *(p.encode() for p in own)], np.array([0.0, *scores]), np.array([2] + [1] * len(own)), True, 0)


def best(v, text):
    """Best sum of scores over all segmentations of a text, by plain dynamic programming."""
    s = ("▁" + text.replace(" ", "▁")) if text else ""
    score = {p.decode(): x for p, x, t in zip(v.pieces, v.scores, v.types, strict=True) if t == pieces.NORMAL}
    low = min(score.values()) - 10
    top = [0.0] + [-1e9] * len(s)
    for e in range(1, len(s) + 1):
        for a in range(e):
            top[e] = max(top[e], top[a] + score.get(s[a:e], low if e - a == 1 else -1e9))
    return top[-1]


def test_viterbi_finds_the_best_sum(unigram):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abc "), int(n))) for n in rng.integers(0, 30, 200)] + ["é", "azb", "zz"]
    low = min(unigram.scores[1:]) - 10
    for text, ids in zip(texts, ids_of(unigram, texts), strict=True):
        if "z" not in text:
            assert sum(unigram.scores[i] if i else low for i in ids) == pytest.approx(best(unigram, text))
            raw = "".join(unigram.pieces[i].decode() for i in ids).replace("▁", " ")
            assert raw == (" " + text if text else "")
    assert ids_of(unigram, ["zz"])[0].count(0) == 1  # neighbouring unknown characters are one piece


def test_a_serialised_model_is_read_whole():
    v = pieces.vocabulary()
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert len(v.pieces) == theirs.get_piece_size() and v.unknown == theirs.unk_id()
    assert io.BytesIO(v.pieces[100]).read().decode() == theirs.id_to_piece(100)


def test_tasks_take_tables_that_were_made_once(monkeypatch):
    v = pieces.vocabulary()
    made = pieces.Codec(v)
    tables = made.tables()
    monkeypatch.setattr(pieces.Codec, "_joins", lambda *_: pytest.fail("made again"))
    raw = "".join([" a unit, ", "naïve \U0001f9ff x", "", "again and again"]).encode()
    data, off = np.frombuffer(raw, np.uint8), np.array([0, 9, len(raw) - 15, len(raw) - 15, len(raw)])
    ids, first = pieces.Codec.of(tables).encode(data, off)
    wanted, at = made.encode(data, off)
    assert np.array_equal(ids, wanted) and np.array_equal(first, at) and len(ids) > 10
    back, cut = pieces.Codec.of(tables).decode(ids, first)
    assert back.tobytes() == raw and np.array_equal(cut, off)
