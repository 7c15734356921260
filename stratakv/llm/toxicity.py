"""Toxicity: a logistic model on words, regularised by counterfactual swaps of identity terms.

The model sees which words, and beginnings of longer words, a text has. It is fitted on a bounded sample of
labelled rows (max_rows of each class, chosen by hash): Spark counts their words by class and keeps the max_words
that tell the classes apart best, and only which of these a row has goes to the driver, at most
2 * max_rows * (max_words + terms) numbers of 8 bytes. Each sampled text that names an identity group is
paired with copies in which the term is swapped for the others of its kind, and one in which a word that names no
group stands in its place; the squared changes of the log-odds are penalised. So naming a group, or one
group rather than another, says little by itself, and neutral mentions are not flagged.

Defined cases: null and empty texts score the base rate. Labels that are null or whose document is missing
are not learned from; rows that repeat a label count again. Without labels of both classes every score is
the share of toxic labels (0 without labels). Whole texts are scored; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import discard, written
from stratakv.llm.text import LOWER, Family, mix64, texts, word_spans

#: Sampled labelled rows of each class, and words kept as features.
MAX_ROWS, MAX_WORDS = 3000, 600
#: Least z-score of a word's share difference between the classes.
LEAST_Z = 4.0
#: Bytes of a longer word whose beginning is a feature too: compounds and inflected forms share it.
BEGINNINGS = (5, 8)
#: Strength of the ridge and of the counterfactual penalty.
RIDGE, SWAP = 0.1, 10.0

#: Identity terms by kind, a parameter of fit(); a term is swapped for the others of its row.
IDENTITY = (
    # en
    "muslim christian jewish hindu buddhist sikh atheist catholic protestant mormon",
    "muslims christians jews hindus buddhists sikhs atheists catholics protestants mormons",
    "black white asian latino hispanic arab african european indigenous",
    "gay lesbian straight bisexual transgender queer heterosexual homosexual",
    "women men girls boys",
    "woman man girl boy",
    "immigrant refugee foreigner citizen migrant",
    "immigrants refugees foreigners citizens migrants",
    "american mexican chinese indian russian turkish polish german french spanish",
    "blind deaf disabled autistic",
    "elderly old young teenage",
    # fr
    "musulman chrétien juif hindou bouddhiste athée catholique protestant",
    "musulmans chrétiens juifs hindous bouddhistes athées catholiques protestants",
    "femme homme fille garçon",
    "femmes hommes filles garçons",
    "noir blanc asiatique arabe africain européen",
    "immigré réfugié étranger citoyen migrant",
    "immigrés réfugiés étrangers citoyens migrants",
    "homosexuel hétérosexuel bisexuel transgenre",
    # de
    "muslim christ jude hindu buddhist atheist katholik protestant",
    "muslime christen juden hindus buddhisten atheisten katholiken protestanten",
    "frau mann mädchen junge",
    "frauen männer",
    "schwarze weiße asiatische arabische afrikanische europäische",
    "einwanderer flüchtling ausländer bürger migrant",
    "flüchtlinge ausländer bürger migranten",
    "schwul lesbisch bisexuell heterosexuell",
    # es
    "musulmán cristiano judío hindú budista ateo católico protestante",
    "musulmanes cristianos judíos hindúes budistas ateos católicos protestantes",
    "mujer hombre niña niño",
    "mujeres hombres niñas niños",
    "negro blanco asiático árabe africano europeo",
    "inmigrante refugiado extranjero ciudadano migrante",
    "inmigrantes refugiados extranjeros ciudadanos migrantes",
    "homosexual heterosexual bisexual transgénero",
)

#: Everything but ASCII letters, digits and the bytes of other characters separates words.
EDGES = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])


class Model(NamedTuple):
    bias: float
    word: np.ndarray  # sorted hashes
    weight: np.ndarray


def _tokens(data: np.ndarray, off: np.ndarray, fam: Family) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, and of the beginnings of longer words after these."""
    data = LOWER[data]
    s, e, first = word_spans(data, off, EDGES)
    h, text = fam.of_bytes(data), np.repeat(np.arange(len(off) - 1), np.diff(first))
    out, of = [fam.span(h, s, e)], [text]
    for n in BEGINNINGS:
        longer = e - s > n
        out.append(mix64(fam.span(h, s[longer], s[longer] + n) + np.uint64(n)))
        of.append(text[longer])
    return np.concatenate(out), np.concatenate(of)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, toxic of at most max_rows labelled rows of each class outside the held-out fold."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    few = known.where("toxic = 1").orderBy(*order).limit(max_rows).union(known.where("toxic = 0").orderBy(*order).limit(max_rows))
    # At most 2 * max_rows rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic")


def features(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """toxic, words (distinct hashes) of the sampled rows, written."""

    def run(batches):
        fam = Family(31)
        for batch, data, off in texts(batches):
            h, text = _tokens(data, off, fam)
            order = np.argsort(text, kind="stable")
            h, text = h[order], text[order]
            words = [np.unique(h[a:b]).view(np.int64) for a, b in zip(np.searchsorted(text, range(len(off) - 1)), np.searchsorted(text, range(1, len(off))), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.int64()))], ["toxic", "words"])

    return written(sample(docs, labels, max_rows).mapInArrow(run, "toxic int, words array<long>"), "features")


def telling(rows: DataFrame, n1: int, n0: int, max_words: int) -> np.ndarray:
    """Hashes of the words whose shares in the classes differ most, by z-score: max_words at most."""
    each = rows.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("d1"), F.count("*").alias("d"))
    p = F.col("d") / (n1 + n0)
    z = F.abs(F.col("d1") / n1 - (F.col("d") - F.col("d1")) / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    best = each.select("w", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "w").limit(max_words)
    return np.sort(np.array([r[0] for r in best.select("w").collect()], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, identity: tuple[str, ...] = IDENTITY, swap: float = SWAP) -> Model:
    rows = features(docs, labels, max_rows)
    share = labels.where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0] or 0.0
    n1, n = (x or 0 for x in rows.agg(F.sum("toxic"), F.count("*")).first())
    if not 0 < n1 < n:
        return Model(_logit(share), np.zeros(0, np.uint64), np.zeros(0))
    terms = [[_hashes(t) for t in line.split()] for line in identity]
    # The beginning of a term would stand for the term where a swap does not reach it.
    begun = np.concatenate([t[1:] for line in terms for t in line] or [np.zeros(0, np.uint64)])
    known = np.array(sorted({int(t[0]) for line in terms for t in line}), np.uint64)
    use = np.unique(np.concatenate([np.setdiff1d(telling(rows, n1, n - n1, max_words), begun), known]))
    own = use.view(np.int64)

    def run(batches):
        for batch in batches:
            words = [np.intersect1d(np.asarray(w.values, np.int64), own) for w in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.int64()))], ["toxic", "words"])

    few = rows.mapInArrow(run, "toxic int, words array<long>").toArrow()
    discard(rows)
    words = few.column("words").combine_chunks()
    words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    row = np.repeat(np.arange(len(words)), np.asarray(pa.compute.list_value_length(words)))
    return fit_words(np.asarray(words.flatten(), np.int64).view(np.uint64), row, few.column("toxic").to_numpy().astype(float), use, [[t[0] for t in line] for line in terms], share, swap=swap)


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def fit_words(word: np.ndarray, row: np.ndarray, y: np.ndarray, use: np.ndarray, terms: list[list[int]], share: float, ridge: float = RIDGE, swap: float = SWAP) -> Model:
    """word, row: which text has which of the features use; y: classes; terms: hashes by kind; share: of class 1 among all labels."""
    x = np.zeros((len(y), len(use) + 1))
    x[row, np.searchsorted(use, word)] = 1
    x[:, -1] = 1
    where = {int(h): i for i, h in enumerate(use)}
    pull = np.zeros((x.shape[1], x.shape[1]))
    for line in terms:
        of = [where[int(t)] for t in line]
        named = x[:, of].sum(axis=0)
        for i, a in enumerate(of):
            pull[a, a] += named[i]  # the copy that names no group
            for b in of:
                if a != b and named[i]:  # every text with term a has a copy with b in its place
                    pull[a, a] += named[i] / (len(of) - 1)
                    pull[b, b] += named[i] / (len(of) - 1)
                    pull[a, b] -= named[i] / (len(of) - 1)
                    pull[b, a] -= named[i] / (len(of) - 1)
    fixed = ridge * np.diag(np.r_[np.ones(len(use)), 1e-6]) + swap * pull
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (q - y) + fixed @ w
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + fixed, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    bias = w[-1] + _logit(share) - _logit(y.sum() / len(y))  # the sample is not the mix of the corpus
    return Model(float(bias), use, w[:-1])


def _hashes(word: str) -> np.ndarray:
    """The word's hash and those of its beginnings."""
    data = np.frombuffer(word.lower().encode(), np.uint8)
    return _tokens(data, np.array([0, len(data)]), Family(31))[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches):
        fam = Family(31)
        for batch, data, off in texts(batches):
            h, text = _tokens(data, off, fam)
            total = np.full(len(off) - 1, model.bias)
            if len(model.word) and len(h):
                at = np.minimum(np.searchsorted(model.word, h), len(model.word) - 1)
                hit = model.word[at] == h
                pair = np.unique(text[hit] * len(model.word) + at[hit])  # a word counts once in a text
                total += np.bincount(pair // len(model.word), model.weight[pair % len(model.word)], len(total))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-total)))], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
