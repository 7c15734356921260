"""Substring dedup: seeds joined on winnowed anchors, extended both ways, maximal repeats removed.

A window is `length` consecutive words of one document. A word goes if a window over it also starts earlier
(smaller doc_id, or the same document at an earlier word).

Seeds are anchors (see anchors.py) whose k-gram occurs again. Around a seed, all windows over it are one
span. Extension goes from large to small: spans equal as a whole repeat with all their windows, so only
their first occurrence is looked at further; where spans over one seed differ, each alignment of the window
around the seed, left to right, is matched by hash. Matched windows that overlap merge into maximal repeats
when the words are removed. Seeds are counted before they are joined, so a passage in a third of all
documents is one counted key, and no group is expanded into pairs.

Defined cases: null and blank texts have no words. A text shorter than the window is kept. Rows with null
doc_id are kept whole and never make another row's words go. Rows are told apart by doc_id and a hash of the
text: rows equal in both are one document, and rows that share only the doc_id are documents of their own, in
order of that hash. Extra columns pass through dedup(); where one has the name of
an output column, the output wins. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.anchors import spans
from stratakv.llm.common import frees_shuffles, written
from stratakv.llm.text import SMALL, Family, ranges, texts, word_spans

LENGTH, GRAM = 20, 4


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row, text of the rows with an id; row is a hash of the text, since an id may repeat with other texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").where("doc_id IS NOT NULL")


def seeds(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """key, h, doc_id, row, lo, n: each span's anchor, hash, document, first window and number of windows; and key alone."""

    def run(batches):
        one, two = Family(21), Family(22)
        for batch, data, off in texts(batches, limit=SMALL):
            s, e, first = word_spans(data, off)
            w = one.span(one.of_bytes(data), s, e)
            found = spans((one, one.prefix(w)), (two, two.prefix(w)), first, length, k)
            doc, row = (np.asarray(batch.column(c))[found.text] if len(found.text) else found.text for c in ("doc_id", "row"))
            cols = [found.key.view(np.int64), found.h.view(np.int64), doc, row, found.lo.astype(np.int32), found.n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "h", "doc_id", "row", "lo", "n"])

    def keys(batches):
        one = Family(21)
        for _, data, off in texts(batches, limit=SMALL):
            s, e, first = word_spans(data, off)
            found = spans((one, one.prefix(one.span(one.of_bytes(data), s, e))), None, first, length, k)
            yield pa.RecordBatch.from_arrays([pa.array(found.key.view(np.int64))], ["key"])

    docs = keyed(docs)
    return docs.mapInArrow(run, "key long, h long, doc_id long, row long, lo int, n int"), docs.select("text").mapInArrow(keys, "key long")


def repeated(seed: DataFrame, keys: DataFrame) -> DataFrame:
    """The spans whose anchor occurs again, from all spans and from their keys alone.

    The frequent keys are written first: a join of two plain shuffles can be split where a key is frequent, which
    one that shares its shuffle with the count cannot.
    """
    again = written(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "again")
    return seed.join(again, "key")


def packed(docs: DataFrame) -> DataFrame:
    """docs with the text compressed as z: what a shuffle of whole texts moves."""
    rest = [c for c in docs.columns if c != "text"]
    fields = docs.select(*rest, F.lit(None).cast("binary").alias("z")).schema

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch, data, off in texts(batches):
            raw = data.tobytes()
            z = pa.array([pack.compress(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), z], [*rest, "z"])

    return docs.select(*rest, "text").mapInArrow(run, fields)


def _windows(spots: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """key, w, doc_id, row, start: every window of the given spans (key, doc_id, row, lo, n) with its hash."""

    def run(batches):
        one, two, unpack = Family(21), Family(22), zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, row, z, spot in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("z"), batch.column("spot"), strict=True):
                data = np.frombuffer(unpack.decompress(z.as_py()), np.uint8)
                s, e, _ = word_spans(data, np.array([0, len(data)]))
                h = two.prefix(one.span(one.of_bytes(data), s, e))
                key, lo, n = (np.asarray(spot.values.field(c)) for c in ("key", "lo", "n"))
                start = ranges(lo.astype(np.int64), n.astype(np.int64))
                fits = start + length < len(h)
                key, start = np.repeat(key, n)[fits], start[fits]
                out.append((key, two.span(h, start, start + length).view(np.int64), np.full(len(key), doc), np.full(len(key), row), start.astype(np.int32)))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "w", "doc_id", "row", "start"])

    by_doc = spots.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "lo", "n")).alias("spot"))
    both = packed(keyed(docs)).join(by_doc, ["doc_id", "row"])
    return both.select("doc_id", "row", "z", "spot").mapInArrow(run, "key long, w long, doc_id long, row long, start int")


@frees_shuffles
def removals(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """doc_id, row, lo, hi: words lo..hi-1 go. Stretches may overlap or repeat."""
    found = written(repeated(*seeds(docs, length, k)), "seeds")
    kinds = found.groupBy("key", "h").agg(F.min(F.struct("doc_id", "row", "lo")).alias("f"), F.count("*").alias("c"), F.min("n").alias("n"))
    kinds = written(kinds, "spans")
    copies = found.join(kinds.where("c > 1").select("key", "h", "f"), ["key", "h"]).where(F.struct("doc_id", "row", "lo") > F.col("f"))
    copies = copies.select("doc_id", "row", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))
    several = written(kinds.groupBy("key").agg(F.count("*").alias("s")).where("s > 1").select("key"), "several")
    spots = kinds.join(several, "key").select("key", "f.doc_id", "f.row", "f.lo", "n")
    wins = written(_windows(spots, docs, length), "windows")
    firsts = written(wins.groupBy("key", "w").agg(F.min(F.struct("doc_id", "row", "start")).alias("f"), F.count("*").alias("c")).where("c > 1"), "firsts")
    later = wins.join(firsts, ["key", "w"]).where(F.struct("doc_id", "row", "start") > F.col("f"))
    return copies.union(later.select("doc_id", "row", F.col("start").alias("lo"), (F.col("start") + length).alias("hi")))


def dedup(docs: DataFrame, length: int = LENGTH, k: int = GRAM, digest: bool = False) -> DataFrame:
    """docs with the words left joined by one space in text, n_words and n_removed.

    Texts that lose nothing stay as they are. With digest, text is replaced by kept_sha256, the SHA-256 of
    the words left, joined by one space.
    """
    gone = removals(docs.select("doc_id", "text"), length, k)
    # A set: rows that repeat another one bring its stretches again.
    by_doc = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_of")).agg(F.collect_set(F.struct("lo", "hi")).alias("_gone"))
    last = "kept_sha256" if digest else "text"
    rest = [f"`{c}`" for c in docs.columns if c.lower() not in ("text", "n_words", "n_removed", "kept_sha256")]
    rows = docs.select(F.struct(*rest).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), "text", F.col("text").isNull().alias("_null"))
    fields = rows.select("_row").schema.add("n_words", "long").add("n_removed", "long").add(last, "string")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            total, lost, out = [], [], []
            for z, gone, null in zip(batch.column("z"), batch.column("_gone"), batch.column("_null").to_pylist(), strict=True):
                raw = unpack.decompress(z.as_py())
                words = raw.split()
                total.append(len(words))
                n = len(words)
                if gone.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    for at, step in (("lo", 1), ("hi", -1)):
                        np.add.at(edge, np.minimum(np.asarray(gone.values.field(at)), n), step)
                    keep = np.cumsum(edge)[:n] == 0
                    words = list(compress(words, keep.tolist()))
                lost.append(n - len(words))
                if digest:
                    out.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    out.append(None if null else (b" ".join(words) if lost[-1] else raw).decode())
            cols = [batch.column("_row"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, fields.names)

    both = packed(rows).join(by_doc, (F.col("_id") == F.col("_doc")) & (F.col("_h") == F.col("_of")), "left")
    return both.select("_row", "z", "_null", "_gone").mapInArrow(run, fields).select("_row.*", "n_words", "n_removed", last)


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s:s + {LENGTH - 1}], ' ') AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(w) - {LENGTH - 2})) AS s) WHERE len(w) >= {LENGTH}
), later AS (
  SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {LENGTH})) AS i FROM later
), one AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w
), left_over AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)
"""
