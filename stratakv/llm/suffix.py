"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere are removed.

Whether a window repeats is decided by a suffix sort alone: a distributed difference-cover sort (sufsort.py)
whose neighbours in the order are compared. What need not be sorted is left out before:

* Anchors (anchors.py) show which windows cannot repeat. Windows over an anchor that occurs once are not sorted.
* Consecutive windows over one anchor are a span. Of spans that are equal as a whole, two are sorted and stand
  for the rest: whatever is true of the windows of one is true of the same windows of all others. So a passage
  that a third of all documents share is sorted twice, not once for each document.

Defined cases: null and empty texts have no bytes. Rows without doc_id are kept whole and repeat nothing.
Rows are told apart by doc_id and a hash of the text; rows equal in both repeat each other, rows that share only
the doc_id are judged each by its own text. Matches never cross documents. Extra columns are ignored. Texts of
any length are used whole. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm import sufsort
from stratakv.llm.anchors import spans
from stratakv.llm.common import discard, frees_shuffles, written
from stratakv.llm.substring import keyed, packed, repeated
from stratakv.llm.text import SMALL, Family, texts

LENGTH, GRAM = 200, 64


def seeds(docs: DataFrame, length: int, k: int) -> tuple[DataFrame, DataFrame]:
    """key, h, doc_id, row, lo, n: each span's anchor, hash, document, first window and number of windows; and key alone."""

    def run(batches):
        one, two = Family(61), Family(62)
        for batch, data, off in texts(batches, limit=SMALL):
            f = spans((one, one.of_bytes(data)), (two, two.of_bytes(data)), off, length, k)
            doc, row = (np.asarray(batch.column(c))[f.text] if len(f.text) else f.text for c in ("doc_id", "row"))
            cols = [f.key.view(np.int64), f.h.view(np.int64), doc, row, f.lo.astype(np.int32), f.n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "h", "doc_id", "row", "lo", "n"])

    def keys(batches):
        one = Family(61)
        for _, data, off in texts(batches, limit=SMALL):
            yield pa.RecordBatch.from_arrays([pa.array(spans((one, one.of_bytes(data)), None, off, length, k).key.view(np.int64))], ["key"])

    docs = keyed(docs)
    return docs.mapInArrow(run, "key long, h long, doc_id long, row long, lo int, n int"), docs.select("text").mapInArrow(keys, "key long")


def _chunks(kinds: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The stretches to be sorted: each kind's first and last span, cut out of their texts."""
    # The first and last are one place where a whole row is repeated: the second copy is then a text of its own.
    last = kinds.where("c > 1").select("g.*", "n", (F.col("f") == F.col("g")).cast("int").alias("copy"))
    spots = kinds.select("f.*", "n", F.lit(0).alias("copy")).unionByName(last)
    by_doc = spots.groupBy("doc_id", "row", "copy").agg(F.collect_list(F.struct("lo", "n")).alias("spot"))
    text = packed(keyed(docs)).join(by_doc, ["doc_id", "row"])
    # Rows that repeat another one are cut once.
    once = text.groupBy("doc_id", "row", "copy").agg(F.any_value("z").alias("z"), F.any_value("spot").alias("spot"))
    return sufsort.cut(once, length)


def _stretches(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, row, lo, hi: windows lo..hi-1 of a text repeat."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, n = (np.concatenate(x).astype(np.int64) for x in zip(*(sufsort.unpack(z, np.uint32, np.uint32) for z in r["starts"]), strict=True))
                o = np.argsort(a, kind="stable")
                a, b = a[o], np.maximum.accumulate((a + n)[o])
                first = np.asarray(r["first"], np.int64)
                of = np.searchsorted(first, a, "right") - 1
                new = np.flatnonzero(np.r_[True, (a[1:] > b[:-1]) | (of[1:] != of[:-1])])
                a, b, of = a[new], b[np.r_[new[1:], len(b)] - 1], of[new]
                lo = np.asarray(r["lo"], np.int64)[of] - first[of]
                cols = [np.asarray(r[c], np.int64)[of] for c in ("doc_id", "row")] + [(a + lo).astype(np.int32), (b + lo).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "row", "lo", "hi"])

    both = chunks.select("chunk", "first", "doc_id", "row", "lo").join(starts, "chunk")
    return both.mapInArrow(run, "doc_id long, row long, lo int, hi int")


def _offsets(kinds: DataFrame, stretches: DataFrame) -> DataFrame:
    """key, h, a, b: of the spans of a kind, windows a..b-1 repeat."""

    def run(batches):
        for batch in batches:
            out = []
            for spot, gone in zip(batch.column("spot"), batch.column("gone"), strict=True):
                key, h, lo, n = (np.asarray(spot.values.field(c)) for c in ("key", "h", "lo", "n"))
                x, y = (np.asarray(gone.values.field(c)).astype(np.int64) for c in ("lo", "hi"))
                o = np.lexsort((y, x))
                x, y = x[o], np.maximum.accumulate(y[o])
                end = lo.astype(np.int64) + n
                # The stretches that meet each span: those that end behind its start and begin before its end.
                i, j = np.searchsorted(y, lo, "right"), np.searchsorted(x, end, "left")
                many = np.maximum(j - i, 0)
                r = np.repeat(np.arange(len(lo)), many)
                s = np.repeat(i - (np.cumsum(many) - many), many) + np.arange(many.sum())
                a, b = np.maximum(x[s], lo[r]), np.minimum(y[s], end[r])
                out.append((key[r], h[r], (a - lo[r]).astype(np.int32), (b - lo[r]).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "h", "a", "b"])

    spots = kinds.groupBy("f.doc_id", "f.row").agg(F.collect_list(F.struct("key", "h", "f.lo", "n")).alias("spot"))
    gone = stretches.groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("gone"))
    return spots.join(gone, ["doc_id", "row"]).select("spot", "gone").mapInArrow(run, "key long, h long, a int, b int")


@frees_shuffles
def removals(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """doc_id, row, lo, hi: bytes lo..hi-1 go. Stretches may overlap or repeat."""
    found = written(repeated(*seeds(docs, length, k)), "seeds")
    at = F.struct("doc_id", "row", "lo")
    kinds = written(found.groupBy("key", "h").agg(F.min(at).alias("f"), F.max(at).alias("g"), F.count("*").alias("c"), F.min("n").alias("n")), "spans")
    chunks = _chunks(kinds, docs, length)
    starts = sufsort.repeats(chunks, length)
    offsets = written(_offsets(kinds, _stretches(chunks, starts)), "offsets")
    discard(chunks, starts, kinds)
    gone = found.join(offsets, ["key", "h"])
    return gone.select("doc_id", "row", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b") + (length - 1)).alias("hi"))


def dedup(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256 for every row."""
    gone = removals(docs.select("doc_id", "text"), length, k)
    by_doc = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_of")).agg(F.collect_set(F.struct("lo", "hi")).alias("_gone"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for z, cut in zip(batch.column("z"), batch.column("_gone"), strict=True):
                raw = unpack.decompress(z.as_py())
                kept, lost, runs = raw, 0, 0
                if cut.is_valid:
                    n = len(raw)
                    edge = np.zeros(n + 1, np.int64)
                    for at, step in (("lo", 1), ("hi", -1)):
                        np.add.at(edge, np.minimum(np.asarray(cut.values.field(at)), n), step)
                    keep = np.cumsum(edge)[:n] == 0
                    kept = np.frombuffer(raw, np.uint8)[keep].tobytes()
                    lost, runs = n - len(kept), int((~keep & np.r_[True, keep[:-1]]).sum())
                for c, x in zip(cols, (len(raw), lost, runs, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    text = packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_row"), "text"))
    both = text.join(by_doc, (F.col("doc_id") == F.col("_doc")) & (F.col("_row") == F.col("_of")), "left").select("doc_id", "z", "_gone")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
