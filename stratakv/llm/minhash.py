"""Near-duplicate classes of documents: tensored MinHash banding, candidates confirmed on full sets.

A document's set holds its distinct n-word shingles. Two collections of m keys are made from m * half
minhashes each; table (i, j) of m * m tables is keyed by key i of the first and key j of the second, so
m * m tables of 2 * half minhashes cost 2 * m * half minhashes instead of 2 * half * m * m. A pair of
similarity s lacks a common table with probability below 2 * (1 - s ** half) ** m: 5e-5 at s = 0.8.

Only keys that a second document shares are combined, so a document like no other reaches no table.
Documents with equal sets are one representative from the start. Tables' groups never expand into all
pairs: each member is first confirmed against its group's smallest member; links found make components.
Documents that met in a table, directly or not, are a cluster; where a cluster still has several components,
the pairs between them that can be similar enough are found by exact prefix filtering and confirmed.

Defined cases: null and blank texts have an empty set and stay alone; a text with fewer words than n has one
shingle, the whole sequence. A row without id joins the class of an equal set, else its class is null; rows
that repeat an id are one document, linked by any of its texts. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakv.llm.common import frees_shuffles, written
from stratakv.llm.components import components, joined
from stratakv.llm.text import LOWER, SMALL, Family, mix64, texts, word_spans

HALF, KEYS = 4, 20
#: Rounds that link component leaders before the pairs left are searched.
ROUNDS = 2


def _seeded(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, n, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray, n: int, fam: Family) -> list[np.ndarray]:
    """Each text's sorted distinct n-word shingles as 64-bit hashes."""
    data = LOWER[data]
    s, e, first = word_spans(data, off)
    h = fam.prefix(fam.span(fam.of_bytes(data), s, e))
    i = np.arange(max(0, len(s) - n + 1))
    every = fam.span(h, i, i + n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        else:
            out.append(fam.span(h, np.array([a]), np.array([b])) if b > a else every[:0])
    return out


def _keys(sets: list[np.ndarray], half: int, keys: int) -> np.ndarray:
    """2 * keys keys for each non-empty set."""
    x, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    mul, add = _seeded(2 * keys * half, 11), _seeded(2 * keys * half, 12)
    out = np.empty((len(sets), 2 * keys), np.uint64)
    for k in range(2 * keys):
        key = np.full(len(sets), k + 1, np.uint64)
        for j in range(k * half, (k + 1) * half):
            low = np.minimum.reduceat((x * mul[j] + add[j]) >> np.uint64(32), at)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, k] = key
    return out.view(np.int64)


SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, a array<long>, b array<long>"


def signatures(docs: DataFrame, n: int, half: int = HALF, keys: int = KEYS, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, 128-bit hash of the set, and the two key collections."""

    def run(batches):
        fam = Family(7)
        for batch, data, off in texts(batches, limit=SMALL):
            sets = shingles(data, off, n, fam)
            size = np.array([len(x) for x in sets], np.int64)
            full = [x for x in sets if len(x)]
            key = np.zeros((len(sets), 2 * keys), np.int64)
            one = two = np.zeros(len(sets), np.uint64)
            if full:
                key[size > 0] = _keys(full, half, keys)
                x, at = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
                one, two = one.copy(), two.copy()
                one[size > 0] = mix64(np.add.reduceat(mix64(x), at))
                two[size > 0] = mix64(np.add.reduceat(mix64(x ^ np.uint64(0x5851F42D4C957F2D)), at))
            at = pa.array(np.arange(0, (len(sets) + 1) * keys, keys), pa.int32())
            sides = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(k).ravel())) for k in (key[:, :keys], key[:, keys:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *sides], ["doc_id", "n_shingles", "h1", "h2", "a", "b"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, SIGNED)


def _shared(reps: DataFrame, side: str) -> DataFrame:
    """doc_id and those of its keys of one side that another representative has too."""
    rows = reps.select("doc_id", F.explode(side).alias("k"))
    twice = rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    return rows.join(twice, "k").groupBy("doc_id").agg(F.collect_list("k").alias(side))


def groups(reps: DataFrame) -> DataFrame:
    """g, doc_id: the tables' groups of two or more, one for each set of members."""
    both = _shared(reps, "a").join(_shared(reps, "b"), "doc_id")
    rows = both.select("doc_id", F.explode("a").alias("x"), "b").select("doc_id", "x", F.explode("b").alias("y")).select("doc_id", F.xxhash64("x", "y").alias("g"))
    rows = written(rows, "tables")
    member = F.xxhash64("doc_id")
    sizes = rows.groupBy("g").agg(F.count("*").alias("c"), F.bit_xor(member).alias("f"), F.min(member).alias("f2")).where("c > 1")
    kept = sizes.groupBy("c", "f", "f2").agg(F.min("g").alias("g")).select("g")
    return rows.join(kept, "g")


def packed_texts(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """doc_id and its text, compressed, of the documents in ids; packed before they are shuffled."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch, data, off in texts(batches):
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack.compress(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["doc_id", "z"])

    packed = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, z binary")
    return packed.join(ids, "doc_id", "left_semi")


def confirm(pairs: DataFrame, packed: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union of their full sets."""

    def run(batches):
        fam, unpack = Family(7), zstandard.ZstdDecompressor()
        last: dict[int, np.ndarray] = {}

        def of(i: int, z: bytes) -> np.ndarray:
            if i not in last:
                if len(last) > 64:
                    last.clear()
                raw = np.frombuffer(unpack.decompress(z), np.uint8)
                last[i] = shingles(raw, np.array([0, len(raw)]), n, fam)[0]
            return last[i]

        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            keep = []
            for i in range(len(u)):
                x, y = of(u[i], batch.column("zu")[i].as_py()), of(v[i], batch.column("zv")[i].as_py())
                total = len(x) + len(y)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    keep.append(total > 0 and 100 * same >= percent * (total - same))
                else:
                    keep.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    with_u = pairs.join(packed.select(F.col("doc_id").alias("u"), F.col("z").alias("zu")), "u")
    with_v = with_u.join(packed.select(F.col("doc_id").alias("v"), F.col("z").alias("zv")), "v")
    return with_v.select("u", "v", "zu", "zv").mapInArrow(run, "u long, v long")


def _leaders(member: DataFrame) -> DataFrame:
    """Pairs of each component's smallest member with the smallest member of the group, where these differ."""
    first = member.groupBy("g", "component").agg(F.min("doc_id").alias("u"))
    low = first.groupBy("g").agg(F.min("u").alias("v"))
    return first.join(low, "g").where("u > v").select("u", "v")


def _tokens(label: DataFrame, packed: DataFrame, n: int) -> DataFrame:
    """cluster, token, doc_id, component, size: the shingles of the documents in label."""

    def run(batches):
        fam, unpack = Family(7), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(unpack.decompress(batch.column("z")[i].as_py()), np.uint8)
                x = shingles(raw, np.array([0, len(raw)]), n, fam)[0]
                same = [pa.array(np.full(len(x), batch.column(c)[i].as_py(), np.int64)) for c in ("cluster", "doc_id", "component")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(x.view(np.int64)), pa.array(np.full(len(x), len(x)))], ["cluster", "doc_id", "component", "token", "size"])

    rows = packed.join(label, "doc_id").select("cluster", "doc_id", "component", "z")
    return rows.mapInArrow(run, "cluster long, doc_id long, component long, token long, size long")


def _across(label: DataFrame, packed: DataFrame, n: int, percent: int) -> DataFrame:
    """Every pair (u, v) of different components of a cluster that can still be similar enough, by prefix filtering.

    label: doc_id, cluster, component. Documents outside their cluster's largest component probe. To be
    linked with a document of size s, a document of size m must share percent * (m + s) / (100 + percent)
    of its shingles, so one of the rest plus one that are rarest in the cluster must be shared. A document
    that differs from all others has rare shingles there, so few pairs come back; none that is linked is lost.
    """
    size = label.groupBy("cluster", "component").agg(F.count("*").alias("c"))
    main = size.groupBy("cluster").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").select("cluster", "main")
    main = written(main, "main")  # of known size: rows of a large cluster are not dealt out by cluster to meet it
    row = written(_tokens(label.join(main, "cluster").select("doc_id", "cluster", "component"), packed, n), "tokens")
    rare = row.groupBy("cluster", "token").agg(F.count("*").alias("df"))
    probe = row.join(main, "cluster").where("component <> main").join(rare, ["cluster", "token"])
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "token"))
    most = F.floor((100 + percent) * (F.col("size") - F.col("r") + 1) / percent) - F.col("size")
    least = F.ceil(F.col("size") * percent / 100)
    probe = probe.select("*", r.alias("r")).select("cluster", "token", "df", F.col("doc_id").alias("u"), F.col("component").alias("cu"), least.alias("least"), most.alias("most"))
    probe = probe.where("most >= least AND df > 1").drop("df")
    other = row.select("cluster", "token", F.col("doc_id").alias("v"), F.col("component").alias("cv"), F.col("size").alias("s"))
    met = probe.join(other, ["cluster", "token"]).where("cu <> cv AND s BETWEEN least AND most")
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


@frees_shuffles
def classes(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", half: int = HALF, keys: int = KEYS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    signed = written(signatures(docs, n, half, keys, text), "signed")
    equal = signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    equal = written(equal, "equal")
    reps = signed.where("doc_id IS NOT NULL").join(equal.select(F.col("rep").alias("doc_id"), "h1", "h2", "n_shingles"), ["doc_id", "h1", "h2", "n_shingles"], "left_semi")
    group = written(groups(reps), "groups")
    packed = written(packed_texts(docs, group.select("doc_id").distinct(), text), "packed")

    first = group.join(group.groupBy("g").agg(F.min("doc_id").alias("v")), "g").where("doc_id > v").select(F.col("doc_id").alias("u"), "v").distinct()
    done = written(first, "pairs")
    links = written(confirm(done, packed, n, percent), "confirmed")
    cluster = written(components(done).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    comp = components(links)
    for k in range(ROUNDS + 1):
        stars = written(comp, "components")
        own = F.coalesce("component", "doc_id").alias("component")
        label = cluster.join(stars.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "cluster", own)
        todo = _leaders(group.join(label, "doc_id")).distinct() if k < ROUNDS else _across(label, packed, n, percent)
        todo = written(todo.join(done, ["u", "v"], "left_anti"), "pairs")
        if todo.head(1):
            more = written(confirm(todo, packed, n, percent), "confirmed")
            done = done.union(todo)
            comp = joined(stars, more)
    label = comp.select(F.col("id").alias("rep"), "component")
    of = equal.join(label, "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "h1", "h2").join(of, ["h1", "h2", "n_shingles"], "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] ELSE w END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), c AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id, w.doc_id <= coalesce(c.m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = w.doc_id
"""
