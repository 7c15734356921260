"""A difference-cover suffix sort of many texts at once, dealt out over Spark tasks.

Texts come in chunks: about a megabyte of bytes each, in which some places are starts of windows. Places whose
lowest k base-3 digits are all 1 or 2 are the sample of level k: of a level's places, two of three are sampled.

1. A triple of level k is three names, 3**k bytes apart, of a place in the sample of level k + 1. Triples are
   sorted and named by rank. Triples of bytes, and triples of these, are short enough to be their own names; the
   first that are sorted are of 27 bytes (level 3), then of 81 and 243, which is more than a window.
2. Coming back, the places of level 4 and then 3 that were not sampled are merged with the sampled ones: by first
   name and rank of the rest against those at 1 mod 3, by two names and the rank after them against those at 2.
3. Level 3 is in order now. Any two places meet in its sample after the same number of bytes, 26 at most, so a
   window and its copy always show as two suffixes of the sample whose neighbours in the order share all but
   the bytes before them: neighbours' prefixes are compared, onward and back, byte by byte around their middle.

Every step is one shuffle: each chunk sorts its own distinct keys, deals them out by splitters (243 bytes each,
from a sample of the suffixes), each part merges what it gets, and the names go back to the chunks. A key that
many chunks share is one row of each. Names are the part's number and the place in the part, so parts need
not know each other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import discard, written
from stratakv.llm.text import Family

#: Bytes that the last names cover, least window, and levels whose triples are sorted.
DEPTH, LEVELS = 243, (3, 4, 5)
#: Text bytes of a chunk and of a part; suffixes sampled from a chunk, and chunks sampled.
CHUNK, PART, SAMPLE, SAMPLED = 1 << 20, 1 << 19, 16, 1024
#: Rounds in which level 3 is sorted.
ROUNDS = 5
#: Bytes at most from a window's start to the sample of level 3.
REACH = 26

RESIDUES = {k: np.array([r for r in range(3**k) if all(r // 3**j % 3 for j in range(k))]) for k in (2, 3, 4, 5)}
PLACE = {k: np.searchsorted(r, np.arange(3**k)) for k, r in RESIDUES.items()}


def sample(k: int, upto: int) -> np.ndarray:
    """The places of level k below a multiple of 3**k."""
    return (np.arange(0, upto, 3**k)[:, None] + RESIDUES[k]).ravel()


def nth(k: int, p: np.ndarray) -> np.ndarray:
    """Which of the places of level k each of p is."""
    return p // 3**k * 2**k + PLACE[k][p % 3**k]


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(z: bytes, *kinds) -> list[np.ndarray]:
    """Arrays of equal length, of the given types; (type, n) is a matrix of n columns."""
    raw, out, at = zstandard.decompress(z), [], 0
    shape = [(np.dtype(k[0]), k[1]) if isinstance(k, tuple) else (np.dtype(k), 0) for k in kinds]
    n = len(raw) // max(1, sum(t.itemsize * max(1, w) for t, w in shape))
    for t, w in shape:
        a = np.frombuffer(raw, t, n * max(1, w), at)
        out.append(a.reshape(n, w) if w else a)
        at += a.nbytes
    return out


def bits(x: np.ndarray) -> int:
    return int(x.max()).bit_length() if len(x) else 0


def sorting(key: np.ndarray, kind: str = "stable") -> tuple[np.ndarray, np.ndarray]:
    """The order of numbers of at least 0, and the sorted numbers. Where they fit, places are sorted along as lower bits: numbers sort faster than places."""
    n = len(key).bit_length()
    if bits(key) + n > 63:
        at = np.argsort(key, kind=kind)
        return at, key[at]
    both = key.astype(np.int64) << n | np.arange(len(key))
    both.sort()
    return both & (1 << n) - 1, both >> n


def dense(key: np.ndarray) -> np.ndarray:
    """Ranks of numbers of at least 0: equal ones share one, and none is left out."""
    at, key = sorting(key, "quicksort")
    out = np.empty(len(at), np.int64)
    out[at] = np.cumsum(np.r_[False, key[1:] != key[:-1]][: len(at)])
    return out


def alphabet(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Each byte's rank among those that occur, and the bits that ranks need."""
    rank = np.cumsum(np.bincount(x, minlength=256) > 0) - 1
    return np.maximum(rank, 0).astype(np.uint8), max(1, int(rank[-1]).bit_length())


def one_key(columns: list[np.ndarray]) -> np.ndarray:
    """Numbers in the order of rows of these columns, equal where the rows are equal."""
    columns = [c - c.min() if len(c) else c for c in columns]
    if sum(map(bits, columns)) > 63:
        columns = [dense(c) if bits(c) > len(c).bit_length() else c for c in columns]
    key = columns[0]
    for c in columns[1:]:
        if bits(key) + bits(c) > 63:
            key, c = dense(key), dense(c)
        key = key << bits(c) | c
    return key


def strings(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on, as rows."""
    return np.ndarray(len(x) - n + 1, f"V{n}", x, strides=(1,))[at].view(np.uint8).reshape(len(at), n)


class Chunk:
    """One chunk's bytes and the local names (ranks among its own) of its triples."""

    def __init__(self, data: bytes, c27: np.ndarray | None = None):
        n = len(data)
        self.n, m = n, -(-n // DEPTH) * DEPTH + 6 * DEPTH
        self.raw = data + bytes(m - n)
        self.bytes = x = np.frombuffer(self.raw, np.uint8)
        self.ends = {3: m - 2 * DEPTH, 4: m - 3 * DEPTH, 5: m - 4 * DEPTH}
        if c27 is None:
            rank, width = alphabet(x)
            p, y = sample(2, m - DEPTH), rank.astype(np.int64)[x]
            six = y[p]
            for i in range(1, 6):
                six = six << width | y[p + i]
            nine = dense(six)
            for i in range(6, 9):
                nine = nine << width | y[p + i]
            c9 = dense(nine)
            c27 = self._triple(c9, nth(2, sample(3, self.ends[3])), 4)
        self.codes = {3: c27}

    def deepen(self, step: int = 5) -> Chunk:
        """Adds the local names of level 4 and, from step 5 on, level 5."""
        self.codes[4] = self._triple(self.codes[3], nth(3, sample(4, self.ends[4])), 8)
        if step > 4:
            self.codes[5] = self._triple(self.codes[4], nth(4, sample(5, self.ends[5])), 16)
        return self

    @staticmethod
    def _triple(c: np.ndarray, i: np.ndarray, step: int) -> np.ndarray:
        c = c.astype(np.int64)
        return dense(one_key([c[i], c[i + step], c[i + 2 * step]]))

    def first(self, k: int) -> np.ndarray:
        """A place for each distinct triple of level k, in order of the triples."""
        c, p = self.codes[k], sample(k, self.ends[k])
        out = np.empty(int(c.max()) + 1, np.int64)
        out[c[::-1]] = p[::-1]
        return out

    def cuts(self, at: np.ndarray, splitters: list[bytes], depth: int) -> np.ndarray:
        """Where the parts begin among suffixes at these places, which are in order."""
        key = lambda t: self.raw[at[t] : at[t] + depth]
        every = range(len(at))
        return np.array([0, *(bisect_left(every, s, key=key) for s in splitters), len(at)])

    def rows(self, names: dict[int, np.ndarray], ranks: np.ndarray | None, k: int, p: np.ndarray) -> dict[str, np.ndarray]:
        """What merging compares, of places of level k: t, names s0 and s1, ranks r0, r1, r2 of level k + 1."""
        step, c = 3**k, self.codes[k]
        t = p // step % 3
        name = lambda q: names[k][c[nth(k, q)]]

        def rank(q: np.ndarray, use: np.ndarray) -> np.ndarray:
            out = np.zeros(len(q), np.int64)
            out[use] = ranks[nth(k + 1, q[use])]
            return out

        return {"t": t.astype(np.uint8), "s0": name(p), "s1": name(p + step), "r0": rank(p, t > 0), "r1": rank(p + step, t < 2), "r2": rank(p + 2 * step, t != 1)}


    def order_of(self, p: np.ndarray) -> np.ndarray:
        """The order of suffixes of level 4 at these places: local names, which are in the order of all chunks' names."""
        return order(self.rows({4: np.arange(self.codes[4].max() + 1)}, self.codes[5].astype(np.int64), 4, p))


MERGED = {"t": np.uint8, "s0": np.int64, "s1": np.int64, "r0": np.int64, "r1": np.int64, "r2": np.int64}


def order(t: dict[str, np.ndarray]) -> np.ndarray:
    """The merged order of suffixes.

    Sampled suffixes are in order of their rank. One at 0 mod 3 compares with those at 1 by the first name and
    the rank after it, with those at 2 by two names and the rank after them. Its place is the number of
    suffixes of either kind before it, added up.
    """
    zero, one, two = (np.flatnonzero(t["t"] == k) for k in (0, 1, 2))
    zero = zero[sorting(one_key([t[c][zero] for c in ("s0", "r1", "r2")]))[0]]
    sampled = np.r_[one, two]
    sampled = sampled[sorting(one_key([t["r0"][sampled]]))[0]]

    def before(own: np.ndarray, other: np.ndarray, cols: tuple[str, ...]) -> np.ndarray:
        """How many of other are below each of own."""
        every, n = np.r_[own, other], len(own)
        key = one_key([t[c][every] for c in cols])
        return np.searchsorted(np.sort(key[n:]), key[:n])

    kind = t["t"][sampled]
    place = before(zero, sampled[kind == 1], ("s0", "r1")) + before(zero, sampled[kind == 2], ("s0", "s1", "r2"))
    place = np.maximum.accumulate(place) if len(place) else place
    return np.r_[zero, sampled][sorting(np.r_[2 * place, 2 * np.arange(len(sampled)) + 1])[0]]


def _truncated(splitters: list[bytes], depth: int) -> list[bytes]:
    """Splitters of keys of `depth` bytes; equal ones are one."""
    return sorted({s[:depth] for s in splitters})


def _names_of(back) -> np.ndarray:
    """A chunk's global names, from what each part gave back."""
    return np.concatenate([(np.int64(b["part"]) << 32) + unpack(b["z"], np.uint32)[0] for b in back] or [np.zeros(0, np.int64)])


EMITTED = "part int, chunk long, z binary"


def _exchange(emitted: DataFrame, merge, tag: str) -> DataFrame:
    """chunk, back: what the parts gave back to each chunk. merge: a part's blobs to one array for each."""

    def part(t: pa.Table) -> pa.Table:
        z, chunk = t.column("z").to_pylist(), t.column("chunk")
        return pa.table({"chunk": chunk, "part": t.column("part"), "z": pa.array([pack(x) for x in merge(z)], pa.binary())})

    back = emitted.groupBy("part").applyInArrow(part, "chunk long, part int, z binary")
    return written(back.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "z"))).alias("back")), tag)


def _narrow(name: np.ndarray) -> np.ndarray:
    """Names in the same order in fewer bits: the part's number follows on the largest place in any part."""
    place = name & 2**32 - 1
    return (name >> 32) - (name.min() >> 32 if len(name) else 0) << bits(place) | place


def _shares(n: list[int], rank: np.ndarray) -> list[np.ndarray]:
    return np.split(rank.astype(np.uint32), np.cumsum(n)[:-1])


def _texts_merged(blobs: list[bytes]) -> list[np.ndarray]:
    some = [unpack(z, (np.uint8, 27))[0] for z in blobs]
    n = [len(x) for x in some]
    text = np.concatenate(some)
    # As many bytes at a time as fit beside the rank so far.
    rank, width = alphabet(text.ravel())
    columns = np.ascontiguousarray(rank[text].T)
    key, a = np.zeros(len(text), np.int64), 0
    while a < 27:
        b = min(27, a + (63 - bits(key)) // width)
        for i in range(a, b):
            key = key << width | columns[i]
        key, a = dense(key), b
    return _shares(n, key)


def _triples_merged(blobs: list[bytes]) -> list[np.ndarray]:
    some = [unpack(z, np.int64, np.int64, np.int64) for z in blobs]
    return _shares([len(x[0]) for x in some], dense(one_key([_narrow(np.concatenate(c)) for c in zip(*some, strict=True)])))


def _names_narrow(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {c: x if c not in MERGED or c == "t" else _narrow(x) for c, x in t.items()}


def _suffixes_merged(blobs: list[bytes]) -> list[np.ndarray]:
    some = [unpack(z, *MERGED.values()) for z in blobs]
    at = order(_names_narrow({c: np.concatenate(x) for c, x in zip(MERGED, zip(*some, strict=True), strict=True)}))
    rank = np.empty(len(at), np.int64)
    rank[at] = np.arange(len(at))
    return _shares([len(x[0]) for x in some], rank)


def _distinct_suffixes(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """For each place of level 4, which of the chunk's distinct suffixes it begins; and a place of each."""
    p = sample(4, c.ends[5] - DEPTH)
    four, five, t = c.codes[4].astype(np.int64), c.codes[5].astype(np.int64), p // 81 % 3
    of, firsts, n = np.empty(len(p), np.int64), [], 0
    for kind, parts in ((0, ((4, 0), (5, 81), (5, 162))), (1, ((5, 0), (5, 81))), (2, ((5, 0), (5, 162)))):
        rows = np.flatnonzero(t == kind)
        key = np.zeros(len(rows), np.int64)
        for k, off in parts:
            key = key << 21 | (four if k == 4 else five)[nth(k, p[rows] + off)]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        of[rows] = inverse + n
        firsts.append(p[rows[first]])
        n += len(first)
    return of, np.concatenate(firsts)


def _spread(at: np.ndarray, n: int) -> np.ndarray:
    """The inverse of an order."""
    out = np.empty(n, np.int64)
    out[at] = np.arange(len(at))
    return out


PAYLOAD = {**MERGED, "near": (np.uint8, 2 * REACH), "w": np.uint64, "lo": np.uint8, "hi": np.uint8, "p": np.uint32}


def _agreeing(group: np.ndarray, texts: np.ndarray):
    """A function of d: numbers that are equal for rows of a group whose first d bytes are equal."""
    full = np.zeros((len(texts), -(-texts.shape[1] // 8) * 8), np.uint8)
    full[:, : texts.shape[1]] = texts
    words = full.view(">u8").astype(np.uint64)
    at = np.lexsort((*words.T[::-1], group))
    unlike = texts[at[1:]] != texts[at[:-1]]
    same = np.where(unlike.any(axis=1), unlike.argmax(axis=1), texts.shape[1])
    agree = np.r_[-1, np.where(group[at[1:]] == group[at[:-1]], same, -1)]  # with the row before, in order

    def of(d: int) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        out[at] = np.cumsum(agree < d) - 1
        return out

    return of


def repeated(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (in any order) and the steps back from them at which a window begins that another row has too."""
    at = order(_names_narrow({c: t[c] for c in MERGED}))
    near, w, lo, hi = t["near"][at], t["w"][at], t["lo"][at].astype(np.int64), t["hi"][at].astype(np.int64)
    same = w[1:] == w[:-1]  # neighbours that share the middle of the window
    group = np.cumsum(np.r_[True, ~same]) - 1
    size = np.bincount(group)
    out_row, out_step = [], []

    # Pairs: how far they agree back from the sampled place and onward from the middle.
    a = np.flatnonzero(size[group[:-1]] == 2)
    a = a[group[a] == group[a + 1]]
    unlike = near[a] != near[a + 1]
    back, on = (np.where(x.any(axis=1), x.argmax(axis=1), REACH) for x in (unlike[:, :REACH], unlike[:, REACH:]))
    low, high = np.maximum.reduce([REACH - on, lo[a], lo[a + 1]]), np.minimum.reduce([back, hi[a], hi[a + 1]])
    many = np.maximum(high - low + 1, 0)
    step = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    for r in (a, a + 1):
        out_row.append(np.repeat(r, many))
        out_step.append(step)

    # Larger groups: for each step, rows that agree so far back and so far onward.
    big = np.flatnonzero(size[group] > 2)
    if len(big):
        l, h = lo[big], hi[big]
        before, after = _agreeing(group[big], near[big, :REACH]), _agreeing(group[big], near[big, REACH:])
        for d in range(REACH + 1):
            use = np.flatnonzero((l <= d) & (d <= h))
            if len(use) > 1:
                key = dense(before(d)[use] * len(big) + after(REACH - d)[use])
                hit = use[np.bincount(key)[key] > 1]
                out_row.append(big[hit])
                out_step.append(np.full(len(hit), d))
    row, step = np.concatenate(out_row), np.concatenate(out_step)
    return at[row], step


def repeats(chunks: DataFrame, length: int) -> DataFrame:
    """chunk, starts: places in a chunk at which a window of `length` bytes begins that begins elsewhere too.

    chunks: chunk, z (bytes, compressed), first and many (arrays: where windows start, and how many from there
    on), as written by cut(). A place and its copy may be in one chunk.
    """
    if not 2 * REACH < length <= DEPTH - REACH:
        raise ValueError(f"windows have {2 * REACH + 1} to {DEPTH - REACH} bytes")
    spark = chunks.sparkSession
    total, count = chunks.agg(F.sum("bytes"), F.count("*")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // PART))
    some = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(max(1, -(-(count or 0) // SAMPLED)))) == 0)
    tried = sorted(s for r in some.select("sample").toLocalIterator() for s in r[0])  # at most about SAMPLED * SAMPLE of 243 bytes
    splitters = sorted({bytes(tried[len(tried) * i // parts]) for i in range(1, parts)}) if tried else []
    shared = spark.sparkContext.broadcast(splitters)  # 243 bytes for each part
    core = length - REACH

    def sent(edge: np.ndarray, cols, row, parts: range):
        parts = [i for i in np.flatnonzero(np.diff(edge)).tolist() if i in parts]
        z = [pack(*(x[edge[i] : edge[i + 1]] for x in cols)) for i in parts]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([row["chunk"]] * len(z), pa.int64()), pa.array(z, pa.binary())], ["part", "chunk", "z"])

    def emit(step: int, depth: int):
        def run(batches):
            cut = _truncated(shared.value, depth)
            for batch in batches:
                for row in batch.to_pylist():
                    c = Chunk(zstandard.decompress(row["z"]), unpack(row["codes"], np.int32)[0])
                    if step > 3:
                        c.deepen(step)
                    got = {k: _names_of(row[f"back{k}"]) for k in LEVELS if row.get(f"back{k}") is not None}
                    at, cols = STEPS[step](c, got, row)
                    yield sent(c.cuts(at, cut, depth), cols, row, range(len(cut) + 1))

        return run

    def emit_windows(parts: range):
        def run(batches):
            cut = _truncated(shared.value, core)
            low = cut[parts.start - 1] if parts.start else None
            high = cut[parts.stop - 1] if parts.stop <= len(cut) else None  # none behind the last part
            fam = Family(71)
            for batch in batches:
                for row in batch.to_pylist():
                    c = Chunk(zstandard.decompress(row["z"]), unpack(row["codes"], np.int32)[0])
                    edge, cols = windows_of(fam, c, {3: _names_of(row["back3"])}, row, low, high, cut)
                    yield sent(edge, cols, row, parts)

        return run

    def texts_of(c: Chunk, got, row):
        at = c.first(3)
        return at, [strings(c.bytes, at, 27)]

    def triples_of(k: int):
        def of(c: Chunk, got, row):
            at, step = c.first(k + 1), 3**k
            return at, [got[k][c.codes[k][nth(k, at + i * step)]] for i in range(3)]

        return of

    def suffixes_of(c: Chunk, got, row):
        _, at = _distinct_suffixes(c)
        t, o = c.rows(got, got[5][c.codes[5]], 4, at), c.order_of(at)
        return at[o], [t[x][o] for x in MERGED]

    def ranks_of(batches):
        """The rank of every place of level 4."""
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(zstandard.decompress(row["z"]), unpack(row["codes"], np.int32)[0]).deepen()
                of, at = _distinct_suffixes(c)
                ranks = _names_of(row["back6"])[_spread(c.order_of(at), len(at))][of]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([pack(ranks >> 32, ranks.astype(np.uint32))], pa.binary())], ["chunk", "ranks"])

    def windows_of(fam: Family, c: Chunk, got, row, low: bytes | None, high: bytes | None, cut: list[bytes]):
        """Level 3's places that windows reach, by part, of suffixes from about low to high."""
        part, rank = unpack(row["ranks"], np.int64, np.uint32)
        ranks = (part << 32) + rank
        # Places that a window reaches, and the steps back from them to starts of windows.
        mark, run = np.zeros(c.n + REACH + 2, np.int32), np.full(c.n + REACH + 2, -1, np.int32)
        for a, m in zip(row["first"], row["many"], strict=True):
            run[a : a + m + REACH] = a
            mark[a : a + m + REACH] = a + m - 1
        p = sample(3, -(-c.n // 27) * 27)
        code, head = c.codes[3][: len(p)], c.first(3)
        key = lambda t: c.raw[head[t] : head[t] + 27]
        edges = [bisect_left(range(len(head)), s[:27], key=key) for s in cut]
        least = edges[cut.index(low)] if low else 0
        most = edges[cut.index(high)] + 1 if high else len(head)
        use = np.flatnonzero((code >= least) & (code < most) & (p < c.n))
        use = use[run[p[use]] >= 0]
        use = use[np.argsort(code[use], kind="stable")]
        p, code = p[use], code[use]
        # The part follows from the first name, but for names that splitters begin with.
        of = np.searchsorted(edges, code, "left")
        for i in np.flatnonzero(np.isin(code, edges)).tolist():
            of[i] = bisect_right(cut, c.raw[p[i] : p[i] + core])
        o = np.argsort(of, kind="stable")
        p, of = p[o], of[o]
        t = c.rows({3: got[3]}, ranks, 3, p)
        # The bytes before, backwards, as far as there are any; lo and hi keep steps back within the text.
        back = np.ascontiguousarray(np.r_[np.repeat(c.bytes[:1], REACH), c.bytes][::-1])
        near = np.concatenate([strings(back, len(c.bytes) - p, REACH), strings(c.bytes, p + core, REACH)], axis=1)
        w = fam.span(fam.of_bytes(c.bytes), p, p + core)
        lo, hi = np.maximum(p - mark[p], 0), np.minimum(p - run[p], REACH)
        t |= {"near": near, "w": w, "lo": lo.astype(np.uint8), "hi": hi.astype(np.uint8), "p": p.astype(np.uint32)}
        return np.searchsorted(of, np.arange(len(cut) + 2)), [t[x] for x in PAYLOAD]

    STEPS = {3: texts_of, 4: triples_of(3), 5: triples_of(4), 6: suffixes_of}

    base = chunks.select("chunk", "z", "codes", "first", "many")
    back: dict[int, DataFrame] = {}
    for step, depth, merge in ((3, 27, _texts_merged), (4, 81, _triples_merged), (5, DEPTH, _triples_merged), (6, DEPTH, _suffixes_merged)):
        back[step] = _exchange(_with(base, back, step).mapInArrow(emit(step, depth), EMITTED), merge, f"names{step}")

    def hits(t: pa.Table) -> pa.Table:
        some = [unpack(z, *PAYLOAD.values()) for z in t.column("z").to_pylist()]
        n = [len(x[0]) for x in some]
        row, step = repeated({c: np.concatenate(x) for c, x in zip(PAYLOAD, zip(*some, strict=True), strict=True)})
        p = np.concatenate([x[-1] for x in some]).astype(np.int64)[row] - step
        of = np.searchsorted(np.cumsum(n), row, "right")
        chunk = t.column("chunk").to_pylist()
        o = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[o], np.arange(len(n) + 1))
        found = [(chunk[i], pack(*_intervals(p[o[edge[i] : edge[i + 1]]]))) for i in range(len(n)) if edge[i] < edge[i + 1]]
        return pa.table({"chunk": pa.array([x[0] for x in found], pa.int64()), "z": pa.array([x[1] for x in found], pa.binary())})

    ranks = written(_with(base, back, 7).mapInArrow(ranks_of, "chunk long, ranks binary"), "ranks")
    discard(*(back[k] for k in (4, 5, 6)))
    # Rounds bound what the shuffle holds at once: each sorts the windows of a part of the order, and frees its files.
    rounds, parts = [], len(_truncated(splitters, core)) + 1
    for i in range(ROUNDS):
        if own := range(parts * i // ROUNDS, parts * (i + 1) // ROUNDS):
            rounds.append(written(_with(base, back, 4).join(ranks, "chunk").mapInArrow(emit_windows(own), EMITTED).groupBy("part").applyInArrow(hits, "chunk long, z binary"), "repeats"))
    out = written(reduce(DataFrame.union, rounds).groupBy("chunk").agg(F.collect_list("z").alias("starts")), "starts")
    discard(back[3], ranks, *rounds)
    return out


def _intervals(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First numbers and lengths of the runs of consecutive numbers in p."""
    p = np.sort(p)
    p = p[np.r_[True, p[1:] != p[:-1]][: len(p)]]
    new = np.flatnonzero(np.r_[True, p[1:] != p[:-1] + 1])
    return p[new].astype(np.uint32), np.diff(np.r_[new, len(p)]).astype(np.uint32)


#: What each step needs of the steps before it.
NEEDS = {3: (), 4: (3,), 5: (4,), 6: (4, 5), 7: (6,)}


def _with(base: DataFrame, back: dict[int, DataFrame], step: int) -> DataFrame:
    for k in NEEDS[step]:
        base = base.join(back[k].withColumnRenamed("back", f"back{k}"), "chunk")
    return base


CUT = "z binary, codes binary, bytes long, sample array<binary>, first array<int>, many array<int>, doc_id array<long>, row array<long>, lo array<int>"


def cut(texts: DataFrame, length: int) -> DataFrame:
    """Chunks of the stretches to be sorted, from doc_id, row, z (text, compressed) and spot (windows lo, n).

    Windows of a text that touch make one stretch; a stretch of more than a chunk is cut where its windows are
    still whole. doc_id, row and lo say where the windows of first and many are in the texts.
    """

    def run(batches):
        held: list[tuple] = []
        size = 0
        rng = np.random.default_rng(5)

        def flush():
            data = b"".join(x[3] for x in held)
            at = np.cumsum([0, *(len(x[3]) for x in held)])[:-1]
            c = Chunk(data)
            some = rng.integers(0, max(1, c.n), SAMPLE)
            return pa.RecordBatch.from_pylist([{
                "z": zstandard.compress(data, 3), "codes": pack(c.codes[3].astype(np.int32)), "bytes": c.n, "sample": [c.raw[i : i + DEPTH] for i in some.tolist()],
                "first": at.tolist(), "many": [len(x[3]) - length + 1 for x in held], "doc_id": [x[0] for x in held], "row": [x[1] for x in held], "lo": [x[2] for x in held],
            }], CUTS)

        for batch in batches:
            for doc, row, z, spot in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("z"), batch.column("spot"), strict=True):
                raw = zstandard.decompress(z.as_py())
                lo, n = (np.asarray(spot.values.field(c)).astype(np.int64) for c in ("lo", "n"))
                o = np.lexsort((n, lo))
                lo, end = lo[o], np.maximum.accumulate((lo + n)[o])
                new = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
                for a, b in zip(lo[new].tolist(), end[np.r_[new[1:], len(lo)] - 1].tolist(), strict=True):
                    for s in range(a, b, CHUNK):
                        piece = raw[s : min(b, s + CHUNK) + length - 1]
                        held.append((doc, row, s, piece))
                        size += len(piece)
                        if size >= CHUNK:
                            yield flush()
                            held.clear()
                            size = 0
        if held:
            yield flush()

    CUTS = pa.schema([
        ("z", pa.binary()), ("codes", pa.binary()), ("bytes", pa.int64()), ("sample", pa.list_(pa.binary())), ("first", pa.list_(pa.int32())),
        ("many", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), ("row", pa.list_(pa.int64())), ("lo", pa.list_(pa.int32())),
    ])
    rows = texts.select("doc_id", "row", "z", "spot").mapInArrow(run, CUT)
    return written(rows.select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")
