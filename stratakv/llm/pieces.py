"""SentencePiece encoding and decoding of whole texts, batched in numpy.

A text is escaped (blanks become U+2581, one is put in front) and cut into units: blanks with the characters
up to the next blank. No piece reaches over such a cut, so units are encoded once each per task and reused.
Units with equally many characters advance together, one column of a matrix at a time.

Viterbi: for every end, the hashes of all substrings that end there probe the sorted piece keys. Each piece found
extends the best path to its start; the maxima are kept with their starts as backpointers.

Unigram models: a path's score is the sum of its pieces' scores.

BPE models, as the public vocabulary at hand is one, define no sum: their scores are ranks of joins, and a text's
pieces are what joining the best neighbours again and again leaves. The same pieces are the only path on which
every two neighbours, joined up from characters by themselves, stay apart. So a step scores 0 if the piece may
follow the piece before it, else minus infinity; whether it may is read off the last joins of the two
(follows()), once for each pair of pieces. Work is in proportion to the length of a unit, whatever its length.

Characters without a piece become byte pieces where the model has them, else the unknown piece.

Defined cases: null and empty texts have no ids. decode(encode(text)) is the text, also with runs of blanks
and with characters outside the vocabulary if the model has byte pieces; only a text that itself holds
U+2581 decodes to blanks there, as the format has it. Repeated rows are encoded one by one.
Extra columns pass through encode(). An empty table gives an empty table.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.text import Family, ranges, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁".encode()
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units that a task remembers before it starts afresh; bits of the table of pairs of neighbours.
REMEMBER, SLOTS = 400_000, 20
#: Characters of a unit that advances alone, and of it looked up at once.
LONG, STRETCH = 64, 1 << 15
SEED = 41


class Vocabulary(NamedTuple):
    kind: int
    pieces: list[bytes]
    scores: np.ndarray
    types: np.ndarray
    prefix: bool  # a blank is put in front
    unknown: int


def _wire(data: bytes):
    """(field, value) of a protocol-buffer message: numbers as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def load(data: bytes) -> Vocabulary:
    """The parts of a serialised model that encoding needs. Normalising models are refused."""
    pieces, scores, types, kind, prefix = [], [], [], UNIGRAM, True
    for field, value in _wire(data):
        if field == 1:
            piece = dict(_wire(value))
            pieces.append(piece.get(1, b""))
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            types.append(piece.get(3, NORMAL))
        elif field == 2:
            kind = dict(_wire(value)).get(3, UNIGRAM)
        elif field == 3:
            rule = dict(_wire(value))
            if rule.get(2) or rule.get(4, 1) or not rule.get(5, 1):
                raise ValueError("only models that keep texts as they are, with escaped blanks, can be used")
            prefix = bool(rule.get(3, 1))
    types = np.array(types)
    return Vocabulary(kind, pieces, np.array(scores), types, prefix, int(np.flatnonzero(types == UNKNOWN)[0]))


class Codec:
    """Tables for one vocabulary, and the units met so far."""

    def __init__(self, v: Vocabulary):
        self.v, self.fam = v, Family(SEED)
        ids = [i for i in range(len(v.pieces)) if v.types[i] in (NORMAL, USER)]
        # Symbols: pieces by id; characters that only occur inside pieces follow.
        self.symbol = {v.pieces[i]: i for i in ids}
        self.longest = max((len(v.pieces[i].decode()) for i in ids), default=1)
        for i in ids:
            inner = v.pieces[i].decode().lstrip("▁")
            if "▁" in inner:
                raise ValueError(f"piece {i} reaches over a blank")
        extra = sorted({c.encode() for i in ids for c in v.pieces[i].decode()} - self.symbol.keys())
        self.symbol |= {c: len(v.pieces) + k for k, c in enumerate(extra)}
        self.width = len(v.pieces) + len(extra) + 1  # the last number stands for any other character
        self.byte = np.full(256, v.unknown)
        for i in np.flatnonzero(v.types == BYTE):
            self.byte[int(v.pieces[i][3:5], 16)] = i
        self.bytes_known = bool((v.types == BYTE).any())
        chars = sorted((self._hash(s), i) for s, i in self.symbol.items() if len(s.decode()) == 1)
        self.char_key, self.char_id = np.array([h for h, _ in chars], np.uint64), np.array([i for _, i in chars])
        self.bpe = v.kind == BPE
        if self.bpe:
            self._pairs(ids)
            ids = self._joins(ids)
        keys = sorted((self._hash(v.pieces[i]), i) for i in ids)
        self.key, self.key_id = np.array([h for h, _ in keys], np.uint64), np.array([i for _, i in keys])
        self.low = float(v.scores[ids].min(initial=0)) - 10.0  # what an unknown character costs
        shown = [self._shown(i) for i in range(len(v.pieces))]
        self.piece_size = np.array([len(p) for p in shown])
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.blob = np.frombuffer(b"".join(shown), np.uint8)
        self._start()

    def _start(self) -> None:
        self.asked, self.answer = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, bool)
        self.forget()

    def tables(self) -> dict:
        """The tables alone, as plain values: made once, sent to every task."""
        own = ("v", "fam", "symbol", "pairs", "asked", "answer", "known", "start", "count", "ids")
        return {k: x for k, x in vars(self).items() if k not in own} | {"v": tuple(self.v)}

    @classmethod
    def of(cls, tables: dict) -> Codec:
        """A codec that knows no unit yet, from another's tables."""
        out = cls.__new__(cls)
        vars(out).update(tables, v=Vocabulary(*tables["v"]), fam=Family(SEED))
        out._start()
        return out

    def _shown(self, i: int) -> bytes:
        if self.v.types[i] == BYTE:
            return bytes([int(self.v.pieces[i][3:5], 16)])
        if self.v.types[i] == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if self.v.types[i] == CONTROL else self.v.pieces[i].replace(BLANK, b" ")

    def _hash(self, s: bytes) -> int:
        h = self.fam.of_bytes(np.frombuffer(s, np.uint8))
        return int(self.fam.span(h, np.array([0]), np.array([len(s)]))[0])

    def _pairs(self, ids: list[int]) -> None:
        """Sorted keys of the neighbours that can be joined, with the joined piece and its place by score."""
        found = {}
        for i in ids:
            text = self.v.pieces[i].decode()
            for cut in range(1, len(text)):
                a, b = self.symbol.get(text[:cut].encode()), self.symbol.get(text[cut:].encode())
                if a is not None and b is not None:
                    found[a * self.width + b] = i
        self.pairs = found
        self.pair = np.array(sorted(found), np.int64)
        self.joined = np.array([found[k] for k in self.pair.tolist()], np.int64)
        order = np.unique(-self.v.scores, return_inverse=True)[1]  # 0: the highest score
        self.place = order[self.joined] if len(self.joined) else self.joined

    def _joins(self, ids: list[int]) -> list[int]:
        """The last join of every symbol: its place by score (-1 for a character), its left and its right part.

        Returns the pieces that joining their own characters makes; no text has another piece.
        """
        self.made = np.full(self.width, -1)
        self.left, self.right = np.zeros(self.width, np.int64), np.zeros(self.width, np.int64)
        place = dict(zip(self.joined.tolist(), self.place.tolist(), strict=True))
        out = []
        for i in ids:
            parts = [self.symbol[c.encode()] for c in self.v.pieces[i].decode()]
            a = b = -1
            while len(parts) > 1:
                found = [(place[j], k, j) for k in range(len(parts) - 1) if (j := self.pairs.get(parts[k] * self.width + parts[k + 1])) is not None]
                if not found:
                    break
                _, k, j = min(found)
                a, b = parts[k], parts[k + 1]
                parts[k : k + 2] = [j]
            if parts == [i]:
                out.append(i)
                if a >= 0:
                    self.made[i], self.left[i], self.right[i] = place[i], a, b
        for i in out:
            if self.made[i] >= 0 and self.made[i] < max(self.made[self.left[i]], self.made[self.right[i]]):
                raise ValueError(f"piece {i} is joined before its parts")
        return out

    def follows(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether symbols u and t, side by side, stay two symbols.

        Their joins are taken back, latest first. Two symbols that meet where u and t do would have been
        joined if that comes before the join just taken back; of equal joins the left one comes first.
        """
        ok, at = np.ones(len(u), bool), np.arange(len(u))
        limit, mine = np.full(len(u), np.iinfo(np.int64).max), np.zeros(len(u), bool)
        while len(at):
            place = self._probe(self.pair, self.place, u * self.width + t, -1)
            bad = (place >= 0) & ((place < limit) | (place == limit) & mine)
            ok[at[bad]] = False
            pu, pt = self.made[u], self.made[t]
            go = ~bad & ((pu >= 0) | (pt >= 0))
            at, u, t, pu, pt = at[go], u[go], t[go], pu[go], pt[go]
            mine = pt >= pu
            limit = np.where(mine, pt, pu)
            u, t = np.where(mine, u, self.right[u]), np.where(mine, self.left[t], t)
        return ok

    def _may(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """follows(), with the last answer kept in each slot of a table."""
        key = u * self.width + t
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out, new = self.answer[slot], np.flatnonzero(self.asked[slot] != key)
        if len(new):
            out[new] = self.follows(u[new], t[new])
            self.asked[slot[new]], self.answer[slot[new]] = key[new], out[new]
        return out

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        raw, cut = self._escape(data, off)
        # A character is a blank where its three bytes are U+2581; a unit begins at a blank after another character.
        blank = np.zeros(len(raw), bool)
        if len(raw) >= 3:
            blank[:-2] = (raw[:-2] == BLANK[0]) & (raw[1:-1] == BLANK[1]) & (raw[2:] == BLANK[2])
        lead = (raw & 0xC0) != 0x80
        first = blank.copy()
        first[3:] &= ~blank[:-3]
        first[cut[:-1][cut[1:] > cut[:-1]]] = True
        a = np.flatnonzero(first)
        b = np.r_[a[1:], len(raw)] if len(a) else a
        if len(a) == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        h = self.fam.of_bytes(raw)
        unit = self.fam.span(h, a, b)
        kind, one, of = np.unique(unit, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self.forget()
        new = ~np.isin(kind, self.known, assume_unique=True)
        if new.any():
            self._learn(raw, lead, h, kind[new], a[one[new]], b[one[new]])
        at = np.searchsorted(self.known, kind)[of]
        n = self.count[at]
        ids = self.ids[ranges(self.start[at], n)]
        total = np.r_[0, np.cumsum(n)]
        return ids, total[np.searchsorted(a, cut)]

    def _escape(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a blank in front (if not empty) and three-byte blanks, and where each begins."""
        space = data == 0x20
        size = np.where(space, 3, 1)
        front = np.where((np.diff(off) > 0) & self.v.prefix, 3, 0)
        shift = np.repeat(np.cumsum(front), np.diff(off))
        at = np.cumsum(size) - size + shift
        total = int(size.sum() + front.sum())
        raw = np.zeros(total, np.uint8)
        raw[at[~space]] = data[~space]
        cut = np.r_[0, np.cumsum(size)][off] + np.r_[0, np.cumsum(front)]
        for k in range(3):
            raw[at[space] + k] = BLANK[k]
            raw[cut[:-1][front > 0] + k] = BLANK[k]
        return raw, cut

    def _learn(self, raw, lead, h, kind, a, b) -> None:
        """Encodes units that are new; kind is sorted."""
        chars = np.r_[0, np.cumsum(lead)]
        length = chars[b] - chars[a]
        begin = np.flatnonzero(lead)
        begin = np.r_[begin, len(raw)]
        start, count, ids, total = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64), [self.ids], len(self.ids)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            block = max(1, (1 << 18) // int(n)) if n <= LONG else 1
            for lo in range(0, len(rows), block):
                some = rows[lo : lo + block]
                edge = begin[chars[a[some]][:, None] + np.arange(n + 1)]  # bytes where characters begin
                edge[:, -1] = b[some]
                sym, at = self._viterbi(h, edge) if n <= LONG else self._alone(h, edge[0])
                plain = (sym < len(self.v.pieces)).all(axis=1)
                for own, of in ((plain, self._as_they_are), (~plain, self._named)):
                    if own.any():
                        found, many = of(raw, edge[own], sym[own], at[own])
                        start[some[own]], count[some[own]] = total + np.cumsum(many) - many, many
                        ids.append(found)
                        total += len(found)
        self.ids = np.concatenate(ids).astype(np.int32)
        known = np.concatenate([self.known, kind])
        order = np.argsort(known)
        self.known, self.start, self.count = known[order], np.concatenate([self.start, start])[order], np.concatenate([self.count, count])[order]

    def _probe(self, keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, none) -> np.ndarray:
        if not len(keys):
            return np.full(wanted.shape, none, values.dtype)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], none)

    def _found(self, h: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
        """For each length from 1 on, the symbol of every substring of so many characters by its start, -1 for none."""
        n = edge.shape[1] - 1
        out = [self._probe(self.char_key, self.char_id, self.fam.span(h, edge[:, :-1].ravel(), edge[:, 1:].ravel()), self.width - 1).reshape(-1, n)]
        for size in range(2, min(self.longest, n) + 1):
            out.append(self._probe(self.key, self.key_id, self.fam.span(h, edge[:, :-size].ravel(), edge[:, size:].ravel()), -1).reshape(-1, n - size + 1))
        return out

    def _cost(self, piece: np.ndarray, size: int) -> np.ndarray:
        """Scores of a unigram model's pieces; characters without a piece have the lowest."""
        known = (piece >= 0) & (piece < len(self.v.pieces))
        return np.where(known, self.v.scores[np.where(known, piece, 0)], self.low if size == 1 else -np.inf)

    def _viterbi(self, h: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each row, padded with -1, and the character each begins with; of equal sums the longer last piece."""
        rows, n = len(edge), edge.shape[1] - 1
        found = self._found(h, edge)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((rows, n + 1), np.int64), np.full((rows, n + 1), self.width - 1)
        for end in range(1, n + 1):
            for size in range(min(len(found), end), 0, -1):
                start = end - size
                step = found[size - 1][:, start]
                if self.bpe:
                    live = np.flatnonzero((step >= 0) & (best[:, end] < 0))
                    if start and len(live):
                        live = live[self._may(piece[live, start], step[live])]
                    best[live, end], back[live, end], piece[live, end] = 0, start, step[live]
                else:
                    score = np.where(step >= 0, self._cost(step, size), -np.inf) + best[:, start]
                    up = score > best[:, end]
                    best[up, end], back[up, end], piece[up, end] = score[up], start, step[up]
        sym, at = np.full((rows, n), -1), np.full((rows, n), n)
        end, k = np.full(rows, n), n
        while (end > 0).any():
            k -= 1
            live = np.flatnonzero(end > 0)
            sym[live, k], at[live, k] = piece[live, end[live]], back[live, end[live]]
            end[live] = back[live, end[live]]
        order = np.argsort(sym < 0, axis=1, kind="stable")
        return np.take_along_axis(sym, order, 1), np.take_along_axis(at, order, 1)

    def _alone(self, h: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_viterbi() of one long unit: a stretch of pieces, and of pairs that meet, is looked up at once; ends advance one by one."""
        n = len(edge) - 1
        best, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [self.width - 1] * (n + 1)
        for lo in range(0, n, STRETCH):
            # Substrings that end in this stretch, and before it those that one of these can follow.
            first, hi = max(0, lo - 2 * self.longest), min(n, lo + STRETCH)
            cols = []
            for size, step in enumerate(self._found(h, edge[None, first : hi + 1]), 1):
                start = np.flatnonzero(step[0] >= 0)
                known = step[0][start]
                cols.append((start + size, np.full(len(start), size), known, np.zeros(len(start)) if self.bpe else self._cost(known, size)))
            end, size, step, cost = (np.concatenate(c) for c in zip(*cols, strict=True))
            order = np.lexsort((-size, end))
            end, size, step, cost = end[order], size[order], step[order], cost[order]
            may = None
            if self.bpe:
                least = np.searchsorted(end, np.arange(hi - first + 2))
                many = (least[1:] - least[:-1])[end - size]
                u = step[ranges(least[end - size], many)].astype(np.int64)
                pair = np.unique(u * self.width + np.repeat(step, many))
                may = set(pair[self.follows(pair // self.width, pair % self.width)].tolist())
            own = np.flatnonzero(end + first > lo)
            for e, k, t, c in zip((end[own] + first).tolist(), size[own].tolist(), step[own].tolist(), cost[own].tolist(), strict=True):
                score = best[e - k] + c
                if score > best[e] and (may is None or e == k or piece[e - k] * self.width + t in may):
                    best[e], back[e], piece[e] = score, e - k, t
        path, at = [], n
        while at:
            path.append((piece[at], back[at]))
            at = back[at]
        sym, at = np.array(path[::-1], np.int64).T
        return sym[None], at[None]

    def _as_they_are(self, raw: np.ndarray, edge: np.ndarray, sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows whose symbols are all pieces, and how many each has."""
        return sym[sym >= 0].astype(np.int32), (sym >= 0).sum(axis=1)

    def _named(self, raw: np.ndarray, edge: np.ndarray, sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of rows with characters without a piece, which become byte pieces or unknown."""
        out, many = [], []
        for r, n in enumerate((sym >= 0).sum(axis=1).tolist()):
            own = []
            for i, c in zip(sym[r, :n].tolist(), at[r].tolist()):
                if i < len(self.v.pieces):
                    own.append(i)
                elif self.bytes_known:
                    own.extend(self.byte[raw[edge[r, c] : edge[r, c + 1]]].tolist())
                elif not own or own[-1] != self.v.unknown:
                    own.append(self.v.unknown)
            out += own
            many.append(len(own))
        return np.array(out, np.int32), np.array(many, np.int64)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each begins."""
        size = self.piece_size[ids]
        data = self.blob[ranges(self.piece_at[ids], size)]
        off = np.r_[0, np.cumsum(size)][first]
        if self.v.prefix:  # the blank that was put in front
            full = off[:-1][(off[1:] > off[:-1])]
            drop = full[data[full] == 0x20]
            keep = np.ones(len(data), bool)
            keep[drop] = False
            off = off - np.r_[0, np.cumsum(~keep)][off]
            data = data[keep]
        return data, off


def _lists(ids: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))


def vocabulary(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as f:
        return load(f.read())


def encode(docs: DataFrame, v: Vocabulary, check: bool = False) -> DataFrame:
    """docs without text, plus ids, n_tokens and, with check, round_trip: whether the ids decode to the text."""
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "round_trip")]
    more = {"ids": F.array(F.lit(0)), "n_tokens": F.lit(0).cast("long")} | ({"round_trip": F.lit(True)} if check else {})
    fields = docs.select(*rest, *(c.alias(k) for k, c in more.items())).schema
    # Tables are made once, not in each task; plain values, which workers read without this package.
    shared = docs.sparkSession.sparkContext.broadcast(Codec(v).tables())

    def run(batches):
        codec = Codec.of(shared.value)
        for batch, data, off in texts(batches):
            ids, first = codec.encode(data, off)
            cols = [*(batch.column(c) for c in rest), _lists(ids, first), pa.array(np.diff(first))]
            if check:
                back, at = codec.decode(ids, first)
                same = np.array_equal(at, off) and np.array_equal(back, data)
                each = [same or np.array_equal(back[at[i] : at[i + 1]], data[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
                cols.append(pa.array(each, pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, fields.names)

    return docs.select(*rest, "text").mapInArrow(run, fields)


def decode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """rows with text instead of ids; null ids give an empty text."""
    rest = [c for c in rows.columns if c not in ("ids", "text")]
    fields = rows.select(*rest, F.lit("").alias("text")).schema
    shared = rows.sparkSession.sparkContext.broadcast(Codec(v).tables())  # as in encode()

    def run(batches):
        codec = Codec.of(shared.value)
        for batch in batches:
            col = batch.column("ids")
            flat = np.asarray(col.flatten(), np.int64)
            first = np.r_[0, np.cumsum([0 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()])].astype(np.int64)
            data, off = codec.decode(flat, first)
            raw = data.tobytes()
            text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(text, pa.string())], fields.names)

    return rows.select(*rest, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, fields)
