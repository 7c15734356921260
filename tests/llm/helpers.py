"""Plain-Python counterparts of the training-data operators, and a fixture of awkward rows."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sentence(seed, n, kinds=400):
    """n pseudo-random words."""
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(f"w{(x >> 8) % kinds}")
    return " ".join(out)


def awkward(spark):
    """documents with null and empty texts, a long one, copies, repeated rows, ties, and columns whose names clash."""
    long = sentence(5, 60_000, 5000)
    base = sentence(1, 120)
    texts = [None, "", " \n\t ", "one", base, base, base.replace("w1 ", "W1 "), base + " tail", sentence(2, 200), long, "é ü 漢字 🙂 " * 40, "x y " * 30, sentence(3, 19), "#" * 5000]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "web", "books", ""][i % 4], len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base, None, "web", 1), (None, None, None, None, None), (8, sentence(9, 50), "en", "web", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = "n_words kept copies component_id ids n_tokens round_trip _h _k z size target n_removed h1 license score held_out part key".split()
    return df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in clash])


def components(nodes, linked):
    """The smallest node reachable from each."""
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            of[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text, n):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def near_classes(docs, n, percent=80):
    """docs: {id: text}. n_shingles and component of each."""
    sets = {i: shingle_set(t, n) for i, t in docs.items()}
    ids = sorted(i for i in sets if sets[i])
    linked = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = sets[a], sets[b]
            if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                same = len(p & q)
                if 100 * same >= percent * (len(p) + len(q) - same):
                    linked.append((a, b))
    comp = components(docs, linked)
    return {i: (len(sets[i]), comp[i]) for i in docs}


def repeated_words(docs, length=20):
    """docs: {id: text}. The words that stay."""
    seen, out = {}, {}
    for i in sorted(docs):
        w = words(docs[i])
        for s in range(len(w) - length + 1):
            seen.setdefault(tuple(w[s : s + length]), (i, s))
    for i in docs:
        w, gone = words(docs[i]), set()
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] < (i, s):
                gone.update(range(s, s + length))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def repeated_bytes(docs, length=200):
    """docs: [(id, text)]. Per row: bytes, removed, spans, digest."""
    count = {}
    raws = [(i, (t or "").encode()) for i, t in docs]
    for _, raw in raws:
        for s in range(len(raw) - length + 1):
            count[raw[s : s + length]] = count.get(raw[s : s + length], 0) + 1
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if count[raw[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def mixed(rows, cycle=3, most=3):
    """rows: (id, source, size). Each source's target, copies for each row, and largest row, by resharing until none is above."""
    size = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % cycle + 1 for k, s in enumerate(order)}
    left, open_, target = float(sum(size.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(most * size[s])
            left -= target[s]
        open_ -= over
    return {s: (target[s], target[s] / size[s] if size[s] else 0, max(n for _, x, n in rows if x == s)) for s in order}
