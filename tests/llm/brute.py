"""Slow, plain versions of the operators' contracts."""

import base64
import collections
import hashlib
import math


def near_duplicates(rows, k, percent):
    """doc_id -> (set size, least doc_id reachable)."""
    sets, parent = {}, {}
    for d, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d in sorted(sets):
        for other, n in collections.Counter(o for s in sets[d] for o in holders[s]).items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[other]) - n):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


LAST = 2**63 - 1


def repeated_bytes(rows, length):
    texts = [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in texts:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, (d, p)), (d, p))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (d, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((None if d == LAST else d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeated_words(rows, length):
    texts = [(LAST if d is None else d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in texts:
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in texts:
        gone = [0] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < d:
                gone[p : p + length] = [1] * length
        out.append((None if d == LAST else d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def warc(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        first = min(same) if same else None
        revisit = first is not None and page != first
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def water_fill(sizes, epochs=3, weights=(1, 2, 3)):
    """source -> target, by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > epochs * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: epochs * sizes[s] for s in over}


def nearest_centroids(texts, model, dim):
    """Per text: the cosine to every centroid, grams counted one by one."""
    out = []
    for text in texts:
        plain = [c | 32 if 65 <= c <= 90 else c for c in text.encode()]
        plain = [32 if c < 97 or 122 < c < 128 else c for c in plain]
        tf = [0.0] * dim
        for k in (1, 2, 3):
            for i in range(len(plain) - k + 1):
                gram = 0
                for c in plain[i : i + k]:
                    gram = (gram * 257 + c) % 2**32
                tf[(gram * 2654435761 % 2**32) >> 20] += 1
        weights = [math.log1p(n) * w for n, w in zip(tf, model.idf.tolist(), strict=True)]
        norm = math.sqrt(sum(x * x for x in weights)) or 1.0
        out.append([sum(a * b for a, b in zip(weights, c, strict=True)) / norm for c in model.centroids.tolist()])
    return out


def bm25_leaks(docs, items, half, k1, b, threshold, overlap, terms, item):
    """(doc, item) -> best score over half-overlapping passages, of pairs whose question and answer words are covered by common trigrams.

    ``terms(text)`` gives words and ``item(text)`` (words, words of the question).
    """
    parsed = {i: item(t) for i, t in items}
    parsed = {i: p for i, p in parsed.items() if p}
    df = collections.Counter(w for words, _ in parsed.values() for w in set(words))
    average = sum(len(words) for words, _ in parsed.values()) / len(parsed)
    half = max([half, *(len(words) for words, _ in parsed.values())])
    impacts = {}
    for i, (words, _) in parsed.items():
        tf = collections.Counter(words)
        raw = {w: math.log(1 + (len(parsed) - df[w] + 0.5) / (df[w] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(words) / average)) for w, n in tf.items()}
        impacts[i] = {w: x / sum(raw.values()) for w, x in raw.items()}
    best = {}
    for d, t in docs:
        words = terms(t)
        for start in range(0, max(1, len(words)), half):
            passage = words[start : start + 2 * half]
            have, grams = set(passage), set(zip(passage, passage[1:], passage[2:], strict=False))
            for i, (own, cut) in parsed.items():
                score = sum(x for w, x in impacts[i].items() if w in have)
                if score < threshold:
                    continue
                covered = [False] * len(own)
                for j in range(len(own) - 2):
                    if tuple(own[j : j + 3]) in grams:
                        covered[j : j + 3] = [True] * 3
                if sum(covered[:cut]) >= overlap * cut and sum(covered[cut:]) >= overlap * (len(own) - cut):
                    best[d, i] = max(best.get((d, i), 0), score)
    return best
