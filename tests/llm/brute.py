"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def rule_counts(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def edited(texts):
    """Of texts in the order of their ids."""
    out = []
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        out.append((len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest(), t[: len(t) - k] + after[:k]))
    return out


def xx64(words_):
    """Spark's xxhash64 of several strings."""
    seed = 42
    for w in words_:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed


def simhash3(t):
    w = words(t)
    terms = [xx64(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [xx64([" ".join(w)])] if w else []
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in terms) > len(terms)):016x}"


def simhash4(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def xx(seed, *values):
    """Spark's xxhash64 of numbers of 4 or 8 bytes; (value, bytes), None is left out."""
    for v, n in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest((v % (1 << 8 * n)).to_bytes(n, "little"), seed)
    return seed


def shards(docs, point, n_shards, vnodes, bins, seed=0):
    """docs: (id, text). (id, size, crc32, shard, slot) of each, one row after the other: bins in shuffled order, each row to
    the first shard with room at or after its bin."""
    rows = []
    for i, t in docs:
        raw = (t or "").encode()
        h = xx(42, (seed, 4), (i, 8), (zlib.crc32(raw), 8))
        h -= (h >> 63) << 64
        rows.append((point(f"{seed}:{h % bins}", 1 << 62), h % bins, h, i is not None, i or 0, zlib.crc32(raw), len(raw) + 8, i))
    ring = sorted((point(f"{seed}/{s}/{v}", bins), point(f"{seed}/{s}/{v}/tie", 1 << 62), s) for s in range(n_shards) for v in range(vnodes))
    room = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    used, out = Counter(), []
    for _, b, _, _, _, crc, size, i in sorted(rows, key=lambda r: r[:7]):
        at = next((k for k, p in enumerate(ring) if p[0] >= b), 0)
        while used[ring[at % len(ring)][2]] == room[ring[at % len(ring)][2]]:
            at += 1
        s = ring[at % len(ring)][2]
        out.append((i, size, crc, s, used[s]))
        used[s] += 1
    return out


def profile_grams(t):
    """n-grams of one to three letters with marked ends of words, as strings, and their counts."""
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split(" "):
        if w:
            out.update(w)
            p = "\x01" + w + "\x01"
            out.update(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1))
    return out


def rank_language(t, profiles, length):
    """profiles: name -> n-grams in order. The language of the least out-of-place distance, and its score."""
    n = profile_grams(t)
    if not n or not profiles:
        return "und", 0.0
    usual = {}
    for p in profiles.values():
        for r, g in enumerate(p):
            usual[g] = min(usual.get(g, length), r)
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = sorted(n, key=lambda g: (-n[g], usual.get(g, length), number(g)))[:length]
    best = min((sum(abs(p.index(g) - i) if g in p else length for i, g in enumerate(own)), name) for name, p in ((k, list(v)) for k, v in profiles.items()))
    return best[1], 1 - best[0] / (len(own) * length)


def components(keys, linked):
    """keys: id -> value; linked(a, b) of two values. The least id of each id's component."""
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(keys)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(keys[a], keys[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in ids}


def removed(docs, size=50):
    """docs: id -> text. For each id, the words that stay."""
    first, out = {}, {}
    for i in sorted(docs):
        w = words(docs[i])
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    for i in docs:
        w = words(docs[i])
        gone = {k for j in range(len(w) - size + 1) if first[tuple(w[j : j + size])] < i for k in range(j, j + size)}
        out[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    return out


def mix_weights(sources):
    """1, 2, 3, repeating, in the order of code points, null last."""
    order = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: 1 + i % 3 for i, s in enumerate(order)}


def mix_targets(sizes, weights, repeats=3):
    """Shares of the whole by weight, capped at `repeats` times a source's size."""
    out, free, left = {}, dict(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        full = [s for s in free if left * weights[s] / total > repeats * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / total for s in free}
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
            del free[s]
    return out


def mix_taken(rows, targets, slots, golden=2654435769, repeats=3):
    """rows: (key, source, size, order), the order that of the circles. Words taken and the first slot of each key."""
    total = sum(r[2] for r in rows)
    names = sorted((s for s in targets if s is not None)) + [None] * (None in targets)
    goals = {s: int(targets[s] + 0.5) for s in names}
    n = max(1, min(total, max(slots, -(-total // (1 << 16)))))
    block = max(1, round(total / n))
    n = round(total / block)
    ends, at = [], 0
    for s in names:
        at += goals[s]
        ends.append(int(at / max(sum(goals.values()), 1) * (1 << 32)))
    owned = {s: [] for s in names}
    for i in range(n):
        u = i * golden % (1 << 32)
        hit = [s for s, e in zip(names, ends, strict=True) if u < e]
        if hit:
            owned[hit[0]].append(i)
    taken, first = Counter(), {}
    for k, s in enumerate(names):
        circle = sorted((r for r in rows if r[1] == s and r[2]), key=lambda r: r[3])
        at = 0
        for r in circle * repeats:
            for w in range(at, min(at + r[2], goals[s])):
                b = w // block
                slot = owned[s][b] if b < len(owned[s]) else n + b * len(names) + k
                taken[r[0]] += 1
                first[r[0]] = min(first.get(r[0], slot), slot)
            at += r[2]
    return taken, first
